"""Aggregations: matching quality, means that differ in what a missing value is, status counts, budgets, speakers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fabula.functions import text as T
from fabula.functions.values import f1, node_budget, node_budget_wide, ratio, temporal_bucket


def set_prf(gold: DataFrame, predicted: DataFrame, group: list[str], keys: list[str]) -> DataFrame:
    """Precision, recall and F1 of distinct predicted keys against gold ones for each group; denominators are one at least."""
    both = gold.select(*group, *keys).distinct().withColumn("_g", F.lit(1)).unionByName(predicted.select(*group, *keys).distinct().withColumn("_g", F.lit(2)))
    each = both.groupBy(*group, *keys).agg(F.sum("_g").alias("_g"))
    n = each.groupBy(*group).agg(F.count_if(F.col("_g") != 2).alias("n_gold"), F.count_if(F.col("_g") != 1).alias("n_pred"), F.count_if(F.col("_g") == 3).alias("n_match"))
    p, r = ratio(F.col("n_match"), F.col("n_pred")), ratio(F.col("n_match"), F.col("n_gold"))
    return n.select(*group, "n_gold", "n_pred", "n_match", p.alias("precision"), r.alias("recall"), f1(p, r).alias("f1"))


def rollup_means(rows: DataFrame, by: str, metrics: list[str], missing_is_zero: bool) -> DataFrame:
    """Means of metrics over all rows (by is "all") and for each value of `by`; a missing metric is zero or is skipped."""
    value = lambda m: F.coalesce(F.col(m), F.lit(0.0)) if missing_is_zero else F.col(m)
    out = rows.rollup(by).agg(F.grouping(by).alias("_all"), F.count("*").alias("n"), *(F.avg(value(m)).alias(f"mean_{m}") for m in metrics))
    return out.withColumn(by, F.when(F.col("_all") == 1, "all").otherwise(F.col(by).cast("string"))).drop("_all")


def status_counts(rows: DataFrame, group: list[str], status: str, names: list[str]) -> DataFrame:
    return rows.groupBy(*group).agg(F.count("*").alias("total"), *(F.count_if(F.col(status) == s).alias(f"n_{s}") for s in names))


def run_summary(rows: DataFrame, status: str, mode: str, role: str, score: str, finished: list[str]) -> DataFrame:
    """Counts and mean scores (finished rows only) by status, by mode, by role and by role and mode in one pass over the rows."""
    done = ", ".join(f"'{s}'" for s in finished)
    text = f"""
        SELECT CASE WHEN grouping({status}) = 0 THEN 'status' WHEN grouping({role}) = 0 AND grouping({mode}) = 0 THEN 'role_mode' WHEN grouping({mode}) = 0 THEN 'mode' ELSE 'role' END AS level,
               CAST({status} AS STRING) AS status, CAST({mode} AS STRING) AS mode, CAST({role} AS STRING) AS role, count(*) AS n,
               avg(CASE WHEN _status IN ({done}) THEN {score} END) AS mean_score
        FROM (SELECT *, {status} AS _status FROM {{rows}}) GROUP BY GROUPING SETS (({status}), ({mode}), ({role}), ({role}, {mode}))"""
    return rows.sparkSession.sql(text, rows=rows)


def vote_means(rows: DataFrame, group: list[str], votes: list[str]) -> DataFrame:
    """The share of true votes of each kind, and overall as the mean of the shares."""
    share = {v: ratio(F.count_if(F.col(v)), F.count(F.lit(1))) for v in votes}
    out = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), *(s.alias(f"share_{v}") for v, s in share.items()))
    return out.withColumn("overall", sum((F.col(f"share_{v}") for v in votes), F.lit(0.0)) / len(votes))


def speaker_counts(scenes: DataFrame, group: list[str], order: str, title: str, content: str, most: int = 20) -> DataFrame:
    """Speakers of each group: utterances, scenes, the first three scenes' titles; the `most` busiest, ties to the first seen."""
    said = scenes.select(*group, order, title, F.posexplode(F.transform(T.lines(content), T.speaker)).alias("_line", "_said"))
    said = said.where(F.col("_said").isNotNull() & ~F.col("_said").isin(T.NO_SPEAKERS)).withColumn("name", T.speaker_name(F.col("_said")))
    by_scene = said.groupBy(*group, "name", order).agg(F.count("*").alias("_n"), F.min("_line").alias("_line"), F.first(title).alias("_title"))
    firsts = by_scene.withColumn("_k", F.row_number().over(Window.partitionBy(*group, "name").orderBy(order)))
    out = firsts.groupBy(*group, "name").agg(F.sum("_n").alias("utterance_count"), F.count("*").alias("scene_count"), F.min(F.struct(order, "_line")).alias("_first"), F.transform(F.array_sort(F.collect_list(F.when(F.col("_k") <= 3, F.struct("_k", "_title")))), lambda x: x["_title"]).alias("sample_scenes"))
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("utterance_count"), "_first"))
    return out.withColumn("rank", rank).where(F.col("rank") <= most).drop("_first")


def merge_candidates(speakers: DataFrame, present: DataFrame, updates: DataFrame, group: list[str], most: int = 48) -> DataFrame:
    """Speakers, the characters of beats and those of updates as one list by name key; the `most` strongest stay.

    speakers: name, utterance_count, scene_count, pos; present: name, pos; updates: name, importance, durable_change,
    pos. pos is the place in its list; ties go to who is named first, speakers before the rest, in which a beat's
    characters and updates share one order. Returns the first spelling, all spellings in order, the counts and the rank.
    """
    zero = F.lit(0).cast("long")
    columns = ["utterance_count", "scene_count", "presence_count", "update_count", "durable_count", "core_count"]

    def rows(df: DataFrame, where: int, **values) -> DataFrame:
        name = T.strip_speaker_variant("name")
        given = [values.get(c, zero).cast("long").alias(c) for c in columns]
        return df.select(*group, T.name_key(name).alias("key"), name.alias("name"), F.struct(F.lit(where).alias("list"), F.col("pos").cast("long").alias("pos")).alias("at"), *given)

    one = F.lit(1)
    parts = [
        rows(speakers, 0, utterance_count=F.col("utterance_count"), scene_count=F.col("scene_count")),
        rows(present, 1, presence_count=one),
        rows(updates, 1, update_count=one, durable_count=F.when(F.col("durable_change"), 1).otherwise(0), core_count=F.when(F.col("importance") == "core", 1).otherwise(0)),
    ]
    spelt = parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy(*group, "key", "name").agg(F.min("at").alias("at"), *((F.max if c in columns[:2] else F.sum)(c).alias(c) for c in columns))
    names = F.transform(F.array_sort(F.collect_list(F.struct("at", "name"))), lambda x: x["name"])
    out = spelt.groupBy(*group, "key").agg(F.min("at").alias("at"), names.alias("aliases"), *((F.max if c in columns[:2] else F.sum)(c).alias(c) for c in columns))
    order = [F.desc(c) for c in ("durable_count", "core_count", "update_count", "presence_count", "scene_count", "utterance_count")]
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(*order, "at", "key"))
    return out.withColumn("rank", rank).where(F.col("rank") <= most).select(*group, "key", F.col("aliases")[0].alias("name"), F.filter("aliases", lambda x: x != "").alias("aliases"), *columns, "rank")


def budgets(cards: DataFrame, group: list[str], score: str, role: str) -> DataFrame:
    """Both milestone budgets of each role from its cards' scores and kinds of part."""
    s, active = F.col(score), F.count_if(F.col(role).isin("foreground", "active"))
    n = cards.groupBy(*group).agg(F.count("*").alias("n"), F.count_if(s >= 3).alias("medium"), F.count_if(s >= 4).alias("high"), F.count_if(s >= 5).alias("very_high"), active.alias("active"))
    c = F.col
    return n.withColumns({"budget": node_budget(c("n"), c("medium"), c("high"), c("active")), "budget_wide": node_budget_wide(c("n"), c("medium"), c("high"), c("very_high"), c("active"))})


def segments(cards: DataFrame, group: list[str], order: str, scene: str, facets: list[str], score: str) -> DataFrame:
    """Each temporal bucket's cards: how many, their scenes in order, the facet most often filled (the first in `facets` on ties), the two strongest."""
    most = F.max(order).over(Window.partitionBy(*group))
    rows = cards.withColumn("bucket", temporal_bucket(F.col(order), most))
    filled = [F.struct(F.count_if(F.trim(F.coalesce(F.col(f), F.lit(""))) != "").alias("n"), F.lit(-i).alias("i"), F.lit(f).alias("facet")) for i, f in enumerate(facets)]
    best = F.row_number().over(Window.partitionBy(*group, "bucket").orderBy(F.desc(score), order, scene))
    rows = rows.withColumn("_k", best)
    listed = lambda c: F.transform(F.array_sort(F.collect_list(c)), lambda x: x["scene"])
    by_order, strongest = F.struct(F.col(order).alias("o"), F.col(scene).alias("scene")), F.when(F.col("_k") <= 2, F.struct(F.col("_k").alias("o"), F.col(scene).alias("scene")))
    return rows.groupBy(*group, "bucket").agg(F.count("*").alias("scene_count"), listed(by_order).alias("scene_ids"), F.greatest(*filled)["facet"].alias("dominant"), listed(strongest).alias("evidence"))


def numbered(rows: DataFrame, group: list[str], order: list, out: str) -> DataFrame:
    """rows with their place from one within a group."""
    return rows.withColumn(out, F.row_number().over(Window.partitionBy(*group).orderBy(*order)))


def usage_totals(calls: DataFrame, group: list[str], usage: str) -> DataFrame:
    """Tokens that a run's calls say they used (usage: map of counts as text); what is no whole number doesn't count."""
    kinds = ["prompt_tokens", "completion_tokens", "total_tokens"]
    number = lambda k: F.when(F.element_at(usage, k).rlike(r"^-?[0-9]+$"), F.element_at(usage, k).cast("long"))
    return calls.groupBy(*group).agg(*(F.coalesce(F.sum(number(k)), F.lit(0).cast("long")).alias(k) for k in kinds))


def build_totals(nodes: DataFrame, arcs: DataFrame, movie: str, character: str) -> DataFrame:
    """How many roles, nodes and arcs a movie's build has."""
    zero = F.lit(0).cast("long")
    both = nodes.select(movie, F.col(character).alias("_c"), F.lit(1).alias("_n"), F.lit(0).alias("_a")).unionByName(arcs.select(movie, F.lit(None).cast(nodes.schema[character].dataType).alias("_c"), F.lit(0).alias("_n"), F.lit(1).alias("_a")))
    return both.groupBy(movie).agg(F.countDistinct("_c").alias("selected_focal_character_count"), F.coalesce(F.sum("_n"), zero).alias("timeline_node_count"), F.coalesce(F.sum("_a"), zero).alias("arc_count"))


def repair_totals(rows: DataFrame, kinds: list[str]) -> DataFrame:
    """One row over all movies: how many, and the sum of each kind of change."""
    return rows.agg(F.count("*").alias("movies"), *(F.coalesce(F.sum(k), F.lit(0)).cast("long").alias(k) for k in kinds))


def role_stats(samples: DataFrame, language: str, movie: str, character: str) -> DataFrame:
    """Of each language, and of all: movies, roles and samples that were found."""
    role = F.struct(movie, character)
    out = samples.rollup(language).agg(F.grouping(language).alias("_all"), F.countDistinct(movie).alias("movies"), F.countDistinct(role).alias("characters"), F.count("*").alias("samples"))
    return out.withColumn(language, F.when(F.col("_all") == 1, "all").otherwise(F.col(language))).drop("_all")


def run_outputs(reports: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each finished run: its score, its path score (the older field where there is no newer one), hit and recall; unreadable ones are null.

    reports: keys, core_score, path_score, legacy_path_score, hit_at_k, recall_at_k (text as found in result files).
    """
    number = lambda c: F.col(c).try_cast("double")
    return reports.select(*keys, number("core_score").alias("score"), F.coalesce(number("path_score"), number("legacy_path_score")).alias("path_score"), number("hit_at_k").alias("hit_at_k"), number("recall_at_k").alias("recall_at_k"))


def retrieval_summary(turns: DataFrame, group: list[str], selected: str, sources: str, size: Column) -> DataFrame:
    """Means over turns; hit and recall only over turns that have sources."""
    known = F.size(sources) > 0
    met = F.size(F.array_intersect(selected, sources))
    return turns.groupBy(*group).agg(
        F.count("*").alias("n_turns"), F.avg(F.size(selected)).alias("mean_selected"), F.avg(size).alias("mean_tokens"), F.count_if(known).alias("n_with_sources"),
        F.avg(F.when(known, (met > 0).cast("double"))).alias("hit_at_k"), F.avg(F.when(known, met / F.size(F.array_distinct(sources)))).alias("recall_at_k"),
    )


def support_at_k(selected: Column, sources: Column) -> tuple[Column, Column]:
    """(hit, recall): hit is 0 and recall null without sources."""
    met = F.size(F.array_intersect(selected, sources))
    distinct = F.size(F.array_distinct(sources))
    return F.when(met > 0, 1.0).otherwise(0.0), F.when(distinct > 0, met / distinct)
