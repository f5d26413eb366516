"""Evaluation of predicted against gold timelines and of dialogue runs, from judged rows to one row a movie and a batch."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fabula.functions import payload as P
from fabula.functions import text as T
from fabula.functions.values import dot, f1, ratio, score_clamp
from fabula.operators import folds, matching, sequence, summaries
from fabula.plans import prompts
from fabula.plans.providers import Offline, Provider, complete_column, embed_column, judge_column

PARTS = ["scene_f1", "node_f1", "development", "state", "arc_links", "arc_focus"]


def match_roles(predicted: DataFrame, gold: DataFrame) -> DataFrame:
    """movie_id, predicted character, gold character. predicted: movie_id, character, pos; gold also aliases."""
    keys = F.array_distinct(F.transform(F.concat(F.array("character"), F.coalesce("aliases", F.array().cast("array<string>"))), lambda a: T.name_key(a)))
    g = gold.select("movie_id", F.col("character").alias("gold_character"), F.col("pos").alias("gold_pos"), keys.alias("keys"))
    p = predicted.select("movie_id", "character", "pos", T.name_key("character").alias("key"))
    return matching.match_entities(p, g, ["movie_id"], "key", "pos", "keys", "gold_character", "gold_pos").select("movie_id", "character", "gold_character")


def match_nodes(predicted: DataFrame, gold: DataFrame, least: float = 0.35) -> DataFrame:
    """Pairs of nodes of the same role and scene by cosine. Both: movie_id, character, scene_id, place, vector (normalised)."""
    g = gold.select("movie_id", "character", "scene_id", F.col("place").alias("gi"), F.col("vector").alias("a"))
    p = predicted.select("movie_id", "character", "scene_id", F.col("place").alias("pi"), F.col("vector").alias("b"))
    scores = g.join(p, ["movie_id", "character", "scene_id"]).select("movie_id", "character", "scene_id", "gi", "pi", dot(F.col("a"), F.col("b")).alias("score"))
    return matching.greedy_pairs(scores, ["movie_id", "character", "scene_id"], least)


def node_quality(predicted: DataFrame, gold: DataFrame, pairs: DataFrame) -> DataFrame:
    """Precision, recall and F1 of nodes and of scenes for each movie."""
    n = lambda df, name: df.groupBy("movie_id").agg(F.count("*").alias(name))
    rows = n(gold, "n_gold").join(n(predicted, "n_pred"), "movie_id", "full").join(n(pairs, "n_match"), "movie_id", "left").fillna(0, ["n_gold", "n_pred", "n_match"])
    p, r = ratio(F.col("n_match"), F.col("n_pred")), ratio(F.col("n_match"), F.col("n_gold"))
    scenes = summaries.set_prf(gold, predicted, ["movie_id"], ["character", "scene_id"]).select("movie_id", F.col("f1").alias("scene_f1"))
    return rows.select("movie_id", p.alias("node_precision"), r.alias("node_recall"), f1(p, r).alias("node_f1")).join(scenes, "movie_id", "left")


def node_text(prefix: str = "") -> Column:
    """What a node is compared by: its development, goal, result and open issue, those that are there, a line each."""
    return T.joined(*(T.clean_text(f"{prefix}{f}") for f in ("salient_development", "goal_state", "resulting_state", "unresolved_issue")))


def arc_text(arc: Column) -> Column:
    return T.joined(*(T.clean_text(arc[f]) for f in ("title", "arc_focus", "arc_summary", "start_state", "end_state", "unresolved_issue")))


def timeline_text(name: Column, summary: Column, nodes: Column) -> Column:
    """A timeline as the fact judge reads it: the role, the summary and a line for each node. nodes: array of structs in order."""
    always = [("scene_id", "scene_id"), ("scene_order", "scene_order"), ("scene_title", "scene_title"), ("role", "role_in_context"), ("development", "salient_development")]
    maybe = [("goal", "goal_state"), ("result", "resulting_state"), ("pressure", "unresolved_issue")]
    text = lambda n, f: T.clean_text(n[f].cast("string"))

    def line(n: Column, i: Column) -> Column:
        parts = [F.concat(F.lit(f"{k}="), text(n, f)) for k, f in always] + [F.when(text(n, f) != "", F.concat(F.lit(f"{k}="), text(n, f))) for k, f in maybe]
        return F.concat(F.lit("["), i + 1, F.lit("] "), F.concat_ws(" | ", *parts))

    head = F.array(F.concat(F.lit("Character: "), T.clean_text(name)), F.concat(F.lit("Timeline summary: "), T.clean_text(summary)))
    return F.array_join(F.concat(head, F.transform(nodes, line)), "\n")


NODE = ["timeline_node_id", "scene_id", "scene_order", "scene_title", "role_in_context", "salient_development", "goal_state", "resulting_state", "unresolved_issue"]


def facts(timelines: DataFrame, provider: Callable[[], Provider] = Offline, most: int = 8) -> DataFrame:
    """timelines (movie_id, character, language, timeline) with facts: at most `most` checkable ones that the model finds."""
    asked = timelines.withColumn("messages", prompts.timeline_facts(F.col("language"), F.col("character"), F.col("timeline"), most))
    return complete_column(asked, "messages", "answer", provider, as_json=True).withColumn("facts", P.facts(F.coalesce("answer", F.lit("{}")), most)).drop("messages", "answer")


def supported(rows: DataFrame, provider: Callable[[], Provider] = Offline) -> DataFrame:
    """rows (character, language, facts, reference) with supported: ids of the facts that the reference timeline bears out; none are asked for where there are no facts."""
    asked = rows.withColumn("messages", F.when(F.size("facts") > 0, prompts.facts_supported(F.col("language"), F.col("character"), F.col("facts"), F.col("reference"))))
    return complete_column(asked, "messages", "answer", provider, as_json=True).withColumn("supported", P.supported_ids(F.coalesce("answer", F.lit("{}")), F.col("facts"))).drop("messages", "answer")


def fact_quality(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """Recall of gold facts, precision of predicted ones and their F1, for each movie. Both: movie_id, facts, supported."""
    n = lambda df, side: df.groupBy("movie_id").agg(F.sum(F.size("facts")).alias(f"{side}_facts"), F.sum(F.size("supported")).alias(f"{side}_supported"))
    both = n(gold, "gold").join(n(predicted, "pred"), "movie_id", "full").fillna(0)
    recall, precision = ratio(F.col("gold_supported"), F.col("gold_facts")), ratio(F.col("pred_supported"), F.col("pred_facts"))
    return both.select("*", recall.alias("gold_fact_recall"), precision.alias("pred_fact_precision"), f1(precision, recall).alias("fact_f1"))


def transitions(nodes: DataFrame) -> DataFrame:
    """Pairs of neighbouring nodes of each role, and whether they are among the few that matter. nodes: movie_id, character, NODE, beat_index, importance, evidence_quotes."""
    rows = nodes.withColumns({"node_id": F.col("timeline_node_id"), "n_quotes": F.size(F.coalesce("evidence_quotes", F.array().cast("array<string>")))})
    pairs = sequence.transition_pairs(rows, ["movie_id", "character"])
    order = ["prev_order", "prev_id"]
    marked = pairs.withColumn("important", F.lit(False))

    def fold(part: list[dict]) -> list[dict]:
        chosen = set(folds.important_pairs(part))
        return [{**r, "important": i in chosen} for i, r in enumerate(part)]

    return folds.per_role(marked, ["movie_id", "character"], fold, order)


def _shares(rows: DataFrame, vote: str, name: str) -> DataFrame:
    return rows.groupBy("movie_id").agg(F.avg(F.col(vote).cast("double")).alias(name))


def evaluate(gold: dict[str, DataFrame], predicted: dict[str, DataFrame], scenes: DataFrame, provider: Callable[[], Provider] = Offline) -> dict[str, DataFrame]:
    """All metrics of all movies in one plan, and the rows behind them.

    gold and predicted hold roles (movie_id, language, character, aliases, pos, timeline_summary), nodes (movie_id,
    character, NODE, beat_index, importance, evidence_quotes, pos) and arcs (movie_id, character, arc_id, pos, title,
    arc_focus, linked_timeline_node_ids, arc_summary, start_state, end_state, unresolved_issue). scenes: movie_id,
    scene_id, content. Nothing is matched twice: a gold role belongs to the first predicted one that goes by its name.
    """
    ask = judge_column(provider)
    who = match_roles(predicted["roles"], gold["roles"])
    language = gold["roles"].select("movie_id", "language").distinct()
    p_nodes = predicted["nodes"].join(who, ["movie_id", "character"]).withColumnRenamed("character", "pred_character").withColumnRenamed("gold_character", "character")
    g_nodes = gold["nodes"].join(who.select("movie_id", F.col("gold_character").alias("character")), ["movie_id", "character"], "left_semi")

    def placed(df: DataFrame) -> DataFrame:
        return embed_column(df.withColumns({"place": F.col("pos"), "text": node_text()}), "text", "vector", provider)

    pairs = match_nodes(placed(p_nodes), placed(g_nodes))
    one = lambda df, place: df.select("movie_id", "character", "scene_id", F.col("pos").alias(place), F.struct(*NODE).alias(f"{place}_node"))
    matched = pairs.join(one(g_nodes, "gi"), ["movie_id", "character", "scene_id", "gi"]).join(one(p_nodes, "pi"), ["movie_id", "character", "scene_id", "pi"])
    name = F.col("character")
    votes = matched.withColumns({"development": ask(prompts.same_development(name, F.col("gi_node"), F.col("pi_node"))), "state": ask(prompts.same_state(name, F.col("gi_node"), F.col("pi_node")))})

    steps = transitions(predicted["nodes"]).join(who, ["movie_id", "character"], "left").withColumn("named", F.coalesce("gold_character", "character")).join(language, "movie_id", "left")
    at = lambda side: predicted["nodes"].select("movie_id", "character", F.col("timeline_node_id").alias(f"{side}_id"), F.struct(*NODE).alias(f"{side}_node"))
    text = lambda side: scenes.select("movie_id", F.col("scene_id").alias(f"{side}_scene"), F.col("content").alias(f"{side}_text"))
    for side in ("prev", "next"):
        steps = steps.join(at(side), ["movie_id", "character", f"{side}_id"]).withColumn(f"{side}_scene", F.col(f"{side}_node.scene_id")).join(text(side), ["movie_id", f"{side}_scene"], "left")
    steps = steps.withColumn("coherent", ask(prompts.coherent(F.col("language"), F.col("named"), F.col("prev_node"), F.col("next_node"), F.col("prev_text"), F.col("next_text"))))

    def told(df: DataFrame, roles: DataFrame) -> DataFrame:
        listed = df.groupBy("movie_id", "character").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.struct(*NODE).alias("n")))), lambda x: x["n"]).alias("nodes"))
        rows = roles.join(listed, ["movie_id", "character"], "left")
        return rows.select("movie_id", "character", timeline_text(name, F.col("timeline_summary"), F.coalesce("nodes", F.array().cast(rows.schema["nodes"].dataType))).alias("timeline"))

    p_roles = predicted["roles"].drop("language").join(who, ["movie_id", "character"]).drop("character").withColumnRenamed("gold_character", "character")
    g_told, p_told = told(g_nodes, gold["roles"].join(p_roles.select("movie_id", "character"), ["movie_id", "character"], "left_semi")), told(p_nodes, p_roles)
    sides = g_told.withColumnRenamed("timeline", "g").join(p_told.withColumnRenamed("timeline", "p"), ["movie_id", "character"]).join(language, "movie_id")
    check = lambda own, other: supported(facts(sides.select("movie_id", "character", "language", F.col(own).alias("timeline"), F.col(other).alias("reference")), provider), provider)
    g_facts, p_facts = check("g", "p"), check("p", "g")

    def linked(arcs: DataFrame, nodes: DataFrame) -> DataFrame:
        known = nodes.select("movie_id", "character", F.col("timeline_node_id").alias("node"), "scene_id")
        places = arcs.select("movie_id", "character", "arc_id", F.posexplode_outer("linked_timeline_node_ids").alias("at", "node")).join(known, ["movie_id", "character", "node"])
        listed = places.groupBy("movie_id", "character", "arc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "scene_id"))), lambda x: x["scene_id"]).alias("scenes"))
        out = arcs.join(listed, ["movie_id", "character", "arc_id"], "left").withColumn("scenes", F.coalesce("scenes", F.array().cast("array<string>")))
        return embed_column(out.withColumn("text", arc_text(F.struct(*[c for c in arcs.columns if c not in ("movie_id", "character")]))), "text", "vector", provider).withColumn("role", F.concat_ws("|", "movie_id", "character"))

    p_arcs = predicted["arcs"].drop("language").join(who, ["movie_id", "character"]).drop("character").withColumnRenamed("gold_character", "character")
    g_arcs = linked(gold["arcs"].drop("language").join(p_roles.select("movie_id", "character"), ["movie_id", "character"], "left_semi"), g_nodes)
    p_arcs = linked(p_arcs, p_nodes)
    best = matching.best_arc_match(g_arcs, p_arcs, "role")
    shown = ["title", "arc_focus", "arc_summary", "start_state", "end_state", "unresolved_issue", "scenes"]
    told_arcs = g_arcs.join(best, ["role", "arc_id"], "left").join(p_arcs.select("role", F.col("arc_id").alias("predicted_id"), F.struct(*shown).alias("p_arc")), ["role", "predicted_id"], "left").join(language, "movie_id")
    there = F.col("p_arc").isNotNull()
    arc_votes = told_arcs.withColumns({f: F.when(there, ask(make(F.col("language"), name, F.struct(*shown), F.col("p_arc")))).otherwise(False) for f, make in (("aspect", prompts.arc_focus), ("progression", prompts.arc_progress))})

    scenes_quality = summaries.set_prf(g_nodes, p_nodes, ["movie_id"], ["character", "scene_id"]).select("movie_id", F.col("precision").alias("scene_precision"), F.col("recall").alias("scene_recall"))
    out = predicted["roles"].select("movie_id").distinct().join(node_quality(p_nodes, g_nodes, pairs), "movie_id", "left").join(scenes_quality, "movie_id", "left")
    out = out.join(fact_quality(g_facts, p_facts).select("movie_id", "gold_fact_recall", "pred_fact_precision", "fact_f1"), "movie_id", "left")
    shares = [(votes, "development", "development"), (votes, "state", "state"), (steps, "coherent", "coherence"), (steps.where("important"), "coherent", "important_coherence"), (arc_votes, "aspect", "arc_aspect"), (arc_votes, "progression", "arc_progression")]
    for rows, vote, metric in shares:
        out = out.join(_shares(rows, vote, metric), "movie_id", "left")
    out = out.select("movie_id", *(F.round(F.coalesce(c, F.lit(0.0)), 4).alias(c) for c in out.columns if c != "movie_id"))
    parts = ["scene_f1", "node_f1", "development", "state", "arc_aspect", "arc_progression"]
    summary = overall(out, parts).withColumn("overall", F.round("overall", 4))
    return {"summary": summary, "matched": votes, "transitions": steps, "gold_facts": g_facts, "pred_facts": p_facts, "arcs": arc_votes}


def overall(rows: DataFrame, parts: list[str] = PARTS, round_first: bool = True) -> DataFrame:
    """The mean of the parts, which are rounded to four places before (or not)."""
    value = (lambda c: F.round(F.col(c), 4)) if round_first else F.col
    return rows.withColumn("overall", reduce(lambda a, b: a + b, map(value, parts)) / len(parts))


def batch(rows: DataFrame, metrics: list[str]) -> DataFrame:
    """Means over finished movies, overall and by language; a missing metric counts as zero."""
    done = rows.where(F.col("status").isin("ok", "ok_timeout", "skipped"))
    return summaries.rollup_means(done, "language", metrics, missing_is_zero=True)


def judged(rows: DataFrame, group: list[str], metric: str = "metric", score: str = "score") -> DataFrame:
    """The mean of clamped scores over the metrics of a turn or an episode."""
    return rows.groupBy(*group).agg(F.round(F.avg(score_clamp(F.col(score).cast("string"))), 4).alias("core_score"), F.countDistinct(metric).alias("n_metrics"))


def path_score(rows: DataFrame, group: list[str], turn: str = "turn_index", score: str = "score") -> DataFrame:
    """The mean of a path's readable turns; a model's own average isn't used."""
    kept = rows.where(F.col(turn).try_cast("int").isNotNull())
    return rows.select(*group).distinct().join(kept.groupBy(*group).agg(F.avg(score_clamp(F.col(score).cast("string"))).alias("path_score")), group, "left").fillna(0.0, ["path_score"])


def rejudge(reports: DataFrame, new: DataFrame, keys: list[str], metric: str) -> DataFrame:
    """Reports (one row a metric) with one metric's score replaced, the old one kept beside it."""
    fresh = new.select(*keys, F.col("score").alias("new_score"))
    both = reports.join(fresh, keys, "left")
    swap = (F.col("metric") == metric) & F.col("new_score").isNotNull()
    return both.withColumn("old_score", F.when(swap, F.col("score"))).withColumn("score", F.when(swap, F.col("new_score")).otherwise(F.col("score"))).drop("new_score")
