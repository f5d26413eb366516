"""Mending finished timelines: quotes that the scene bears out, missing goals, summaries, and arcs for roles that have none."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fabula.functions import payload as P
from fabula.functions import text as T
from fabula.operators import summaries
from fabula.plans import prompts
from fabula.plans.providers import Offline, Provider, complete_column

ROLE = ["movie_id", "character"]
FIELDS = ["role_in_context", "salient_development", "goal_state", "resulting_state", "unresolved_issue"]


def _none(kind: str) -> Column:
    return F.array().cast(kind)


def alias_quotes(title: Column, content: Column, aliases: Column, most: int = 3) -> Column:
    """The aliases, collapsed, that stand in the title or the content, distinct and in order, at most `most`."""
    names = F.array_distinct(F.filter(F.transform(aliases, T.clean_text), lambda a: a != ""))
    return F.slice(F.filter(names, lambda a: F.contains(title, a) | F.contains(content, a)), 1, most)


def evidence_quotes(title: Column, content: Column, language: Column, aliases: Column, fields: list[Column], most: int = 3) -> Column:
    """The scene's lines that bear a node out: a point for each keyword of the node, four for an alias, one less for a speaker's line.

    The best `most`, the earlier of equal ones; aliases in the scene where no line has a point.
    """
    words = F.array_distinct(F.flatten(F.array(*(T.keyword_set(f, language) for f in fields))))
    names = F.filter(F.transform(aliases, lambda a: F.lower(T.clean_text(a))), lambda a: a != "")

    def scored(line: Column, i: Column) -> Column:
        low = F.lower(T.clean_text(line))
        points = F.size(F.array_intersect(words, T.keyword_set(line, language))) + F.when(F.exists(names, lambda a: F.contains(low, a)), 4).otherwise(0) - F.when(line.rlike(T.SPEAKER_LINE), 1).otherwise(0)
        return F.struct((-points).alias("points"), i.alias("i"), line.alias("line"))

    lines = F.filter(F.transform(T.quote_candidates(content), scored), lambda x: x["points"] < 0)
    best = F.slice(F.transform(F.array_sort(lines), lambda x: x["line"]), 1, most)
    return F.when(F.size(best) > 0, best).otherwise(alias_quotes(title, content, aliases, most))


def repaired_quotes(given: Column, found: Column, content: Column) -> Column:
    """A model's quotes as far as they stand in the scene, else those found in it; four at most."""
    kept = P.found_quotes(given, content, 4)
    return F.when(F.size(kept) > 0, kept).otherwise(F.slice(found, 1, 4))


def batches(rows: DataFrame, size: int, order: list[str]) -> DataFrame:
    """rows with a number for each run of `size` of a role's rows in order."""
    return summaries.numbered(rows, ROLE, order, "_n").withColumn("batch", F.floor((F.col("_n") - 1) / size)).drop("_n")


_REPAIR = "struct<timeline_node_id: string, role_in_context: string, salient_development: string, goal_state: string, resulting_state: string, unresolved_issue: string, evidence_quotes: array<string>>"


def _asked(rows: DataFrame, size: int, provider: Callable[[], Provider]) -> DataFrame:
    """(role, timeline_node_id, r): the model's repairs of the rows, asked for in batches; of several for a node the last."""
    item = F.struct("scene_order", "timeline_node_id", "title", *FIELDS, "evidence_quotes", F.col("content").alias("scene_text"))
    asked = batches(rows, size, ["scene_order", "timeline_node_id"]).groupBy(*ROLE, "language", "aliases", "batch").agg(F.array_sort(F.collect_list(item)).alias("nodes"))
    asked = asked.withColumn("messages", prompts.repair_nodes(F.col("language"), F.col("character"), F.col("aliases"), F.col("nodes")))
    answered = complete_column(asked.drop("nodes"), "messages", "answer", provider, as_json=True)
    found = answered.select(*ROLE, F.posexplode(P.items(F.col("answer"), "repairs", _REPAIR)).alias("_at", "r"))
    return found.groupBy(*ROLE, T.clean_text("r.timeline_node_id").alias("timeline_node_id")).agg(F.max_by("r", "_at").alias("r"))


def nodes(rows: DataFrame, scenes: DataFrame, provider: Callable[[], Provider] = Offline, size: int = 3) -> DataFrame:
    """Nodes with quotes found, weak fields mended in batches of `size`, and goals that still lack asked for one by one; changed counts what was mended.

    rows: movie_id, character, language, aliases, timeline_node_id, scene_id, scene_order, title, fields and evidence_quotes.
    """
    text = scenes.select("movie_id", "scene_id", "content", F.col("title").alias("_scene_title"))
    both = rows.join(text, ["movie_id", "scene_id"], "left")
    bare = F.size(F.coalesce("evidence_quotes", _none("array<string>"))) == 0
    names = F.array_distinct(F.concat(F.array("character"), "aliases"))
    found = evidence_quotes(F.col("_scene_title"), F.col("content"), F.col("language"), names, [F.col(f) for f in FIELDS])
    there = F.col("content").isNotNull()
    first = both.withColumns({"_found": F.when(there, found)}).withColumns({"evidence_quotes": F.when(there & bare, F.col("_found")).otherwise(F.coalesce("evidence_quotes", _none("array<string>"))), "changed": F.when(there & bare & (F.size("_found") > 0), 1).otherwise(0)})
    lacks = T.clean_text("goal_state") == ""
    weak = first.where(there & (lacks | (F.size("evidence_quotes") == 0)))
    one = first.join(_asked(weak, size, provider), [*ROLE, "timeline_node_id"], "left")
    new = {f: F.coalesce(P.filled(F.col(f"r.{f}")), F.col(f)) for f in FIELDS}
    given = F.col("r").isNotNull()
    new["evidence_quotes"] = F.when(given, repaired_quotes(F.col("r.evidence_quotes"), F.col("_found"), F.col("content"))).otherwise(F.col("evidence_quotes"))
    differs = F.to_json(F.struct(*(v.alias(k) for k, v in new.items()))) != F.to_json(F.struct(*(F.col(k) for k in new)))
    one = one.withColumn("changed", F.col("changed") + F.when(given & differs, 1).otherwise(0)).withColumns(new).drop("r")
    goals = _asked(one.where(there & lacks), 1, provider).select(*ROLE, "timeline_node_id", P.filled(F.col("r.goal_state")).alias("_goal"))
    out = one.join(goals, [*ROLE, "timeline_node_id"], "left")
    return out.withColumns({"changed": F.col("changed") + F.when(lacks & F.col("_goal").isNotNull(), 1).otherwise(0), "goal_state": F.when(lacks, F.coalesce("_goal", "goal_state")).otherwise(F.col("goal_state"))}).drop("_goal", "_found", "_scene_title", "content")


def arc_rows(answer: DataFrame, known: DataFrame, prefix: str) -> DataFrame:
    """A model's arcs with the links that exist, distinct and in order, two at least. answer: movie_id, character, answer; known: movie_id, character, timeline_node_id."""
    ids = known.groupBy(*ROLE).agg(F.collect_set(T.clean_text("timeline_node_id")).alias("_ids"))
    found = answer.select(*ROLE, F.posexplode(P.items(F.col("answer"), "arcs", P.ARC)).alias("pos", "a")).join(ids, ROLE)
    given = F.transform(F.coalesce("a.linked_timeline_node_ids", _none("array<string>")), T.clean_text)
    links = F.array_distinct(F.filter(given, lambda i: F.array_contains("_ids", i)))
    title = T.clean_text("a.title")
    out = found.select(*ROLE, "pos", T.stable_id(prefix, F.col("character"), title).alias("arc_id"), title.alias("title"), F.coalesce(P.filled(F.col("a.arc_focus")), F.lit("mixed")).alias("arc_focus"), links.alias("linked_timeline_node_ids"), T.clean_text("a.arc_summary").alias("arc_summary"), *(P.filled(F.col(f"a.{f}")).alias(f) for f in ("start_state", "end_state", "unresolved_issue")))
    return out.where(F.size("linked_timeline_node_ids") >= 2)


def arcs(rows: DataFrame, held: DataFrame, provider: Callable[[], Provider] = Offline) -> DataFrame:
    """Arcs for roles of two nodes or more that have none: the model's, else one through first, middle and last. held: movie_id, character of arcs there are."""
    lone = rows.join(held.select(*ROLE).distinct(), ROLE, "left_anti")
    listed = F.array_sort(F.collect_list(F.struct("scene_order", "timeline_node_id", "scene_id", "title", "salient_development", "goal_state", "resulting_state", "unresolved_issue")))
    groups = lone.groupBy(*ROLE, "language").agg(listed.alias("nodes")).where(F.size("nodes") >= 2)
    asked = groups.withColumn("messages", prompts.arcs(F.col("language"), F.col("character"), F.col("nodes")))
    answered = complete_column(asked.drop("nodes"), "messages", "answer", provider, as_json=True).select(*ROLE, "answer")
    said = arc_rows(answered, lone, "v6arc")
    plain = groups.join(said.select(*ROLE).distinct(), ROLE, "left_anti")
    return said.unionByName(fallback_arc(plain))


def fallback_arc(groups: DataFrame) -> DataFrame:
    """One arc of a role through its first, middle and last nodes (first and last of two). groups: role, language, nodes in order."""
    n = F.col("nodes")
    first, last = n[0], F.element_at(n, -1)
    middle = F.get(n, F.floor(F.size(n) / 2).cast("int"))
    links = F.when(F.size(n) >= 3, F.array(first["timeline_node_id"], middle["timeline_node_id"], last["timeline_node_id"])).otherwise(F.array(first["timeline_node_id"], last["timeline_node_id"]))
    said = lambda c, other: F.coalesce(P.filled(c), F.lit(other))
    zh = F.col("language") == "zh"
    title = F.when(zh, "角色主线推进").otherwise("Primary Story Trajectory")
    # The wording is our own; what it must name is the role and both ends.
    english = F.concat("character", F.lit(" goes from "), said(first["salient_development"], "where the story begins"), F.lit(" to "), said(last["salient_development"], "where it ends"), F.lit("; the linked nodes are the way there."))
    chinese = F.concat("character", F.lit("从"), said(first["salient_development"], "开端"), F.lit("走到"), said(last["salient_development"], "结局"), F.lit("，所连节点是其间的路径。"))
    start = F.coalesce(P.filled(first["goal_state"]), P.filled(first["salient_development"]))
    end = F.coalesce(P.filled(last["resulting_state"]), P.filled(last["salient_development"]))
    return groups.select(*ROLE, F.lit(0).alias("pos"), T.stable_id("v6arc", F.col("character"), title).alias("arc_id"), title.alias("title"), F.lit("mixed").alias("arc_focus"), F.transform(links, T.clean_text).alias("linked_timeline_node_ids"), F.when(zh, chinese).otherwise(english).alias("arc_summary"), start.alias("start_state"), end.alias("end_state"), P.filled(last["unresolved_issue"]).alias("unresolved_issue"))


def summaries_of(rows: DataFrame, timelines: DataFrame, provider: Callable[[], Provider] = Offline) -> DataFrame:
    """timelines (role, language, timeline_summary) with summaries that need it written anew, and whether they were."""
    weak = T.summary_needs_repair("timeline_summary", F.col("language"))
    listed = F.array_sort(F.collect_list(F.struct("scene_order", "title", "salient_development", "goal_state", "resulting_state", "unresolved_issue")))
    groups = timelines.where(weak).join(rows.groupBy(*ROLE).agg(listed.alias("nodes")), ROLE, "left")
    asked = groups.withColumn("messages", F.when(F.size("nodes") > 0, prompts.timeline_summary(F.col("language"), F.col("character"), F.col("nodes"))))
    answered = complete_column(asked, "messages", "answer", provider, as_json=True)
    said = P.filled(F.get_json_object("answer", "$.timeline_summary"))
    new = answered.select(*ROLE, F.when(said.isNotNull() & ~T.is_placeholder_summary(said), said).otherwise(fallback_summary(F.col("language"), F.col("character"), F.col("nodes"))).alias("_new"))
    return timelines.join(new, ROLE, "left").withColumns({"rewritten": F.col("_new").isNotNull(), "timeline_summary": F.coalesce("_new", "timeline_summary")}).drop("_new")


def fallback_summary(language: Column, name: Column, nodes: Column) -> Column:
    """A summary without a model, in our own words: the first, the middle (of three or more) and the last development."""
    n = F.coalesce(F.size(nodes), F.lit(0))
    at = lambda i: P.filled(F.get(nodes, i)["salient_development"])
    first, last = at(F.lit(0)), at((n - 1).cast("int"))
    middle = F.when(n >= 3, at(F.floor(n / 2).cast("int")))
    english = F.concat_ws(" ", F.concat(name, F.lit("'s timeline opens with "), F.coalesce(first, F.lit("an early pressure")), F.lit(".")), F.when(middle.isNotNull(), F.concat(F.lit("It turns on "), middle, F.lit("."))), F.concat(F.lit("It comes to rest on "), F.coalesce(last, F.lit("a changed state")), F.lit(".")))
    chinese = F.concat_ws("", F.concat(name, F.lit("的时间线始于"), F.coalesce(first, F.lit("早期的处境")), F.lit("。")), F.when(middle.isNotNull(), F.concat(F.lit("转折在于"), middle, F.lit("。"))), F.concat(F.lit("最终落在"), F.coalesce(last, F.lit("改变后的状态")), F.lit("。")))
    none = F.when(language == "zh", F.concat(name, F.lit("还没有可概括的时间线。"))).otherwise(F.concat(name, F.lit(" has no timeline to sum up yet.")))
    return F.when(n <= 0, none).when(language == "zh", chinese).otherwise(english)


def movie(rows: DataFrame, timelines: DataFrame, held: DataFrame, scenes: DataFrame, provider: Callable[[], Provider] = Offline) -> dict[str, DataFrame]:
    """All repairs of finished movies: nodes, timelines, new arcs, and what changed for each movie."""
    mended = nodes(rows, scenes, provider)
    told = summaries_of(mended, timelines, provider)
    added = arcs(mended, held, provider)
    n = lambda df, c, name: df.groupBy("movie_id").agg(F.sum(c).cast("long").alias(name))
    counts = n(mended, "changed", "changed_nodes").join(n(told, F.col("rewritten").cast("int"), "changed_summaries"), "movie_id", "full").join(n(added, F.lit(1), "added_arcs"), "movie_id", "full").fillna(0)
    return {"nodes": mended, "timelines": told, "arcs": added, "changes": counts}
