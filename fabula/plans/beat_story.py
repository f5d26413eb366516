"""The way from beats to timelines: summaries of beats, candidates of a role, nodes that candidates back, repaired and grounded."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fabula.functions import payload as P
from fabula.functions import text as T
from fabula.functions import values as V
from fabula.operators import beats as B
from fabula.operators import folds, sequence, summaries
from fabula.plans import prompts
from fabula.plans.providers import Offline, Provider, complete_column

ROLE = ["movie_id", "character"]
PLACE = ["scene_id", "beat_index"]
STATES = ["goal_state", "resulting_state", "unresolved_issue"]
CANDIDATE = ["importance", "change_type", "role_in_context", "salient_development", *STATES, "evidence_quotes"]


def split(scenes: DataFrame) -> DataFrame:
    """The beats of scenes (movie_id, language, scene_id, scene_order, title, content)."""
    keyed = scenes.select(F.struct("movie_id", "language", "scene_id", "scene_order", "title").alias("scene"), "title", "content")
    return B.beats(keyed, "scene", "title", "content").select("scene_id.*", "beat_index", F.col("heading").alias("beat_heading"), "beat_text")


def summarise(beats: DataFrame, provider: Callable[[], Provider] = Offline) -> DataFrame:
    """beats with beat_summary, present and updates, as the model says and the text bears out."""
    asked = beats.withColumn("messages", prompts.beat(F.col("language"), F.col("title"), F.col("beat_heading"), F.col("beat_index"), F.col("beat_text")))
    answered = complete_column(asked, "messages", "answer", provider, as_json=True)
    return read_summaries(answered).drop("messages")


def read_summaries(answered: DataFrame) -> DataFrame:
    """Rows with an answer column -> beat_summary, present, updates."""
    raw = answered.withColumn("_raw", P.first_object(F.col("answer"), P.BEAT))
    none = lambda c, like: F.coalesce(c, F.array().cast(like))
    found = P.updates(F.col("_raw"), F.col("beat_text"))
    kind = raw.select(found.alias("u")).schema["u"].dataType
    return raw.withColumns({"beat_summary": T.clean_text(F.col("_raw.beat_summary")), "present": none(P.present(F.col("_raw")), "array<string>"), "updates": none(found, kind)}).drop("_raw", "answer")


def candidate_score(durable: Column, importance: Column, n_quotes: Column, goal: Column, result: Column) -> Column:
    """3 for a durable change, 2 for a core one, one each for up to two quotes, a goal and a result."""
    one = lambda c, n=1: F.when(c, n).otherwise(0)
    return one(durable, 3) + one(importance == "core", 2) + F.least(F.lit(2), n_quotes) + one(F.coalesce(goal, F.lit("")) != "") + one(F.coalesce(result, F.lit("")) != "")


def candidates(summaries_: DataFrame, roles: DataFrame) -> DataFrame:
    """What durable or core updates say about a role, one row for each beat and development, before pruning.

    roles: movie_id, character, aliases. An update belongs to the roles that have its name among theirs.
    """
    names = F.concat(F.array("character"), F.coalesce("aliases", F.array().cast("array<string>")))
    keys = F.array_distinct(F.filter(F.transform(names, lambda n: T.name_key(T.strip_speaker_variant(n))), lambda k: k != ""))
    known = roles.select(*ROLE, F.explode(keys).alias("_key"))
    said = summaries_.select("movie_id", *PLACE, "scene_order", "title", "beat_heading", "beat_summary", F.posexplode("updates").alias("_at", "u"))
    said = said.select("*", "u.*").withColumn("_key", T.name_key(T.strip_speaker_variant("character_name"))).drop("u", "character_name").where("durable_change OR importance = 'core'").where("salient_development <> ''")
    rows = said.join(known, ["movie_id", "_key"])
    rows = rows.withColumn("candidate_score", candidate_score(F.col("durable_change"), F.col("importance"), F.size("evidence_quotes"), F.col("goal_state"), F.col("resulting_state")))
    rows = rows.withColumn("_same", T.name_key("salient_development"))
    return sequence.first_of_equals(rows, [*ROLE, *PLACE, "_same"], [F.desc("candidate_score"), "_at"]).drop("_same", "_key", "_at", "durable_change")


def prune(rows: DataFrame) -> DataFrame:
    """At most fourteen candidates of a role, by rank and third of the story."""
    n = F.size("evidence_quotes")
    ranked = rows.withColumns({"n_quotes": n, "rank": V.rank_score(F.col("candidate_score"), F.lower("change_type"), n, F.col("salient_development"), F.coalesce("goal_state", F.lit("")), F.coalesce("resulting_state", F.lit("")))})
    return folds.per_role(ranked, ROLE, folds.prune, ["scene_order", "beat_index", "salient_development"])


def back(nodes: DataFrame, backing: DataFrame) -> DataFrame:
    """A model's nodes with what the candidate of the same beat says where they say nothing; nodes without a candidate, repeated ones and ones without a development go.

    nodes: movie_id, character, pos, scene_id, beat_index (text) and fields; backing: candidates.
    """
    said = nodes.withColumns({"scene_id": T.clean_text("scene_id"), "beat_index": F.coalesce(F.col("beat_index").try_cast("int"), F.lit(0))})
    own = [*ROLE, *PLACE]
    fields = ["importance", "role_in_context", "salient_development", *STATES]
    theirs = sequence.first_of_equals(backing, own, [F.desc("candidate_score"), "salient_development"])
    both = said.select(*own, "pos", *(F.col(f).alias(f"_{f}") for f in fields)).join(theirs, own)
    merged = {f: F.coalesce(P.filled(F.col(f"_{f}")), P.filled(F.col(f))) for f in fields}
    merged["importance"] = F.coalesce(merged["importance"], F.lit("core"))
    out = both.withColumns(merged).where("salient_development IS NOT NULL")
    return sequence.first_of_equals(out, own, ["pos"]).drop("pos", *(f"_{f}" for f in fields))


def mend(nodes: DataFrame, rows: DataFrame, scenes: DataFrame) -> DataFrame:
    """Seven to nine nodes a role, from candidates where nodes lack. Both have the columns of pruned candidates; candidates of unknown scenes are no help."""
    columns = [c for c in rows.columns if c in nodes.columns]
    usable = rows.join(scenes.select("movie_id", "scene_id").distinct(), ["movie_id", "scene_id"], "left_semi").where(T.clean_text("salient_development") != "")
    both = nodes.select(*columns, F.lit(True).alias("_node")).unionByName(usable.select(*columns, F.lit(False).alias("_node")))

    def fold(part: list[dict]) -> list[dict]:
        return folds.repair([r for r in part if r["_node"]], [r for r in part if not r["_node"]])

    return folds.per_role(both, ROLE, fold, ["scene_order", "beat_index", "salient_development"]).drop("_node")


def ground(nodes: DataFrame, summaries_: DataFrame, provider: Callable[[], Provider] = Offline) -> DataFrame:
    """Nodes whose fields the model has held against the beat; quotes stand in the beat, else the node's first two stay. Ids count a role's nodes in order."""
    beat = summaries_.select("movie_id", "language", *PLACE, "beat_text", "beat_summary")
    rows = nodes.drop("language", "beat_summary").join(beat, ["movie_id", *PLACE])
    draft = F.to_json(F.struct(*PLACE, "importance", "role_in_context", "salient_development", *STATES, "evidence_quotes"))
    asked = rows.withColumn("messages", prompts.ground(F.col("language"), F.col("character"), draft, F.col("beat_text")))
    raw = complete_column(asked, "messages", "answer", provider, as_json=True).withColumn("_raw", P.first_object(F.col("answer"), P.NODE))
    fields = ["role_in_context", "salient_development", *STATES]
    quotes = F.coalesce(P.found_quotes(F.col("_raw.evidence_quotes"), F.col("beat_text"), 4), F.array().cast("array<string>"))
    out = raw.withColumns({**{f: F.coalesce(P.filled(F.col(f"_raw.{f}")), F.col(f)) for f in fields}, "evidence_quotes": F.when(F.size(quotes) > 0, quotes).otherwise(F.slice("evidence_quotes", 1, 2))})
    out = summaries.numbered(out, ROLE, ["scene_order", "beat_index"], "ordinal")
    node_id = T.stable_id("ptu3", F.col("character"), F.col("scene_id"), F.col("beat_index"), F.col("ordinal"))
    document = F.concat_ws("_", F.lit("scene"), "scene_id", F.lit("beat"), "beat_index")
    return out.withColumns({"timeline_node_id": node_id, "document_id": document}).drop("_raw", "answer", "messages", "beat_text")


def model_nodes(rows: DataFrame, provider: Callable[[], Provider] = Offline) -> DataFrame:
    """What a model makes of a role's candidates: timeline_summary and its final nodes, one row a node (movie_id, character, pos and fields)."""
    listed = F.array_sort(F.collect_list(F.struct("scene_order", *PLACE, *CANDIDATE, "beat_summary")))
    asked = rows.groupBy(*ROLE).agg(F.to_json(listed).alias("c")).withColumn("messages", prompts.refine(F.col("character"), F.col("c")))
    answered = complete_column(asked, "messages", "answer", provider, as_json=True)
    return answered.select(*ROLE, T.clean_text(F.get_json_object("answer", "$.timeline_summary")).alias("timeline_summary"), F.posexplode_outer(P.items(F.col("answer"), "final_nodes", P.NODE)).alias("pos", "n")).select(*ROLE, "timeline_summary", "pos", "n.*")


def build(scenes: DataFrame, roles: DataFrame, provider: Callable[[], Provider] = Offline) -> dict[str, DataFrame]:
    """Beat summaries, candidates and grounded nodes of all movies. roles: movie_id, character, aliases."""
    told = summarise(split(scenes), provider)
    pruned = prune(candidates(told, roles))
    said = model_nodes(pruned, provider)
    kept = back(said.where("pos IS NOT NULL"), pruned)
    nodes = ground(mend(kept, pruned, scenes), told, provider)
    return {"beat_summaries": told, "candidates": pruned, "nodes": nodes, "summaries": said.select(*ROLE, "timeline_summary").distinct()}


def named_roles(answer: Column, known: Column) -> Column:
    """The roles that a model selects, as far as candidates have them: canonical name, at most six aliases, reason; each once.

    known: array of (key, name, aliases).
    """
    kind = "struct<character_name: string, aliases: array<string>, selection_reason: string>"

    def one(s: Column) -> Column:
        base = F.get(F.filter(known, lambda k: k["key"] == T.name_key(s["character_name"])), F.lit(0))
        aliases = F.transform(F.concat(base["aliases"], F.coalesce(s["aliases"], F.array().cast("array<string>"))), T.strip_speaker_variant)
        reason = F.coalesce(P.filled(s["selection_reason"]), F.lit("selected among the script's characters"))
        return F.struct(base["key"].alias("key"), base["name"].alias("character"), F.slice(F.array_distinct(F.filter(aliases, lambda a: a != "")), 1, 6).alias("aliases"), reason.alias("selection_reason"))

    found = F.filter(F.transform(P.items(answer, "selected_characters", kind), one), lambda r: r["key"].isNotNull())
    keys = F.transform(found, lambda r: r["key"])
    return F.filter(found, lambda r, i: F.array_position(keys, r["key"]) == i + 1)
