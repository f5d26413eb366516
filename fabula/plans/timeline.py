"""Timelines from scenes: candidate scenes of a role, cards, milestones, nodes and arcs, each step a DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fabula.functions import payload as P
from fabula.functions import text as T
from fabula.functions import values as V
from fabula.operators import folds, matching, retrieval, sequence, summaries
from fabula.plans import prompts, repairs
from fabula.plans.providers import Offline, Provider, complete_column, embed_column

ROLE = ["movie_id", "character"]


def scored_scenes(scenes: DataFrame, roles: DataFrame) -> DataFrame:
    """Every scene of a movie for every role of the movie, with the role's alias score. roles: movie_id, character and, if known, aliases."""
    more = [F.coalesce("aliases", F.array().cast("array<string>"))] if "aliases" in roles.columns else []
    both = scenes.join(roles.select(*ROLE, T.aliases_of("character", *more).alias("aliases")), "movie_id")
    return both.withColumn("alias_score", T.alias_score("title", "content", T.speaker_names("content"), F.col("aliases")))


def rescued(scored: DataFrame, provenance: DataFrame) -> DataFrame:
    """For roles that no scene names: the scenes in which provenance (movie_id, scene_order, name) has a character of that name, compared loosely."""
    hit = scored.where("alias_score > 0").select(*ROLE).distinct()
    lost = scored.join(hit, ROLE, "left_anti")
    keys = lost.select(*ROLE, F.explode("aliases").alias("alias")).distinct().select(*ROLE, T.compact_key("alias").alias("a"))
    said = provenance.select("movie_id", F.col("scene_order").cast("string").alias("_place"), "name", T.compact_key(F.replace("name", F.lit("_"), F.lit(" "))).alias("b"))
    met = matching.fuzzy_names(keys, said, ["movie_id"], "a", "b").select(*ROLE, "_place").distinct()
    return lost.withColumn("_place", F.col("scene_order").cast("string")).join(met, [*ROLE, "_place"], "left_semi").drop("_place")


def shortlisted(scenes: DataFrame, roles: DataFrame, provenance: DataFrame | None = None) -> DataFrame:
    scored = scored_scenes(scenes, roles)
    near = retrieval.shortlist(scored, ROLE, "scene_order", "alias_score")
    return near if provenance is None else near.unionByName(rescued(scored, provenance))


def plain_card(speaks: Column, score: Column) -> tuple[Column, Column]:
    """(scene_role, milestone_score) without a model: by whether the role speaks in the scene and by the alias score."""
    role = F.when(speaks & (score >= 8), "foreground").when(speaks | (score >= 7), "active").otherwise("indirect")
    return role, F.when(speaks & (score >= 8), 3).when(speaks | (score >= 7), 2).otherwise(F.when(score > 0, 1).otherwise(0))


def role_cards(scenes: DataFrame, roles: DataFrame, provider: Callable[[], Provider] = Offline, provenance: DataFrame | None = None, size: int = 2) -> DataFrame:
    """Cards of the scenes that matter to a role, asked for `size` scenes at a time and singly where a batch lacks one.

    Strong scenes that the model makes nothing of get a card from the alias score; so do a role's twelve strongest
    scenes if it has no card at all. Weak neighbours of strong cards are promoted.
    """
    near = summaries.numbered(shortlisted(scenes, roles, provenance), ROLE, ["scene_order", "scene_id"], "_n").withColumn("_batch", F.floor((F.col("_n") - 1) / size)).drop("_n")
    scene = F.struct("scene_order", "scene_id", "title", "content")
    groups = near.groupBy(*ROLE, "language", "_batch").agg(F.array_sort(F.collect_list(scene)).alias("scenes"))
    asked = groups.withColumn("messages", prompts.scene_roles(F.col("language"), F.col("character"), F.col("scenes")))
    answered = complete_column(asked.drop("scenes"), "messages", "answer", provider, as_json=True)
    given = answered.select(*ROLE, F.posexplode(P.items(F.coalesce("answer", F.lit("[]")), "scene_cards", P.CARD)).alias("_at", "r")).withColumn("scene_id", T.clean_text("r.scene_id"))
    given = sequence.first_of_equals(given, [*ROLE, "scene_id"], ["_at"]).select(*ROLE, "scene_id", "r")
    both = near.drop("_batch").join(given, [*ROLE, "scene_id"], "left")
    alone = both.withColumn("messages", F.when(F.col("r").isNull(), prompts.messages(prompts.scene_role(F.col("language"), F.col("character"), F.col("title"), F.col("content"), order=F.col("scene_order")))))
    single = complete_column(alone, "messages", "answer", provider, as_json=True)
    raw = F.coalesce("r", P.first_object(F.coalesce("answer", F.lit("{}")), P.CARD))
    a = F.col("alias_score")
    names = F.transform("aliases", T.match_key)
    speaks = F.exists(T.speaker_names("content"), lambda s: F.array_contains(names, T.match_key(s)))
    cards = single.withColumn("c", P.card(raw, F.col("content")))
    nothing = (F.col("c.scene_role") == "absent") & (F.col("c.milestone_score") == 0)
    role, score = plain_card(speaks, a)
    plain = nothing & (a >= 6)
    found = F.coalesce("c.evidence_quotes", F.array().cast("array<string>"))
    texts = [f for f in folds._TEXT_FIELDS]
    out = cards.select(
        *ROLE, "language", "scene_id", F.col("scene_order").cast("long").alias("scene_order"), "title", "content", "alias_score", speaks.alias("speaks"), nothing.alias("_nothing"), plain.alias("_plain"),
        F.when(plain, role).otherwise(F.col("c.scene_role")).alias("scene_role"), F.when(plain, score).otherwise(F.col("c.milestone_score")).alias("score"), *(F.when(plain, "").otherwise(F.coalesce(f"c.{f}", F.lit(""))).alias(f) for f in texts),
        F.when(plain, repairs.alias_quotes(F.col("title"), F.col("content"), F.col("aliases"))).otherwise(found).alias("evidence_quotes"),
    )
    kept = out.where("NOT _nothing OR _plain")
    bare = out.join(kept.select(*ROLE).distinct(), ROLE, "left_anti").where("alias_score > 0")
    bare = sequence.top_of_bucket(bare, ROLE, "language", [F.desc("alias_score"), "scene_order"], 12).drop("rank")
    role, score = plain_card(F.col("speaks"), F.col("alias_score"))
    bare = bare.withColumns({"scene_role": role, "score": score})
    every = kept.unionByName(bare).drop("_nothing", "_plain", "speaks", "alias_score")
    return sequence.promote_neighbours(every, ROLE, "scene_order", "score", "scene_role")


def milestones(cards: DataFrame, wide: bool = True) -> DataFrame:
    """The selected cards of each role, within its budget, after pairwise refinement."""
    budget = summaries.budgets(cards, ROLE, "score", "scene_role").select(*ROLE, F.col("budget_wide" if wide else "budget").alias("budget"))
    chosen = folds.milestones(cards.join(budget, ROLE), ROLE, wide, checks=14 if wide else 8)
    return cards.join(chosen.select(*ROLE, "scene_id", F.col("rank").alias("ordinal")), [*ROLE, "scene_id"])


def nodes(chosen: DataFrame) -> DataFrame:
    """Timeline nodes of milestones: fields from the card, ids that are stable for the role, scene and place."""
    first = lambda *names: F.coalesce(*(F.when(F.col(n) != "", F.col(n)) for n in names), F.lit(""))
    return chosen.select(
        *ROLE, "language", "scene_id", "scene_order", F.col("title").alias("scene_title"), "ordinal", T.stable_id("node", F.col("character"), F.col("scene_id"), F.col("ordinal")).alias("timeline_node_id"),
        F.when(F.col("score") >= 4, "core").otherwise("supporting").alias("importance"), F.lit(0).alias("beat_index"), F.col("role_in_scene").alias("role_in_context"), first("external_change", "relation_shift", "goal_shift", "state_pressure", "milestone_reason", "role_in_scene").alias("salient_development"),
        F.col("goal_shift").alias("goal_state"), first("external_change", "relation_shift").alias("resulting_state"), F.col("state_pressure").alias("unresolved_issue"), "evidence_quotes",
    )


def valid_nodes(found: DataFrame, scenes: DataFrame) -> DataFrame:
    """Nodes of scenes that exist, the first of a scene, with a development, in story order."""
    known = found.drop("scene_order", "scene_title").join(scenes.select("movie_id", "scene_id", "scene_order", F.col("title").alias("scene_title")), ["movie_id", "scene_id"])
    return sequence.first_of_equals(known.where(T.clean_text("salient_development") != ""), [*ROLE, "scene_id"], ["ordinal"])


def summary_of(timeline: DataFrame) -> DataFrame:
    """A role's summary without a model: its first, middle and last developments."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct("scene_order", "scene_id", "salient_development"))), lambda x: x["salient_development"])
    rows = timeline.groupBy(*ROLE).agg(listed.alias("d"))
    n = F.size("d")
    return rows.select(*ROLE, F.concat_ws(" ", F.array_distinct(F.array(F.get("d", F.lit(0)), F.get("d", F.floor(n / 2).cast("int")), F.get("d", n - 1)))).alias("timeline_summary"), n.alias("n_nodes"))


def fallback_arcs(timeline: DataFrame) -> DataFrame:
    """One arc of a role through its first, middle and last nodes; roles of one node have none."""
    node = F.struct("scene_order", "timeline_node_id", "salient_development", "resulting_state", "unresolved_issue")
    rows = timeline.groupBy(*ROLE).agg(F.array_sort(F.collect_list(node)).alias("n")).where(F.size("n") >= 2)
    last = F.element_at("n", -1)
    links = F.array_distinct(F.array(F.col("n")[0]["timeline_node_id"], F.get("n", F.floor(F.size("n") / 2).cast("int"))["timeline_node_id"], last["timeline_node_id"]))
    return rows.select(*ROLE, T.stable_id("arc", F.col("movie_id"), F.col("character")).alias("arc_id"), links.alias("linked_timeline_node_ids"), F.col("n")[0]["salient_development"].alias("start_state"), last["resulting_state"].alias("end_state"), last["unresolved_issue"].alias("unresolved_issue"))


def rendered(chosen: DataFrame, provider: Callable[[], Provider] = Offline) -> DataFrame:
    """Timeline nodes of milestones as the model tells them, each field from the card where the model says nothing; quotes stand in the scene."""
    card = F.struct("scene_id", "scene_order", "scene_role", *folds._TEXT_FIELDS, "score", "evidence_quotes")
    asked = nodes(chosen).join(chosen.select(*ROLE, "scene_id", "content", card.alias("card")), [*ROLE, "scene_id"])
    asked = asked.withColumn("messages", prompts.render_node(F.col("language"), F.col("character"), F.col("card"), F.col("content")))
    raw = complete_column(asked, "messages", "answer", provider, as_json=True).withColumn("r", P.first_object(F.coalesce("answer", F.lit("{}")), P.NODE))
    fields = ["role_in_context", "salient_development", "goal_state", "resulting_state", "unresolved_issue"]
    quotes = F.coalesce(P.found_quotes(F.col("r.evidence_quotes"), F.col("content"), 4), F.array().cast("array<string>"))
    new = {f: F.coalesce(P.filled(F.col(f"r.{f}")), F.col(f)) for f in fields}
    new["evidence_quotes"] = F.when(F.size(quotes) > 0, quotes).otherwise(F.slice("evidence_quotes", 1, 2))
    return raw.withColumns(new).drop("r", "answer", "messages", "card", "content")


def told_segments(cards: DataFrame, provider: Callable[[], Provider] = Offline) -> DataFrame:
    """The thirds of each role's story with the model's summary of their first ten cards, or one of our own wording."""
    plain = summaries.segments(cards, ROLE, "scene_order", "scene_id", list(folds.FACETS.values()), "score")
    most = F.max("scene_order").over(Window.partitionBy(*ROLE))
    card = F.struct("scene_order", "scene_id", "scene_role", *folds._TEXT_FIELDS, "score")
    listed = cards.withColumn("bucket", V.temporal_bucket(F.col("scene_order"), most)).groupBy(*ROLE, "language", "bucket").agg(F.array_sort(F.collect_list(card)).alias("cards"))
    asked = listed.withColumn("messages", prompts.segment(F.col("language"), F.col("character"), F.col("bucket"), F.col("cards")))
    raw = complete_column(asked, "messages", "answer", provider, as_json=True).withColumn("s", P.first_object(F.coalesce("answer", F.lit("{}")), P.SEGMENT))
    both = plain.join(raw, [*ROLE, "bucket"])
    first, last = F.col("cards")[0]["scene_order"].cast("string"), F.element_at("cards", -1)["scene_order"].cast("string")
    english = F.concat("character", F.lit(", "), "bucket", F.lit(": scenes "), first, F.lit(" to "), last, F.lit(", mostly "), "dominant", F.lit("."))
    chinese = F.concat("character", F.lit("，"), "bucket", F.lit("：第"), first, F.lit("至"), last, F.lit("场，主要为"), "dominant", F.lit("。"))
    summary = F.coalesce(P.filled(F.col("s.segment_summary")), F.when(F.col("language") == "zh", chinese).otherwise(english))
    return both.select(*ROLE, "bucket", "scene_count", "scene_ids", summary.alias("segment_summary"), F.coalesce(P.filled(F.col("s.dominant_aspect")), F.col("dominant")).alias("dominant_aspect"))


def told_arcs(timeline: DataFrame, provider: Callable[[], Provider] = Offline) -> DataFrame:
    """The model's arcs over a role's nodes, with links that exist."""
    return repairs.arc_rows(_arc_answers(timeline, provider), timeline, "v6arc")


def told_summaries(timeline: DataFrame, provider: Callable[[], Provider] = Offline) -> DataFrame:
    """movie_id, character, timeline_summary of each role with nodes."""
    roles = timeline.select(*ROLE, "language").distinct().withColumn("timeline_summary", F.lit(""))
    return repairs.summaries_of(timeline.withColumn("title", F.col("scene_title")), roles, provider).select(*ROLE, "timeline_summary")


def build(scenes: DataFrame, roles: DataFrame, provider: Callable[[], Provider] = Offline, wide: bool = True, provenance: DataFrame | None = None) -> dict[str, DataFrame]:
    """All artifacts of a build, for all movies at once: wide is the current selection, the narrow one the one before."""
    cards = role_cards(scenes, roles, provider, provenance)
    chosen = milestones(cards, wide)
    timeline = valid_nodes(rendered(chosen, provider), scenes)
    pairs = sequence.transition_pairs(timeline.withColumns({"node_id": F.col("timeline_node_id"), "n_quotes": F.size("evidence_quotes")}), ROLE)
    arcs = told_arcs(timeline, provider)
    return {
        "cards": cards, "segments": told_segments(cards, provider), "milestones": chosen, "nodes": timeline, "summaries": told_summaries(timeline, provider), "arcs": arcs,
        "transitions": pairs, "totals": summaries.build_totals(timeline, arcs, "movie_id", "character"),
    }


# What is asked beside the character's name.
EXPANSIONS = ["decision conflict", "relationship change", "goal failure success"]


def queries_of(name: Column, aliases: Column) -> Column:
    """A role's queries: its name, the name with each expansion, two aliases; each once."""
    own = F.array(name, *(F.concat(name, F.lit(f" {x}")) for x in EXPANSIONS))
    return F.array_distinct(F.filter(F.concat(own, F.slice(aliases, 1, 2)), lambda q: T.clean_text(q) != ""))


def retrieve_scenes(scenes: DataFrame, roles: DataFrame, k: int = 12, provider: Callable[[], Provider] | None = None) -> DataFrame:
    """The retrieval way to a role's scenes: expanded queries, BM25 and (with a provider of embeddings) vectors per movie, fused ranks."""
    aliases = F.coalesce("aliases", F.array().cast("array<string>")) if "aliases" in roles.columns else F.array().cast("array<string>")
    asked = roles.select("movie_id", "character", F.explode(queries_of(F.col("character"), aliases)).alias("query"))
    lang = F.col("language")
    docs = scenes.select("movie_id", "scene_id", "language", F.concat_ws("\n", "title", "subtitle", T.excerpt("content", 1800)).alias("text"))
    q = asked.join(scenes.select("movie_id", "language").distinct(), "movie_id").withColumn("q", F.struct("character", "query"))
    scores = retrieval.bm25_scores(docs.withColumn("tokens", T.tokens("text", lang)), q.withColumn("tokens", T.tokens("query", lang)), ["movie_id"], "scene_id", "q")
    ranked = retrieval.top_k(scores, ["movie_id", "q"], k, "scene_id").withColumn("source", F.lit("bm25"))
    if provider is not None:
        d, x = embed_column(docs, "text", "vector", provider, "passage: "), embed_column(q, "query", "vector", provider, "query: ")
        ranked = retrieval.with_vectors(ranked, d, x, ["movie_id"], "scene_id", "q", k)
    lists = ranked.select("movie_id", F.col("q.character").alias("character"), "scene_id", "rank", F.concat("source", F.lit(":"), F.col("q.query")).alias("source"))
    return retrieval.reciprocal_rank_fusion(lists, ROLE, "scene_id", k)


def build_by_retrieval(scenes: DataFrame, roles: DataFrame, provider: Callable[[], Provider] = Offline, most: int = 14) -> dict[str, DataFrame]:
    """The first way of building: nodes proposed from retrieved scenes, refined, held against their scenes, and arcs. roles: movie_id, character, aliases."""
    hits = retrieve_scenes(scenes, roles, 12, provider).where(F.col("rank") <= most).select(*ROLE, "scene_id")
    met = hits.join(scenes, ["movie_id", "scene_id"]).join(roles.select(*ROLE, "aliases"), ROLE)
    card = F.struct("scene_order", "scene_id", F.col("title").alias("scene_title"), T.excerpt("content", 700).alias("excerpt"))
    asked = met.groupBy(*ROLE, "language", "aliases").agg(F.to_json(F.array_sort(F.collect_list(card))).alias("cards")).withColumn("messages", prompts.propose_nodes(F.col("language"), F.col("character"), F.col("aliases"), F.col("cards")))

    def read(answered: DataFrame, field: str) -> DataFrame:
        rows = answered.select(*ROLE, "language", F.posexplode(P.items(F.coalesce("answer", F.lit("{}")), field, P.NODE)).alias("ordinal", "n")).select(*ROLE, "language", "ordinal", "n.*")
        rows = rows.withColumns({"scene_id": T.clean_text("scene_id"), "importance": F.coalesce(P.filled(F.col("importance")), F.lit("core")), **{f: P.filled(F.col(f)) for f in ("role_in_context", "salient_development", "goal_state", "resulting_state", "unresolved_issue")}})
        return valid_nodes(rows, scenes)

    proposed = read(complete_column(asked.drop("cards"), "messages", "answer", provider, as_json=True), "proposed_nodes")
    listed = proposed.groupBy(*ROLE, "language").agg(F.to_json(F.array_sort(F.collect_list(F.struct("scene_order", "scene_id", "scene_title", "salient_development", "goal_state", "resulting_state", "unresolved_issue")))).alias("n"))
    refined = complete_column(listed.withColumn("messages", prompts.refine(F.col("character"), F.col("n"), F.col("language"), 4, 10)), "messages", "answer", provider, as_json=True)
    final = read(refined, "final_nodes").join(scenes.select("movie_id", "scene_id", "content"), ["movie_id", "scene_id"])
    draft = F.to_json(F.struct("scene_id", "role_in_context", "salient_development", "goal_state", "resulting_state", "unresolved_issue"))
    raw = complete_column(final.withColumn("messages", prompts.ground(F.col("language"), F.col("character"), draft, F.col("content"))), "messages", "answer", provider, as_json=True).withColumn("r", P.first_object(F.coalesce("answer", F.lit("{}")), P.NODE))
    new = {f: F.coalesce(P.filled(F.col(f"r.{f}")), F.col(f)) for f in ("role_in_context", "salient_development", "goal_state", "resulting_state", "unresolved_issue")}
    new |= {"timeline_node_id": T.stable_id("ptu", F.col("character"), F.col("scene_id")), "document_id": F.concat(F.lit("scene_"), "scene_id", F.lit("_part_1")), "scene_summary": T.excerpt(T.clean_text("content"), 240)}
    timeline = raw.withColumns(new).drop("r", "answer", "messages", "content")
    arcs = repairs.arc_rows(_arc_answers(timeline, provider), timeline, "parc")
    return {"nodes": timeline, "arcs": arcs, "totals": summaries.build_totals(timeline, arcs, "movie_id", "character")}


def _arc_answers(timeline: DataFrame, provider: Callable[[], Provider]) -> DataFrame:
    node = F.struct("scene_order", "timeline_node_id", "scene_id", "scene_title", "salient_development", "goal_state", "resulting_state", "unresolved_issue")
    asked = timeline.groupBy(*ROLE, "language").agg(F.array_sort(F.collect_list(node)).alias("n")).withColumn("messages", prompts.arcs(F.col("language"), F.col("character"), F.col("n")))
    return complete_column(asked.drop("n"), "messages", "answer", provider, as_json=True).select(*ROLE, F.coalesce("answer", F.lit("{}")).alias("answer"))
