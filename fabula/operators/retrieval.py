"""Retrieval: BM25 as relational algebra, vector top-k, reciprocal-rank fusion, memory modes, scene shortlists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fabula.functions.text import CJK, clean_text
from fabula.functions.values import dot, temporal_bucket, unit
from fabula.operators.matching import band_neighbours

K1, B, FLOOR = 1.5, 0.75, 0.25


def bounded(rows: DataFrame, most: int = 100_000) -> DataFrame:
    """Rows of a stated query set, to be broadcast if they are counted to be no more than `most`; else as they are."""
    return F.broadcast(rows) if rows.limit(most + 1).count() <= most else rows


def bm25_scores(docs: DataFrame, queries: DataFrame, index: list[str], doc: str, query: str, tokens: str = "tokens") -> DataFrame:
    """index, query, doc, score of documents that hold a token of the query; every statistic is the index's own.

    docs: index, doc, tokens; queries: index, query, tokens (repeated tokens count again). A token in most documents
    has the floor share of the mean inverse frequency. Documents without a hit score 0 and have no row. overlap counts
    the distinct tokens that are shared.
    """
    d = docs.select(*index, doc, tokens)
    stats = d.groupBy(*index).agg(F.count("*").alias("_N"), F.avg(F.size(tokens)).alias("_avg"))
    # A document counts once for a token, so frequencies need no row for each document and token beyond the scan.
    df = d.select(*index, F.explode(F.array_distinct(tokens)).alias("_t")).groupBy(*index, "_t").agg(F.count("*").alias("_df")).join(stats, index)
    df = df.withColumn("_idf", F.log(F.col("_N") - F.col("_df") + 0.5) - F.log(F.col("_df") + 0.5))
    mean = df.groupBy(*index).agg(F.avg("_idf").alias("_mean"))
    words = queries.select(*index, query, F.explode(tokens).alias("_t"))
    terms = bounded(words.select(*index, "_t").distinct())
    idf = df.join(terms, [*index, "_t"]).join(mean, index).select(*index, "_t", "_avg", F.when(F.col("_idf") < 0, FLOOR * F.col("_mean")).otherwise(F.col("_idf")).alias("_idf"))
    asked = bounded(words.groupBy(*index, query, "_t").agg(F.count("*").alias("_q")).join(idf, [*index, "_t"]))
    said = d.select(*index, doc, F.size(tokens).alias("_len"), F.explode(tokens).alias("_t")).join(terms, [*index, "_t"])
    tf = said.groupBy(*index, doc, "_len", "_t").agg(F.count("*").alias("_tf"))
    part = F.col("_q") * F.col("_idf") * F.col("_tf") * (K1 + 1) / (F.col("_tf") + K1 * (1 - B + B * F.col("_len") / F.col("_avg")))
    return tf.join(asked, [*index, "_t"]).groupBy(*index, query, doc).agg(F.sum(part).alias("score"), F.count("*").alias("overlap"))


def top_k(scores: DataFrame, group: list[str], k: int, *ties, digits: int = 9) -> DataFrame:
    """The k best of each group with their rank; scores that agree to `digits` places are ties."""
    w = Window.partitionBy(*group).orderBy(F.desc(F.round("score", digits)), *ties)
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def vector_scores(docs: DataFrame, queries: DataFrame, index: list[str], doc: str, query: str, vector: str) -> DataFrame:
    """Dot products of normalised vectors of each stated query with the rows of its index, or with all rows where index is empty.

    The queries then travel to the rows, as blocks that are broadcast where their size allows, not the rows to them.
    """
    d = docs.select(*index, doc, unit(F.col(vector)).alias("unit"))
    q = queries.select(*index, query, unit(F.col(vector)).alias("_q"))
    if index:
        met = d.join(q, index)
    else:
        blocks = q.groupBy(F.pmod(F.xxhash64(query), F.lit(64)).alias("_block")).agg(F.collect_list(F.struct(query, "_q")).alias("_queries"))
        met = d.crossJoin(blocks).select(doc, "unit", F.explode("_queries").alias("_asked")).select(doc, "unit", f"_asked.{query}", "_asked._q")
    return met.select(*index, query, doc, dot(F.col("unit"), F.col("_q")).alias("score"))


def reciprocal_rank_fusion(ranked: DataFrame, group: list[str], doc: str, k: int, constant: int = 60) -> DataFrame:
    """ranked: group, doc, rank, source. Sum of 1 / (constant + rank) over all lists; the k best with their sources."""
    fused = ranked.groupBy(*group, doc).agg(F.sum(1.0 / (constant + F.col("rank"))).alias("score"), F.substring(F.array_join(F.array_sort(F.collect_set("source")), "+"), 1, 400).alias("trace"))
    return top_k(fused, group, k, doc)


def select_memories(memories: DataFrame, scores: DataFrame, keys: list[str], memory: str, order: str, mode: str, k: int = 4) -> DataFrame:
    """The memories a sample sees, with scores of six places: none (persona_only), all (full_memory_all_in) or the k best (bm25_topk, embedding_topk).

    memories: keys, memory, order; scores: keys, memory, score (a missing score is 0). Equal scores go by order, where
    a missing one is 0; the whole list goes by order, where a missing one is last.
    """
    if mode == "persona_only":
        return memories.where("false").withColumns({"score": F.lit(0.0), "rank": F.lit(0)})
    if mode == "full_memory_all_in":
        w = Window.partitionBy(*keys).orderBy(F.coalesce(order, F.lit(1_000_000_000)), memory)
        return memories.withColumns({"score": F.lit(0.0), "rank": F.row_number().over(w)})
    if mode not in ("bm25_topk", "embedding_topk"):
        raise NotImplementedError(mode)
    both = memories.join(scores.select(*keys, memory, "score"), [*keys, memory], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    return top_k(both, keys, k, F.coalesce(order, F.lit(0)), memory).withColumn("score", F.round("score", 6))


def shortlist(scenes: DataFrame, group: list[str], order: str, score: str, most: int = 120, each: int = 24, strong: int = 6, reach: int = 2) -> DataFrame:
    """Scenes of a role to look at: all with a score, and neighbours of strong ones; if that is too many, the best of each third of the story, then the best of all."""
    hits = scenes.where(F.col(score) > 0)
    near = band_neighbours(hits.where(F.col(score) >= strong), scenes, group, order, reach)
    wide = near.unionByName(hits).dropDuplicates([*group, order])
    n = wide.groupBy(*group).agg(F.count("*").alias("_n"))
    best = [F.desc(score), order]
    all_of = scenes.groupBy(*group).agg(F.max(order).alias("_max"))
    few = hits.join(all_of, group).withColumn("_b", temporal_bucket(F.col(order), F.col("_max")))
    few = few.withColumn("_r", F.row_number().over(Window.partitionBy(*group, "_b").orderBy(*best)))
    few = few.withColumn("_k", F.row_number().over(Window.partitionBy(*group).orderBy(F.col("_r") > each, *best))).where(F.col("_k") <= most)
    narrow = few.join(n.where(F.col("_n") > most), group, "left_semi").select(*scenes.columns)
    return wide.join(n.where(F.col("_n") <= most), group, "left_semi").select(*scenes.columns).unionByName(narrow)


def persona_summary(traits: Column, style: Column, constraints: Column) -> Column:
    """Up to six traits, four traits of style and three constraints, a line each; lines without any are left out."""
    listed = lambda c, n: F.slice(F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), clean_text), lambda x: x != ""), 1, n)
    line = lambda name, c, n, by: F.when(F.size(listed(c, n)) > 0, F.concat(F.lit(f"{name}: "), F.array_join(listed(c, n), by)))
    return F.concat_ws("\n", line("Traits", traits, 6, ", "), line("Style", style, 4, ", "), line("Constraints", constraints, 3, " "))


def memory_document(text: Column, facts: Column, tags: Column) -> Column:
    """What a memory is found by: its text, its grounded facts and its tags, a line each."""
    listed = lambda c: F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), clean_text), lambda x: x != "")
    line = lambda name, c, by: F.when(F.size(listed(c)) > 0, F.concat(F.lit(f"{name}: "), F.array_join(listed(c), by)))
    return F.concat_ws("\n", clean_text(text), line("Grounded facts", facts, " "), line("Tags", tags, ", "))


def memory_tokens(c: Column, language: Column) -> Column:
    """Tokens of memories and questions: of Chinese runs of ASCII letters, digits and _ and single letters, else runs of a-z, 0-9 and '."""
    low = F.lower(clean_text(c))
    return F.when(F.lower(language) == "chinese", F.regexp_extract_all(low, F.lit(rf"[a-z0-9_]+|[{CJK}]"), 0)).otherwise(F.regexp_extract_all(low, F.lit("[a-z0-9']+"), 0))


def memory_query(persona: Column, history: Column, turn: Column) -> Column:
    """What memories are sought with: the persona, the dialogue so far (lines with a text) and the current turn. history: array of (speaker, text)."""
    said = F.filter(F.coalesce(history, F.array().cast("array<struct<speaker:string,text:string>>")), lambda x: clean_text(x["text"]) != "")
    lines = F.transform(said, lambda x: F.concat(clean_text(x["speaker"]), F.lit(": "), clean_text(x["text"])))
    return F.concat_ws("\n\n", persona, F.when(F.size(lines) > 0, F.concat(F.lit("Dialogue history:\n"), F.array_join(lines, "\n"))), F.concat(F.lit("Current user turn:\n"), clean_text(turn)))


def relation_context(relations: Column) -> Column:
    """A role's relations with collapsed texts; the summary stands in for a relation without a name."""
    text = lambda r, f: clean_text(r[f])
    return F.transform(relations, lambda r: F.struct(text(r, "relation_id").alias("relation_id"), text(r, "target_character").alias("target_character"), F.when(text(r, "relation") != "", text(r, "relation")).otherwise(text(r, "relation_summary")).alias("relation"), text(r, "relation_summary").alias("relation_summary")))


def with_vectors(ranked: DataFrame, docs: DataFrame, queries: DataFrame, index: list[str], doc: str, query: str, k: int, source: str = "vector") -> DataFrame:
    """Rank lists (index, query, doc, rank, source) and, beside them, those of the vectors in docs and queries."""
    scores = vector_scores(docs, queries, index, doc, query, "vector")
    lists = top_k(scores, [*index, query], k, doc).select(*index, query, doc, "rank", F.lit(source).alias("source"))
    return ranked.select(*index, query, doc, "rank", "source").unionByName(lists)
