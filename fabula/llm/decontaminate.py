"""Benchmark decontamination by winnowing (operator 8); DataFrame functions only.

Both sides keep the smallest k-gram hash of every sliding window of hashes (the leftmost of equal ones). Any shared span
of `window` words holds one full window of hashes, so both sides keep the same k-gram of it: joining fingerprints finds
every shared span, and extending each hit word by word on both sides confirms it. Benchmark items with the same words
are one until the end. Items of fewer words than the window are one window of their own length: their first two words (or
the only one) are joined, and all their words compared.

Defined cases: null texts and texts without words have no words and no hits (items: no window); repeated rows are
separate rows of the result; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_hash

#: Words of a k-gram, and the most benchmark fingerprints that are broadcast (each row is some hundred bytes).
GRAM, BROADCAST_ROWS = 6, 200_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: str) -> F.Column:
    return F.array_remove(F.split(F.translate(F.coalesce(F.col(text), F.lit("")), _UPPER, _LOWER), _BREAK), "")


def _run(steps: list[F.Column]) -> F.Column:
    """How many of the conditions hold before the first that doesn't."""
    return reduce(lambda rest, c: F.when(c, F.lit(1) + rest).otherwise(F.lit(0)), reversed(steps), F.lit(0))


def _agreeing(x: F.Column, y: F.Column) -> F.Column:
    """How many words two arrays begin with alike."""
    differs = F.array_position(F.zip_with(x, y, lambda a, b: F.coalesce(a == b, F.lit(False))), False)
    return F.when(differs > 0, differs - 1).otherwise(F.size(x)).cast("int")


def _hash(at: F.Column, size: int) -> F.Column:
    return F.xxhash64(*(F.get("words", at + j) for j in range(size)))


def _fingerprints(texts: DataFrame, window: int, *keep: str) -> DataFrame:
    """texts (with words) -> keep, words, pos, g: the winnowed k-grams. Each word is hashed once, a k-gram from its words' hashes."""
    span = window - GRAM + 1  # hashes in a window
    hashed = texts.select(*keep, "words", F.when(F.size("words") >= window, F.transform("words", lambda w: F.xxhash64(w))).alias("x"))
    grams = F.transform(F.sequence(F.lit(0), F.size("x") - GRAM), lambda i: F.xxhash64(*(F.get("x", i + j) for j in range(GRAM))))
    # Outer, since for an inner explode Catalyst adds a filter that splits the text anew for every word.
    rows = hashed.select(*keep, "words", F.when(F.col("x").isNotNull(), grams).alias("h")).select(*keep, "words", "h", F.posexplode_outer("h").alias("pos", "g"))
    left = _run([F.get("h", F.col("pos") - d) > F.col("g") for d in range(1, span)])
    right = _run([F.get("h", F.col("pos") + d) >= F.col("g") for d in range(1, span)])
    return rows.where(left + right + 1 >= span).select(*keep, "words", "pos", "g")


def _entries(items: DataFrame, window: int) -> DataFrame:
    """Fingerprints of items with what stands around them, nearest words first."""
    reach = window - GRAM
    rows = _fingerprints(items, window, "item")
    before = F.reverse(F.slice("words", F.greatest(F.col("pos") - reach, F.lit(0)) + 1, F.least(F.col("pos"), F.lit(reach))))
    return rows.select("item", "g", F.slice("words", F.col("pos") + 1, GRAM).alias("gram"), before.alias("before"), F.slice("words", F.col("pos") + GRAM + 1, reach).alias("after"))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 13, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", one_in: int = 20) -> DataFrame:
    """One row for each row of docs: id, n_words, n_hit, n_items, items_sha256, contaminated, text_hash.

    A word is hit inside any occurrence of a window of `window` consecutive item words (all words of a shorter item);
    contaminated: n_hit > 0 and one_in * n_hit >= n_words.
    """
    if window < GRAM:
        raise ValueError(f"window must be {GRAM} words at least")
    texts = docs.select(F.col(id_col).alias("id"), text_hash(text_col).alias("th"), words_of(text_col).alias("words"))
    items = benchmark.select(F.col(item_col).cast("string").alias("item_id"), words_of(item_text_col).alias("words")).where("size(words) > 0")
    items = items.withColumn("item", F.sha2(F.concat_ws(" ", "words"), 256))
    same_words = items.select("item", "words").dropDuplicates(["item"])
    entries = _entries(same_words.where(F.size("words") >= window), window)
    checked = lambda df: F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else None

    reach = window - GRAM
    back = _agreeing(F.reverse(F.slice("words", F.greatest(F.col("pos") - reach, F.lit(0)) + 1, F.least(F.col("pos"), F.lit(reach)))), F.col("before"))
    on = _agreeing(F.slice("words", F.col("pos") + GRAM + 1, reach), F.col("after"))

    def met(rows: DataFrame, known: DataFrame) -> DataFrame:
        if (small := checked(known)) is not None:
            return rows.join(small, "g")
        found = rows.drop("words").join(known, "g")  # without the words, which come back for the hits
        again = texts.select(F.col("id").alias("_id"), F.col("th").alias("_th"), "words").dropDuplicates(["_id", "_th"])
        return found.join(again, F.col("id").eqNullSafe(F.col("_id")) & F.col("th").eqNullSafe(F.col("_th"))).drop("_id", "_th")

    hits = met(_fingerprints(texts, window, "id", "th"), entries).where(F.slice("words", F.col("pos") + 1, GRAM) == F.col("gram"))
    # Through an array of one: as a plain column, the length would become part of the join's condition, which then isn't
    # compiled with the rows before it, and every fingerprint of a long text would be copied out with all its words.
    found = F.struct((F.col("pos") - back).alias("a"), (F.col("pos") + GRAM + on).alias("b"))
    hits = hits.select("id", "th", "item", F.explode(F.array(found)).alias("x")).where(F.col("x.b") - F.col("x.a") >= window).select("id", "th", "item", "x.a", "x.b")
    short = same_words.where(F.size("words") < window).withColumn("n", F.size("words"))
    for lead in (1, 2):  # items of one word by that word, longer ones by their first two
        known = short.where("n = 1" if lead == 1 else "n > 1")
        if known.isEmpty():
            continue
        known = known.select("item", _hash(F.lit(0), lead).alias("g"), F.col("words").alias("gram"), "n")
        places = F.when(F.size("words") >= lead, F.transform(F.sequence(F.lit(0), F.size("words") - lead), lambda i: _hash(i, lead)))
        rows = texts.select("id", "th", "words", places.alias("h")).select("id", "th", "words", F.posexplode_outer("h").alias("pos", "g")).where("pos IS NOT NULL")
        more = met(rows, known).where(F.slice("words", F.col("pos") + 1, F.col("n")) == F.col("gram"))
        hits = hits.unionByName(more.select("id", "th", "item", F.col("pos").alias("a"), (F.col("pos") + F.col("n")).alias("b")))

    spots = hits.groupBy("id", "th").agg(F.collect_set(F.struct("a", "b")).alias("spans"), F.collect_set("item").alias("items"))
    n_hit = F.size(F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["a"], s["b"] - 1))))).cast("long")
    spots = spots.select("id", "th", n_hit.alias("n_hit"), F.explode("items").alias("item")).join(items.select("item", "item_id"), "item")
    spots = spots.groupBy("id", "th").agg(F.first("n_hit").alias("n_hit"), F.sort_array(F.collect_set("item_id")).alias("ids"))
    rows = texts.select("id", "th", F.size("words").cast("long").alias("n_words"))
    out = rows.join(spots, rows["id"].eqNullSafe(spots["id"]) & rows["th"].eqNullSafe(spots["th"]), "left").select(rows["id"].alias(id_col), rows["th"].alias("text_hash"), "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("ids", F.array().cast("array<string>")).alias("ids"))
    return out.select(id_col, "n_words", "n_hit", F.size("ids").cast("long").alias("n_items"), F.sha2(F.encode(F.concat_ws(",", "ids"), "UTF-8"), 256).alias("items_sha256"), ((F.col("n_hit") > 0) & (one_in * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"), "text_hash")


def op8(spark, sf_dir) -> DataFrame:
    from .common import table

    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_hash")


SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[i + 1:i + least(len(w), 13)], ' ') AS g
       FROM b, unnest(range(greatest(len(w) - 12, 1))) AS t(i) WHERE len(w) > 0),
ns AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, i, n, array_to_string(w[i + 1:i + n], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(len(w) - n + 1)) AS i FROM d, ns WHERE len(w) >= n)),
hit AS (SELECT doc_id, i, dw.n, item_id FROM dw JOIN bw USING (n, g)),
spots AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN spots ON d.doc_id = spots.doc_id LEFT JOIN found ON d.doc_id = found.doc_id
"""
