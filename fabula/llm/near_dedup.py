"""Near-duplicate groups by bottom-k sketches of one hash function (operator 9).

A document's set is its distinct word shingles. The hash deals the set into parts, and what a sketch holds is the bottom
k of the parts' hashes; a part's hash is made of all its shingles, so that two documents that merely share a frequent
shingle share no retained value. Sets of similarity t or more differ in at most (1 - t) / (1 + t) of their summed sizes,
each difference spoils one part, and with k two more than that bound such sets always share two retained values,
whatever the order; the order puts parts without a rare shingle last. Sizes are dealt into levels; a level fixes the
number of parts, and a document has a sketch for each level in which a partner of its size can be the larger one.
Sketches have at most MOST values. Where the bound asks for more (sets of more than some 400 shingles), values are in
random order, at least 0.22 of the parts of two linked sets agree, and fewer than two agreeing values among MOST have a
probability below 1e-9 for a pair of similarity t, and far less above it.

Inverted lists of retained values generate candidates. Not all pairs of a list are made: in each turn a list's members
are held against a few of it (at first one for each document), which then leave; linked documents become one component,
and lists whose members are all in one component are done. The union sketch (the bottom UNION shingle hashes of both) estimates the similarity, drops what is far below t, and the
full sets confirm the rest. Equal sets are one from the start.

Defined cases: null, empty and wordless texts have no set and no link; a text of fewer words than a shingle has one, its
whole sequence; rows that share an id are documents of their own by their texts, and both get the least id that either
reaches; a null id counts only where a component has no other; repeated rows are alike; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, cut, mix, scratch, signed, small, text_hash, texts_of, tidy, word_hashes
from .components import components

#: Buckets of the table of shingle counts and its parts; the table is broadcast as one byte a bucket.
BUCKETS, PARTS = 1 << 20, 16
#: Most values of a sketch, and shingle hashes of the union sketch.
MOST, UNION = 96, 64
#: A level's largest size over the level's before, and how many parts there are for each that must be kept.
STEP, SPARE = 1.4, 1.25
#: Most members of a list that all others are held against in a turn, and words of a set's odd sketch.
HUBS, ODD = 512, 8
#: About how many members of a list one row holds at most, where members are held against others.
BLOCK = 128
_ODD = [f"odd{k}" for k in range(ODD)]


def _shingles(texts: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles of all texts, sorted within each text, and each one's text."""
    x, at = word_hashes(texts, lower=True)
    n = np.diff(at)
    owner = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(x)) - at[owner]
    s = np.zeros(len(x), np.uint64)
    for j in range(size):  # the words there are, up to the shingle's size
        inside = place + j < n[owner]
        s += np.where(inside, mix(np.roll(x, -j) + np.uint64(j + 1)) * np.uint64(2 * j + 3), np.uint64(0))
    s = mix(s + np.minimum(n, size)[owner].astype(np.uint64))
    starts = place <= np.maximum(n - size, 0)[owner]
    s, owner = s[starts], owner[starts]
    order = np.lexsort((s, owner))
    s, owner = s[order], owner[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (owner[1:] != owner[:-1])
    return s[new], owner[new]


def _survey(size: int):
    """Of each document its set's size and fingerprint; of each task, in rows without a document, its shingle counts."""

    def run(batches):
        counts = np.zeros(BUCKETS, np.uint64)
        for batch in batches:
            s, owner = _shingles(texts_of(batch.column(2)), size)
            counts += np.bincount((s >> np.uint64(44)).astype(np.int64), minlength=BUCKETS).astype(np.uint64)
            n, f1, f2 = _fingerprint(s, owner, len(batch))
            nulls = pa.nulls(len(batch), pa.int32()), pa.nulls(len(batch), pa.binary())
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(n), f1, f2, *nulls], ["id", "th", "n", "f1", "f2", "part", "counts"])
        if counts.any():
            none = [pa.nulls(PARTS, pa.int64())] * 4
            parts = pa.array([zlib.compress(p.tobytes(), 1) for p in np.split(counts, PARTS)], pa.binary())
            yield pa.record_batch([pa.nulls(PARTS, batch.column(0).type), *none, pa.array(range(PARTS), pa.int32()), parts], ["id", "th", "n", "f1", "f2", "part", "counts"])

    return run


def _fingerprint(s: np.ndarray, owner: np.ndarray, texts: int) -> tuple[np.ndarray, pa.Array, pa.Array]:
    """Of each set its size and two sums of hashes, whatever the order."""
    n = np.bincount(owner, minlength=texts).astype(np.int64)
    first = np.concatenate(([0], np.cumsum(n)))
    sums = [np.concatenate(([np.uint64(0)], np.cumsum(v, dtype=np.uint64))) for v in (s, mix(s))]
    return n, *(signed(c[first[1:]] - c[first[:-1]]) for c in sums)


def _add(_, rows: pa.Table) -> pa.Table:
    total = np.zeros(BUCKETS // PARTS, np.uint64)
    for c in rows["counts"]:
        total += np.frombuffer(zlib.decompress(c.as_py()), np.uint64)
    return pa.table({"part": rows["part"][:1], "counts": pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())})


def bucket_bits(survey: DataFrame) -> np.ndarray:
    """How much each bucket of shingles tells: a byte, by the logarithm of its share of all shingles; 1 MB whatever the input."""
    parts = survey.where("part IS NOT NULL").select("part", "counts")
    some = parts.withColumn("salt", F.spark_partition_id() % 64).groupBy("part", "salt").applyInArrow(lambda k, t: _add(k, t), "part int, counts binary")
    counts = np.zeros((PARTS, BUCKETS // PARTS), np.float64)
    for r in some.groupBy("part").applyInArrow(lambda k, t: _add(k, t), "part int, counts binary").collect():
        counts[r["part"]] = np.frombuffer(zlib.decompress(r["counts"]), np.uint64)
    share = (counts.reshape(-1) + 1) * BUCKETS / (counts.sum() + BUCKETS)  # 1 is a usual bucket
    return np.clip(np.round(16 - 2 * np.log2(share)), 1, 24).astype(np.uint8)


def level_sizes(most: int) -> np.ndarray:
    """The largest set size of each level, as far as sizes up to `most` need."""
    out = [8]
    while out[-1] < most:
        out.append(int(out[-1] * STEP))
    return np.array(out, np.int64)


def _levels(n: np.ndarray, percent: int) -> tuple[np.ndarray, ...]:
    """Of each sketch to make: the document's position, the level, the level's parts, how many values to retain, whether by rarity."""
    largest = n * 100 // percent  # of a partner
    tops = level_sizes(int(largest.max(initial=1)))
    own, high = np.searchsorted(tops, n), np.searchsorted(tops, largest)
    doc = np.repeat(np.arange(len(n)), high - own + 1)
    level = np.arange(len(doc)) - np.repeat(np.cumsum(high - own + 1) - (high - own + 1), high - own + 1) + own[doc]
    apart, whole = 100 - percent, 100 + percent
    worst = 2 * tops * apart // whole + 2  # as many as a pair of the level may ask for
    parts = np.ceil(SPARE * worst).astype(np.int64)
    keep = (n[doc] + np.minimum(tops[level], largest[doc])) * apart // whole + 2
    needed = (n[doc] > 0) & (keep > 2)  # without differences only equal sets are linked
    return tuple(x[needed] for x in (doc, level, parts[level], np.minimum(keep, MOST), (worst <= MOST)[level]))


def sketches(s: np.ndarray, n: np.ndarray, percent: int, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Retained values of each document's sketches, and where each document's begin (one more entry than documents)."""
    doc, level, parts, keep, rare = _levels(n, percent)
    first = np.cumsum(n) - n
    size = n[doc]
    begin = np.cumsum(size) - size
    at = np.repeat(first[doc] - begin, size) + np.arange(int(size.sum()))
    which = np.repeat(np.arange(len(doc)), size)  # sketch of each shingle
    x = s[at]
    turned = mix(x + (level[which].astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
    base = np.cumsum(parts) - parts
    part = ((turned >> np.uint64(32)) * parts[which].astype(np.uint64) >> np.uint64(32)).astype(np.int64) + base[which]
    total = int(parts.sum())
    sums, sizes, rarity = np.zeros(total, np.uint64), np.zeros(total, np.int64), np.zeros(total, np.int64)
    np.add.at(sums, part, mix(turned))
    np.add.at(sizes, part, 1)
    np.add.at(rarity, part, bits[(x >> np.uint64(44)).astype(np.int64)])
    sketch = np.repeat(np.arange(len(doc)), parts)
    index = np.arange(total) - base[sketch]
    value = mix(sums + mix((level[sketch].astype(np.uint64) << np.uint64(32)) + index.astype(np.uint64) + np.uint64(1)))
    order = np.where(rare[sketch], 254 - np.minimum(rarity, 254), 3 - np.minimum(sizes, 3))
    order = np.where(sizes > 0, order, 255).astype(np.uint64)  # empty parts come last in any case
    value = (order << np.uint64(56)) | (value >> np.uint64(8))
    sort = np.lexsort((value, sketch))
    value = value[sort]
    held = index < keep[sketch]  # places within the sorted sketch are as the indexes were
    counts = np.zeros(len(n) + 1, np.int64)
    np.add.at(counts, doc + 1, np.minimum(keep, parts))
    return value[held], np.cumsum(counts)


def _keys(size: int, percent: int, bits):
    def run(batches):
        for batch in batches:
            s, owner = _shingles(texts_of(batch.column(2)), size)
            n, f1, f2 = _fingerprint(s, owner, len(batch))
            values, at = sketches(s, n, percent, bits.value)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(n), f1, f2, pa.ListArray.from_arrays(pa.array(at, pa.int32()), signed(values))], ["id", "th", "n", "f1", "f2", "keys"])

    return run


def odd_sketch(s: np.ndarray, owner: np.ndarray, texts: int) -> np.ndarray:
    """ODD words of 64 bits a set: of each bit's hashes, whether their number is odd. Sets differ in no fewer elements than their sketches in bits."""
    place = owner * (64 * ODD) + ((mix(s) >> np.uint64(32)) * np.uint64(64 * ODD) >> np.uint64(32)).astype(np.int64)
    odd = (np.bincount(place, minlength=texts * 64 * ODD) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view(np.int64).reshape(texts, ODD)


def _sets(size: int):
    def run(batches):
        for batch in batches:
            s, owner = _shingles(texts_of(batch.column(1)), size)
            n = np.bincount(owner, minlength=len(batch))
            at = np.concatenate(([0], np.cumsum(n)))
            low = np.arange(len(s)) - at[owner] < UNION
            ends = np.concatenate(([0], np.cumsum(np.minimum(n, UNION))))
            odd = odd_sketch(s, owner, len(batch))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), signed(s[low])), pa.ListArray.from_arrays(pa.array(at, pa.int32()), signed(s))
            yield pa.record_batch([batch.column(0), pa.array(n), *(pa.array(odd[:, k]) for k in range(ODD)), *lists], ["id", "n", *_ODD, "low", "shingles"])

    return run


def estimate(x: np.ndarray, y: np.ndarray) -> float:
    """The similarity of two sets by their union's bottom UNION hashes (exact for sets that are no larger)."""
    union = np.union1d(x, y)[:UNION]
    both = np.intersect1d(x, y, assume_unique=True)
    return np.count_nonzero(both <= union[-1]) / len(union)


def _estimated(percent: int):
    """Whether a pair's estimate is at least half of what is asked: from 64 hashes, a linked pair falls below with a probability under 1e-10."""
    return lambda u, v: 200 * estimate(u, v) >= percent


def _confirmed(percent: int):
    def fits(u: np.ndarray, v: np.ndarray) -> bool:
        both = len(np.intersect1d(u, v, assume_unique=True))
        return 100 * both >= percent * (len(u) + len(v) - both)

    return fits


def _kept(fits):
    """The pairs whose two arrays (the third column, in either order) fit."""

    def run(batches):
        for batch in batches:
            both = batch.column(2)
            keep = [fits(*(x.values.to_numpy(zero_copy_only=False).view(np.uint64) for x in p.values)) for p in both]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _fitting(pairs: DataFrame, sets: DataFrame, column: str, fits) -> DataFrame:
    """Those of the written pairs (a, b) whose arrays fit. Only the arrays that a pair needs travel, to the pair."""
    needed = small(pairs).select(F.explode(F.array("a", "b")).alias("id"), "a", "b")
    both = sets.select("id", F.col(column).alias("x")).join(needed, "id").groupBy("a", "b").agg(F.collect_list("x").alias("both"))
    return both.mapInArrow(tidy(_kept(fits)), "a long, b long")


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) that are near: by the union sketch, then by the full sets."""
    pairs = cut(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
    near = cut(_fitting(pairs, sets, "low", _estimated(percent)), "near")
    return cut(_fitting(near, sets, "shingles", _confirmed(percent)), "links")


def _open(lists: DataFrame, groups: DataFrame) -> DataFrame:
    """(v, rep, c, lesser, blocks): members, with their components, of the lists that hold more than one component; lesser: not of the list's largest one; blocks: how many the list is dealt into, a power of two."""
    now = lists.join(small(groups).withColumnRenamed("id", "rep"), "rep", "left").select("v", "rep", F.coalesce("component", "rep").alias("c"))
    held = now.groupBy("v", "c").agg(F.count("*").alias("size"))
    several = held.groupBy("v").agg(F.count("*").alias("n"), F.max(F.struct("size", "c")).alias("most"), F.sum("size").alias("all")).where("n > 1")
    several = several.select("v", F.col("most.c").alias("largest"), F.expr(f"CAST(pow(2, ceil(log2(greatest(1, all / {BLOCK})))) AS long)").alias("blocks"))
    several = cut(several, "several")  # written first, so that the join can be split at a hot value
    return cut(now.join(small(several), "v").select("v", "rep", "c", (F.col("c") != F.col("largest")).alias("lesser"), "blocks"), "open")


def _meetings(held: DataFrame, hubs: DataFrame, marks: DataFrame, percent: int) -> DataFrame:
    """(a, b): each hub with the members of its lists that are of other components and that size and odd sketch leave possible.

    Two sets close to the similarity share a hundred lists, so a hub meets blocks of lists, and what it met in like blocks
    is made one before it becomes rows. Blocks go by the members' hashes: a pair is in the same block of lists of like size.
    """
    both = held.join(marks, "rep")
    blocks = both.groupBy("v", "blocks", F.pmod(F.xxhash64("rep"), "blocks").alias("block")).agg(F.collect_list(F.struct("rep", "c", "n", *_ODD)).alias("members"))
    first = both.join(hubs, "rep", "left_semi").select("v", F.col("rep").alias("a"), F.col("c").alias("d"), F.col("n").alias("m"), *(F.col(o).alias(f"{o}_a") for o in _ODD))
    odd = " + ".join(f"bit_count(x.{o} ^ {o}_a)" for o in _ODD)
    possible = f"x.c <> d AND 100 * least(x.n, m) >= {percent} * greatest(x.n, m) AND ({100 + percent}) * ({odd}) <= ({100 - percent}) * (x.n + m)"
    met = blocks.join(first, "v").select("a", "blocks", "block", F.expr(f"transform(filter(members, x -> {possible}), x -> x.rep)").alias("met"))
    once = met.groupBy("a", "blocks", "block").agg(F.array_distinct(F.flatten(F.collect_list("met"))).alias("met"))
    return once.select("a", F.explode("met").alias("b"))


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: id, n_shingles, component_id (the smallest id reachable over links), kept, text_hash.

    Two documents are linked if 100 * |intersection| >= percent * |union| of their sets of `shingle`-word shingles,
    words being runs without ASCII white space with A-Z lower-cased. text_hash is the row's xxhash64(text).
    """
    spark = docs.sparkSession
    with scratch():
        bounded_batches(spark, mb=2)
        kind = dict(docs.dtypes)[id_col]
        base = docs.select(F.col(id_col).alias("id"), text_hash(text_col).alias("th"), F.col(text_col).alias("text"))
        survey = cut(base.mapInArrow(tidy(_survey(shingle)), f"id {kind}, th long, n long, f1 long, f2 long, part int, counts binary"), "survey")
        bits = spark.sparkContext.broadcast(bucket_bits(survey))
        rows = survey.where("part IS NULL").select("id", "th", "n", "f1", "f2")
        keyed = base.mapInArrow(tidy(_keys(shingle, percent, bits)), f"id {kind}, th long, n long, f1 long, f2 long, keys array<long>").where("n > 0")
        sets = keyed.groupBy("f1", "f2", "n").agg(F.min("id").alias("least"), F.min(F.struct("id", "th")).alias("at"), F.first("keys").alias("keys"))
        sets = cut(sets.withColumn("rep", F.monotonically_increasing_id()), "distinct")  # written, so that the numbers stay

        keys = sets.select(F.explode("keys").alias("v"), "rep")
        shared = cut(keys.groupBy("v").agg(F.count("*").alias("size")).where("size > 1"), "shared")
        lists = cut(keys.join(shared, "v"), "lists")
        wanted = sets.join(small(cut(lists.select("rep").distinct(), "listed")), "rep", "left_semi").select("rep", "at.id", "at.th")
        wanted = small(cut(wanted, "wanted")).select("rep", F.col("id").alias("_id"), F.col("th").alias("_th"))
        full = base.join(wanted, F.col("id").eqNullSafe(F.col("_id")) & (F.col("th") == F.col("_th"))).select("rep", "text").dropDuplicates(["rep"])
        full = cut(full.mapInArrow(tidy(_sets(shingle)), f"id long, n long, {', '.join(f'{o} long' for o in _ODD)}, low array<long>, shingles array<long>"), "sets")

        # At first each document meets one: of its lists' most central members, which are in the largest lists, the one it meets most often.
        ranked = lists.join(lists.groupBy("rep").agg(F.sum("size").alias("score")), "rep")
        central = ranked.groupBy("v").agg(F.max(F.struct("score", "rep")).alias("c")).select("v", F.col("c.rep").alias("hub"))
        met = lists.join(central, "v").where("rep <> hub").groupBy("rep", "hub").agg(F.count("*").alias("met")).groupBy("rep").agg(F.max(F.struct("met", "hub")).alias("c"))
        groups = components(_linked(met.select(F.col("rep").alias("a"), F.col("c.hub").alias("b")), full, percent))
        marks = small(full).select(F.col("id").alias("rep"), "n", *_ODD)
        rest, turn = lists.select("v", "rep"), 0
        while not (held := _open(rest, groups)).isEmpty():
            # Members outside a list's largest component meet all others, some of each list at a time, and leave: at last one component remains.
            order = F.xxhash64("rep", F.lit(turn))
            slots = F.pmod(order, F.lit(min(8 << 2 * turn, HUBS)))
            hubs = held.where("lesser").groupBy("v", slots).agg(F.min(F.struct(order.alias("o"), "rep")).alias("h"))
            hubs = small(cut(hubs.select("h.rep").distinct(), "hubs"))
            found = _linked(_meetings(held, hubs, marks, percent), full, percent)
            rest = held.join(hubs, "rep", "left_anti").select("v", "rep")
            if not found.isEmpty():
                groups = components(found.unionByName(groups.select(F.col("id").alias("a"), F.col("component").alias("b"))))
            turn += 1
        ids = sets.select("f1", "f2", "n", "rep", "least")
        roots = ids.join(groups.withColumnRenamed("id", "rep"), "rep", "left").select("f1", "f2", "n", "least", F.coalesce("component", "rep").alias("root"))
        least = ids.join(groups.select(F.col("id").alias("rep"), "component").unionByName(groups.select(F.col("component").alias("rep"), "component").distinct()), "rep").groupBy("component").agg(F.min("least").alias("of_all"))
        roots = roots.join(least, F.col("root") == F.col("component"), "left").select("f1", "f2", "n", F.when(F.col("component").isNotNull(), F.col("of_all")).otherwise(F.col("least")).alias("least"), F.lit(True).alias("known"))
        out = rows.join(roots, ["f1", "f2", "n"], "left").select("id", "n", F.when(F.col("known"), F.col("least")).otherwise(F.col("id")).alias("component"), "th")
        out = out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.col("id").eqNullSafe(F.col("component")).alias("kept"), F.col("th").alias("text_hash"))
        return cut(out, "near-duplicates", outer=True)


def op9(spark, sf_dir) -> DataFrame:
    from .common import table

    return near_duplicates(table(spark, sf_dir, "documents"), shingle=2, percent=80).drop("text_hash")


SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i + 1:i + 2], ' ') AS g FROM (SELECT doc_id, w, unnest(range(greatest(len(w) - 1, 1))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
met AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM met JOIN n na ON a = na.doc_id JOIN n nb ON b = nb.doc_id WHERE 100 * c >= 80 * (na.n + nb.n - c)),
reach AS (SELECT doc_id AS id, doc_id AS c FROM documents UNION SELECT b, c FROM reach JOIN link ON id = a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
FROM (SELECT id AS doc_id, min(c) AS component_id FROM reach GROUP BY id) LEFT JOIN n USING (doc_id)
"""
