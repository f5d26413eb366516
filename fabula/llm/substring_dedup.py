"""Exact substring deduplication of whole texts (operator 3).

Two ways with one meaning, "remove words covered by a passage of at least `window` words that also starts elsewhere":

* `SuffixAutomaton` / `remove_known_passages`: broadcast suffix automata of bounded reference shards; documents stream
  through them, matching statistics give the spans to remove. For references of a checked size.
* `remove_repeated`: every document is reference for every other. Streaming all documents through the automata of all
  shards grows with the square of the corpus, so the reference is cut by content instead: each window belongs to the
  piece around its smallest k-gram hash, equal windows meet in the same piece key, and only pieces whose key occurs
  twice are compared (README, operator 3, has the figures).

Defined cases: null and empty texts have no words; repeated rows repeat each other's windows; texts shorter than the
window lose nothing; an empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import FIRST, SECOND, bounded_batches, cut, mix, signed, texts_of, word_hashes

#: Words in a k-gram of the content-defined cut.
GRAM = 6
_COEFFICIENTS = mix(np.arange(1, GRAM + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


class SuffixAutomaton:
    """Suffix automaton of one reference shard of word sequences; a separator that no word equals stands between them."""

    def __init__(self, sequences: list[list[bytes]]):
        self.next: list[dict] = [{}]
        self.link, self.length = [-1], [0]
        last = 0
        for k, words in enumerate(sequences):
            for w in [*words, k]:
                last = self._extend(last, w)

    def _extend(self, last: int, w) -> int:
        nxt, link, length = self.next, self.link, self.length
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and w not in nxt[p]:
            nxt[p][w] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][w]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(dict(nxt[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and nxt[p].get(w) == q:
                    nxt[p][w] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        return cur

    def statistics(self, words: list[bytes]) -> Iterator[int]:
        """For each word, the length of the longest passage that ends there and occurs in the shard."""
        state = matched = 0
        for w in words:
            while state and w not in self.next[state]:
                state = self.link[state]
                matched = self.length[state]
            if w in self.next[state]:
                state = self.next[state][w]
                matched += 1
            else:
                matched = 0
            yield matched

    def spans(self, words: list[bytes], window: int) -> list[tuple[int, int]]:
        """Maximal spans of words covered by matches of at least `window` words."""
        out: list[list[int]] = []
        for i, m in enumerate(self.statistics(words), 1):
            if m >= window:
                if out and i - m <= out[-1][1]:
                    out[-1] = [min(out[-1][0], i - m), i]
                else:
                    out.append([i - m, i])
        return [(a, b) for a, b in out]


def _kept(text: bytes, spans: list[tuple[int, int]]) -> tuple[int, int, bytes]:
    words = text.split()
    gone = np.zeros(len(words) + 1, np.int64)
    for a, b in spans:
        gone[a] += 1
        gone[b] -= 1
    gone = np.cumsum(gone)[:-1] > 0
    return len(words), int(gone.sum()), b" ".join(w for w, g in zip(words, gone, strict=True) if not g) if gone.any() else b" ".join(words)


def remove_known_passages(docs: DataFrame, references: list[list[str]], window: int = 35, max_reference_words: int = 2_000_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Remove from docs the passages of at least `window` words that occur in the reference shards (lists of texts).

    The automata are broadcast, so the references' size is checked: more than `max_reference_words` words are refused.
    Returns id, n_words, n_removed, text (kept words joined by one space).
    """
    shards = [[t.encode().split() for t in shard] for shard in references]
    if (n := sum(len(w) for shard in shards for w in shard)) > max_reference_words:
        raise ValueError(f"{n} reference words are more than {max_reference_words}; use remove_repeated")
    automata = docs.sparkSession.sparkContext.broadcast([SuffixAutomaton(shard) for shard in shards])

    def run(batches):
        for batch in batches:
            rows = [_kept(t, [s for a in automata.value for s in a.spans(t.split(), window)]) for t in texts_of(batch.column(1))]
            yield pa.record_batch([batch.column(0), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2].decode() for r in rows], pa.string())], ["id", "n_words", "n_removed", "text"])

    kind = dict(docs.dtypes)[id_col]
    bounded_batches(docs.sparkSession)
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).mapInArrow(run, f"id {kind}, n_words long, n_removed long, text string").withColumnRenamed("id", id_col)


def _pieces(window: int):
    """Of each document: its pieces, that is runs of windows with the same smallest k-gram (the leftmost of equal ones)."""
    grams = window - GRAM + 1

    def run(batches):
        for batch in batches:
            x, at = word_hashes(texts_of(batch.column(2)))
            n = len(x) - window + 1
            if n <= 0:
                continue
            k = sum(x[j : len(x) - GRAM + 1 + j] * _COEFFICIENTS[j] for j in range(GRAM))
            k = mix(k)
            least = np.empty(n, np.int64)
            for a in range(0, n, 1 << 18):  # in blocks, to bound the memory
                b = min(n, a + (1 << 18))
                least[a:b] = np.lib.stride_tricks.sliding_window_view(k[a : b + grams - 1], grams).argmin(1) + np.arange(a, b)
            doc = np.repeat(np.arange(len(at) - 1), np.diff(at))[:n]
            starts = np.arange(n)
            whole = starts + window <= at[doc + 1]
            starts, doc, least = starts[whole], doc[whole], least[whole]
            if not len(starts):
                continue
            new = np.concatenate(([True], (np.diff(starts) != 1) | (np.diff(doc) != 0) | (np.diff(least) != 0)))
            first = np.flatnonzero(new)
            size = np.diff(np.concatenate((first, [len(starts)])))
            a, d = starts[first], doc[first]
            b = a + size - 1 + window
            key = k[least[first]]
            p1, p2 = (r.spans(r.prefix(x), a, b) for r in (FIRST, SECOND))
            take = pa.array(d)
            yield pa.record_batch([batch.column(0).take(take), batch.column(1).take(take), pa.array((a - at[d]).astype(np.int64)), pa.array(size.astype(np.int32)), signed(key), signed(p1), signed(p2)], ["id", "th", "a", "n", "k", "p1", "p2"])

    return run


def _windows(window: int):
    """Of each document with pieces to compare: the hashes of their windows."""

    def run(batches):
        for batch in batches:
            x, at = word_hashes(texts_of(batch.column(2)))
            pre1, pre2 = FIRST.prefix(x), SECOND.prefix(x)
            for i, pieces in enumerate(batch.column(3).to_pylist()):
                if not pieces:
                    continue
                a = np.concatenate([np.arange(p["a"], p["a"] + p["n"]) for p in pieces])
                c = np.concatenate([np.full(p["n"], min(p["c"], 2)) for p in pieces])
                s = a + at[i]
                take = pa.array(np.full(len(a), i))
                yield pa.record_batch([batch.column(0).take(take), batch.column(1).take(take), pa.array(a), pa.array(c.astype(np.int32)), signed(FIRST.spans(pre1, s, s + window)), signed(SECOND.spans(pre2, s, s + window))], ["id", "th", "a", "c", "w1", "w2"])

    return run


def _remove(window: int):
    def run(batches):
        for batch in batches:
            out = []
            for text, spans in zip(texts_of(batch.column(2)), batch.column(3).to_pylist(), strict=True):
                out.append(_kept(text, [(s["a"], s["a"] + s["n"] - 1 + window) for s in spans or []]))
            yield pa.record_batch([batch.column(0), pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64()), pa.array([o[2].decode() for o in out], pa.string())], ["id", "n_words", "n_removed", "kept"])

    return run


def remove_repeated(docs: DataFrame, window: int = 35, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Remove each word covered by a window of `window` words whose words also start anywhere else in docs.

    Returns id, n_words, n_removed, kept (the kept words joined by one space), one row for each input row. Rows are
    told apart by id and text, so that repeated ids do no harm.
    """
    if window < GRAM:
        raise ValueError(f"window must be {GRAM} words at least")
    spark = docs.sparkSession
    bounded_batches(spark)
    kind = dict(docs.dtypes)[id_col]
    base = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("th"), F.col(text_col).alias("text"))
    pieces = base.mapInArrow(_pieces(window), f"id {kind}, th long, a long, n int, k long, p1 long, p2 long")
    # Written first, so that the join that follows can split the pieces of a hot key over tasks.
    twice = cut(pieces.groupBy("k").agg(F.count("*").alias("c")).where("c >= 2").select("k"), "twice")
    met = cut(pieces.join(twice, "k", "left_semi"), "pieces")  # the pieces whose key occurs twice; few beside all windows
    kinds = cut(met.groupBy("p1", "p2").agg(F.count("*").alias("c"), F.min("k").alias("k"), F.min(F.struct("id", "th", "a", "n")).alias("at")), "kinds")
    whole = met.join(kinds.where("c >= 2").select("p1", "p2"), ["p1", "p2"], "left_semi").select("id", "th", "a", "n")
    # Of a key with several contents, windows are compared one by one, a representative of each content.
    several = kinds.join(kinds.groupBy("k").agg(F.count("*").alias("d")).where("d >= 2").select("k"), "k", "left_semi")
    compare = several.select("at.id", "at.th", F.struct("at.a", "at.n", "c").alias("p")).groupBy("id", "th").agg(F.collect_list("p").alias("pieces"))
    same = lambda x, y: x["id"].eqNullSafe(y["id"]) & x["th"].eqNullSafe(y["th"])
    windows = base.join(compare, same(base, compare)).select(base["id"], base["th"], "text", "pieces").dropDuplicates(["id", "th"])
    windows = cut(windows.mapInArrow(_windows(window), f"id {kind}, th long, a long, c int, w1 long, w2 long"), "windows")
    again = windows.groupBy("w1", "w2").agg(F.sum("c").alias("c")).where("c >= 2").select("w1", "w2")
    single = windows.where("c = 1").join(again, ["w1", "w2"], "left_semi").select("id", "th", "a", F.lit(1).alias("n"))
    spans = whole.unionByName(single).groupBy("id", "th").agg(F.collect_set(F.struct("a", "n")).alias("spans"))
    joined = base.join(spans, same(base, spans), "left").select(base["id"], base["th"], "text", "spans")
    return joined.mapInArrow(_remove(window), f"id {kind}, n_words long, n_removed long, kept string").withColumnRenamed("id", id_col)


def op3(spark, sf_dir) -> DataFrame:
    from .common import table

    kept = remove_repeated(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT r, i, array_to_string(w[i + 1:i + 35], ' ') AS g FROM (SELECT r, w, unnest(range(len(w) - 34)) AS i FROM d WHERE len(w) >= 35)),
t AS (SELECT r, i FROM s QUALIFY count(*) OVER (PARTITION BY g) > 1),
c AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS p FROM t),
k AS (SELECT r, string_agg(x, ' ' ORDER BY p) AS body, count(*) AS n FROM (SELECT r, unnest(w) AS x, generate_subscripts(w, 1) - 1 AS p FROM d) ANTI JOIN c USING (r, p) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(body, '')) AS kept_sha256 FROM d LEFT JOIN k USING (r)
"""
