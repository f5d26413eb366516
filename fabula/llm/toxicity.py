"""Toxicity scores from subword-bag embeddings under a linear softmax, trained jointly in numpy (operator 1).

A word is the bag of its character n-grams and itself, hashed to a fixed table of vectors; the average of the bag's
vectors goes through a linear softmax. A misspelling that was never seen shares n-grams, so it shares vectors. A
document's score is its most toxic word's; in training, words share a document's gradient by a softmax over their own
scores, and vectors and softmax weights are learnt together.

The model is fitted on the driver on a bounded sample of labelled rows (`sample_rows`, texts up to `sample_chars`), the
smallest by a hash of their id; everything else covers all rows. Executors get one number a bucket, 512 KB.

Defined cases: null and empty texts and texts without words get the score of an empty bag; labels that are null or
belong to no document are ignored; repeated rows are scored alike; without labels of both kinds every score is 0; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BYTES, bounded_batches, tidy

BUCKETS, GRAMS = 1 << 17, (3, 4, 5)
#: Separators: ASCII other than letters and digits. Texts are lower-cased before.
_WORD = np.ones(256, bool)
_WORD[[c for c in range(128) if not chr(c).isalnum()]] = False
_BLOCK = 1 << 20


def _bags(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text's words, and where each word's begin (one more entry than words)."""
    data = np.frombuffer(b" " + text + b" ", np.uint8)
    inside = _WORD[data]
    data = np.where(inside, data, 32).astype(np.uint64) + np.uint64(1)
    edge = np.diff(inside.view(np.int8))
    starts, stops = np.flatnonzero(edge == 1) + 1, np.flatnonzero(edge == -1) + 1
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(1, np.int64)
    prefix = BYTES.prefix(data)
    size = stops - starts + 1  # places where an n-gram may begin, the separator before the word too
    word = np.repeat(np.arange(len(starts)), size)
    place = np.arange(len(word)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(starts - 1, size)
    end = (stops + 1)[word]
    found, owner = [BYTES.spans(prefix, starts, stops)], [np.arange(len(starts))]
    for n in GRAMS:
        ok = place + n <= end
        found.append(BYTES.spans(prefix, place[ok], place[ok] + n))
        owner.append(word[ok])
    owner = np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    buckets = (np.concatenate(found)[order] >> np.uint64(64 - 17)).astype(np.int64)
    return buckets, np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=len(starts)))))


def prepare(text: str | None) -> bytes:
    return (text or "").lower().encode()


def _blocks(text: bytes):
    """A long text in blocks that end between words (a word longer than a block is cut)."""
    at = 0
    while at < len(text):
        stop = min(len(text), at + _BLOCK)
        if stop < len(text) and (space := text.rfind(b" ", at, stop)) > at:
            stop = space
        yield text[at:stop]
        at = stop


class Model:
    """What scoring needs: the softmax's log-odds of each bucket's vector, and of an empty bag; pool: how a document's words become one (max or mean)."""

    def __init__(self, odds: np.ndarray, bias: float, pool: str = "max"):
        self.odds, self.bias, self.pool = odds.astype(np.float32), float(bias), pool

    def words(self, text: bytes) -> np.ndarray:
        """Log-odds of each word: of the average of its bag, as the softmax is linear."""
        buckets, at = _bags(text)
        if len(at) == 1:
            return np.zeros(0)
        return np.add.reduceat(self.odds[buckets], at[:-1], dtype=np.float64) / np.diff(at)

    def score(self, text: str | None) -> float:
        parts = [w for b in _blocks(prepare(text)) if len(w := self.words(b))]
        if self.pool == "mean":
            best = sum(float(w.sum()) for w in parts) / max(1, sum(map(len, parts)))
        else:
            best = max((float(w.max()) for w in parts), default=0.0)
        return float(1 / (1 + np.exp(-np.clip(self.bias + best, -30, 30))))


def train(rows: list[tuple[str, int]], dims: int = 8, sharp: float = 10.0, epochs: int = 3, batch: int = 64, rate: float = 0.2, prior: float = 10.0, seed: int = 1, rate_of_toxic: float | None = None, pool: str = "max", start: str = "ratios") -> Model:
    """Fit vectors and softmax together. rows: texts and labels.

    pool and start exist for comparison (README has the figures): mean averages all words of a document, random starts
    vectors without the labels' ratios.
    """
    labels = np.array([y for _, y in rows], float)
    if not len(rows) or labels.min() == labels.max():
        return Model(np.zeros(BUCKETS), -30.0)
    rate_of_toxic = rate_of_toxic or labels.mean()
    known: dict[bytes, int] = {}
    docs = []
    for text, _ in rows:  # each document's distinct words, and every word's bag once
        clean = prepare(text).translate(bytes(c if _WORD[c] else 32 for c in range(256)))
        docs.append(np.array(sorted({known.setdefault(w, len(known)) for w in clean.split()}), np.int64))
    words, parts, at = list(known), [], np.zeros(1, np.int64)
    for i in range(0, len(words), 20_000):  # in blocks, to bound the driver's memory
        found, first = _bags(b" ".join(words[i : i + 20_000]))
        parts.append(found.astype(np.int32))
        at = np.concatenate((at, first[1:] + at[-1]))
    bags = np.concatenate(parts) if parts else np.zeros(0, np.int32)
    del words, parts
    rng = np.random.default_rng(seed)
    sharp = 0.0 if pool == "mean" else sharp
    # Vectors start along the softmax's direction, as far as documents of one label hold a bucket more than is usual.
    held = np.zeros((2, BUCKETS))
    for words, y in zip(docs, labels.astype(int), strict=True):
        n = at[words + 1] - at[words]
        ends = np.cumsum(n)
        if len(words):
            held[y, np.unique(bags[np.arange(ends[-1]) + np.repeat(at[words] - (ends - n), n)])] += 1
    usual = np.array([[1 - labels.mean()], [labels.mean()]])
    lift = np.log((held + prior * usual) / ((held.sum(0) + prior) * usual))
    weights = rng.normal(0, 1, dims)  # the softmax's difference of classes
    weights /= np.linalg.norm(weights)
    vectors = (lift[1] - lift[0])[:, None] * weights * (start == "ratios") + rng.normal(0, 0.01, (BUCKETS, dims))
    bias, grown, grown_w = -3.0, np.full(BUCKETS, 1e-6), 1e-6
    share = np.where(labels > 0, 0.5 / labels.mean(), 0.5 / (1 - labels.mean()))
    for _ in range(epochs):
        order = rng.permutation(len(docs))
        for chosen in np.split(order, range(batch, len(order), batch)):
            chosen = [d for d in chosen if len(docs[d])]
            if not chosen:
                continue
            words = np.concatenate([docs[d] for d in chosen])
            sizes = np.array([len(docs[d]) for d in chosen])
            first = np.cumsum(sizes) - sizes
            n = at[words + 1] - at[words]
            ends = np.cumsum(n)
            buckets = bags[np.arange(ends[-1]) + np.repeat(at[words] - (ends - n), n)]
            mean = np.add.reduceat(vectors[buckets], ends - n) / n[:, None]
            s = mean @ weights
            top = np.maximum.reduceat(s, first)
            pull = np.exp(sharp * (s - np.repeat(top, sizes)))
            pull /= np.repeat(np.add.reduceat(pull, first), sizes)
            z = bias + np.add.reduceat(pull * s, first)
            off = share[chosen] * (1 / (1 + np.exp(-z)) - labels[chosen])  # gradient of the cross entropy
            each = pull * np.repeat(off, sizes)
            push = np.bincount(buckets, np.repeat(each / n, n), BUCKETS)
            turn = each @ mean
            grown += push**2
            grown_w += turn @ turn
            vectors -= (rate * push / np.sqrt(grown))[:, None] * weights
            weights -= 0.1 * rate * turn / np.sqrt(grown_w)
            bias -= 0.02 * rate * off.mean()
    # The softmax's scale and bias once more, on whole documents' scores at the labels' own rate.
    odds = vectors @ weights
    each = np.add.reduceat(odds[bags], at[:-1]) / np.diff(at) if len(known) else np.zeros(0)
    best = np.array([(each[words].mean() if pool == "mean" else each[words].max()) if len(words) else 0.0 for words in docs])
    share = np.where(labels > 0, rate_of_toxic / labels.mean(), (1 - rate_of_toxic) / (1 - labels.mean()))
    x, fit = np.stack([best, np.ones(len(best))], 1), np.array([1.0, bias])
    for _ in range(50):  # Newton's method, drawn a little to scale 1
        q = 1 / (1 + np.exp(-np.clip(x @ fit, -30, 30)))
        slope = x.T @ (share * (q - labels)) + np.array([fit[0] - 1, 0.0])
        curve = (x * (share * q * (1 - q))[:, None]).T @ x + np.diag([1.0, 1e-3])
        fit = fit - np.clip(np.linalg.solve(curve, slope), -1, 1)
    return Model(odds * max(fit[0], 0.1), fit[1], pool)


def training_rows(docs: DataFrame, labels: DataFrame, sample_rows: int = 6000, sample_chars: int = 20_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", held_out: bool = True) -> tuple[list[tuple[str, int]], float]:
    """At most sample_rows labelled (text, label), half of each label where there are enough, and the rate of label 1 over all labels; rows held out for measuring stay out."""
    rows = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("y IN (0, 1) AND id IS NOT NULL")
    if held_out:
        rows = rows.where(F.crc32(F.col("id").cast("string")) % 4 != 2)
    rate = rows.agg(F.avg("y")).first()[0] or 0.0
    order = F.xxhash64("id")
    picked = [rows.where(F.col("y") == y).dropDuplicates(["id"]).orderBy(order, "id").limit(sample_rows // 2) for y in (0, 1)]
    picked = F.broadcast(picked[0].unionByName(picked[1]))  # bounded by sample_rows
    got = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(picked, "id").where(F.length("text") <= sample_chars).groupBy("id", "y").agg(F.min("text").alias("text"))
    return [(r["text"], r["y"]) for r in sorted(got.collect(), key=lambda r: (str(r["id"]), r["y"]))], rate


def _score(shared, threshold: float):  # shared: odds, bias and pool
    def run(batches):
        model = Model(*shared.value)
        for batch in batches:
            scores = [model.score(t) for t in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32())], ["id", "score", "predicted"])

    return run


def score_documents(docs: DataFrame, model: Model, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: id, score, predicted."""
    spark = docs.sparkSession
    bounded_batches(spark)
    kind = dict(docs.dtypes)[id_col]
    shared = spark.sparkContext.broadcast((model.odds, model.bias, model.pool))
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(tidy(_score(shared, threshold)), f"id {kind}, score double, predicted int").withColumnRenamed("id", id_col)


def filter_documents(docs: DataFrame, model: Model, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, whose text scores below the threshold."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((model.odds, model.bias, model.pool))
    at = docs.columns.index(text_col)

    def run(batches):
        model = Model(*shared.value)
        for batch in batches:
            yield batch.filter(pa.array([model.score(t) < threshold for t in batch.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(tidy(run), docs.schema)


def fit(docs: DataFrame, labels: DataFrame, **bounds) -> Model:
    rows, rate = training_rows(docs, labels, **bounds)
    return train(rows, rate_of_toxic=rate)


def op1(spark, sf_dir) -> DataFrame:
    from .common import table

    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"))
    scored = score_documents(docs, model)
    return scored.select("doc_id", (F.crc32(F.col("doc_id").cast("string")) % 4 == 2).alias("held_out"), "score", "predicted")
