"""Model calls behind a small interface; the default answers offline and always alike."""

from __future__ import annotations

import hashlib
import time
import uuid
from collections.abc import Callable, Sequence
from typing import Protocol

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fabula.functions.jsonx import extract


class Provider(Protocol):
    def complete(self, messages: Sequence[dict], max_tokens: int = 512, temperature: float = 0.0) -> str: ...

    def embed(self, texts: Sequence[str]) -> list[list[float]]: ...


class Offline:
    """Answers with a digest of the question; embeds by hashing words. For tests and dry runs."""

    def __init__(self, size: int = 64):
        self.size = size

    def complete(self, messages: Sequence[dict], max_tokens: int = 512, temperature: float = 0.0) -> str:
        return hashlib.sha256("\n".join(m["content"] for m in messages).encode()).hexdigest()[:16]

    def embed(self, texts: Sequence[str]) -> list[list[float]]:
        out = []
        for text in texts:
            v = [0.0] * self.size
            for w in text.lower().split():
                h = int.from_bytes(hashlib.md5(w.encode()).digest()[:8], "little")
                v[h % self.size] += 1.0 if h >> 63 else -1.0
            n = max(1e-12, sum(x * x for x in v) ** 0.5)
            out.append([x / n for x in v])
        return out


class Routes:
    """Several providers in order, each tried a few times; an empty answer is a failure."""

    def __init__(self, routes: Sequence[Provider], tries: int = 3, pause: float = 1.0):
        self.routes, self.tries, self.pause = list(routes), tries, pause

    def complete(self, messages: Sequence[dict], max_tokens: int = 512, temperature: float = 0.0) -> str:
        last: Exception | None = None
        for route in self.routes:
            for k in range(self.tries):
                try:
                    if answer := route.complete(messages, max_tokens, temperature).strip():
                        return answer
                    last = ValueError("empty answer")
                except Exception as e:  # noqa: BLE001  the next route may work
                    last = e
                if k + 1 < self.tries:
                    time.sleep(self.pause)
        raise RuntimeError("no route answered") from last

    def embed(self, texts: Sequence[str]) -> list[list[float]]:
        return self.routes[0].embed(texts)


def ask_json(provider: Provider, messages: Sequence[dict], tries: int = 4) -> str | None:
    """A JSON answer: each try is read tolerantly, and if that fails the model is asked once to mend it."""
    for _ in range(tries):
        answer = provider.complete(messages)
        if found := extract(answer):
            return found
        if found := extract(provider.complete([{"role": "user", "content": "Return only the valid JSON of this text:\n" + answer}])):
            return found
    return None


def kept(rows: DataFrame) -> DataFrame:
    """Rows that calls were paid for: written to spark.checkpoint.dir and read again where that is set, else persisted, so that no later step asks again."""
    spark = rows.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        return rows.persist()
    path = f"{folder.rstrip('/')}/answers-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def complete_column(rows: DataFrame, messages: str, out: str, provider: Callable[[], Provider], as_json: bool = False) -> DataFrame:
    """rows with the model's answer to the column of messages (array of role and content); a provider for each task."""
    schema = rows.withColumn(out, F.lit(None).cast("string")).schema
    at = rows.columns.index(messages)

    def run(batches):
        model = provider()
        for batch in batches:
            answers = [None if m is None else ask_json(model, m) if as_json else model.complete(m) for m in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(answers, pa.string())], [*batch.schema.names, out])

    return kept(rows.mapInArrow(run, schema))


def embed_column(rows: DataFrame, text: str, out: str, provider: Callable[[], Provider], prefix: str = "", size: int = 32) -> DataFrame:
    """rows with the text's embedding, in calls of `size` texts; prefix: what the model wants before queries or documents."""
    schema = rows.withColumn(out, F.lit(None).cast("array<double>")).schema
    at = rows.columns.index(text)

    def run(batches):
        model = provider()
        for batch in batches:
            texts = [prefix + (t or "") for t in batch.column(at).to_pylist()]
            vectors = [v for i in range(0, len(texts), size) for v in model.embed(texts[i : i + size])]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(vectors, pa.list_(pa.float64()))], [*batch.schema.names, out])

    return kept(rows.mapInArrow(run, schema))


def judge_column(provider: Callable[[], Provider]):
    """A column function for yes-or-no questions."""

    @F.pandas_udf("string")
    def ask(questions: pd.Series) -> pd.Series:
        model = provider()
        return questions.map(lambda q: model.complete([{"role": "user", "content": q}], 8, 0.0))

    from fabula.functions.values import parse_bool

    return lambda c: parse_bool(ask(c))
