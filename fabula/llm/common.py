"""What the operators of this subpackage share: tables cut to the shared folder, Arrow batches, word hashes."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of the contracts: U+0020 and U+0009 to U+000D.
ASCII_SPACE = (9, 10, 11, 12, 13, 32)

_own_dir: str | None = None


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where that is unset, a folder of our own, which only a local master can share."""
    global _own_dir
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    _own_dir = _own_dir or tempfile.mkdtemp(prefix="fabula-")
    return f"file://{_own_dir}"


_scopes: list[list[tuple[SparkSession, str]]] = []


@contextmanager
def scratch() -> Iterator[None]:
    """What is written to the shared folder inside is deleted at the end, when its readers must be done."""
    _scopes.append([])
    try:
        yield
    finally:
        for spark, path in _scopes.pop():
            delete(spark, path)


def delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def own_path(spark: SparkSession, name: str, outer: bool = False) -> str:
    """A new path in the shared folder, known to the scratch() around the call (outer: to the one around that)."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if len(_scopes) > outer:
        _scopes[-1 - outer].append((spark, path))
    return path


def cut(df: DataFrame, name: str, outer: bool = False) -> DataFrame:
    """df written once to the shared folder and read back: later steps survive lost executors and don't run it again.

    outer: the table outlives the scratch() around the call.
    """
    spark = df.sparkSession
    path = own_path(spark, name, outer)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._fabula_path = path
    return out


def drop_cut(*frames: DataFrame) -> None:
    """Delete the files behind cut() tables that nothing reads any more."""
    for df in frames:
        if path := getattr(df, "_fabula_path", None):
            delete(df.sparkSession, path)


def bounded_batches(spark: SparkSession, rows: int = 512, mb: int = 8) -> None:
    """Arrow batches of few rows and megabytes, so that Python workers hold little whatever the length of texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(mb << 20))


#: Batches after which a worker gives freed memory back.
_TIDY = 16


def give_back() -> None:
    """Freed memory that Arrow's pool and the C library hold goes back to the system."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def tidy(run: Callable) -> Callable:
    """run, for mapInArrow, with freed memory given back meanwhile and at the end: workers stay, and what they hold counts beside the JVM's heap in later stages too."""

    def tidied(batches):
        k = 0
        for out in run(batches):
            yield out
            k += 1
            if k % _TIDY == 0:
                give_back()
        out = None
        give_back()

    return tidied


#: Most rows of a table that small() has broadcast; its rows are ids, hashes and numbers, some hundred bytes at most.
SMALL_ROWS = 250_000


def small(df: DataFrame) -> DataFrame:
    """A written table of narrow rows, to be broadcast if it is counted to be no larger than SMALL_ROWS; else as it is, for a shuffled join."""
    return F.broadcast(df) if df.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS else df


def text_hash(text: str) -> Column:
    """What tells rows of one id apart by their text; null is as empty."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def without(docs: DataFrame, gone: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows whose id and text_hash are in gone, a written table; texts don't move while that is small."""
    keys = small(gone).select(F.col(id_col).alias("_fabula_id"), F.col("text_hash").alias("_fabula_th"))
    return docs.join(keys, docs[id_col].eqNullSafe(F.col("_fabula_id")) & (text_hash(text_col) == F.col("_fabula_th")), "left_anti")


def texts_of(column: pa.Array) -> list[bytes]:
    """UTF-8 of a string column; null is empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: each output bit depends on every input bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64."""
    out = np.ones(max(n, 1), np.uint64)
    done = 1
    while done < n:
        step = min(done, n - done)
        out[done : done + step] = out[:step] * np.uint64(pow(base, done, 1 << 64))
        done += step
    return out[:n]


class Rolling:
    """Hashes of any span of a sequence of 64-bit values from prefix sums: the sum of value * base ** place, moved back to place 0."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self._up, self._down = powers(base, 1024), powers(self.inverse, 1024)

    def _grow(self, n: int) -> None:
        if len(self._up) < n:
            n = 1 << (n - 1).bit_length()
            self._up, self._down = powers(self.base, n), powers(self.inverse, n)

    def prefix(self, values: np.ndarray) -> np.ndarray:
        self._grow(len(values) + 1)
        out = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * self._up[: len(values)], out=out[1:])
        return out

    def spans(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((prefix[end] - prefix[start]) * self._down[start] + (end - start).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


class Residues:
    """As Rolling, but by two polynomials modulo primes, so that no sequence cancels itself out as it may modulo a power of two."""

    _MODULI = ((2147483647, 1103515245), (2147483629, 1664525009))

    def __init__(self) -> None:
        self._tables = [(np.ones(1, np.uint64), np.ones(1, np.uint64))] * 2

    @staticmethod
    def _powers(base: int, modulus: int, n: int) -> np.ndarray:
        out, done = np.ones(n, np.uint64), 1
        while done < n:
            step = min(done, n - done)
            out[done : done + step] = out[:step] * np.uint64(pow(base, done, modulus)) % np.uint64(modulus)
            done += step
        return out

    def prefix(self, values: np.ndarray) -> list[np.ndarray]:
        n = len(values) + 1
        if len(self._tables[0][0]) < n:
            size = 1 << (n - 1).bit_length()
            self._tables = [(self._powers(b, m, size), self._powers(pow(b, -1, m), m, size)) for m, b in self._MODULI]
        out = []
        for (m, _), (up, _) in zip(self._MODULI, self._tables, strict=True):
            terms = np.zeros(n, np.uint64)
            np.cumsum(values % np.uint64(m) * up[: n - 1] % np.uint64(m), out=terms[1:])
            out.append(terms)
        return out

    def spans(self, prefix: list[np.ndarray], start: np.ndarray, end: np.ndarray) -> np.ndarray:
        a, b = (
            (sums[end] - sums[start]) % np.uint64(m) * down[start] % np.uint64(m)
            for sums, (m, _), (_, down) in zip(prefix, self._MODULI, self._tables, strict=True)
        )
        return mix((a << np.uint64(32) | b) + (end - start).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


#: Odd numbers; changing them changes hashes, not results.
BYTES, FIRST, SECOND = Rolling(0x9F3B62C7D1E8A4B5), Rolling(0xC2B2AE3D27D4EB4F), Residues()
#: Letters that are hashed at once; a worker holds some ten numbers for each.
_SEGMENT = 1 << 19


def word_table(separators: bytes | tuple[int, ...]) -> np.ndarray:
    out = np.ones(256, bool)
    out[list(separators)] = False
    return out


WORD = word_table(ASCII_SPACE)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


#: A random number for each byte at each of the first places of a word.
_PLACES = 64
_BYTE_AT = mix(np.arange(1, 256 * _PLACES + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))


def hash_words(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words data[starts:stops]: each byte adds a number that its value and its place in the word fix, so words don't cancel out."""
    size = stops - starts
    if not len(size):
        return np.zeros(0, np.uint64)
    first = np.cumsum(size) - size
    place = np.arange(first[-1] + size[-1]) - np.repeat(first, size)
    letters = data[place + np.repeat(starts, size)]
    numbers = _BYTE_AT[np.minimum(place, _PLACES - 1) << 8 | letters]
    if len(far := np.flatnonzero(place >= _PLACES)):
        numbers[far] = mix((place[far].astype(np.uint64) << np.uint64(8) | letters[far]) * np.uint64(0xA24BAED4963EE407))
    return mix(np.add.reduceat(numbers, first) + size.astype(np.uint64))


def word_hashes(texts: list[bytes], lower: bool = False, is_word: np.ndarray = WORD) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts in order, and where each text's words begin (one more entry than texts)."""
    hashes, counts = [], np.zeros(len(texts) + 1, np.int64)
    i = 0
    while i < len(texts):
        j, total = i, 0
        while j < len(texts) and (j == i or total + len(texts[j]) < _SEGMENT):
            total += len(texts[j]) + 1
            j += 1
        data = np.frombuffer(b" ".join(texts[i:j]) + b" ", np.uint8)
        ends = np.cumsum([len(t) + 1 for t in texts[i:j]])
        parts, places = [], []
        at = 0
        while at < len(data):
            stop = min(len(data), at + _SEGMENT)
            while stop < len(data) and is_word[data[stop - 1]]:  # never inside a word
                gaps = np.flatnonzero(~is_word[data[stop : stop + _SEGMENT]])
                stop = min(len(data), stop + _SEGMENT) if not len(gaps) else stop + int(gaps[0]) + 1
            piece = data[at:stop]
            if lower:
                piece = LOWER[piece]
            flags = np.concatenate(([0], is_word[piece].view(np.int8), [0]))
            edges = np.diff(flags)
            starts, stops = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
            parts.append(hash_words(piece, starts, stops))
            places.append(starts + at)
            at = stop
        hashes += parts
        counts[i + 1 : j + 1] = np.searchsorted(np.concatenate(places), ends, "left") + counts[i]
        i = j
    return np.concatenate(hashes) if hashes else np.zeros(0, np.uint64), counts


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))
