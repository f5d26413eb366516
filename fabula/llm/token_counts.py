"""Token counts of a sentencepiece BPE model by rank-synchronous array merging (operator 5).

Pre-tokens (a run of spaces and what follows up to the next space) are held as one ragged numpy array of symbols; each
round finds every sequence's lowest-rank pair and applies it in all sequences at once, and the symbols that survive are
counted. No piece has a space after another letter, so nothing merges across pre-tokens.

Defined cases: null counts as empty, which has no tokens; repeated rows are separate rows; a text is encoded whole; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches

#: Pre-tokens whose counts a worker remembers, and letters of the longest such.
CACHE, REMEMBERED = 400_000, 64
_SPACE = "▁"


class PieceCounter:
    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        plain = [i for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        plain.sort(key=lambda i: -model.get_score(i))
        pieces = [model.id_to_piece(i) for i in plain]  # by rank
        rank = {p: r for r, p in enumerate(pieces)}
        letters = sorted({c for p in pieces for c in p} - rank.keys())
        symbol = rank | {c: len(rank) + k for k, c in enumerate(letters)}
        self.letter = {c: s for c, s in symbol.items() if len(c) == 1}
        #: After these come letters of no piece, by their number of bytes.
        self.strange = len(symbol)
        self.tokens = np.ones(len(symbol) + 5, np.int64)
        for c in letters:
            self.tokens[symbol[c]] = len(c.encode())
        self.tokens[self.strange :] = np.arange(5)
        keys, out = [], []
        early = np.zeros(len(pieces), bool)
        for r, p in enumerate(pieces):
            for j in range(1, len(p)):
                a, b = symbol.get(p[:j]), symbol.get(p[j:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    out.append(r)
                    for part in (a, b):
                        if r < part < len(pieces):  # made of a piece of higher rank: after that piece this one is next
                            early[part] = True
        order = np.argsort(keys)
        self.keys, self.made = np.array(keys, np.int64)[order], np.array(out, np.int64)[order]
        self.early = early
        self.joins = any(_SPACE in p.lstrip(_SPACE) for p in pieces)
        if self.joins:
            raise ValueError("pieces of this model join pre-tokens")
        apart = "" if any("\n" in p and len(p) > 1 for p in pieces) else "\n"
        self.split = re.compile(f"{apart}| *[^ {apart}]+| +" if apart else " *[^ ]+| +").findall
        self.cache: dict[str, int] = {}

    def count_words(self, words: list[str]) -> np.ndarray:
        """Tokens of each of the (not empty) pre-tokens."""
        points = np.frombuffer("".join(words).replace(" ", _SPACE).encode("utf-32-le"), np.uint32)
        kinds, back = np.unique(points, return_inverse=True)
        known = np.array([self.letter.get(chr(c), self.strange + len(chr(c).encode())) for c in kinds], np.int64)
        symbols, sizes = known[back], np.array([len(w) for w in words])
        owner = np.repeat(np.arange(len(words)), sizes)
        total = np.zeros(len(words), np.int64)
        none = len(self.made) + len(self.early)
        while len(symbols):
            key = symbols[:-1] << 32 | symbols[1:]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            rank = np.full(len(symbols), none)
            rank[:-1] = np.where((self.keys[at] == key) & (owner[:-1] == owner[1:]), self.made[at], none)
            first = np.flatnonzero(np.diff(owner, prepend=-1))
            least = np.minimum.reduceat(rank, first)
            length = np.diff(np.append(first, len(symbols)))
            least = np.repeat(least, length)
            over = least == none
            if over.any():  # these sequences have ended
                total += np.bincount(owner[over], self.tokens[symbols[over]], len(words)).astype(np.int64)
                symbols, owner, rank, least = symbols[~over], owner[~over], rank[~over], least[~over]
                if not len(symbols):
                    break
            hit = np.flatnonzero(rank == least)
            # Of pairs that overlap in a run, every second from the left; of early ones, only a sequence's leftmost.
            run = np.flatnonzero(np.diff(hit, prepend=-2) != 1)
            inside = np.arange(len(hit)) - np.repeat(run, np.diff(np.append(run, len(hit))))
            take = inside % 2 == 0
            if (lone := self.early[least[hit]]).any():
                take &= ~lone | (np.diff(owner[hit], prepend=-1) != 0)
            hit = hit[take]
            symbols[hit] = least[hit]
            keep = np.ones(len(symbols), bool)
            keep[hit + 1] = False
            symbols, owner = symbols[keep], owner[keep]
        return total

    def count(self, texts: list[str | None]) -> list[int]:
        lists = [self.split(" " + t.replace(_SPACE, " ")) if t else [] for t in texts]
        cache = self.cache
        if len(cache) > CACHE:
            cache.clear()
        new = list(set().union(*lists) - cache.keys())
        if new:
            cache.update(zip(new, self.count_words(new).tolist(), strict=True))
        out = [sum(map(cache.__getitem__, words)) for words in lists]
        for w in new:
            if len(w) > REMEMBERED:
                del cache[w]
        return out


_loaded: dict[str, PieceCounter] = {}


def load(path: str) -> PieceCounter:
    if path not in _loaded:
        _loaded[path] = PieceCounter(path)
    return _loaded[path]


def _count(path: str, limit: int):
    def run(batches):
        counter = load(path)
        for batch in batches:
            texts = batch.column(1)
            n = counter.count(texts.to_pylist())
            size = [0 if t is None else len(t) for t in texts.cast(pa.binary()).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], ["id", "n_bytes", "n_tokens", "over_limit"])

    return run


def token_counts(docs: DataFrame, path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit)."""
    bounded_batches(docs.sparkSession)
    kind = dict(docs.dtypes)[id_col]
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(_count(path, limit), f"id {kind}, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("id", id_col)


def op5(spark, sf_dir) -> DataFrame:
    import public_tokenizers

    from .common import table

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
