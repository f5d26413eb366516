"""Byte-pair encoding as a streaming transducer with bounded lookahead, and incremental decoding (operator 10).

How far to the right a merge can depend on what follows is computed from the merge list: whether rule (a, b) applies at
a place hangs on whether b is there, which an earlier rule (b, c) may take away, and so on along rules of ever lower
rank. The longest such chain, in symbols, is the list's sufficient lookahead. A pre-token is read in blocks; symbols
whose tokens end further than the lookahead before the block's end are final and emitted, and encoding goes on from
there, so memory is constant however long a pre-token is.

Defined cases: null and empty texts have no tokens; the two special strings inside a text are their ids, as the
library does by default; repeated rows are separate rows; an empty table gives an empty result.
"""

from __future__ import annotations

import codecs
import json
import unicodedata
from collections.abc import Iterable, Iterator
from itertools import islice, repeat

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, tidy

#: Most words that a worker remembers, letters of the longest such, and letters of a text that is taken at once.
CACHE, REMEMBERED, PIECE = 400_000, 64, 1 << 20


def byte_letters() -> dict[int, str]:
    """The printable letter of each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Merges:
    """Vocabulary and ranked merges of symbols (strings)."""

    def __init__(self, vocabulary: dict[str, int], merges: Iterable[tuple[str, str]]):
        self.vocabulary = vocabulary
        self.ranks: dict[tuple[str, str], int] = {}
        for pair in merges:
            self.ranks.setdefault(tuple(pair), len(self.ranks))
        self.lookahead = self._lookahead()

    def _lookahead(self) -> int:
        """Symbols to the right of a token on which its being final can depend, over the whole list, in one pass by rank."""
        length: dict[str, int] = {}
        taken: dict[str, int] = {}  # of a token: how far rules that start with it reach
        formed: dict[str, int] = {}  # of a token: how far the rules that made its last part reach
        for a, b in self.ranks:
            size = length.setdefault(b, 1)
            beyond = max(taken.get(b, 0), formed.get(b, 0))
            length[a + b] = length.setdefault(a, 1) + size
            formed[a + b] = max(formed.get(a + b, 0), beyond)
            taken[a] = max(taken.get(a, 0), size + beyond)
        return 1 + max([0, *taken.values(), *formed.values()])

    def merge(self, symbols: list[str]) -> list[str]:
        """All merges of one sequence: the lowest rank first, the leftmost of equal ones."""
        rank, none = self.ranks.get, repeat(len(self.ranks))
        while len(symbols) > 1:
            found = list(map(rank, zip(symbols, symbols[1:]), none))
            least = min(found)
            if least == len(self.ranks):
                break
            i = found.index(least)
            symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
        return symbols

    def stream(self, symbols: Iterable[str], block: int = 0) -> Iterator[str]:
        """Tokens of a sequence of any length, emitted once nothing that follows can change them."""
        block = max(block, 1) + 2 * self.lookahead
        held: list[str] = []
        for s in symbols:
            held.append(s)
            if len(held) >= block:
                final, at, parts = len(held) - self.lookahead, 0, self.merge(list(held))
                for k, token in enumerate(parts):
                    size = self.size(token)
                    if at + size > final:
                        held = held[at:]
                        yield from parts[:k]
                        break
                    at += size
        yield from self.merge(list(held))

    def size(self, token: str) -> int:
        """Symbols of a token; the end-of-word mark belongs to its last letter."""
        return len(token)


class WordBpe(Merges):
    """Lower-casing byte-level BPE with word ends, read from a tokenizers file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.end = spec["model"]["end_of_word_suffix"]
        super().__init__(spec["model"]["vocab"], [tuple(m) for m in spec["model"]["merges"]])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(split["pattern"]["Regex"])
        self.letters = {b: c for b, c in byte_letters().items()}
        self.bytes_of = {c: b for b, c in self.letters.items()}
        self.names = {i: t for t, i in (spec["model"]["vocab"] | self.special).items()}
        self.name_bytes = {i: t.encode() for i, t in self.names.items()}
        self.specials = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")")
        self.cache: dict[str, bytes] = {}

    def size(self, token: str) -> int:
        return len(token) - len(self.end) + 1 if token.endswith(self.end) else len(token)

    def normalise(self, text: str) -> str:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            if "Σ" in text:  # letter by letter: no final sigma
                text = text.replace("Σ", "σ")
        return text.lower()

    def _symbols(self, word: str) -> Iterator[str]:
        letters, last = self.letters, None
        for i in range(0, len(word), 4096):
            for b in word[i : i + 4096].encode():
                if last is not None:
                    yield last
                last = letters[b]
        yield last + self.end

    def word(self, word: str) -> bytes:
        """The ids of a pre-token as little-endian 32-bit numbers, by the transducer; those of short ones are remembered."""
        vocabulary = self.vocabulary
        out = b"".join(vocabulary[t].to_bytes(4, "little") for t in self.stream(self._symbols(word)))
        if len(word) <= REMEMBERED:
            if len(self.cache) >= CACHE:
                self.cache.clear()
            self.cache[word] = out
        return out

    def encode_stream(self, text: str) -> Iterator[bytes]:
        """Ids of a whole text as little-endian 32-bit numbers, without added special tokens, piece by piece."""
        cache, slow = self.cache, self.word
        for part in self.specials.split(text) if "<|" in text else [text]:
            if part in self.special:
                yield self.special[part].to_bytes(4, "little")
            elif len(part) < PIECE:
                yield b"".join([cache.get(w) or slow(w) for w in self.words.findall(self.normalise(part))])
            else:  # words one after the other, not all at once
                found = (m.group() for m in self.words.finditer(self.normalise(part)))
                while some := list(islice(found, 4096)):
                    yield b"".join([cache.get(w) or slow(w) for w in some])

    def encode(self, text: str) -> bytes:
        return b"".join(self.encode_stream(text))

    def decoder(self) -> "Decoder":
        return Decoder(self)

    def decode(self, ids: Iterable[int]) -> str:
        """As the library decodes a file without a decoder: the tokens' names, parted by spaces."""
        machine = self.decoder()
        return (machine.feed(ids) + machine.end()).decode()

    def decode_text(self, ids: Iterable[int]) -> Iterator[str]:
        """The text behind ids, piece by piece: bytes go through an incremental UTF-8 machine that holds only an unfinished letter."""
        machine = codecs.getincrementaldecoder("utf-8")("replace")
        for i in ids:
            name = self.names[i]
            if name in self.special:
                yield machine.decode(b"", True) + name
                machine.reset()
                continue
            ended = name.endswith(self.end)
            got = machine.decode(bytes(self.bytes_of[c] for c in (name[: -len(self.end)] if ended else name)), ended)
            yield got + " " if ended else got
        yield machine.decode(b"", True)


class Decoder:
    """Decoding as a machine with one state, whether a token has come: ids in, in any portions, bytes of the text out.

    The rule is the library's for files without a decoder: names of tokens with a space between them. Every name is
    whole UTF-8, so portions are too.
    """

    def __init__(self, coder: WordBpe):
        self.names, self.begun = coder.name_bytes, False

    def feed(self, ids: Iterable[int]) -> bytes:
        out = b" ".join(map(self.names.__getitem__, ids))
        lead, self.begun = b" " if self.begun and out else b"", self.begun or bool(out)
        return lead + out

    def end(self) -> bytes:
        self.begun = False
        return b""


_loaded: dict[str, WordBpe] = {}


def load(path: str) -> WordBpe:
    if path not in _loaded:
        _loaded[path] = WordBpe(path)
    return _loaded[path]


def _code(path: str, with_ids: bool):
    def run(batches):
        import hashlib
        import struct

        coder = load(path)
        for batch in batches:
            n, ids, back, raw = [], [], [], []
            for text in batch.column(1).to_pylist():
                code, text_out, machine, numbers = hashlib.sha256(), hashlib.sha256(), coder.decoder(), []
                count = 0
                for piece in coder.encode_stream(text or ""):  # piece by piece: nothing grows with the text but the ids asked for
                    own = struct.unpack(f"<{len(piece) // 4}I", piece)
                    count += len(own)
                    code.update(piece)
                    text_out.update(machine.feed(own))
                    if with_ids:
                        numbers += own
                n.append(count)
                ids.append(code.hexdigest())
                back.append(text_out.hexdigest())
                raw.append(numbers)
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())]
            yield pa.record_batch(columns + ([pa.array(raw, pa.list_(pa.int32()))] if with_ids else []), ["id", "n_tokens", "ids_sha256", "decoded_sha256"] + (["ids"] if with_ids else []))

    return run


def encode_documents(docs: DataFrame, path: str, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, the ids."""
    bounded_batches(docs.sparkSession)
    kind = dict(docs.dtypes)[id_col]
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(tidy(_code(path, with_ids)), f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if with_ids else "")).withColumnRenamed("id", id_col)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op10(spark, sf_dir) -> DataFrame:
    from .common import table

    return encode_documents(table(spark, sf_dir, "documents"), default_path())
