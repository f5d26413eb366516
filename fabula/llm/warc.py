"""WARC derivatives (operator 7): response records become linked metadata and plain-text conversion records.

Both derived records name the response they come from (WARC-Refers-To, its target URI and date) and keep its payload
digest; the metadata record also lists the response's HTTP headers. Record ids are made from the response's id and the
kind, so that a task that runs again writes the same records.

Defined cases: a null url or html counts as empty; a null id differs from every other; rows of one id and url with
other html have ids of their own, repeated rows give repeated records; a block that is no HTTP message has no headers
and its whole block as payload; codings that can't be undone leave the body as it is, which the metadata record says
(source-problem); letters that the charset doesn't have are replaced; a file whose records can't be read on ends with a
row that has a problem in place of a record; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import codecs
import gzip
import hashlib
import html
import io
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches
from .html_extract import _BLOCK, _RAW, _TAG

VERSION = "WARC/1.1"


@dataclass
class Record:
    headers: list[tuple[str, str]]
    block: bytes = b""
    offset: int = 0
    _index: dict[str, str] = field(default_factory=dict, repr=False)

    def get(self, name: str, default: str = "") -> str:
        if not self._index:
            self._index.update({k.lower(): v for k, v in reversed(self.headers)})
        return self._index.get(name.lower(), default)

    def to_bytes(self) -> bytes:
        head = "".join(f"{k}: {v}\r\n" for k, v in self.headers if k.lower() != "content-length")
        return f"{VERSION}\r\n{head}Content-Length: {len(self.block)}\r\n\r\n".encode() + self.block + b"\r\n\r\n"


def _headers(lines: list[bytes]) -> list[tuple[str, str]]:
    out: list[tuple[str, str]] = []
    for line in lines:
        text = line.decode("utf-8", "replace")
        if text[:1] in " \t" and out:  # a folded line
            out[-1] = (out[-1][0], f"{out[-1][1]} {text.strip()}")
        elif ":" in text:
            name, value = text.split(":", 1)
            out.append((name.strip(), value.strip()))
    return out


def parse_records(data: bytes) -> Iterator[Record]:
    """Records of a WARC file, plain or gzipped (one member a record or one for all)."""
    stream: io.BufferedIOBase = gzip.GzipFile(fileobj=io.BytesIO(data)) if data[:2] == b"\x1f\x8b" else io.BytesIO(data)
    while True:
        at = stream.tell()
        line = stream.readline()
        if not line:
            return
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record at offset {at}")
        lines = []
        while (line := stream.readline()) not in (b"\r\n", b"\n"):
            if not line:
                raise ValueError(f"record at offset {at} ends in its headers")
            lines.append(line)
        record = Record(_headers(lines), b"", at)
        length = record.get("Content-Length", "0").strip()
        if not (length.isascii() and length.isdigit()):
            raise ValueError(f"record at offset {at} has no length")
        size = int(length)
        record.block = stream.read(size)
        if len(record.block) != size:
            raise ValueError(f"record at offset {at} is cut short")
        yield record


def _dechunked(body: bytes) -> bytes:
    parts, at = [], 0
    while at < len(body):
        end = body.find(b"\r\n", at)
        size = body[at : end if end >= 0 else len(body)].split(b";")[0].strip()
        if not re.fullmatch(rb"[0-9A-Fa-f]+", size):
            raise ValueError("bad chunk size")
        n = int(size, 16)
        if not n:
            return b"".join(parts)
        at = end + 2
        if end < 0 or at + n > len(body):
            raise ValueError("chunk is cut short")
        parts.append(body[at : at + n])
        at += n + 2
    raise ValueError("chunks without an end")


def http_parts(block: bytes) -> tuple[str, list[tuple[str, str]], bytes, bytes, str]:
    """Status line, headers, body as it was sent, body with transfer and content codings undone, and what was wrong with these.

    A coding that can't be undone, or isn't known, leaves the body as it was before it.
    """
    if not block.startswith(b"HTTP/"):
        return "", [], block, block, ""
    head, _, sent = block.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    headers = _headers(lines[1:])
    index = {k.lower(): v.lower().strip() for k, v in headers}
    undo = [_dechunked] if "chunked" in index.get("transfer-encoding", "") else []
    for coding in reversed([c.strip() for c in index.get("content-encoding", "").split(",")]):
        if coding in ("gzip", "x-gzip"):
            undo.append(gzip.decompress)
        elif coding == "deflate":
            undo.append(_inflated)
        elif coding not in ("", "identity"):
            undo.append(lambda body, coding=coding: _unknown(coding))
    body, problem = sent, ""
    try:
        for step in undo:
            body = step(body)
    except (ValueError, OSError, EOFError, zlib.error) as e:
        problem = " ".join(str(e).split()) or type(e).__name__
    return lines[0].decode("utf-8", "replace"), headers, sent, body, problem


def _inflated(body: bytes) -> bytes:
    try:
        return zlib.decompress(body)
    except zlib.error:
        return zlib.decompress(body, -zlib.MAX_WBITS)  # without the wrapper, as some servers send it


def _unknown(coding: str) -> bytes:
    raise ValueError(f"unknown coding {coding}")


def decoded(body: bytes, headers: list[tuple[str, str]]) -> str:
    """The body's text in the charset that its Content-Type names, UTF-8 where it names none that is known."""
    kind = next((v for k, v in headers if k.lower() == "content-type"), "")
    named = re.search(r"charset\s*=\s*[\"']?([\w.:-]+)", kind, re.I)
    try:
        return body.decode(codecs.lookup(named[1]).name if named else "utf-8", "replace")
    except (LookupError, ValueError):
        return body.decode("utf-8", "replace")


def sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256('|'.join(parts).encode()).digest()[:16], version=4)}>"


def visible_text(page: str) -> str:
    """Everything a page shows, block by block: markup, scripts and styles gone, references decoded."""
    out, at, end = [], 0, len(page)
    while at < end:
        m = _TAG.search(page, at)
        out.append(page[at : m.start() if m else end])
        if not m:
            break
        at, tag = m.end(), (m[2] or "").lower()
        if tag in _BLOCK or tag == "br":
            out.append("\n")
        if tag in _RAW and not m[1]:  # no markup inside: only its own closing tag ends it
            found = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, at)
            stop = found.start() if found else end
            if tag in ("title", "textarea"):
                out.append(page[at:stop])
            at = stop
    lines = (" ".join(html.unescape(line).split()) for line in "".join(out).split("\n"))
    return "\n".join(line for line in lines if line)


def response(page_id, url: str | None, page: str | None, date: str) -> Record:
    """A response record for a crawled page."""
    body = (page or "").encode()
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body
    own = record_id("response", "no id" if page_id is None else f"id {page_id}", url or "", hashlib.sha256(body).hexdigest())
    return Record([("WARC-Type", "response"), ("WARC-Record-ID", own), ("WARC-Date", date), ("WARC-Target-URI", url or ""), ("WARC-Payload-Digest", sha1(body)), ("WARC-Block-Digest", sha1(block)), ("Content-Type", "application/http; msgtype=response")], block)


def derive(source: Record) -> list[Record]:
    """The metadata and conversion records of a response record; other records have none."""
    if source.get("WARC-Type") != "response":
        return []
    status, headers, sent, body, problem = http_parts(source.block)
    digest = source.get("WARC-Payload-Digest") or sha1(sent)
    link = [("WARC-Date", source.get("WARC-Date")), ("WARC-Refers-To", source.get("WARC-Record-ID")), ("WARC-Refers-To-Target-URI", source.get("WARC-Target-URI")), ("WARC-Refers-To-Date", source.get("WARC-Date")), ("WARC-Target-URI", source.get("WARC-Target-URI"))]
    fields = [("source-payload-digest", digest), ("source-block-digest", source.get("WARC-Block-Digest") or sha1(source.block)), ("source-content-type", source.get("Content-Type")), ("http-status", status)]
    fields += [("source-problem", problem)] if problem else []
    meta = "".join(f"{k}: {v}\r\n" for k, v in fields + [(f"http-header-{k.lower()}", v) for k, v in headers]).encode()
    text = visible_text(decoded(body, headers)).encode("utf-8", "replace")
    out = []
    for kind, mime, block in (("metadata", "application/warc-fields", meta), ("conversion", "text/plain; charset=utf-8", text)):
        own = record_id(kind, source.get("WARC-Record-ID"))
        out.append(Record([("WARC-Type", kind), ("WARC-Record-ID", own), *link, ("WARC-Block-Digest", sha1(block)), ("WARC-Source-Payload-Digest", digest), ("Content-Type", mime)], block))
    return out


_SCHEMA = "warc_type string, record_id string, refers_to string, target_uri string, warc_date string, content_type string, source_digest string, block_digest string, n_bytes long, record_sha256 string, record binary"
_NAMES = [c.split()[0] for c in _SCHEMA.split(", ")]


def _rows(source: Record) -> list[tuple]:
    out = []
    for r in derive(source):
        whole = r.to_bytes()
        out.append((r.get("WARC-Type"), r.get("WARC-Record-ID"), r.get("WARC-Refers-To"), r.get("WARC-Target-URI"), r.get("WARC-Date"), r.get("Content-Type"), r.get("WARC-Source-Payload-Digest"), r.get("WARC-Block-Digest"), len(r.block), hashlib.sha256(whole).hexdigest(), whole))
    return out


def _batch(first: pa.Array | None, name: str, rows: list[tuple]) -> pa.RecordBatch:
    columns = [pa.array([r[i] for r in rows], pa.int64() if n == "n_bytes" else pa.binary() if n == "record" else pa.string()) for i, n in enumerate(_NAMES)]
    return pa.record_batch(([first] if first is not None else []) + columns, ([name] if first is not None else []) + _NAMES)


def derive_pages(pages: DataFrame, date: str = "2024-01-01T00:00:00Z", id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Two rows for each row of pages, its metadata and its conversion record. date: when the pages were fetched, as no column says so."""

    def run(batches):
        for batch in batches:
            rows, owner = [], []
            for i, (p, u, h) in enumerate(zip(*(batch.column(j).to_pylist() for j in range(3)), strict=True)):
                source = next(parse_records(response(p, u, h, date).to_bytes()))
                for r in _rows(source):
                    rows.append(r)
                    owner.append(i)
            yield _batch(batch.column(0).take(pa.array(owner, pa.int64())), id_col, rows)

    bounded_batches(pages.sparkSession)
    kind = dict(pages.dtypes)[id_col]
    return pages.select(F.col(id_col), F.col(url_col).cast("string"), F.col(html_col)).mapInArrow(run, f"{id_col} {kind}, {_SCHEMA}")


def derive_files(spark: SparkSession, path: str) -> DataFrame:
    """Derived records of all response records in the WARC files under path, which Spark's reader opens (a file fits in a task's memory).

    problem is null but for a last row of a file that can't be read to its end, which has nothing else.
    """

    def with_problem(rows: pa.RecordBatch, problem: str | None) -> pa.RecordBatch:
        return rows.append_column("problem", pa.array([problem] * len(rows), pa.string()))

    def run(batches):
        for batch in batches:
            for name, data in zip(*(batch.column(j).to_pylist() for j in range(2)), strict=True):
                try:
                    for source in parse_records(data):
                        if rows := _rows(source):
                            yield with_problem(_batch(pa.array([name] * len(rows)), "file", rows), None)
                except (ValueError, OSError, EOFError, zlib.error) as e:
                    yield with_problem(_batch(pa.array([name]), "file", [(None,) * len(_NAMES)]), str(e) or type(e).__name__)

    bounded_batches(spark, rows=1)
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, f"file string, {_SCHEMA}, problem string")


def write_records(records: DataFrame, path: str, compression: str = "gzip") -> None:
    """Write derived records (UTF-8) as WARC files, one for each partition."""
    end = "\r\n\r\n"
    text = F.decode("record", "UTF-8")
    records.select(F.substring(text, F.lit(1), F.length(text) - len(end)).alias("value")).write.option("lineSep", end).option("compression", compression).text(path)


def op7(spark, sf_dir) -> DataFrame:
    from .common import table

    return derive_pages(table(spark, sf_dir, "pages")).drop("record")
