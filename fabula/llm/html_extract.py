"""Main text of web pages (operator 4): markup first, then a suffix array over each host's pages.

A page is read into blocks, once. Markup decides most: text inside an article is content, text inside menus, headers,
footers, sidebars, notices, adverts, forms and comments is not. What markup leaves open (what stands beside an article
in the main element, and all of pages without an article or main element) goes to the host's suffix array: the token streams of its pages are concatenated, runs of tokens that
recur on distinct pages are boilerplate and are removed, unique runs stay. Removing repeated runs from articles too
would lose reposted articles and quoted passages and would keep adverts that appear once (README, operator 4).

No task holds a whole large host: beyond SHARD_CHARS, the runs of its pages are counted over the host by their hashes
instead, with the same result.

Defined cases: null html counts as empty and gives an empty text; pages with equal streams count as one page; repeated
rows are separate rows of the result; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import html
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, cut

#: Tokens of a run that counts as boilerplate when it recurs, and characters of a host's pages that one task may hold.
RUN_TOKENS, SHARD_CHARS = 8, 8 << 20

# Names of the HTML standard and usual names of page parts.
_RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "xmp", "noembed", "noframes"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_BLOCK = set("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
_NEVER = set("head nav footer aside form button select menu dialog template svg math object audio video canvas datalist".split()) | _RAW
_NEVER_ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
_NEVER_WORDS = set("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion sidebar cookie cookies consent gdpr notice popup modal overlay comment comments commentlist respond reply replies disqus breadcrumb breadcrumbs pagination pager navbar nav navigation menu footer masthead share sharing social related recommended recommendations newsletter subscribe subscription login signup toolbar".split())
_COMMENT_WORDS = set("comment comments commentlist respond reply replies disqus".split())
# Words that say where or as what something stands; a name made of these and at least one of the above is a part's name.
_PART_WORDS = set("area bar block body bottom box button buttons column container content form footer header holder icons inner item items left level links list main media module outer page pages panel post posts primary right row secondary section site slot story stories sub text top unit widget widgets wrap wrapper".split())
#: Elements that are no part of a page: what their names say is about the page, not about themselves.
_WHOLE = {"html", "body", "main", "article"}
_TAG = re.compile(r"""<(?:!--.*?(?:-->|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^>"'])*)(?:>|\Z)|[!?/][^>]*(?:>|\Z))""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


def _kind(tag: str, rest: str) -> tuple[int, int]:
    """Of an element: its rank as a holder of content (0: none, 1: main, 2: article), and whether its text is no content (0: it may be, 1: by its name only, 2: never)."""
    if tag in _NEVER:
        return 0, 2
    named = 0
    rank = 2 if tag == "article" else 1 if tag == "main" else 0
    if not rest or rest.isspace():
        return rank, 0
    for m in _ATTRIBUTE.finditer(rest):
        name, value = m[1].lower(), html.unescape(m[2] or m[3] or m[4] or "")
        if name == "role":
            if value.lower() in _NEVER_ROLES:
                return 0, 2
            rank = max(rank, {"article": 2, "main": 1}.get(value.lower(), 0))
        elif name == "itemprop" and value == "articleBody":
            rank = 2
        elif name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none", value, re.I):
            return 0, 2
        elif name in ("class", "id") and tag not in _WHOLE:
            for one in value.split():
                words = {w.lower() for w in _WORDS.findall(one)}
                if words & _NEVER_WORDS and words <= _NEVER_WORDS | _PART_WORDS:
                    named = max(named, 2 if words & _COMMENT_WORDS else 1)
    return (0, named) if named else (rank, 0)


def blocks(page: str) -> list[tuple[int, str]]:
    """(rank, text) of each block that isn't boilerplate by markup, in page order; white space runs are one space."""
    out: list[tuple[int, str]] = []
    stack: list[tuple[str, int, int]] = []  # tag, rank, skipped (as _kind has it)
    text: list[str] = []
    rank, skipped, at, end = 0, 0, 0, len(page)

    def close() -> None:
        if text:
            if body := " ".join(html.unescape("".join(text)).split()):
                out.append((rank, body))
            text.clear()

    while at < end:
        m = _TAG.search(page, at)
        stop = m.start() if m else end
        if not skipped and stop > at:
            text.append(page[at:stop])
        if not m:
            break
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    if tag in _BLOCK:
                        close()
                    del stack[i:]
                    rank, skipped = stack[-1][1:] if stack else (0, 0)
                    break
            else:
                if tag in _BLOCK:
                    close()
            continue
        if tag in _BLOCK:
            close()
            if stack and stack[-1][0] == "p":
                stack.pop()
                rank, skipped = stack[-1][1:] if stack else (0, 0)
        elif tag == "br" and not skipped:
            text.append(" ")
        if tag in _VOID or m[3].endswith("/") and tag not in _BLOCK:
            continue
        if tag in _RAW:
            found = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, at)
            at = found.start() if found else end
            stack.append((tag, rank, 2))
            skipped = 2
            continue
        own, never = _kind(tag, m[3])
        if tag == "header" and rank < 2:
            never = 2
        # An article inside a part that only its name speaks against is content after all, but not inside comments.
        around = 0 if skipped == 1 and own == 2 else skipped
        stack.append((tag, max(rank, own), max(around, never)))
        rank, skipped = stack[-1][1:]
    close()
    return out


def read(page: str | None) -> tuple[list[str], list[bool]]:
    """A page's blocks that may be content, and which of them markup leaves open.

    With an article, its blocks are content and what stands beside it in the main element is open; without one, the
    main element's blocks are content; without either, all are open.
    """
    found = blocks(page or "")
    best = max((r for r, _ in found), default=0)
    kept = [(t, r < best or not best) for r, t in found if r == best or r == best - 1 == 1]
    return [t for t, _ in kept], [is_open for _, is_open in kept]


def suffix_array(tokens: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The suffix array by prefix doubling, and the ranks by the first 1, 2, 4, ... tokens."""
    n = len(tokens)
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64)
    levels, k = [rank], 1
    order = np.argsort(rank, kind="stable")
    while k < n:
        after = np.full(n, -1)
        after[: n - k] = rank[k:]
        order = np.lexsort((after, rank))
        new = np.concatenate(([0], np.cumsum((np.diff(rank[order]) != 0) | (np.diff(after[order]) != 0))))
        rank = np.empty(n, np.int64)
        rank[order] = new
        levels.append(rank)
        if new[-1] == n - 1:
            break
        k *= 2
    return order, levels


def common_prefixes(order: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """Common tokens of each suffix with the one before it in order."""
    n = len(order)
    lcp = np.zeros(n, np.int64)
    a, b = order[1:].copy(), order[:-1].copy()
    for j in range(len(levels) - 1, -1, -1):
        inside = (a < n) & (b < n)
        same = np.zeros(len(a), bool)
        same[inside] = levels[j][a[inside]] == levels[j][b[inside]]
        same &= np.maximum(a, b) + (1 << j) <= n
        lcp[1:] += same * (1 << j)
        a, b = a + same * (1 << j), b + same * (1 << j)
    return lcp


def repeated_tokens(streams: list[np.ndarray], run: int) -> list[np.ndarray]:
    """Which tokens of each stream are inside a run of `run` tokens that occurs in streams of other content too."""
    if not streams:
        return []
    content: dict[bytes, int] = {}
    page = [content.setdefault(s.tobytes(), len(content)) for s in streams]
    top = max((int(s.max()) for s in streams if len(s)), default=0) + 1
    tokens = np.concatenate([np.append(s, top + i) for i, s in enumerate(streams)])
    owner = np.repeat(page, [len(s) + 1 for s in streams])
    order, levels = suffix_array(tokens)
    group = np.cumsum(common_prefixes(order, levels) < run)
    pairs = np.unique(np.stack([group, owner[order]]), axis=1)
    pages = np.bincount(pairs[0], minlength=group[-1] + 1)
    starts = order[pages[group] > 1]
    edge = np.zeros(len(tokens) + run + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + run, -1)
    covered = np.cumsum(edge)[: len(tokens)] > 0
    ends = np.cumsum([len(s) + 1 for s in streams])
    return [covered[e - len(s) - 1 : e - 1] for s, e in zip(streams, ends, strict=True)]


def _kept(blocks: list[list[str]], gone: np.ndarray, run: int) -> list[str]:
    """The blocks (as words) without the covered tokens, empty where nothing is left; the ends of blocks are tokens too."""
    at, kept = 0, []
    for b in blocks:
        covered = gone[at : at + len(b)]
        at += len(b) + 1
        if not covered.all():  # of a block that has text of its own, only runs of full length go, not words that lie at an end
            edge = np.flatnonzero(np.diff(np.concatenate(([0], covered.view(np.int8), [0]))))
            covered = covered.copy()
            for i, j in edge.reshape(-1, 2):
                covered[i:j] = j - i >= run
        kept.append(" ".join(w for w, g in zip(b, covered, strict=True) if not g))
    return kept


def _page_text(blocks: list[str], is_open: list[bool], left: list[str]) -> str:
    """A page's text: blocks that markup decides, and of open ones what the repeated runs left."""
    rest = iter(left)
    return "\n\n".join(t for b, o in zip(blocks, is_open, strict=True) if (t := next(rest) if o else b))


def _open_blocks(blocks: list[str], is_open: list[bool]) -> list[str]:
    return [b for b, o in zip(blocks, is_open, strict=True) if o]


def unique_blocks(pages: list[list[str]], run: int = RUN_TOKENS) -> list[list[str]]:
    """Each page's blocks without runs that recur on the other pages."""
    known: dict[str, int] = {"": 0}
    words = [[b.split(" ") for b in p] for p in pages]
    streams = [np.array([known.setdefault(w, len(known)) for b in p for w in (*b, "")], np.int64) for p in words]
    return [_kept(p, gone, run) for p, gone in zip(words, repeated_tokens(streams, run), strict=True)]


def without_runs(blocks: list[str], starts: list[int], run: int) -> list[str]:
    """A page's blocks without the runs of tokens that begin at starts."""
    words = [b.split(" ") for b in blocks]
    edge = np.zeros(sum(len(b) + 1 for b in words) + 1, np.int64)
    np.add.at(edge, np.array(starts, np.int64), 1)
    np.add.at(edge, np.array(starts, np.int64) + run, -1)
    return _kept(words, np.cumsum(edge)[:-1] > 0, run)


def recurring_runs(pages: DataFrame, run: int) -> DataFrame:
    """host, content, starts: where in the tokens of a content runs begin that other contents of its host have too. pages: host, content, blocks (open ones)."""
    one = pages.groupBy("host", "content").agg(F.first("blocks").alias("blocks"))  # rows of equal content have equal blocks
    tokens = F.flatten(F.transform("blocks", lambda b: F.concat(F.split(b, " "), F.array(F.lit("")))))
    one = one.select("host", "content", tokens.alias("t")).where(F.size("t") >= run)
    hashes = F.transform(F.sequence(F.lit(1), F.size("t") - run + 1), lambda i: F.unhex(F.md5(F.array_join(F.slice("t", i, run), "\n"))))
    runs = one.select("host", "content", F.posexplode(hashes).alias("at", "h"))
    often = runs.groupBy("host", "h").agg(F.min("content").alias("a"), F.max("content").alias("b")).where("a < b").select("host", "h")
    often = cut(often, "often")  # written first, so that the join can be split at hot runs
    return runs.join(often, ["host", "h"]).groupBy("host", "content").agg(F.collect_list("at").alias("starts"))


def _parsed(batches):
    for batch in batches:
        found = [read(p) for p in batch.column(2).to_pylist()]
        flags = pa.array([f for _, f in found], pa.list_(pa.bool_()))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([b for b, _ in found], pa.list_(pa.string())), flags], ["id", "url", "blocks", "is_open"])


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", run: int = RUN_TOKENS, shard_chars: int = SHARD_CHARS) -> DataFrame:
    """One row for each row of pages: id, url, text (blocks joined by two newlines), n_chars (code points)."""
    spark = pages.sparkSession
    bounded_batches(spark)
    types = dict(pages.dtypes)
    base = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html"))
    parsed = cut(base.mapInArrow(_parsed, f"id {types[id_col]}, url string, blocks array<string>, is_open array<boolean>"), "parsed")
    some = F.exists("is_open", lambda o: o)
    sure = parsed.where(~some).select("id", "url", F.array_join("blocks", "\n\n").alias("text"))
    host = F.lower(F.coalesce(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), F.lit("")))
    left = parsed.where(some).withColumn("host", host)
    open_ones = F.transform(F.filter(F.arrays_zip("blocks", "is_open"), lambda x: x["is_open"]), lambda x: x["blocks"])
    size = F.sum(F.aggregate(open_ones, F.lit(0).cast("long"), lambda n, x: n + F.length(x)))
    left = left.join(left.groupBy("host").agg((size > shard_chars).alias("large")), "host")
    schema = f"id {types[id_col]}, url string, text string"

    def unique(rows: pa.Table) -> pa.Table:
        found = list(zip(rows["blocks"].to_pylist(), rows["is_open"].to_pylist(), strict=True))
        rest = unique_blocks([_open_blocks(*f) for f in found], run)
        return pa.table({"id": rows["id"], "url": rows["url"], "text": pa.array([_page_text(*f, r) for f, r in zip(found, rest, strict=True)], pa.string())})

    def clean(batches):
        for batch in batches:
            found = zip(*(batch.column(i).to_pylist() for i in (2, 3, 4)), strict=True)
            texts = [_page_text(b, o, without_runs(_open_blocks(b, o), at or [], run)) for b, o, at in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["id", "url", "text"])

    rest = left.where("NOT large").select("host", "id", "url", "blocks", "is_open").groupBy("host").applyInArrow(unique, schema)
    large = left.where("large").withColumn("open_blocks", open_ones)
    large = large.withColumn("content", F.sha2(F.concat_ws("\n", "open_blocks"), 256))  # no block has a line end
    runs = recurring_runs(large.select("host", "content", F.col("open_blocks").alias("blocks")), run)
    found = large.join(runs, ["host", "content"], "left")
    rest = rest.unionByName(found.select("id", "url", "blocks", "is_open", "starts").mapInArrow(clean, schema))
    both = sure.unionByName(rest)
    return both.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", F.char_length("text").cast("long").alias("n_chars"))


def op4(spark, sf_dir) -> DataFrame:
    from .common import table

    return extract_text(table(spark, sf_dir, "pages"))
