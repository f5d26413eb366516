"""Tokenizers against the libraries, held-out accuracy of the toxicity model, HTML and WARC round trips, the pipeline."""

import base64
import gzip
import hashlib
import html.parser
import random
import re
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from fabula.llm import bpe, html_extract, token_counts, toxicity, warc

SF = "/root/testdata/sf0.01"


def odd_texts(n=1500):
    rnd = random.Random(11)
    letters = list("abcdeéÉ İΣσς ıß 'S'T're1२½ \t\n\r​́漢字😀<>|!?-_\x00\x85▁") + ["<|endoftext|>", "<s>", "</s>", "   ", "the", "'ll"]
    out = ["", " ", "\n", "A" * 3000, "ab" * 2000, "the" * 900, " " * 70, "<|endoftext|>", "a<|startoftext|>b", "<|ENDOFTEXT|>"]
    return out + ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 50))) for _ in range(n)]


def test_piece_counts():
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    rnd = random.Random(4)
    pieces = [model.id_to_piece(i) for i in range(259, 32000)]
    texts = odd_texts() + ["".join(rnd.choice(pieces) for _ in range(8)).replace("▁", " ") for _ in range(3000)]
    assert token_counts.load(path).count(texts) == [len(x) for x in model.encode(texts)]


def test_bpe():
    from tokenizers import Tokenizer

    coder, library = bpe.load(bpe.default_path()), Tokenizer.from_file(bpe.default_path())
    for t in odd_texts():
        ids = struct.unpack(f"<{len(coder.encode(t)) // 4}I", coder.encode(t))
        want = library.encode(t, add_special_tokens=False).ids
        assert list(ids) == want and coder.decode(ids) == library.decode(want, skip_special_tokens=False)


def test_bpe_stream_is_whole():
    coder, rnd = bpe.load(bpe.default_path()), random.Random(8)
    for _ in range(20):
        word = "".join(rnd.choice("aeionrst") for _ in range(2000))
        symbols = list(coder._symbols(word))
        assert list(coder.stream(iter(symbols))) == coder.merge(list(symbols))


def test_bpe_lookahead_of_random_lists():
    """Blocks no longer than the computed lookahead needs give the tokens of the whole, for lists that chain."""
    rnd = random.Random(21)
    for _ in range(120):
        tokens, rules = list("abc"), []
        for _ in range(rnd.randint(1, 14)):
            pair = (rnd.choice(tokens), rnd.choice(tokens))
            if pair not in rules and len("".join(pair)) <= 12:
                rules.append(pair)
                tokens.append("".join(pair))
        merges = bpe.Merges({t: i for i, t in enumerate(tokens)}, rules)
        for _ in range(12):
            symbols = [rnd.choice("abc") for _ in range(rnd.randint(1, 40) + 4 * merges.lookahead)]
            assert list(merges.stream(iter(symbols))) == merges.merge(list(symbols)), (rules, "".join(symbols))


def test_bpe_lookahead_of_chains():
    """Chains of the tokenizer's own list: each rule's second part begins a rule of lower rank, which may take it away."""
    coder, rnd = bpe.load(bpe.default_path()), random.Random(22)
    by_first = {}
    for (a, b), rank in coder.ranks.items():
        by_first.setdefault(a, []).append((rank, b))
    for _ in range(40):
        (a, b), rank = rnd.choice(list(coder.ranks.items()))
        chain = [a, b]
        while lower := [x for x in by_first.get(chain[-1], []) if x[0] < rank]:
            rank, nxt = rnd.choice(lower)
            chain.append(nxt)
        text = "".join(chain).replace(coder.end, "")
        symbols = list(text * (2 + 4 * coder.lookahead // len(text)))
        assert list(coder.stream(iter(symbols))) == coder.merge(list(symbols))


def test_bpe_pieces(monkeypatch):
    coder = bpe.load(bpe.default_path())
    texts = odd_texts(300) + ["word " * 9000 + "<|endoftext|>" + "x" * 700]
    whole = [coder.encode(t) for t in texts]
    monkeypatch.setattr(bpe, "PIECE", 5)
    assert [coder.encode(t) for t in texts] == whole
    for code in whole:
        ids = struct.unpack(f"<{len(code) // 4}I", code)
        machine = coder.decoder()
        parts = b"".join(machine.feed(ids[i : i + 3]) for i in range(0, len(ids), 3)) + machine.end()
        assert parts.decode() == coder.decode(ids) == " ".join(coder.names[i] for i in ids)


def test_bpe_decode_text():
    coder = bpe.load(bpe.default_path())
    code = coder.encode("héllo 漢 wörld <|endoftext|>")
    assert "".join(coder.decode_text(struct.unpack(f"<{len(code) // 4}I", code))).split() == ["héllo", "漢", "wörld", "<|endoftext|>"]


def test_tokens_of_tables(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "Hello", "x"), (3, "Hello", "x"), (None, "a b", "x")], "doc_id long, text string, id string")
    assert sorted((r.doc_id or 0, r.n_bytes, r.n_tokens) for r in token_counts.token_counts(docs, public_tokenizers.path("piece_bpe_32k.model")).collect()) == [(0, 3, 2), (1, 0, 0), (2, 0, 0), (3, 5, 1), (3, 5, 1)]
    got = bpe.encode_documents(docs, bpe.default_path(), with_ids=True).collect()
    assert sorted((r.doc_id or 0, r.n_tokens, len(r.ids)) for r in got) == [(0, 2, 2), (1, 0, 0), (2, 0, 0), (3, 1, 1), (3, 1, 1)]
    none = docs.where("false")
    assert bpe.encode_documents(none, bpe.default_path()).collect() == []
    assert token_counts.token_counts(none, public_tokenizers.path("piece_bpe_32k.model")).collect() == []


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    scored = toxicity.op1(spark, sf).join(labels.select("doc_id", "toxic"), "doc_id").where("held_out").collect()
    assert all((zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in scored)
    found = sum(r.predicted and r.toxic for r in scored) / sum(r.toxic for r in scored)
    wrong = sum(r.predicted and not r.toxic for r in scored) / sum(not r.toxic for r in scored)
    assert found > 0.8 and wrong < 0.03


def test_toxicity_ablation():
    """What the departures from plain averaging are for: one toxic word in a long text is lost in the average of all."""
    import pyarrow.parquet as pq

    read = lambda name: pq.read_table(f"/root/testdata/sf0.1/{name}.parquet").to_pylist()
    text = {r["doc_id"]: r["text"] for r in read("documents")}
    known = [(r["doc_id"], r["toxic"]) for r in read("labels") if r["toxic"] in (0, 1)]
    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    rows = [(text[i], y) for i, y in known if not held(i) and len(text[i] or "") <= 20_000]
    test = [(text[i], y) for i, y in known if held(i)]
    rate = sum(y for _, y in rows) / len(rows)

    def found(**how):
        model = toxicity.train(rows, rate_of_toxic=rate, **how)
        said = [(model.score(t) >= 0.3, y) for t, y in test]
        return sum(p for p, y in said if y), sum(p for p, y in said if not y)

    toxic = sum(y for _, y in test)
    right, wrong = found()
    assert right >= 0.85 * toxic and wrong <= 0.02 * len(test)
    assert found(pool="mean")[1] > 20 * max(1, wrong) and found(start="random")[0] < right


def test_toxicity_cases(spark):
    rows = [("good day to all people here", 0)] * 90 + [("you are an idiot my friend", 1)] * 10
    model = toxicity.train(rows)
    assert model.score("what an idiot") > model.score("what an idiit") > model.score("what a day")
    assert 0 <= model.score(None) == model.score("") <= 1
    assert toxicity.train([]).score("x") < 1e-6
    long = "good day " * 300_000 + "idiot"
    assert abs(model.score(long) - model.score("good day idiot")) < 1e-9
    docs = spark.createDataFrame([(1, None, 0.5), (2, "an idiot", 0.1), (2, "an idiot", 0.1), (3, "good day", None)], "doc_id long, text string, score double")
    assert toxicity.filter_documents(docs, model).count() == 2
    assert toxicity.score_documents(docs.where("false"), model).collect() == []
    labels = spark.createDataFrame([(1, None), (9, 1), (None, 0)], "doc_id long, toxic int")
    assert toxicity.training_rows(docs, labels, held_out=False)[0] == []


PAGE = '<!DOCTYPE html><html><head><title>T</title><script>var a="</p>"</script></head><body><nav><a>Home</a></nav><div class="ad">Buy</div><article><h1>Title &amp;amp;</h1><p>One <b>two<br>three<p>four &lt;x&gt;<div class="comments"><p>no</p></div><aside>no</aside></article><footer>&copy; me</footer>'


def sure(page):
    """The text of a page of which markup leaves nothing open."""
    found, is_open = html_extract.read(page)
    assert not any(is_open)
    return "\n\n".join(found)


def test_html():
    assert sure(PAGE) == "Title &amp;\n\nOne two three\n\nfour <x>"
    assert html_extract.read(None) == ([], []) and html_extract.read("") == ([], [])
    assert html_extract.read("<article></article><p>x") == (["x"], [True])
    assert sure('<main><p>a<a title="x>y">b</a></main>') == "ab"
    assert sure("<article><p>a<!-- <p>b") == "a"
    assert html_extract.read("<p>out<main><h1>T</h1><article><p>a</article><p>b</main>") == (["T", "a", "b"], [True, False, True])


def test_html_names():
    for name in ("social-science", "related-work", "has-sidebar", "roadmap", "single comments-open", "thread", "noticeable"):
        assert sure(f"<article><p class='{name}'>a</article>") == "a", name
    for name in ("ad", "related-posts", "relatedPosts", "social-share", "sidebar_left", "x cookie-notice", "comment-list", "top-ad-banner ads"):
        assert sure(f"<article><div id='{name}'>a</div><p>b</article>") == "b", name
    for tag in ("html", "body", "main", "article"):
        assert sure(f"<{tag} class='comments sidebar'><article><p>a</article>") == "a"


def test_repeated_runs():
    rnd = random.Random(3)
    for _ in range(150):
        streams, run = [np.array([rnd.randint(0, 3) for _ in range(rnd.randint(0, 25))]) for _ in range(4)], 3
        for s, gone in zip(streams, html_extract.repeated_tokens(streams, run)):
            want = [False] * len(s)
            for p in range(len(s) - run + 1):
                w = tuple(s[p : p + run])
                if any(tuple(q[k : k + run]) == w for q in streams if q.tobytes() != s.tobytes() for k in range(len(q) - run + 1)):
                    want[p : p + run] = [True] * run
            assert gone.tolist() == want


def test_html_pages(spark):
    frame = "<div>Welcome to the site of news and more for all of you</div><p>%s</p><div>Copyright of the site do not copy any of this text please</div>"
    rows = [(1, "http://h/a", frame % "story one about cats"), (2, "http://h/b", frame % "story two about dogs"), (3, "http://h/b", frame % "story two about dogs"), (4, None, None), (5, "x", PAGE), (5, "x", PAGE)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted((r.page_id, r.url, r.text, r.n_chars) for r in html_extract.extract_text(pages.withColumnRenamed("x", "y")).collect() if r.page_id != 4)
    assert [g[2] for g in got] == ["story one about cats", "story two about dogs", "story two about dogs"] + ["Title &amp;\n\nOne two three\n\nfour <x>"] * 2
    assert all(g[3] == len(g[2]) for g in got)
    assert html_extract.extract_text(pages.where("false")).collect() == []
    assert [(r.text, r.n_chars) for r in html_extract.extract_text(pages.where("page_id = 4")).collect()] == [("", 0)]


def test_html_article_in_named_part():
    assert sure("<body class='has-sidebar'><p>menu</p><article><p>a<p class='ad'>no</article>") == "a"
    assert sure("<div class='sidebar'><article><p>a</article></div>") == "a"
    assert html_extract.read("<div id='comments'><article>no</article></div><aside><article>no</article></aside><p>x") == (["x"], [True])


def brute_text(pages, run):
    """{(page_id, url): text} by looking at each run of each page on its own."""
    read = {key: html_extract.read(page) for key, page in pages}
    host = lambda key: (key[1] or "").split("/")[2].lower() if "://" in (key[1] or "") else ""
    streams = {key: [w for b, o in zip(*found) if o for w in (*b.split(" "), "")] for key, found in read.items()}
    out = {}
    for key, (found, is_open) in read.items():
        own = streams[key]
        others = [s for k, s in streams.items() if host(k) == host(key) and s != own]
        seen = {tuple(s[i : i + run]) for s in others for i in range(len(s) - run + 1)}
        gone = [False] * len(own)
        for i in range(len(own) - run + 1):
            if tuple(own[i : i + run]) in seen:
                gone[i : i + run] = [True] * run
        at, texts = 0, []
        for b, o in zip(found, is_open):
            if not o:
                texts.append(b)
                continue
            words = b.split(" ")
            here = gone[at : at + len(words)]
            at += len(words) + 1
            if not all(here):
                i = 0
                while i < len(here):
                    j = i
                    while j < len(here) and here[j] == here[i]:
                        j += 1
                    if here[i] and j - i < run:
                        here[i:j] = [False] * (j - i)
                    i = j
            texts.append(" ".join(w for w, g in zip(words, here) if not g))
        out[key] = "\n\n".join(t for t in texts if t)
    return out


def test_html_query_brute(spark):
    rnd = random.Random(11)
    words = lambda n: " ".join(rnd.choice("abcde") for _ in range(n))
    shared = [words(9) for _ in range(5)]
    part = lambda: rnd.choice([f"<p>{words(7)}</p>", f"<div>{rnd.choice(shared)} {words(3)}</div>", f"<nav>{words(4)}</nav>", f"<p>{words(2)}"])
    forms = ["{}{}{}", "{}<article>{}{}</article>", "<main>{}<article><p>{}</article>{}</main>", "<main>{}{}</main>{}"]
    rows = [(i, rnd.choice(["http://h/", "https://K.x/", "k"]) + str(i), rnd.choice(forms).format(part(), part(), part())) for i in range(60)]
    rows += [(60, None, None), (61, "http://h/61", rows[0][2])]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for run in (3, 8):
        want = brute_text([((i, u), p) for i, u, p in rows], run)
        for size in (html_extract.SHARD_CHARS, 100):
            assert {(r.page_id, r.url): r.text for r in html_extract.extract_text(pages, run=run, shard_chars=size).collect()} == want


def test_html_large_host(spark):
    rnd = random.Random(5)
    words = lambda n: " ".join(rnd.choice("abcdefgh") for _ in range(n))
    shared = [words(12) for _ in range(8)]
    rows = [(i, f"http://{'hk'[i % 2]}/{i}", f"<p>{words(9)}</p><div>{shared[i // 4]} {words(5)}</div><p>{words(3)}") for i in range(24)]
    pages = spark.createDataFrame([*rows, rows[0], (24, "http://h/24", rows[2][2]), (25, "http://h/25", "<p>b")], "page_id long, url string, html string")
    for run in (3, 8):
        got = [sorted(map(tuple, html_extract.extract_text(pages, run=run, shard_chars=size).collect())) for size in (html_extract.SHARD_CHARS, 40)]
        assert got[0] == got[1] and len(got[0]) == 27


def test_warc_raw_elements():
    assert warc.visible_text("<script>for(i=0;i<n;i++){f(i)}</script><p>text") == "text"
    assert warc.visible_text("<title>a<b c</title><style>x<y</STYLE ><p>d<script>e</scripts>") == "a<b c\nd"


def test_warc_round_trip(spark, tmp_path):
    source = warc.response(7, "http://h/ä", PAGE, "2024-01-01T00:00:00Z")
    data = source.to_bytes() + source.to_bytes()
    assert [r.block for r in warc.parse_records(data)] == [source.block] * 2
    assert [r.block for r in warc.parse_records(gzip.compress(source.to_bytes()) + gzip.compress(source.to_bytes()))] == [source.block] * 2
    with pytest.raises(ValueError, match="cut short"):
        list(warc.parse_records(data[:-30]))
    meta, text = warc.derive(source)
    assert meta.get("WARC-Refers-To") == text.get("WARC-Refers-To") == source.get("WARC-Record-ID")
    assert b"http-header-content-type: text/html" in meta.block and source.get("WARC-Payload-Digest").encode() in meta.block
    assert text.block.decode().split("\n")[1:4] == ["Home", "Buy", "Title &amp;"]
    assert warc.derive(text) == []
    pages = spark.createDataFrame([(7, "http://h/ä", PAGE), (8, None, None)], "page_id long, url string, html string")
    rows = warc.derive_pages(pages)
    assert rows.count() == 4 and warc.derive_pages(pages.where("false")).count() == 0
    warc.write_records(rows, f"file://{tmp_path}/out")
    back = [r for f in sorted((tmp_path / "out").glob("*.gz")) for r in warc.parse_records(f.read_bytes())]
    assert sorted(r.get("WARC-Record-ID") for r in back) == sorted(r.record_id for r in rows.collect())
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.warc").write_bytes(data)
    assert warc.derive_files(spark, f"file://{tmp_path}/in").count() == 4


def test_warc_http():
    body = gzip.compress(b"<p>hi")
    chunked = b"%x\r\n" % len(body) + body + b"\r\n0\r\n\r\n"
    head = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\nContent-Encoding: gzip\r\nX-A: b\r\n c\r\n\r\n"
    _, headers, sent, got, problem = warc.http_parts(head + chunked)
    assert (sent, got, problem) == (chunked, b"<p>hi", "") and ("X-A", "b c") in headers
    coded = lambda coding, body: warc.http_parts(b"HTTP/1.1 200 OK\r\nContent-Encoding: " + coding + b"\r\n\r\n" + body)[3:]
    assert coded(b"deflate", zlib.compress(b"x")) == (b"x", "") and coded(b"identity", b"x") == (b"x", "")
    assert coded(b"br", b"x") == (b"x", "unknown coding br")
    for bad in (head + b"zz\r\nab", head + b"5\r\nab", head + b"2\r\nab\r\n0\r\n\r\n", b"HTTP/1.0 200\r\nContent-Encoding: gzip\r\nContent-Length: many\r\n\r\nplain"):
        assert warc.http_parts(bad)[4]
    assert warc.http_parts(b"junk")[2:] == (b"junk", b"junk", "")


def test_warc_bad_records(spark, tmp_path):
    block = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\nzz\r\n<p>a"
    odd = warc.Record([("WARC-Type", "response"), ("WARC-Record-ID", "<urn:x>"), ("WARC-Date", "d")], block)
    meta, text = warc.derive(odd)
    assert b"source-problem: bad chunk size" in meta.block and text.block.endswith(b"a")
    assert warc.sha1(b"zz\r\n<p>a").encode() in meta.block  # the payload as it was sent
    latin = warc.Record([("WARC-Type", "response")], b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=ISO-8859-1\r\n\r\n\xe9")
    assert warc.derive(latin)[1].block == "é".encode()
    unknown = warc.Record([("WARC-Type", "response")], b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=none\r\n\r\n\xe9")
    assert warc.derive(unknown)[1].block == "\ufffd".encode()
    good = warc.response(1, "http://h/", PAGE, "d").to_bytes()
    for name, data in (("a", good + good[:-40]), ("b", b"no record"), ("c", good.replace(b"Content-Length: ", b"Content-Length: x")), ("d", gzip.compress(good)[:-9]), ("e", good)):
        (tmp_path / name).write_bytes(data)
    rows = warc.derive_files(spark, f"file://{tmp_path}").collect()
    count = lambda name, bad: sum(r.file.endswith(name) and (r.problem is not None) == bad for r in rows)
    assert [(count(n, False), count(n, True)) for n in "abce"] == [(2, 1), (0, 1), (0, 1), (2, 0)] and count("d", True) == 1


def test_warc_ids(spark):
    rows = [(1, "u", "<p>a"), (1, "u", "<p>b"), (None, "u", "<p>a"), (None, "u", "<p>a")]
    pages = spark.createDataFrame([(str(i) if i else None, u, h) for i, u, h in rows] + [("null", "u", "<p>a")], "page_id string, url string, html string")
    got = warc.derive_pages(pages.withColumn("record", F.lit(1))).where("warc_type = 'conversion'").collect()
    assert len(got) == 5 and len({r.record_id for r in got}) == 4


class Shown(html.parser.HTMLParser):
    """What a page shows, read by another parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.hidden = [], 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style")
        if tag in html_extract._BLOCK or tag == "br":
            self.out.append("\n")

    def handle_endtag(self, tag):
        self.hidden -= tag in ("script", "style")
        if tag in html_extract._BLOCK:
            self.out.append("\n")

    def handle_data(self, data):
        if not self.hidden:
            self.out.append(data)


def test_warc_pages_brute(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    rows = {(r.warc_type, r.target_uri, r.source_digest): r for r in warc.derive_pages(pages).collect()}
    seen = 0
    for p in pages.collect():
        digest = "sha1:" + base64.b32encode(hashlib.sha1((p.html or "").encode()).digest()).decode()
        meta, text = (rows[kind, p.url, digest] for kind in ("metadata", "conversion"))
        assert meta.refers_to == text.refers_to and meta.record_id != text.record_id
        for r in (meta, text):
            head, _, rest = r.record.partition(b"\r\n\r\n")
            fields = dict(line.split(b": ", 1) for line in head.split(b"\r\n")[1:])
            block = rest[:-4]
            assert rest.endswith(b"\r\n\r\n") and int(fields[b"Content-Length"]) == len(block) == r.n_bytes
            assert fields[b"WARC-Refers-To"].decode() == r.refers_to and r.record_sha256 == hashlib.sha256(r.record).hexdigest()
            assert r.block_digest == "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()
        shown = Shown()
        shown.feed(p.html)
        lines = [" ".join(x.split()) for x in "".join(shown.out).split("\n")]
        assert text.record.partition(b"\r\n\r\n")[2][:-4].decode() == "\n".join(x for x in lines if x)
        seen += 1
    assert 2 * seen == len(rows) or seen > 10


def test_pipeline(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    at, ids = docs, []
    for name, stage in p.STAGES[:-1]:
        at = p.cut(stage(spark, at, SF), "test")
        assert at.columns == docs.columns
        ids.append({r.doc_id for r in at.select("doc_id").collect()})
    assert all(b <= a for a, b in zip(ids, ids[1:])) and len(ids[-1]) < docs.count()
    whole = p.run(spark, SF)
    assert {r.doc_id for r in whole.select("doc_id").collect()} == ids[-1]
    bodies = [" ".join(r.text.split()) for r in at.select("text").collect()]
    assert len(set(bodies)) == len(bodies)


def test_pipeline_cases(spark):
    import corpus_pipeline as p

    rows = [(1, None, "extra"), (2, "", "extra"), (3, "same text", None), (3, "same text", None), (4, "same  text", "x"), (None, "other", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, th string")
    for _, stage in p.STAGES[1:4]:
        assert stage(spark, docs.where("false"), SF).count() == 0
    assert sorted(str(r.doc_id) for r in p.drop_copies(spark, docs, SF).collect()) == ["1", "3", "None"]
    assert sorted(str(r.doc_id) for r in p.drop_near_copies(spark, docs, SF).collect()) == ["1", "2", "3", "3", "None"]
    assert p.drop_contaminated(spark, docs, SF).count() == 6
    assert hashlib.sha256(b"").hexdigest() in {r.ids_sha256 for r in p.encode(spark, docs, SF).collect()}


def test_pipeline_repeated_ids(spark):
    import corpus_pipeline as p

    item = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    clean = " ".join(f"word{i}" for i in range(80))
    rows = [(1, item), (1, clean), (2, clean + " more"), (None, "quite another text " * 9), (None, item)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = lambda df: sorted((str(r.doc_id), r.text[:5]) for r in df.collect())
    assert kept(p.drop_contaminated(spark, docs, SF)) == [("1", "word0"), ("2", "word0"), ("None", "quite")]
    assert kept(p.drop_near_copies(spark, docs, SF)) == sorted([("1", item[:5]), ("1", "word0"), ("None", "quite")])


def test_pipeline_brute(spark):
    """The pipeline's rows by plain Python: the model's scores are taken, all that follows is computed anew."""
    import tokenizers

    import corpus_pipeline as p

    table = lambda name: spark.read.parquet(f"{SF}/{name}.parquet")
    model = toxicity.fit(table("documents"), table("labels"))
    left = {r.doc_id: r.text or "" for r in table("documents").collect() if model.score(r.text) < 0.3}
    firsts = {}
    for i in sorted(left):
        firsts.setdefault(re.sub("[\x20\x09-\x0d]+", " ", left[i]), i)
    left = {i: left[i] for i in firsts.values()}
    lower = {c: c + 32 for c in range(65, 91)}

    def shingles(text):
        w = re.findall("[^\x20\x09-\x0d]+", text.translate(lower))
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    sets, root = {i: shingles(t) for i, t in left.items()}, {i: i for i in left}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in sets:
            if j < i and sets[i] and 5 * min(len(sets[i]), len(sets[j])) >= 4 * max(len(sets[i]), len(sets[j])) and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    left = {i: t for i, t in left.items() if find(i) == i}
    words = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").translate(lower))
    grams = {}
    for r in table("benchmark").collect():
        w = words(r.text)
        n = min(13, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            grams.setdefault(n, set()).add(tuple(w[i : i + n]))

    def clean(text):
        w = words(text)
        hit = set()
        for n, known in grams.items():
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in known:
                    hit.update(range(i, i + n))
        return not hit or 20 * len(hit) < len(w)

    coder = tokenizers.Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    coder.no_truncation()
    coder.no_padding()
    want = {}
    for i, t in left.items():
        if clean(t):
            ids = coder.encode(t, add_special_tokens=False).ids
            decoded = coder.decode(ids, skip_special_tokens=False)
            want[i] = (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in p.run(spark, SF).collect()} == want
