"""Operators with exact answers against brute force: copies, near copies, repeated passages, benchmark passages, licences."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from fabula.llm import components, decontaminate, exact_dedup, licenses, near_dedup, substring_dedup, toxicity

SCHEMA = "doc_id long, text string, lang string, id string, th string, words string"


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(7)
    vocabulary = [f"w{i}" for i in range(60)] + ["Äpfel", "the", "of"]
    out = [None, "", " \n\t", "one", "one", "one two", "x" * 3000, "a " * 200, "a " * 200]
    passage = [rnd.choice(vocabulary) for _ in range(60)]
    for _ in range(60):
        words = [rnd.choice(vocabulary) for _ in range(rnd.randint(1, 150))]
        if rnd.random() < 0.4:
            at, cut = rnd.randint(0, len(words)), rnd.randint(0, 30)
            words[at:at] = passage[cut : cut + rnd.randint(20, 60)]
        out.append(" ".join(words))
        if rnd.random() < 0.5:
            near = list(words)
            near[rnd.randrange(len(near))] = "CHANGED"
            out += [" ".join(near), "  ".join(words)]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(i, t, None, "x", None, "y") for i, t in enumerate(texts)], SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_exact(docs, texts, empty):
    got = by_id(exact_dedup.exact_duplicates(docs))
    body = [re.sub("[\x20\x09-\x0d]+", " ", t or "") for t in texts]
    for i, b in enumerate(body):
        same = [j for j, x in enumerate(body) if x == b]
        r = got[i]
        assert (r.keep_id, r.group_size, r.kept, r.text_sha256) == (same[0], len(same), i == same[0], hashlib.sha256(b.encode()).hexdigest())
    assert exact_dedup.exact_duplicates(empty).collect() == []


def test_exact_in_batches(docs, texts):
    whole, parts = by_id(exact_dedup.exact_duplicates(docs)), by_id(exact_dedup.exact_duplicates(docs, files_per_batch=1))
    assert whole == parts


def test_exact_clashes(spark, docs, texts, monkeypatch):
    """Texts that differ under one digest are told apart by their bytes."""
    want = {i: (r.keep_id, r.group_size, r.kept) for i, r in by_id(exact_dedup.exact_duplicates(docs)).items()}
    whole = sorted(r.doc_id for r in exact_dedup.first_of_each(docs).collect())
    assert whole == sorted(i for i, (_, _, kept) in want.items() if kept)
    keyed = exact_dedup._keyed
    monkeypatch.setattr(exact_dedup, "_keyed", lambda *a: keyed(*a).withColumns({"digest": F.unhex(F.lit("00")), "n_bytes": F.col("n_bytes") % 3}))
    assert {i: (r.keep_id, r.group_size, r.kept) for i, r in by_id(exact_dedup.exact_duplicates(docs)).items()} == want


def test_first_of_each(spark):
    rows = [(3, "a", 1), (3, "a", 1), (4, "a", 2), (None, "a", 3), (None, "b", 4), (5, None, 5), (6, "", 6), (7, " c", 7), (7, "c", 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, digest long")
    assert sorted(r.digest for r in exact_dedup.first_of_each(docs).collect()) == [1, 4, 5, 7, 8]
    assert exact_dedup.first_of_each(docs.where("false")).collect() == []
    named = docs.withColumnsRenamed({"digest": "keep"}).withColumns({"body": F.col("text"), "size": F.col("keep"), "_id": F.col("keep"), "_th": F.col("text"), "n": F.col("keep"), "rep": F.col("keep")})
    assert sorted(r.keep for r in exact_dedup.first_of_each(named).collect()) == [1, 4, 5, 7, 8]
    from fabula.llm.common import cut, without

    gone = cut(near_dedup.near_duplicates(named).where("doc_id = 4").select("doc_id", "text_hash"), "gone")
    assert without(named, gone).columns == named.columns and without(named, gone).count() == 8


def test_exact_repeated_rows(spark):
    docs = spark.createDataFrame([(3, "a"), (3, "a"), (None, "a"), (None, "b")], "doc_id long, text string")
    got = sorted(exact_dedup.exact_duplicates(docs).select("doc_id", "keep_id", "group_size", "kept").collect(), key=str)
    assert [tuple(r) for r in got] == sorted([(3, 3, 3, True)] * 2 + [(None, 3, 3, False), (None, None, 1, True)], key=str)


def sets(texts, size):
    out = []
    for t in texts:
        w = re.findall("[^\x20\x09-\x0d]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        out.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
    return out


@pytest.mark.parametrize("size", [2, 5])
def test_near(docs, texts, empty, size):
    s = sets(texts, size)
    root = list(range(len(s)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(s)):
        for j in range(i):
            if s[i] and 100 * len(s[i] & s[j]) >= 80 * len(s[i] | s[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    got = by_id(near_dedup.near_duplicates(docs, shingle=size))
    assert {i: (r.n_shingles, r.component_id, r.kept) for i, r in got.items()} == {i: (len(s[i]), find(i), find(i) == i) for i in range(len(s))}
    assert near_dedup.near_duplicates(empty).collect() == []


def test_near_meets_once(spark, monkeypatch):
    """Documents just below the similarity share a hundred lists; as a pair they are looked at once, from either side."""
    words = [f"w{i}" for i in range(300)]
    texts = [" ".join("x" + w + str(k) if i % 32 == 2 * k and i < 288 else w for i, w in enumerate(words)) for k in range(16)]
    texts += [texts[0].replace("w299", "end"), texts[9].replace("w299", "end")]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    seen, linked = [], near_dedup._linked

    def counted(pairs, sets, percent):
        a, b = pairs.columns
        seen.append((pairs.count(), pairs.select(F.least(a, b), F.greatest(a, b)).distinct().count()))
        return linked(pairs, sets, percent)

    monkeypatch.setattr(near_dedup, "_linked", counted)
    got = by_id(near_dedup.near_duplicates(docs, shingle=2))
    assert {i: r.component_id for i, r in got.items()} == {**{i: i for i in range(16)}, 16: 0, 17: 9}
    assert len(seen) > 1 and all(n <= 2 * once for n, once in seen[1:])
    assert seen[1][1] > 20


def test_near_ids(spark):
    a, b = "one two three four five six seven eight nine ten eleven", "red green blue cyan"
    rows = [(1, a), (1, b), (2, a + " twelve"), (None, b), (None, "lone words"), (None, "lone  words"), (7, "lone"), (8, None), (8, None)]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=2)
    found = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got.collect()), key=str)
    want = [(1, 10, 1, True), (1, 3, 1, True), (2, 11, 1, False), (None, 3, 1, False), (None, 1, None, True), (None, 1, None, True), (7, 1, 7, True), (8, 0, 8, True), (8, 0, 8, True)]
    assert found == sorted(want, key=str)


def test_near_sketches_share_two_values():
    """Of linked sets of any size, in whichever place they differ, two retained values are equal; sketches have a bounded size."""
    import numpy as np

    rnd = np.random.default_rng(5)
    bits = rnd.integers(1, 25, near_dedup.BUCKETS)
    for n in (4, 5, 9, 17, 40, 100, 300, 1000, 6000):
        for _ in range(30):
            both = rnd.integers(1, 1 << 63, n, dtype=np.uint64)
            most = 20 * n // 100  # elements that only one set has
            left = int(rnd.integers(0, most + 1))
            right = most - left
            x = np.unique(both[: n - right])
            y = np.unique(np.concatenate((both[left : n - right], rnd.integers(1, 1 << 63, right, dtype=np.uint64))))
            if 100 * len(np.intersect1d(x, y)) < 80 * len(np.union1d(x, y)) or len(x) == len(np.intersect1d(x, y)) == len(y):
                continue
            sizes = np.array([len(x), len(y)])
            values, at = near_dedup.sketches(np.concatenate((x, y)), sizes, 80, bits)
            assert len(np.intersect1d(values[: at[1]], values[at[1] :])) >= 2
            assert len(values) <= 2 * 2 * near_dedup.MOST


def test_odd_sketch_is_a_bound():
    import numpy as np

    rnd = np.random.default_rng(6)
    for n in (5, 100, 3000):
        x, y = (np.unique(rnd.integers(1, 2 * n, n).astype(np.uint64)) for _ in range(2))
        marks = near_dedup.odd_sketch(np.concatenate((x, y)), np.repeat([0, 1], [len(x), len(y)]), 2).view(np.uint64)
        assert int(np.bitwise_count(marks[0] ^ marks[1]).sum()) <= len(np.setxor1d(x, y))


def thue_morse(n, a, b):
    return "".join((a, b)[bin(i).count("1") % 2] for i in range(n))


def test_words_that_cancel_out(spark):
    """Words that a polynomial modulo a power of two takes for one another."""
    filler = [f"v{i}" for i in range(34)]
    for n in (64, 1024, 4096):
        x, y = thue_morse(n, "a", "b"), thue_morse(n, "b", "a")
        docs = spark.createDataFrame([(1, x), (2, y), (3, " ".join([*filler, x])), (4, " ".join([*filler, y]))], "doc_id long, text string")
        assert {r.component_id for r in near_dedup.near_duplicates(docs, shingle=2).where("doc_id < 3").collect()} == {1, 2}
        assert {r.n_removed for r in substring_dedup.remove_repeated(docs).collect()} == {0}
    x, y = thue_morse(1 << 12, "a ", "b "), thue_morse(1 << 12, "b ", "a ")
    from fabula.llm.common import FIRST, SECOND, word_hashes

    hashes, at = word_hashes([x.encode(), y.encode()])
    for kind in (FIRST, SECOND)[1:]:
        one, two = kind.spans(kind.prefix(hashes), at[:-1], at[1:])
        assert one != two


def test_components(spark):
    rnd = random.Random(5)
    links = [(i, i + 1) for i in range(100, 160)] + [(rnd.randint(0, 60), rnd.randint(0, 60)) for _ in range(40)] + [(7, 7)]
    root = {x: x for p in links for x in p}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    got = {r.id: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root if find(x) != x}
    assert components.components(spark.createDataFrame([], "a long, b long")).collect() == []


@pytest.mark.parametrize("window", [8, 35])
def test_substring(docs, texts, empty, window):
    words = [(t or "").encode().split() for t in texts]
    starts = {}
    for i, w in enumerate(words):
        for j in range(len(w) - window + 1):
            starts.setdefault(tuple(w[j : j + window]), []).append((i, j))
    gone = [[False] * len(w) for w in words]
    for where in starts.values():
        if len(where) > 1:
            for i, j in where:
                gone[i][j : j + window] = [True] * window
    got = by_id(substring_dedup.remove_repeated(docs, window))
    for i, w in enumerate(words):
        r = got[i]
        assert (r.n_words, r.n_removed, r.kept.encode()) == (len(w), sum(gone[i]), b" ".join(x for x, g in zip(w, gone[i]) if not g))
    assert substring_dedup.remove_repeated(empty, window).collect() == []


def test_automaton():
    rnd = random.Random(3)
    for _ in range(50):
        shard = [[bytes([rnd.randint(97, 99)]) for _ in range(rnd.randint(0, 30))] for _ in range(3)]
        text = [bytes([rnd.randint(97, 100)]) for _ in range(30)]
        got = list(substring_dedup.SuffixAutomaton(shard).statistics(text))
        inside = lambda p: any(p == s[k : k + len(p)] for s in shard for k in range(len(s)))
        assert got == [max((n for n in range(1, i + 2) if inside(text[i + 1 - n : i + 1])), default=0) for i in range(30)]


def test_known_passages(docs, texts):
    got = by_id(substring_dedup.remove_known_passages(docs, [[texts[12]], [texts[9]]], window=5))
    assert got[12].n_removed == got[12].n_words == len(texts[12].split()) and got[12].text == ""
    with pytest.raises(ValueError):
        substring_dedup.remove_known_passages(docs, [[texts[7]]], max_reference_words=10)


def test_contamination(spark, docs, texts, empty):
    items = [(1, texts[12]), (10, texts[12].upper()), (2, None), (3, "?!"), (4, "one"), (5, "W1 w2"), (6, " ".join(texts[20].split()[:13]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    split = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    got = by_id(decontaminate.contamination(docs, bench))
    for i, t in enumerate(texts):
        w = split(t)
        hit, found = [False] * len(w), set()
        for k, text in items:
            x = split(text)
            n = min(13, len(x))
            grams = {tuple(x[j : j + n]) for j in range(len(x) - n + 1)} if x else set()
            for j in range(len(w) - n + 1 if n else 0):
                if tuple(w[j : j + n]) in grams:
                    hit[j : j + n] = [True] * n
                    found.add(str(k))
        r = got[i]
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (len(w), sum(hit), len(found), sum(hit) > 0 and 20 * sum(hit) >= len(w))
        assert r.items_sha256 == hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
    assert decontaminate.contamination(empty, bench).collect() == []
    none = by_id(decontaminate.contamination(docs, bench.where("false")))
    assert not any(r.contaminated for r in none.values())


def test_contamination_without_broadcast(spark, docs, texts, monkeypatch):
    bench = spark.createDataFrame([(1, texts[12]), (4, "one"), (5, "w1 w2")], "item_id long, text string")
    small = by_id(decontaminate.contamination(docs, bench))
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 0)
    assert by_id(decontaminate.contamination(docs, bench)) == small


def test_licenses(spark, empty):
    text = ["x\nReleased under the MIT License.\ny", "Released under an MIT License", None, "", "word", "Licensed under the Apache License, Version 2.0.\nLicensed under CC BY 4.0.", "\n\n".join(licenses.TEMPLATES["MIT"][2:]), "a " * 5000]
    docs = spark.createDataFrame(list(enumerate(text)), "doc_id long, text string")
    got = {i: r.license_ids for i, r in by_id(licenses.license_matches(docs)).items()}
    assert got == {0: "MIT", 1: "", 2: "", 3: "", 4: "", 5: "Apache-2.0,CC-BY-4.0", 6: "MIT", 7: ""}
    assert licenses.license_matches(empty).collect() == []


def test_license_bounds():
    for size in range(1, 60):
        allowed = set(licenses._bounds(size, 80))
        assert {n for n in range(1, 200) if 200 * min(n, size) >= 80 * (n + size)} <= allowed


def test_license_repeats(spark):
    notice = licenses.TEMPLATES["Apache-2.0"][1]
    text = [" ".join([notice] * 4), "Released under the MIT License. " * 60, "Released under the MIT License. " * 900, " ".join(f"w{i}" for i in range(5000)), "one two " * 5000]
    got = [r.license_ids for r in licenses.license_matches(spark.createDataFrame(enumerate(text), "doc_id long, text string")).orderBy("doc_id").collect()]
    assert got == ["Apache-2.0", "MIT", "MIT", "", ""]


def test_stores_are_closed_when_their_tasks_end(docs):
    """Else the stores of all partitions stay in an executor's memory for a minute, beside the stages that follow."""
    exact_dedup.first_of_each(docs).count()
    assert docs.sparkSession._jvm.org.apache.spark.sql.execution.streaming.state.RocksDBMemoryManager.getNumRocksDBInstances(True) == 0


def test_idle_workers_hold_no_freed_memory(spark):
    def held(batches):
        """How many MB a worker could give back: freed memory that it holds all the same."""
        import pyarrow as pa

        from fabula.llm.common import give_back

        def mb():
            with open("/proc/self/smaps_rollup") as f:
                return int(re.search(r"\nPss_Anon:\s+(\d+)", f.read())[1]) / 1024

        for _ in batches:
            pass
        before = mb()
        give_back()
        yield pa.record_batch([pa.array([before - mb()])], ["mb"])

    long = spark.range(4000, numPartitions=4).selectExpr("id AS doc_id", "array_join(transform(sequence(1, 1500), k -> hex(hash(id, k))), ' ') AS text").localCheckpoint()
    freed = {}
    stages = {"toxicity": lambda: toxicity.filter_documents(long, toxicity.Model(np.zeros(toxicity.BUCKETS), -3.0)), "near dedup": lambda: near_dedup.near_duplicates(long)}
    for name, stage in stages.items():
        with near_dedup.scratch():
            stage().write.format("noop").mode("overwrite").save()
        freed[name] = max(r.mb for r in spark.range(4, numPartitions=4).mapInArrow(held, "mb double").collect())
    assert max(freed.values()) < 32, freed
