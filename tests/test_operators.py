import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fabula.operators import beats, folds, matching, retrieval, summaries
from fabula.operators.folds import Card


def test_prf(spark):
    gold = spark.createDataFrame([("a", i) for i in (2, 3, 4, 5)], "g string, k int")
    pred = spark.createDataFrame([("a", i) for i in (1, 2, 3, 3)], "g string, k int")
    r = summaries.set_prf(gold, pred, ["g"], ["k"]).first()
    assert (r.precision, r.recall) == (2 / 3, 1 / 2) and abs(r.f1 - 4 / 7) < 1e-12


def test_means(spark):
    rows = spark.createDataFrame([("en", 1.0), ("en", None)], "lang string, m double")
    zero = {r.lang: r.mean_m for r in summaries.rollup_means(rows, "lang", ["m"], True).collect()}
    skip = {r.lang: r.mean_m for r in summaries.rollup_means(rows, "lang", ["m"], False).collect()}
    assert zero == {"all": 0.5, "en": 0.5} and skip == {"all": 1.0, "en": 1.0}


def test_bm25(spark):
    docs = spark.createDataFrame([(1, 1, ["a", "b"]), (1, 2, ["a", "c"]), (1, 3, ["c", "d"])], "i int, d int, tokens array<string>")
    q = spark.createDataFrame([(1, 9, ["b"])], "i int, q int, tokens array<string>")
    got = {r.d: r.score for r in retrieval.bm25_scores(docs, q, ["i"], "d", "q").collect()}
    assert got.keys() == {1} and abs(got[1] - math.log(2.5 / 1.5)) < 1e-9


def test_fusion(spark):
    ranked = spark.createDataFrame([(1, 7, 1, "bm25"), (1, 7, 1, "vector"), (1, 8, 2, "vector")], "q int, d int, rank int, source string")
    got = retrieval.reciprocal_rank_fusion(ranked, ["q"], "d", 2).orderBy("rank").collect()
    assert [r.d for r in got] == [7, 8] and abs(got[0].score - 2 / 61) < 1e-12 and got[0].trace == "bm25+vector"


def test_memory_order(spark):
    m = spark.createDataFrame([(1, "x", 5), (1, "y", None), (1, "z", 2)], "r int, m string, o int")
    none = spark.createDataFrame([], "r int, m string, score double")
    order = lambda mode: [x.m for x in retrieval.select_memories(m, none, ["r"], "m", "o", mode).orderBy("rank").collect()]
    assert order("bm25_topk") == ["y", "z", "x"] and order("full_memory_all_in") == ["z", "x", "y"] and order("persona_only") == []
    with pytest.raises(NotImplementedError):
        order("graph")


def test_greedy(spark):
    scores = spark.createDataFrame([(1, 0, 0, 0.9), (1, 0, 1, 0.8), (1, 1, 0, 0.7), (1, 1, 1, 0.3)], "s int, gi int, pi int, score double")
    assert [(r.gi, r.pi) for r in matching.greedy_pairs(scores, ["s"]).collect()] == [(0, 0)]


def test_links(spark):
    arcs = spark.createDataFrame([("p", ["b", "x", "b", "a"]), ("q", ["a", "x"])], "arc string, links array<string>").withColumn("g", F.lit(1))
    known = spark.createDataFrame([("a", 1), ("b", 1)], "node string, g int")
    assert [(r.arc, r.links) for r in matching.valid_links(arcs, "links", known, ["g"], "node").collect()] == [("p", ["b", "a"])]


def test_strict_join(spark):
    left = spark.createDataFrame([(1,), (2,)], "k int")
    with pytest.raises(Exception, match="no partner"):
        matching.strict_join(left, spark.createDataFrame([(1, "a")], "k int, v string"), ["k"]).collect()


def test_beats():
    assert beats.split_beats(None, "t") == [(0, "t", "")]
    body = "word " * 60
    got = beats.split_beats(f"INT. HOUSE - DAY\n{body}\nEXT. STREET - NIGHT\n{body}", "t")
    assert [b[1] for b in got] == ["INT. HOUSE - DAY", "EXT. STREET - NIGHT"]
    long = beats.split_beats("\n".join(f"line number {i}" for i in range(200)))
    assert len(long) > 2 and long[0][2].startswith("line number 0\n") and long[-1][2].endswith("line number 199")


cards = st.lists(st.tuples(st.integers(1, 40), st.integers(0, 5), st.sampled_from(["a secret kiss", "they refuse", "new belief and comfort", "", "locked window"])), max_size=30, unique_by=lambda t: t[0])


def _cards(rows):
    return [Card(str(o), o, s, "active", {"role_in_scene": t, "goal_shift": t}) for o, s, t in rows]


@settings(max_examples=60, deadline=None)
@given(cards, st.integers(1, 24), st.randoms())
def test_selection_bounds(rows, budget, rnd):
    for select in (folds.select_milestones, folds.select_milestones_wide):
        chosen = select(_cards(rows), budget)
        assert len(chosen) <= budget and len({c.scene_id for c in chosen}) == len(chosen)
        assert [c.scene_order for c in chosen] == sorted(c.scene_order for c in chosen)
        mixed = list(rows)
        rnd.shuffle(mixed)
        assert [c.scene_id for c in select(_cards(mixed), budget)] == [c.scene_id for c in chosen]
    strong = {str(o) for o, s, _ in rows if s >= 4}
    if len(strong) <= budget:
        assert strong <= {c.scene_id for c in folds.select_milestones(_cards(rows), budget)}


def test_targets():
    c = _cards([(i, 2, "") for i in range(1, 31)])
    t = folds.bucket_targets(c, 12, 30)
    assert sum(t.values()) == 12 and min(t.values()) >= 3


def _card(order, score=3, part="active", scene=None, **fields):
    return Card(scene or str(order), order, score, part, fields)


def test_arcs():
    love = lambda o, more="": _card(o, role_in_scene=f"a kiss {more}")
    assert folds.same_arc(love(1, "here now"), love(7, "other words"))
    assert not folds.same_arc(love(1), love(8))
    assert not folds.same_arc(_card(1, role_in_scene="a kiss, comfort one two"), _card(6, role_in_scene="some kiss three four"))  # support in either card
    a, b = _card(1, role_in_scene="secret alpha beta gamma"), _card(5, role_in_scene="alpha delta epsilon")
    assert folds.same_arc(a, b)  # a reveal in one card is enough
    assert not folds.same_arc(_card(1, role_in_scene="alpha beta gamma"), _card(5, role_in_scene="alpha beta gamma"))
    assert folds.same_arc(_card(1, role_in_scene="alpha beta gamma"), _card(3, role_in_scene="alpha beta gamma"))


def test_priority():
    assert _card(1, 2, "foreground", role_in_scene="x").priority == (22, 2, 0, 2)
    assert _card(1, 2, "active", role_in_scene="a kiss and comfort").strength == 20 + 1 + 4 - 4  # support doesn't waive what intimacy costs
    assert _card(1, 0, "", role_in_scene="comfort and belief").strength == 4 + 8
    assert _card(1, 0, "", role_in_scene="her family decides").strength == 7 + 4 + 2


def test_novelty():
    chosen = [_card(1, role_in_scene="alpha beta gamma"), _card(2, role_in_scene="alpha beta gamma")]
    assert folds.novelty(_card(3, role_in_scene="alpha beta gamma"), []) == (0, 2, 1, 0)
    assert folds.novelty(_card(3, role_in_scene="alpha beta gamma", goal_shift="alpha"), chosen) == (1, 1, 0, -2)
    assert folds.novelty(_card(3, role_in_scene="alpha beta gamma"), chosen) == (0, 0, 0, -2)
    assert folds.novelty(_card(9, role_in_scene="she decides to pick a window lock"), chosen) == (0, 2, 1, 0)


def test_observers():
    assert folds.weak_observer(_card(1, 3, role_in_scene="An Observer")) and not folds.weak_observer(_card(1, 4, role_in_scene="observer"))
    assert not folds.weak_observer(_card(1, 3, milestone_reason="observer"))


def test_rebalance_stops_at_the_neediest_third():
    cards = [_card(o, 3) for o in (1, 2, 3)] + [_card(10, 4), _card(19, 3), _card(20, 3)]
    chosen = cards[:3]
    # late lacks most and has no strong card, so nothing is swapped although middle has one
    assert folds.rebalance(chosen, cards, {"early": 1, "middle": 1, "late": 2}, 20) == chosen
    assert [c.scene_order for c in folds.rebalance(chosen, cards, {"early": 1, "middle": 2, "late": 1}, 20)] == [2, 3, 10]


def test_refine():
    held = _card(5, 5, role_in_scene="comfort")
    better = _card(6, 4, role_in_scene="comfort and belief")
    assert folds.heuristic_judge(better, held) == "b" and folds.heuristic_judge(better, _card(5, 4, role_in_scene="comfort belief")) == "a"
    assert folds.refine([held], [held, better], 1, 8) == [better]  # both are strong: the judge decides
    assert folds.refine([held], [held, _card(6, 3, role_in_scene="comfort and belief")], 1, 8) == [held]
    assert folds.refine([held], [held, better], 1, 0) == [held] and folds.refine([held], [held, better], 2, 8) == [held, better]


def _node(order, beat=0, rank=5, scene=None, kind="x", quotes=1, **more):
    return {"scene_id": scene or str(order), "scene_order": order, "beat_index": beat, "rank": rank, "candidate_score": rank, "change_type": kind, "n_quotes": quotes, **more}


def test_prune_rules():
    assert len(folds.prune([_node(1, 0), _node(1, 0, 9)])) == 1  # a beat once
    assert [n["beat_index"] for n in folds.prune([_node(1, b, b) for b in range(4)])] == [2, 3]
    # the last place is that of a dropped node, so places 1 and 2 are both early: two seats by quota, then the rest by rank
    assert len(folds.prune([_node(1, b, scene=f"s{b}") for b in range(3)] + [_node(90, kind=" Other ", quotes=0)])) == 3
    assert folds.prune([_node(3, kind="other", quotes=0)]) == [] and len(folds.prune([_node(None, None)])) == 1
    many = [_node(o, 0, r) for o, r in zip(range(1, 31), range(30, 0, -1), strict=True)]
    kept = [n["scene_order"] for n in folds.prune(many)]
    assert kept == [1, 2, 3, 4, 5, 6, 7, 8, 11, 12, 13, 21, 22, 23]


def test_repair_rules():
    nodes = [_node(2), _node(1)]
    assert folds.repair(nodes, []) == nodes  # nothing to repair with
    pool = [_node(o, 0, r) for o, r in ((10, 5), (11, 5), (50, 3), (90, 1))]
    got = folds.repair([], pool)
    assert [n["scene_order"] for n in got] == [10, 11, 50, 90]
    got = folds.repair([_node(o, 0, 5, candidate_score=o) for o in range(1, 13)], [_node(30, 0, 1, candidate_score=0)])
    assert len(got) == 9 and [n["scene_order"] for n in got] == [5, 6, 7, 8, 9, 10, 11, 12, 30][-9:]  # the least candidate scores of the fullest third go


def test_important_pairs_rules():
    def pair(gap, label="early", score=1, anchored=True, **more):
        a, _, b = label.partition("->")
        return {"scene_gap": gap, "phase_label": label, "prev_phase": a, "next_phase": b or a, "pair_score": score, "anchored": anchored, "prev_core": False, "next_core": False, **more}

    assert folds.important_pairs([]) == []
    assert folds.important_pairs([pair(0, anchored=False), pair(11)]) == [0, 1]  # none is usable: all may be
    assert folds.important_pairs([pair(8, anchored=False), pair(3)]) == [1]  # anchored and near ones are the pool
    assert folds.important_pairs([pair(9), pair(7, "early->late"), pair(10, anchored=False)]) == [0, 2]
    rows = [pair(1, score=9), pair(2, "early->middle"), pair(3, "middle"), pair(4, "middle->late"), pair(5, "late"), pair(6, "late", 8)]
    assert folds.important_pairs(rows) == [0, 1, 3, 5]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 20), st.integers(0, 3), st.integers(0, 9)), max_size=25))
def test_prune_and_repair(rows):
    nodes = [{"scene_id": str(o), "scene_order": o, "beat_index": b, "rank": r, "candidate_score": r, "change_type": "x", "n_quotes": 1, "i": i} for i, (o, b, r) in enumerate(rows)]
    kept = folds.prune(nodes)
    assert len(kept) <= 14 and all(sum(k["scene_id"] == n["scene_id"] for k in kept) <= 2 for n in kept)
    assert len(folds.repair(nodes[:3], nodes[3:])) <= 9


def test_prune_pool(spark):
    """prune keeps the same nodes of the pool as of all, ties and full scenes included, and the pool of a long role is short."""
    import random

    rnd = random.Random(4)
    order = ["scene_order", "beat_index", "no", "scene_id", "change_type", "n_quotes"]
    kinds = ["other", " Other ", "career_move"]
    rows = []
    for role, (n, scenes, places, ranks) in enumerate([(3000, 40, 97, 9), (3000, 3, 97, 9), (2000, 500, 3, 2), (500, 5, 9, 1), (40, 9, 30, 5), (3, 2, 2, 2), (900, 2, 1, 4)]):
        rows += [(role, f"s{rnd.randrange(scenes)}", rnd.randrange(places), rnd.randrange(4), rnd.randrange(ranks), rnd.choice(kinds), rnd.randrange(2), i) for i in range(n)]
    df = spark.createDataFrame(rows, "role long, scene_id string, scene_order long, beat_index int, rank int, change_type string, n_quotes int, no long").repartition(5)
    pool = folds.prune_pool(df, ["role"], order)
    assert max(r["count"] for r in pool.groupBy("role").count().collect()) <= 3 * 2 * 14
    kept = lambda x: sorted(tuple(r[c] for c in df.columns) for r in folds.per_role(x, ["role"], folds.prune, order).collect())
    assert folds.per_role(pool, ["role"], folds.prune, order).schema == df.schema
    assert kept(pool) == kept(df)


def test_arcs_of_a_kind_are_scored_once(spark):
    """Many arcs of few vectors and scenes: the join makes no row for each pair, and the first of equal ones is found."""
    arcs = lambda n, k: spark.createDataFrame([(i % 2, i, 1000 - i, [float(i % 3 + 1), 2.0], [i % k, 0, i % k]) for i in range(n)], "role long, arc_id long, pos long, vector array<double>, scenes array<long>")
    gold, predicted = arcs(600, 4), arcs(900, 5)
    got = {(r.role, r.arc_id): (r.predicted_id, r.score) for r in matching.best_arc_match(gold, predicted, "role").collect()}

    def score(g, p):
        a, b, s, t = g.vector, p.vector, set(g.scenes), set(p.scenes)
        dot = lambda x, y: sum(i * j for i, j in zip(x, y, strict=True))
        return 0.85 * dot(a, b) / (dot(a, a) ** 0.5 * dot(b, b) ** 0.5) + (1 - 0.85) * (len(s & t) / len(s | t))

    others = predicted.collect()
    assert len(got) == 600
    for g in gold.collect()[::37]:
        best, first = max((round(score(g, p), 9), -p.pos) for p in others if p.role == g.role)
        found, points = got[g.role, g.arc_id]
        assert (found, round(points, 9)) == (1000 + first, best)
    plan = matching.best_arc_match(gold, predicted, "role")
    plan.collect()
    nodes, made = [plan._jdf.queryExecution().executedPlan().executedPlan()], []
    while nodes:
        node = nodes.pop()
        kids = node.plan().children() if node.getClass().getSimpleName().endswith("QueryStageExec") else node.children()
        if "Join" in node.nodeName():
            made.append(node.metrics().apply("numOutputRows").value())
        nodes += [kids.apply(i) for i in range(kids.size())] or ([node.plan()] if node.getClass().getSimpleName().endswith("QueryStageExec") else [])
    assert made and max(made) <= 900


def test_ratios_are_those_of_sequence_matcher():
    """For thousands of pairs at a time, in any letters, and in a fraction of the time."""
    import random
    import time
    from difflib import SequenceMatcher

    import pyarrow as pa

    rnd = random.Random(8)
    for letters in ("ab", "abc 0123", "äb陈𝒳c"):
        names = []
        for _ in range(1500):
            x = "".join(rnd.choice(letters) for _ in range(rnd.choice([5, 6, 9, 18, 30, 119, 120, 121, 210])))
            y = list(x)
            for _ in range(rnd.randrange(1, 3 + len(x) // 5)):
                k = rnd.randrange(len(y))
                y[k : k + rnd.randrange(2)] = rnd.choice(["", rnd.choice(letters)])
                y = y or ["a"]
            names.append((x, "".join(y)) if rnd.random() < 0.8 else (x, "".join(rnd.sample(x, len(x)))))
        for least in (0.86, 0.6):
            got = matching._ratios(pa.array([x for x, _ in names]), pa.array([y for _, y in names]), least)
            for (x, y), g in zip(names, got, strict=True):
                if max(len(x), len(y)) <= matching.LONG:
                    assert g == (SequenceMatcher(None, x, y).ratio() >= least), (x, y)
                else:
                    assert g == matching.names_alike(x, y, least)
    pairs = [[f"supplier {i * k % 10**6:09d}" for i in range(4096)] for k in (7919, 104729)]
    x, y = map(pa.array, pairs)
    begin = time.process_time()
    many = matching._ratios(x, y, 0.86)
    between = time.process_time()
    assert many.tolist() == [SequenceMatcher(None, p, q).ratio() >= 0.86 for p, q in zip(*pairs, strict=True)]
    assert 3 * (between - begin) < time.process_time() - between
