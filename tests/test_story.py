"""Builds, evaluation, repairs and role play end to end, with a provider that answers by the kind of question."""

import json

import pytest
from pyspark.sql import functions as F

from fabula import __main__ as cli
from fabula.operators import retrieval
from fabula.plans import beat_story, evaluation, prompts, repairs, roleplay, timeline
from fabula.plans.providers import Offline
from fabula.sources import readers, sinks

SCENES = [{"_id": str(i), "title": f"INT. ROOM {i}", "subtitle": "", "content": f"BARRY\nI decide to go {i}.\n{'LENA' if i % 2 else 'EXTRA'}\nYes, the secret.\n"} for i in range(12)]


class Scripted(Offline):
    """Answers in JSON, by the instruction at the head of the question."""

    def complete(self, messages, max_tokens=512, temperature=0.0):
        text = "\n".join(m["content"] for m in messages)
        kind = next((k for k, (english, _) in prompts.INSTRUCTIONS.items() if english in text), "")
        quote = next((line for line in text.splitlines() if line.startswith("I decide")), "")
        number = "".join(c for c in quote if c.isdigit())
        if kind == "beat":
            who = [{"character_name": "BARRY (V.O.)", "importance": "core", "durable_change": True, "change_type": "explicit_decision", "salient_development": f"Barry goes to {number}", "goal_state": "to go", "evidence_quotes": [quote, "not there"]}, {"character_name": ""}]
            return json.dumps({"beat_summary": "s", "characters_present": ["BARRY", " "], "character_updates": who})
        if kind == "refine":
            return json.dumps({"timeline_summary": "Barry goes.", "final_nodes": [{"scene_id": str(i), "beat_index": 0, "salient_development": f"node {i}"} for i in (0, 0, 5, 99)]})
        if kind == "propose_nodes":
            return json.dumps({"proposed_nodes": [{"scene_id": "1", "salient_development": "one"}, {"scene_id": "1", "salient_development": "again"}, {"scene_id": "x", "salient_development": "no"}]})
        if kind == "render_node":
            return json.dumps([{"salient_development": f"told {number}", "evidence_quotes": [quote]}])
        if kind == "scene_roles":
            return json.dumps({"scene_cards": [{"scene_id": "0", "scene_role": "FOREGROUND", "milestone_score": 9, "goal_shift": "to go"}]})
        if kind == "scene_role":
            return json.dumps({"scene_role": "active", "milestone_score": "2", "evidence_quotes": [quote]})
        if kind == "arcs":
            ids = sorted({w.strip('"') for w in text.replace(",", " ").replace(":", " ").replace("{", " ").replace("}", " ").split() if w.strip('"').startswith(("node_", "ptu_", "n"))})
            return json.dumps({"arcs": [{"title": "T", "linked_timeline_node_ids": [*ids[:3], ids[0], "zz"]}, {"title": "short", "linked_timeline_node_ids": ids[:1]}]})
        if kind == "facts":
            return json.dumps({"facts": [{"fact_text": "Barry goes", "fact_type": "goal"}, {"text": "barry  GOES!"}, {"fact_text": "Barry stays", "fact_id": "S"}]})
        if kind == "facts_supported":
            return json.dumps({"supported_fact_ids": ["F1", "F1", "none"]})
        if kind == "repair_nodes":
            return json.dumps({"repairs": [{"timeline_node_id": "n0", "goal_state": "mended", "evidence_quotes": ["not there"]}]})
        if kind in ("same_development", "arc_focus", "coherent"):
            return "TRUE"
        if kind == "judge_turn":
            return json.dumps({"score": 4, "reason": "fine"})
        if kind == "judge_path":
            return json.dumps({"turns": [{"turn_index": 1, "score": 9}, {"turn_index": "x", "score": 1}]})
        return super().complete(messages, max_tokens, temperature)


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    root = tmp_path_factory.mktemp("root") / "English"
    folder = root / "en1"
    folder.mkdir(parents=True)
    write = lambda name, value: (folder / name).write_text(json.dumps(value))
    write("script.json", SCENES)
    write("roles.json", {"roles": [{"character_name": "Barry"}]})
    node = lambda i, **more: {"timeline_node_id": f"n{i}", "scene_id": str(i), "scene_order": i + 1, "scene_title": "t", "salient_development": f"Barry goes to {i}", "evidence_quotes": []} | more
    roles = [{"character_name": "Barry", "aliases": ["B."], "timeline_summary": "short", "timeline_nodes": [node(i) for i in (0, 3, 6)]}]
    arc = {"arc_id": "a", "character_name": "Barry", "title": "T", "linked_timeline_node_ids": ["n0", "n6", "gone"]}
    for prefix in ("", "pred_"):
        write(f"{prefix}task_1_character_timelines.json", {"focal_character_timelines": roles})
        write(f"{prefix}task_1_cross_scene_arcs.json", {"cross_scene_arcs": [arc]})
    write("x_role_assets.json", {"roles": [{"character_name": "Barry", "persona_card": {"traits": ["shy", "kind"], "constraints": ["stay calm."]}, "relations": [{"target_character": "Lena", "relation_summary": "loves"}], "memories": [{"memory_id": f"m{i}", "memory_text": f"memory {w}", "scene_order": i, "tags": ["t"]} for i, w in enumerate(["pudding plane", "sisters call", "plane ticket", "harmonium"])]}]})
    write("x_single_turn.json", {"instances": [{"instance_id": "i1", "character": "Barry", "input": {"dialogue_history": [{"speaker": "Lena", "text": "hi"}], "current_user_turn": "the plane?"}, "reference": {"source_memory_ids": ["m2", "m3"]}}]})
    turn = lambda k, lines: {"turn_index": k, "input": {"dialogue_history_template": lines, "current_user_turn": f"turn {k} harmonium"}, "reference": {"source_memory_ids": ["m3"]}}
    episode = {"episode_id": "e1", "character": "Barry", "turns": [turn(1, []), turn(2, [{"speaker": "Barry", "fill_with": "previous_model_response", "source_turn_index": 1}])]}
    write("x_multi_turn.json", {"episodes": [episode]})
    return root


def test_discover(spark, root):
    (root / "en2").mkdir()
    got = readers.discover(spark, f"{root.parent}", needed=["script.json", "roles.json"]).collect()
    assert [(r.language, r.movie_id) for r in got] == [("en", "en1")]
    assert readers.discover(spark, f"{root.parent}", ["zh"]).count() == 0 and readers.discover(spark, f"{root.parent}", movies=["x"]).count() == 0


def test_beat_story(spark, root):
    scenes = readers.scenes(spark, f"{root}/en1/script.json")
    roles = spark.createDataFrame([("en1", "Barry", ["Barry Egan"])], "movie_id string, character string, aliases array<string>")
    out = beat_story.build(scenes, roles, Scripted)
    told = out["beat_summaries"].orderBy("scene_order").first()
    assert told.present == ["BARRY"] and [u.character_name for u in told.updates] == ["BARRY"] and told.updates[0].evidence_quotes == ["I decide to go 0."]
    found = out["candidates"].collect()
    assert len(found) == 12 and {c.candidate_score for c in found} == {3 + 2 + 1 + 1}
    nodes = sorted(out["nodes"].collect(), key=lambda r: r.scene_order)
    assert len(nodes) == 7 and [n.ordinal for n in nodes] == list(range(1, 8)) and nodes[0].salient_development == "node 0"
    assert nodes[0].evidence_quotes == ["I decide to go 0."] and nodes[0].document_id == "scene_0_beat_0" and nodes[0].timeline_node_id.startswith("ptu3_")


def test_build_with_a_model(spark, root):
    scenes, roles = readers.scenes(spark, f"{root}/en1/script.json"), spark.createDataFrame([("en1", "Barry")], "movie_id string, character string")
    cards = {c.scene_id: c for c in timeline.role_cards(scenes, roles, Scripted).collect()}
    assert len(cards) == 12 and (cards["0"].scene_role, cards["0"].score, cards["0"].goal_shift) == ("foreground", 5, "to go")
    assert (cards["1"].scene_role, cards["1"].score, cards["1"].evidence_quotes) == ("active", 2, ["I decide to go 1."])
    out = timeline.build(scenes, roles, Scripted)
    node = out["nodes"].orderBy("scene_order").first()
    assert (node.salient_development, node.evidence_quotes, node.goal_state) == ("told 0", ["I decide to go 0."], "to go")
    arcs = out["arcs"].collect()
    assert len(arcs) == 1 and len(arcs[0].linked_timeline_node_ids) == 3
    totals = out["totals"].first()
    assert (totals.selected_focal_character_count, totals.arc_count) == (1, 1) and totals.timeline_node_count == out["nodes"].count()
    plain = timeline.role_cards(scenes, roles).collect()
    assert {c.score for c in plain} == {3} and {c.scene_role for c in plain} == {"foreground"} and plain[0].evidence_quotes == []
    old = timeline.build_by_retrieval(scenes, roles.withColumn("aliases", F.array(F.lit("Barry"))), Scripted)
    found = {n.scene_id: n for n in old["nodes"].collect()}
    assert set(found) == {"0", "5"} and found["5"].salient_development == "node 5" and found["0"].document_id == "scene_0_part_1" and found["0"].timeline_node_id.startswith("ptu_")


def test_provenance(spark):
    scenes = spark.createDataFrame([("m", i, str(i), "t", "nobody here") for i in range(3)], "movie_id string, scene_order int, scene_id string, title string, content string")
    roles = spark.createDataFrame([("m", "Barry Egan"), ("m", "Nobody")], "movie_id string, character string")
    said = spark.createDataFrame([("m", "1", "BARRY_EGANN"), ("m", "2", "else"), ("x", "0", "barry egan")], "movie_id string, scene_order string, name string")
    got = timeline.shortlisted(scenes, roles, said)
    assert sorted((r.character, r.scene_order) for r in got.collect()) == [("Barry Egan", 1), ("Nobody", 0), ("Nobody", 1), ("Nobody", 2)]


def test_evaluate(spark, root):
    side = cli._side(spark, str(root), "task_1_character_timelines.json", "task_1_cross_scene_arcs.json")
    out = evaluation.evaluate(side, side, readers.scenes(spark, f"{root}/en1/script.json"), Scripted)
    r = out["summary"].first()
    assert (r.node_precision, r.node_recall, r.scene_f1) == (1.0, 1.0, 1.0)
    assert (r.gold_fact_recall, r.pred_fact_precision, r.fact_f1) == (0.5, 0.5, 0.5)  # two facts, one of which is supported
    assert (r.development, r.state, r.coherence, r.arc_aspect, r.arc_progression) == (1.0, 0.0, 1.0, 1.0, 0.0)
    assert r.overall == round((1 + 1 + 1 + 0 + 1 + 0) / 6, 4)
    assert out["transitions"].count() == 2 and out["arcs"].first().scenes == ["0", "6"]


def test_repairs(spark, root):
    side = cli._side(spark, str(root), "task_1_character_timelines.json", "task_1_cross_scene_arcs.json")
    roles = side["roles"].select("movie_id", "language", "character", "aliases", "timeline_summary")
    rows = side["nodes"].join(roles.drop("timeline_summary"), ["movie_id", "character"]).withColumn("title", F.col("scene_title"))
    scenes = readers.scenes(spark, f"{root}/en1/script.json")
    out = repairs.movie(rows, roles.drop("aliases"), side["arcs"].where("false"), scenes, Scripted)
    nodes = {n.timeline_node_id: n for n in out["nodes"].collect()}
    assert nodes["n0"].goal_state == "mended" and nodes["n3"].goal_state is None
    assert nodes["n0"].evidence_quotes[0] == "BARRY" and (nodes["n0"].changed, nodes["n3"].changed) == (2, 1)
    told = out["timelines"].first()
    assert told.rewritten and told.timeline_summary.startswith("Barry's timeline opens with Barry goes to 0.")
    assert [a.linked_timeline_node_ids for a in out["arcs"].collect()] == [["n0", "n3", "n6"]]
    c = out["changes"].first()
    assert (c.changed_nodes, c.changed_summaries, c.added_arcs) == (4, 1, 1)
    assert repairs.movie(rows, roles.drop("aliases"), side["arcs"], scenes)["arcs"].count() == 0
    lone = repairs.arcs(out["nodes"].withColumn("title", F.lit("")), side["arcs"].where("false")).first()
    assert lone.linked_timeline_node_ids == ["n0", "n3", "n6"] and (lone.start_state, lone.arc_focus) == ("mended", "mixed")


def test_bm25_in_a_fold(spark):
    docs = [["a", "b", "a"], ["a", "c"], ["c", "d", "e"], ["a"]]
    rows = spark.createDataFrame([(1, i, d) for i, d in enumerate(docs)], "i int, d int, tokens array<string>")
    asked = spark.createDataFrame([(1, 9, ["a", "c", "c", "z"])], "i int, q int, tokens array<string>")
    want = {r.d: r.score for r in retrieval.bm25_scores(rows, asked, ["i"], "d", "q").collect()}
    got = roleplay.bm25(docs, ["a", "c", "c", "z"])
    assert all(abs(got[i] - want.get(i, 0.0)) < 1e-9 for i in range(4)) and roleplay.bm25([], ["a"]) == []


def test_memory_choice():
    memories = [{"memory_id": f"m{i}", "scene_order": o, "document": d} for i, (o, d) in enumerate([(5, "x"), (None, "x"), (2, "y z")])]
    ids = lambda mode, k=4: [m["memory_id"] for m, _ in roleplay.choose(memories, "z", "en", mode, k, Offline())]
    assert ids("persona_only") == [] and ids("full_memory_all_in") == ["m2", "m0", "m1"]
    assert ids("bm25_topk") == ["m2", "m1", "m0"] and ids("bm25_topk", 1) == ["m2"] and len(ids("embedding_topk", 2)) == 2
    with pytest.raises(NotImplementedError):
        ids("graph")


def test_command_lines(spark, root, tmp_path):
    run = lambda *a: cli.main([*a, "--provider", "tests.test_story:Scripted"], spark)
    assert run("build", "--input", str(root), "--output", f"{tmp_path}/b").count() >= 9
    assert run("evaluate", "--input", str(root), "--output", str(root)).first().node_f1 == 1.0
    assert run("repair", "--input", str(root), "--output", f"{tmp_path}/r").first().changed_nodes == 4
    one = run("single-turn", "--input", str(root), "--output", f"{tmp_path}/s", "--modes", "persona_only", "bm25_topk", "embedding_topk", "full_memory_all_in").collect()
    scores = {r["mode"]: (r.core_score, r.hit_at_k, r.recall_at_k) for r in one}
    assert scores["persona_only"] == (4.0, 0.0, 0.0) and scores["full_memory_all_in"] == (4.0, 1.0, 1.0) and scores["bm25_topk"][1] == 1.0
    many = run("multi-turn", "--input", str(root), "--output", f"{tmp_path}/m", "--modes", "bm25_topk", "persona_only").collect()
    assert {(r["mode"], r.core_score, r.path_score, r.n_turns) for r in many} == {("bm25_topk", 4.0, 5.0, 2), ("persona_only", 4.0, 5.0, 2)}
    turns = spark.read.json(f"{tmp_path}/m/turns").where("mode = 'persona_only'").orderBy("turn_index").collect()
    assert turns[0].history == "- none" and turns[1].history == f"- Barry: {turns[0].answer}"
    levels = {r.level for r in run("matrix", "--input", f"{tmp_path}/m", "--output", f"{tmp_path}/x").collect()}
    assert levels == {"status", "mode", "role", "role_mode"}
    assert run("rejudge", "--input", f"{tmp_path}/m", "--output", f"{tmp_path}/y").count() == 2


def test_release(spark, root, tmp_path):
    side = cli._side(spark, str(root), "task_1_character_timelines.json", "task_1_cross_scene_arcs.json")
    roles = side["roles"].withColumn("selection_reason", F.lit("from Task3 list"))
    sinks.release(roles, side["nodes"].drop("pos"), side["arcs"], f"file://{tmp_path}")
    got = spark.read.json(f"file://{tmp_path}/timelines").first()
    assert got.build_summary.timeline_node_count == 3 and [n.scene_id for n in got.focal_character_timelines[0].timeline_nodes] == ["1", "4", "7"]
    assert got.focal_character_timelines[0].selection_reason == "provided externally via Task 3 role list"
    assert spark.read.json(f"file://{tmp_path}/arcs").first().build_summary.arc_count == 1
    rows = spark.createDataFrame([(1, "finished", 1.0), (2, "failed", 1.0), (3, "finished", 1.0)], "k int, status string, score double")
    new = spark.createDataFrame([(1, 2.0), (2, 2.0)], "k int, score double")
    assert {r.k: r.score for r in sinks.refreshed(rows, new, ["k"], ["score"]).collect()} == {1: 2.0, 2: 1.0, 3: 1.0}
