import json

import pytest
from pyspark.sql import functions as F

from fabula.plans import evaluation, jobs, prompts, providers, timeline
from fabula.sources import config, readers, sinks
from fabula.streaming import dialogue, status


@pytest.fixture(scope="module")
def movie(tmp_path_factory):
    root = tmp_path_factory.mktemp("movies")
    folder = root / "en1"
    folder.mkdir()
    scenes = [{"_id": str(i), "title": f"INT. ROOM {i}", "content": f"\nBARRY\nI decide to go {i}.\n{'LENA' if i % 2 else 'EXTRA'}\nYes.\n"} for i in range(30)]
    (folder / "script.json").write_text(json.dumps(scenes))
    (folder / "roles.json").write_text(json.dumps({"roles": [{"character_name": "Barry"}, {"character_name": "BARRY"}, {"character_name": "Lena"}]}))
    (folder / "timelines.json").write_text(json.dumps({"focal_character_timelines": [{"character_name": "Other", "timeline_nodes": [{"timeline_node_id": "n1", "scene_id": "0"}]}]}))
    (folder / "info.csv").write_bytes(b"movie_id,title,word_count,num_scenes,genre_1,genre_2,genre_3\r\nen1,T,10,30,Drama,Comedy,\r\n")
    return root


def test_readers(spark, movie):
    s = readers.scenes(spark, f"{movie}/en1/script.json")
    first = s.orderBy("scene_order").first()
    assert (s.count(), first.scene_order, first.scene_id, first.language, first.content[:5]) == (30, 1, "0", "en", "BARRY")
    found = readers.focal_roles(spark, [f"{movie}/en1/roles.json", f"{movie}/en1/timelines.json"], ["roles.json", "timelines.json"])
    assert sorted(r.character for r in found.collect()) == ["Barry", "Lena"]
    assert readers.timeline_nodes(spark, f"{movie}/en1/timelines.json").first().node.timeline_node_id == "n1"
    assert readers.movies(spark, f"{movie}/en1/info.csv").first().genre_3 is None


def test_manifest(spark, tmp_path):
    rows = [{"language": "en", "movie_id": "m", "character": "B"}, {"language": "en", "movie_id": "m", "character": "A"}]
    for i, content in enumerate((rows, {"rows": rows})):
        (tmp_path / f"{i}.json").write_text(json.dumps(content))
        got = readers.filter_roles(readers.roles(spark, f"{tmp_path}/{i}.json"), characters=["A"])
        assert [r.character for r in got.collect()] == ["A"]
    (tmp_path / "x.json").write_text('"no"')
    with pytest.raises(Exception, match="no list of roles"):
        readers.roles(spark, f"{tmp_path}/x.json").collect()


def test_build(spark, movie):
    s = readers.scenes(spark, f"{movie}/en1/script.json")
    roles = spark.createDataFrame([("en1", "Barry"), ("en1", "Lena")], "movie_id string, character string")
    out = timeline.build(s, roles)
    n = {r.character: r["count"] for r in out["nodes"].groupBy("character").count().collect()}
    assert set(n) <= {"Barry", "Lena"} and out["cards"].count() >= 0
    assert timeline.retrieve_scenes(s, roles).where("rank = 1").count() == 2


def test_evaluation(spark):
    gold = spark.createDataFrame([("m", "Barry Egan", 0, ["Barry"]), ("m", "Lena", 1, None)], "movie_id string, character string, pos int, aliases array<string>")
    pred = spark.createDataFrame([("m", "BARRY", 0), ("m", "barry egan", 1), ("m", "Nobody", 2)], "movie_id string, character string, pos int")
    assert [(r.character, r.gold_character) for r in evaluation.match_roles(pred, gold).collect()] == [("BARRY", "Barry Egan")]
    node = "movie_id string, character string, scene_id string, place int, vector array<double>"
    g = spark.createDataFrame([("m", "B", "1", 0, [1.0, 0.0]), ("m", "B", "2", 1, [0.0, 1.0])], node)
    p = spark.createDataFrame([("m", "B", "1", 0, [1.0, 0.0]), ("m", "B", "3", 1, [0.0, 1.0])], node)
    r = evaluation.node_quality(p, g, evaluation.match_nodes(p, g)).first()
    assert r.node_f1 == r.scene_f1 == 0.5
    scores = spark.createDataFrame([("e", "a", "7"), ("e", "b", "2")], "ep string, metric string, score string")
    assert evaluation.judged(scores, ["ep"]).first().core_score == 3.5
    path = spark.createDataFrame([("e", "1", "4"), ("e", "x", "1"), ("f", None, "5")], "ep string, turn_index string, score string")
    assert {r.ep: r.path_score for r in evaluation.path_score(path, ["ep"]).collect()} == {"e": 4.0, "f": 0.0}


def test_jobs(spark):
    roles = spark.createDataFrame([("a",), ("b",)], "character string")
    samples = spark.createDataFrame([("a", 1), ("a", 2)], "character string, sample int")
    done = spark.createDataFrame([("a", 1, "x")], "character string, sample int, mode string")
    todo = jobs.plan(roles, samples, done, "sample", ["x", "y"], ["character"])
    assert sorted((r.character, r.sample or 0, r.mode or "", r.status) for r in todo.collect()) == [("a", 1, "y", "planned"), ("a", 2, "x", "planned"), ("a", 2, "y", "planned"), ("b", 0, "", "no_episodes")]

    def work(value):
        if value == "bad":
            raise ValueError(value)
        return value.upper()

    ran = jobs.run(spark.createDataFrame([("a", "ok", "planned"), ("b", "bad", "planned")], "character string, p string, status string"), "p", work)
    assert sorted((r.status, r.attempt_count, r.result, r.error) for r in ran.collect()) == [("failed", 3, None, "ValueError: bad"), ("finished", 1, "OK", None)]


def test_providers(spark):
    rows = spark.createDataFrame([("en", "hi")], "language string, t string").withColumn("m", prompts.messages(prompts.prompt("beat", F.col("language"), text=F.col("t"))))
    assert len(providers.complete_column(rows, "m", "a", providers.Offline).first().a) == 16
    assert abs(sum(x * x for x in providers.embed_column(rows, "t", "v", providers.Offline).first().v) - 1) < 1e-9

    class Dead(providers.Offline):
        def complete(self, *args):
            return ""

    assert providers.Routes([Dead(), providers.Offline()], tries=2, pause=0).complete([{"role": "user", "content": "x"}])
    with pytest.raises(RuntimeError):
        providers.Routes([Dead()], tries=1, pause=0).complete([{"role": "user", "content": "x"}])


def test_dialogue(spark):
    place = {"speaker": "a", "fill_with": dialogue.ANSWER, "source_turn_index": 1}
    assert dialogue.render_history([place], {1: "hi"}) == [{"speaker": "a", "text": "hi", "source_turn_index": 1}]
    assert [x["text"] for x in dialogue.render_history([place, {"text": " b  c "}], {})] == ["", "b c"]
    rows = [(1, 2, "b", [("a", "", dialogue.ANSWER, 1), ("u", "x", None, None)]), (1, 1, "a", None)]
    turns = spark.createDataFrame(rows, "e int, turn_index int, text string, history array<struct<speaker:string,text:string,fill_with:string,source_turn_index:int>>")
    got = dialogue.play_episodes(turns, ["e"], history="history").orderBy("turn_index").collect()
    assert got[0].prompt == "- none\nuser: a" and got[1].prompt == f"- a: {got[0].answer}\n- u: x\nuser: b"


def test_status_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"job":"x","ts":"2024-01-01T00:00:00Z","status":"running"}\n{"job":"x","ts":"2024-01-01T00:01:00Z","status":"finished"}\n')
    q = status.watch(spark, f"file://{tmp_path}/in", "job string, ts timestamp, status string", f"file://{tmp_path}/out", f"file://{tmp_path}/state")
    q.processAllAvailable()
    q.stop()
    assert [r.status for r in spark.read.json(f"file://{tmp_path}/out/batch=0").collect()] == ["finished"]


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("m/x", 1, "ok"), ("m", 2, "failed")], "mode string, v int, status string")
    sinks.write_results(rows, f"file://{tmp_path}/r", ["mode"])
    assert sorted(p.name for p in (tmp_path / "r").glob("mode_dir=*")) == ["mode_dir=m", "mode_dir=m_x"]
    sinks.write_dead_letters(rows, f"file://{tmp_path}/dead")
    assert spark.read.json(f"file://{tmp_path}/dead").count() == 1
    assert sinks.report(rows.orderBy("v"), "T").splitlines()[4] == "| m/x | 1 | ok |"


def test_config(tmp_path):
    e = {"model": "m", "base_url": "http://x/"}
    path = tmp_path / "c.json"
    path.write_text(json.dumps({"profiles": {"default": {"llm": {**e, "timeout_sec": "", "fallback": e}, "embed": e}}}))
    p = config.load_profile(str(path), env={"FABULA_LLM_MODEL": "n"})
    assert (p.llm.model, p.llm.base_url, p.llm.timeout_sec, p.llm.fallback.model, p.embed.model) == ("n", "http://x", 180, "m", "m")
    with pytest.raises(KeyError):
        config.load_profile(str(path), "other", env={})
    path.write_text(json.dumps({"profiles": {"default": {"llm": {"model": "m"}, "embed": e}}}))
    with pytest.raises(ValueError, match="base_url"):
        config.load_profile(str(path), env={})


def test_milestones_see_all_cards(spark):
    from fabula.plans import queries

    rows = [(i, u, "click", 5.0 if i == 330 else 0.0) for u in (1, 201) for i in range(u, u + 130)]
    events = spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double").cache()
    assert queries._card_rows(lambda name: events).count() == 260
    for select in (queries.milestone_select, queries.milestone_select_wide):
        got = {(r.role, r.scene_order) for r in select(lambda name: events).collect()}
        assert {u for u, _ in got} == {1, 201} and (201, 130) in got


def test_repair_sees_all_nodes(spark):
    from fabula.plans import queries

    rows = [(i, 7, i, 1, 5.0, "R") for i in range(1, 97)] + [(i, 507, i, 1, 8.0, "R") for i in range(1, 9)]
    rows += [(96, p, 300, 1, 1.0, "A") for p in (7, 507)]  # without candidates nothing would change
    lines = spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_returnflag string")
    got = [(r.role, r.scene_order) for r in queries.repair_nodes(lambda name: lines).collect()]
    assert [r for r, _ in got].count(7) == 9 and [r for r, _ in got].count(507) == 9 and max(o for _, o in got) > 60
