from pyspark.sql import functions as F

from fabula.functions import jsonx
from fabula.functions import text as T
from fabula.functions import values as V


def one(spark, column, **values):
    schema = ", ".join(f"{k} {kind}" for k, (_, kind) in values.items()) or "x int"
    row = tuple(v for v, _ in values.values()) or (1,)
    return spark.createDataFrame([row], schema).select(column).first()[0]


def s(value):
    return value, "string"


def test_text(spark):
    assert one(spark, T.clean_text("t"), t=s("  a  b　c  ")) == "a b c"
    assert one(spark, T.clean_text("t"), t=s(None)) == ""
    assert one(spark, T.name_key("t"), t=s("JOHN_SMITH!")) == "john smith"
    assert one(spark, T.name_key("t"), t=s("Amélie 宫二")) == "am lie 宫二"
    assert one(spark, T.character_key("t"), t=s(" Barry__Egan ")) == "barry egan"
    assert one(spark, T.safe_name("t"), t=s("宫二/a b")) == "宫二_a_b"
    assert one(spark, T.strip_speaker_variant("t"), t=s("BARRY (V.O.) (cont'd)")) == "BARRY"
    assert one(spark, T.tokens("t", F.lit("en")), t=s("Don't stop")) == ["don't", "stop"]
    assert one(spark, T.tokens("t", F.lit("zh")), t=s("宫二60场 OK")) == ["宫", "二", "60", "场", "ok"]
    assert one(spark, T.tokens("t", F.lit("zh")), t=s("。!")) == ["。", "!"]
    assert one(spark, T.stable_id("v6tu", F.lit("Barry Egan"), F.lit("12"), F.lit("1"))) == "v6tu_2bb0e9385469f5a3"
    assert one(spark, T.title_case("t"), t=s("JEAN-LUC o'neil")) == "Jean-Luc O'Neil"
    assert one(spark, T.public_scene_id("t"), t=s("0")) == "1"
    assert one(spark, T.public_scene_id("t"), t=s("12a")) == "12a"
    assert one(spark, T.speaker_names("t"), t=s("INTRO\nBARRY (V.O.)\nhello\nLENA\nBARRY\n")) == ["Intro", "Barry", "Lena"]
    assert one(spark, T.speaker_names("t"), t=s("R2D2\n.LENA:\nA\nTHE MAN IN THE HAT\nO'NEIL\n")) == ["Lena", "O'Neil"]
    assert one(spark, T.bullets(F.array(F.lit(" "))), t=s("")) == "- none"


def test_headings(spark):
    from fabula.operators import beats

    for line, expected in (("12 INT. HOUSE - DAY", True), ("EST. CITY", True), ("OMITTED", True), ("TITLE: ONE", True), ("FADE TO BLACK", False), ("LATER THAT DAY", False), ("INT HOUSE", False), ("INT. A", True), ("INT.:", False), ("Int. house", False)):
        assert one(spark, T.is_slug_line("t"), t=s(line)) is expected and beats.is_slug(line) is expected, line


def test_alias_score(spark):
    def score(title, content, speakers, aliases):
        names = lambda xs: F.array(*map(F.lit, xs)).cast("array<string>")
        return one(spark, T.alias_score("a", "b", names(speakers), names(aliases)), a=s(title), b=s(content))

    assert score("Barry goes", "nothing", [], ["Barry"]) == 3  # a word in the title alone is worth nothing
    assert score("", "Barry waits", [], ["Barry Egan"]) == 1
    assert score("", "barry", ["Barry"], ["Barry"]) == 3 + 1 + 4 + 2
    assert score("", "", ["Barry Egan"], ["Barry"]) == 0 and score("", "", ["Barry"], ["Barry Egan"]) == 2


def test_summary_length(spark):
    for n, expected in ((11, True), (12, False), (110, False), (111, True)):
        assert one(spark, T.summary_needs_repair("t", F.lit("en")), t=s(" ".join(["w"] * n))) is expected


def test_quotes(spark):
    q = T.quotes(F.col("t"), F.array(F.lit("b c"), F.lit("x"), F.lit("b c"), F.lit("")), 3)
    assert one(spark, q, t=s("a b c d")) == ["b c"]


def test_scores(spark):
    for raw, expected in (("7", 5), ("0", 1), (None, 1), ("2.5", 2), ("3.5", 4), ("x", 1)):
        assert one(spark, V.score_clamp(F.col("v")), v=s(raw)) == expected
    for raw, expected in (("TRUE.", True), (" Yes ", True), ("yes.", False), ("1!", False), ("No", False), ("true or false", False), ("it is true", True), (None, False)):
        assert one(spark, V.parse_bool(F.col("v")), v=s(raw)) is expected


def test_buckets(spark):
    rows = [(o,) for o in range(1, 11)]
    got = spark.createDataFrame(rows, "o int").select(V.temporal_bucket(F.col("o"), F.lit(10)), V.phase_bucket(F.col("o"), F.lit(10))).collect()
    assert [r[0] for r in got] == ["early"] * 4 + ["middle"] * 3 + ["late"] * 3
    assert [r[1] for r in got] == ["early"] * 3 + ["middle"] * 3 + ["late"] * 4
    assert one(spark, V.temporal_bucket(F.lit(1), F.lit(1))) == "middle"
    assert [one(spark, V.coverage_width(F.lit(n))) for n in (23, 24, 53, 54)] == [1, 2, 2, 3]


def test_sets_and_vectors(spark):
    a = lambda *x: F.array(*map(F.lit, x)).cast("array<int>")
    assert one(spark, V.jaccard(a(1, 2, 3), a(2, 3, 4))) == 0.5
    assert one(spark, V.jaccard(a(), a())) == 0
    assert one(spark, V.cosine(a(1, 0), a(0, 1, 2))) == 0
    assert abs(one(spark, V.cosine(a(1, 1), a(1, 0))) - 0.5**0.5) < 1e-12
    assert one(spark, V.f1(F.lit(0.0), F.lit(0.0))) == 0


def test_json():
    assert jsonx.extract('```json\n{"a": [1, 2,],}\n```') == '{"a":[1,2]}'
    assert jsonx.extract('So: {"a": "x}y"} and more') == '{"a":"x}y"}'
    assert jsonx.extract('{"a": {"b": "c') == '{"a":{"b":"c"}}'
    assert jsonx.extract("“a”") is None
    assert jsonx.extract(None) is None
