"""Queries over the driver's tables for the parts that read scenes, model answers and timelines, with SQL for each.

Suppliers, customers and parts lend names; documents are scenes, lineitem rows are nodes and updates. Where a model's
answer is read, the answer is made from a row's values, so that SQL can say what must come of it.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from fabula.functions import payload as P
from fabula.functions import text as T
from fabula.functions import values as V
from fabula.operators import matching, retrieval, summaries
from fabula.plans import beat_story, evaluation, repairs, timeline
from fabula.registry import query

_WS = r"[\s\x0B\x85\xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def _clean(c: str) -> str:
    return f"trim(regexp_replace(coalesce({c}, ''), '{_WS}', ' ', 'g'))"


def _key(c: str) -> str:
    return f"trim(regexp_replace(lower({c}), '[^a-z0-9\\x{{4E00}}-\\x{{9FFF}}]+', ' ', 'g'))"


# Scenes of a play: an order's customer segment speaks, with a mark or not; every third line is plain.
_SCRIPT = """SELECT o_custkey % 7 AS movie, o_orderkey AS o, 'scene ' || CAST(o_orderkey AS VARCHAR) AS title,
CASE o_orderkey % 4 WHEN 0 THEN c_mktsegment || ' (V.O.)' WHEN 1 THEN '.' || c_mktsegment || ':' WHEN 2 THEN 'NIGHT' ELSE c_mktsegment || '2' END AS a, CASE WHEN o_orderkey % 3 = 0 THEN 'plain words' ELSE replace(o_orderpriority, '-', ' ') END AS b FROM orders JOIN customer ON o_custkey = c_custkey"""


def _script(table):
    rows = table("orders").join(table("customer"), F.col("o_custkey") == F.col("c_custkey"))
    k, segment = F.col("o_orderkey"), F.col("c_mktsegment")
    a = F.when(k % 4 == 0, F.concat(segment, F.lit(" (V.O.)"))).when(k % 4 == 1, F.concat(F.lit("."), segment, F.lit(":"))).when(k % 4 == 2, "NIGHT").otherwise(F.concat(segment, F.lit("2")))
    b = F.when(k % 3 == 0, "plain words").otherwise(F.replace("o_orderpriority", F.lit("-"), F.lit(" ")))
    return rows.select((F.col("o_custkey") % 7).alias("movie"), k.alias("o"), F.concat(F.lit("scene "), k).alias("title"), a.alias("a"), b.alias("b"), F.concat(a, F.lit("\n"), b).alias("content"))


@query(f"""WITH l AS (SELECT movie, o, title, unnest([{{p: 0, x: a}}, {{p: 1, x: b}}]) AS l FROM ({_SCRIPT})),
s AS (SELECT movie, o, title, l.p AS p, trim(replace(replace(l.x, '(V.O.)', ''), '(O.S.)', ''), ' .:-') AS x FROM l),
n AS (SELECT *, array_to_string(list_transform(string_split(x, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS name FROM s WHERE regexp_matches(x, '^[A-Z][A-Z .''-]{{1,40}}$') AND x <> 'NIGHT'),
c AS (SELECT movie, name, o, any_value(title) AS title, count(*) AS n, min(p) AS p FROM n GROUP BY movie, name, o), f AS (SELECT *, row_number() OVER (PARTITION BY movie, name ORDER BY o) AS k FROM c)
SELECT movie, name, CAST(sum(n) AS BIGINT) AS utterance_count, count(*) AS scene_count, string_agg(title, '|' ORDER BY k) FILTER (k <= 3) AS sample_scenes FROM f GROUP BY movie, name""")
def speaker_counts(table):
    out = summaries.speaker_counts(_script(table), ["movie"], "o", "title", "content")
    return out.select("movie", "name", "utterance_count", "scene_count", F.array_join("sample_scenes", "|").alias("sample_scenes"))


@query(f"""SELECT movie, o, (CASE WHEN contains(lower(title), k) THEN 3 ELSE 0 END) + (CASE WHEN contains(body, k) THEN 4 ELSE 0 END) + (CASE WHEN spoken = k THEN 6 ELSE 0 END) AS score
FROM (SELECT movie, o, title, lower(a || ' ' || b) AS body, 'machinery' AS k, CASE WHEN o % 4 IN (0, 1) THEN lower(trim(replace(a, '(V.O.)', ''), ' .:')) END AS spoken FROM ({_SCRIPT})) s""")
def alias_scores(table):
    rows = _script(table).withColumn("aliases", F.array(F.lit("Machinery")))
    return rows.select("movie", "o", T.alias_score("title", "content", T.speaker_names("content"), F.col("aliases")).alias("score"))


@query("""WITH u AS (SELECT l_orderkey % 50 AS movie, p_brand AS name, l_linenumber AS pos, l_returnflag = 'R' AS durable, l_linestatus = 'O' AS core, l_partkey, l_suppkey FROM lineitem JOIN part ON l_partkey = p_partkey),
x AS (SELECT movie, trim(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g')) AS key, sum(durable::INT) AS durable, sum(core::INT) AS core, count(*) AS n FROM u GROUP BY ALL)
SELECT movie, key, CAST(n AS BIGINT) AS update_count, CAST(n AS BIGINT) AS presence_count, CAST(durable AS BIGINT) AS durable_count, CAST(core AS BIGINT) AS core_count, CASE WHEN key = 'brand 1' THEN 5::BIGINT ELSE 0::BIGINT END AS utterance_count FROM x""")
def merged_candidates(table):
    """Marks behind names don't part them; counts of speakers, of presence and of updates meet in one row a name."""
    u = table("lineitem").join(table("part"), F.col("l_partkey") == F.col("p_partkey"))
    movie = (F.col("l_orderkey") % 50).alias("movie")
    updates = u.select(movie, F.when(F.col("l_quantity") > 25, F.concat("p_brand", F.lit(" (V.O.)"))).otherwise(F.col("p_brand")).alias("name"), F.when(F.col("l_linestatus") == "O", "core").otherwise("supporting").alias("importance"), (F.col("l_returnflag") == "R").alias("durable_change"), F.col("l_linenumber").alias("pos"))
    present = u.select(movie, F.upper("p_brand").alias("name"), F.col("l_linenumber").alias("pos"))
    held = updates.where("name LIKE 'Brand#1' OR name = 'Brand#1 (V.O.)'").select("movie").distinct()
    speakers = held.select("movie", F.lit("BRAND#1").alias("name"), F.lit(5).alias("utterance_count"), F.lit(2).alias("scene_count"), F.lit(0).alias("pos"))
    out = summaries.merge_candidates(speakers, present, updates, ["movie"], most=1000)
    return out.select("movie", "key", "update_count", "presence_count", "durable_count", "core_count", "utterance_count")


@query("""WITH e AS (SELECT user_id AS role, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS o, CAST(floor(value) AS BIGINT) % 6 AS score, event_type FROM events), m AS (SELECT *, max(o) OVER (PARTITION BY role) AS m FROM e),
b AS (SELECT *, CASE WHEN m <= 1 THEN 'middle' WHEN (o - 1) / greatest(1, m - 1) < 0.34 THEN 'early' WHEN (o - 1) / greatest(1, m - 1) < 0.67 THEN 'middle' ELSE 'late' END AS bucket FROM m),
r AS (SELECT *, row_number() OVER (PARTITION BY role, bucket ORDER BY score DESC, o) AS k FROM b)
SELECT role, bucket, count(*) AS scene_count, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY o) AS scene_ids, CASE WHEN count(*) FILTER (event_type = 'view') > count(*) FILTER (event_type = 'click') THEN 'goal_shift' ELSE 'relation_shift' END AS dominant,
string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY k) FILTER (k <= 2) AS evidence FROM r GROUP BY role, bucket""")
def story_segments(table):
    rows = table("events").select(F.col("user_id").alias("role"), F.col("event_id").cast("string").alias("scene"), F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).alias("o"), (F.floor("value").cast("long") % 6).alias("score"), F.when(F.col("event_type") == "click", "x").otherwise(" ").alias("relation_shift"), F.when(F.col("event_type") == "view", "x").alias("goal_shift"))
    out = summaries.segments(rows, ["role"], "o", "scene", ["relation_shift", "goal_shift"], "score")
    return out.select("role", "bucket", "scene_count", F.array_join("scene_ids", ",").alias("scene_ids"), "dominant", F.array_join("evidence", ",").alias("evidence"))


@query("""WITH g AS (SELECT l_suppkey % 20 AS role, l_orderkey AS arc, list(DISTINCT l_partkey % 30) AS s, max(l_linenumber) AS v FROM lineitem WHERE l_returnflag = 'R' AND l_orderkey % 40 = 0 GROUP BY 1, 2), p AS (SELECT l_suppkey % 20 AS role, l_orderkey AS pid, list(DISTINCT l_partkey % 30) AS s, max(l_linenumber) AS v FROM lineitem WHERE l_returnflag = 'A' AND l_orderkey % 40 = 1 GROUP BY 1, 2),
x AS (SELECT role, arc, pid, 0.85 * ((g.v * p.v + 4.0) / (sqrt(g.v * g.v + 4.0) * sqrt(p.v * p.v + 4.0)))::DOUBLE + 0.15 * (len(list_intersect(g.s, p.s)) / len(list_distinct(list_concat(g.s, p.s)))) AS score FROM g JOIN p USING (role))
SELECT role, arc, round(max(score), 9) AS score FROM x GROUP BY role, arc""")
def arc_matches(table):
    """Stated sets of orders as gold and predicted arcs."""
    def arcs(flag, rest):
        rows = table("lineitem").where((F.col("l_returnflag") == flag) & (F.col("l_orderkey") % 40 == rest))
        out = rows.groupBy((F.col("l_suppkey") % 20).alias("role"), F.col("l_orderkey").alias("arc_id")).agg(F.collect_set(F.col("l_partkey") % 30).alias("scenes"), F.max("l_linenumber").cast("double").alias("v"))
        return out.select("role", "arc_id", F.col("arc_id").alias("pos"), F.array("v", F.lit(2.0)).alias("vector"), "scenes")

    best = matching.best_arc_match(arcs("R", 0), arcs("A", 1), "role")
    return best.select("role", F.col("arc_id").alias("arc"), F.round("score", 9).alias("score"))


@query(f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE text IS NOT NULL), c AS (SELECT doc_id, {_clean('x')} AS x, min(i) AS i FROM l GROUP BY 1, 2)
SELECT doc_id, count(*) AS n, md5(string_agg(x, chr(10) ORDER BY i)) AS digest FROM c WHERE length(x) BETWEEN 4 AND 220 GROUP BY doc_id""")
def quote_lines(table):
    rows = table("documents").select("doc_id", T.quote_candidates("text").alias("q")).where(F.size("q") > 0)
    return rows.select("doc_id", F.size("q").cast("long").alias("n"), F.md5(F.array_join("q", "\n").cast("binary")).alias("digest"))


_STOP = "the a an and or but to of for in on at by with from is are was were be been being that this these those his her their them he she they it as into over under after before during while through about because when then than very more most just still"


def _words(c: str) -> str:
    return f"list_distinct(list_filter(regexp_extract_all(lower({c}), '[a-z0-9'']+'), lambda w: length(w) > 2 AND NOT list_contains(string_split('{_STOP}', ' '), w)))"


@query(f"""WITH b AS (SELECT doc_id, text, regexp_extract(text, '[A-Za-z]+ [A-Za-z]+', 0) AS alias, split_part(text, chr(10), 1) AS dev FROM documents WHERE lang = 'en' AND text IS NOT NULL),
l AS (SELECT doc_id, alias, dev, {_clean('x')} AS line, min(i) AS i FROM (SELECT doc_id, alias, dev, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM b) GROUP BY ALL),
s AS (SELECT *, len(list_intersect({_words('dev')}, {_words('line')})) + CASE WHEN alias <> '' AND contains(lower(line), lower(alias)) THEN 4 ELSE 0 END - CASE WHEN regexp_matches(line, '^[A-Z][A-Z .''-]{{1,40}}$') THEN 1 ELSE 0 END AS points FROM l WHERE length(line) BETWEEN 4 AND 220),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY points DESC, i) AS k FROM s WHERE points > 0),
q AS (SELECT doc_id, string_agg(line, '|' ORDER BY k) AS quotes FROM r WHERE k <= 3 GROUP BY doc_id)
SELECT b.doc_id, coalesce(quotes, CASE WHEN {_clean('alias')} <> '' AND contains(text, {_clean('alias')}) THEN {_clean('alias')} ELSE '' END) AS quotes FROM b LEFT JOIN q USING (doc_id)""")
def evidence_quotes(table):
    rows = table("documents").where("lang = 'en' AND text IS NOT NULL").withColumn("alias", F.regexp_extract("text", "[A-Za-z]+ [A-Za-z]+", 0)).withColumn("dev", F.split_part("text", F.lit("\n"), F.lit(1)))
    found = repairs.evidence_quotes(F.lit(""), F.col("text"), F.col("lang"), F.array("alias"), [F.col("dev")])
    return rows.select("doc_id", F.array_join(found, "|").alias("quotes"))


@query("""WITH f AS (SELECT o_custkey AS c, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i, CASE o_orderstatus WHEN 'F' THEN 'decision' WHEN 'O' THEN 'goal' ELSE 'other' END AS kind, CASE o_orderkey % 3 WHEN 0 THEN 'late' ELSE 'multi' END AS phase, trim(regexp_replace(lower(o_orderpriority), '[^a-z0-9]+', ' ', 'g')) AS key FROM orders),
u AS (SELECT *, row_number() OVER (PARTITION BY c, key ORDER BY i) AS n FROM f), k AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY i) AS r FROM u WHERE n = 1)
SELECT c, string_agg(CASE WHEN o_orderkey % 2 = 0 THEN 'F' || CAST(i AS VARCHAR) ELSE 'x' || CAST(o_orderkey AS VARCHAR) END || ':' || kind || ':' || phase || ':' || CAST(o_orderkey AS VARCHAR), ' ' ORDER BY i) AS facts,
coalesce(string_agg(CASE WHEN o_orderkey % 2 = 0 THEN 'F' || CAST(i AS VARCHAR) ELSE 'x' || CAST(o_orderkey AS VARCHAR) END, ' ' ORDER BY i) FILTER (i % 2 = 1), '') AS supported FROM k WHERE r <= 8 GROUP BY c""")
def fact_payloads(table):
    """Facts of a customer's orders as a model would list them: unknown kinds, missing ids, repeated texts; and which of them are called supported."""
    k = F.col("o_orderkey")
    one = F.struct(
        F.when(k % 2 == 1, F.concat(F.lit(" x"), k)).otherwise("").alias("fact_id"), F.when(F.col("o_orderstatus") == "F", " Decision").when(F.col("o_orderstatus") == "O", "goal").otherwise("mystery").alias("fact_type"),
        F.when(k % 3 == 0, "LATE").alias("phase"), F.when(k % 2 == 0, F.col("o_orderpriority")).alias("fact_text"), F.concat(F.lower("o_orderpriority"), F.lit(" !")).alias("text"), F.when(k % 2 == 0, F.array(k.cast("string"), k.cast("string"), F.lit(" "))).alias("scene_refs"), F.array(k.cast("string")).alias("scene_ids"),
    )
    rows = table("orders").select(F.col("o_custkey").alias("c"), k, one.alias("f")).groupBy("c").agg(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "f"))), lambda x: x["f"]).alias("l"))
    rows = rows.withColumn("facts", P.facts(F.to_json(F.struct(F.col("l").alias("facts")))))
    said = F.transform(F.col("l"), lambda f, i: F.when(i % 2 == 0, F.coalesce(F.nullif(F.trim(f["fact_id"]), F.lit("")), F.concat(F.lit("F"), i + 1))).otherwise("none"))
    rows = rows.withColumn("ids", P.supported_ids(F.to_json(F.struct(F.concat(said, said).alias("supported_fact_ids"))), F.col("facts")))
    shown = F.transform("facts", lambda f: F.concat_ws(":", f["fact_id"], f["fact_type"], f["phase"], F.array_join(f["scene_refs"], ",")))
    return rows.select("c", F.array_join(shown, " ").alias("facts"), F.array_join("ids", " ").alias("supported"))


@query("""SELECT event_id, CASE WHEN event_type IN ('click', 'view') THEN CASE event_type WHEN 'click' THEN 'foreground' ELSE 'active' END ELSE 'absent' END AS scene_role, CASE WHEN event_type = 'error' THEN 0 ELSE least(5, greatest(0, CAST(floor(value) AS INTEGER) - 3)) END AS milestone_score, CASE WHEN event_id % 2 = 0 THEN 'a b' END AS goal_shift,
CASE WHEN event_id % 3 = 0 THEN '' ELSE 'k|4' END AS quotes FROM events""")
def scene_card_payloads(table):
    """Raw cards, as an object or in a list, with scores out of range or no numbers, unknown roles and quotes that the scene doesn't have."""
    e, i = F.col("event_type"), F.col("event_id")
    raw = F.struct(F.when(e == "click", "Foreground ").when(e == "view", "active").otherwise("lead").alias("scene_role"), F.when(e == "error", "high").otherwise((F.floor("value") - 3).cast("string")).alias("milestone_score"), F.when(i % 2 == 0, " a \n b ").otherwise("  ").alias("goal_shift"), F.when(i % 3 == 0, F.array(F.lit("x y"))).otherwise(F.array(F.lit(" k "), F.lit("none"), F.lit("4"), F.lit("k"))).alias("evidence_quotes"))
    json = F.when(i % 2 == 0, F.to_json(F.array(raw))).otherwise(F.to_json(F.struct(F.array(raw).alias("scene_cards"))))
    card = P.card(F.get(P.items(json, "scene_cards", P.CARD), F.lit(0)), F.lit('{"k": 4}'))
    return table("events").select("event_id", card.alias("c")).select("event_id", "c.scene_role", "c.milestone_score", "c.goal_shift", F.array_join("c.evidence_quotes", "|").alias("quotes"))


_UPDATES = """SELECT l_orderkey % 100 AS movie, l_suppkey AS scene, l_linenumber AS beat, l_orderkey AS o, p_brand AS name, l_returnflag = 'R' AS durable, CASE WHEN l_linestatus = 'O' THEN 'core' ELSE 'supporting' END AS importance, p_type || ' ' || CAST(l_partkey % 5 AS VARCHAR) AS dev, l_quantity > 25 AS goal, l_tax > 0.04 AS res FROM lineitem JOIN part ON l_partkey = p_partkey"""


@query(f"""WITH s AS (SELECT *, 3 * durable::INT + 2 * (importance = 'core')::INT + goal::INT + res::INT AS score, row_number() OVER (PARTITION BY movie, scene, beat ORDER BY o, name, dev, durable, importance, goal, res) AS place FROM ({_UPDATES})),
k AS (SELECT *, row_number() OVER (PARTITION BY movie, name, scene, beat, {_key('dev')} ORDER BY score DESC, place) AS n FROM s WHERE (durable OR importance = 'core') AND name IN ('Brand#1', 'Brand#2'))
SELECT movie, name AS character, CAST(scene AS VARCHAR) AS scene_id, beat AS beat_index, dev AS salient_development, score AS candidate_score FROM k WHERE n = 1""")
def beat_candidates(table):
    """Updates of two roles, named with marks or not, as candidates: durable or core ones, of equal developments of a beat the strongest."""
    u = table("lineitem").join(table("part"), F.col("l_partkey") == F.col("p_partkey"))
    name = F.when(F.col("l_quantity") > 10, F.concat(F.upper("p_brand"), F.lit(" (O.S.)"))).otherwise(F.col("p_brand"))
    update = F.struct(
        name.alias("character_name"), F.when(F.col("l_linestatus") == "O", "core").otherwise("supporting").alias("importance"), (F.col("l_returnflag") == "R").alias("durable_change"), F.lit("other").alias("change_type"), F.lit("").alias("role_in_context"),
        F.concat("p_type", F.lit(" "), F.col("l_partkey") % 5).alias("salient_development"), F.when(F.col("l_quantity") > 25, "g").alias("goal_state"), F.when(F.col("l_tax") > 0.04, "r").alias("resulting_state"), F.lit(None).cast("string").alias("unresolved_issue"), F.array().cast("array<string>").alias("evidence_quotes"),
    )
    order = F.struct(F.col("l_orderkey").alias("a"), F.col("p_brand").alias("b"), update["salient_development"].alias("c"), update["durable_change"].alias("d"), update["importance"].alias("e"), (F.col("l_quantity") > 25).alias("f"), (F.col("l_tax") > 0.04).alias("g"), update.alias("u"))
    told = u.groupBy((F.col("l_orderkey") % 100).alias("movie_id"), F.col("l_suppkey").cast("string").alias("scene_id"), F.col("l_linenumber").alias("beat_index")).agg(F.transform(F.array_sort(F.collect_list(order)), lambda x: x["u"]).alias("updates"))
    told = told.select("*", F.lit(1).alias("scene_order"), F.lit("").alias("title"), F.lit("").alias("beat_heading"), F.lit("").alias("beat_summary"))
    roles = told.select("movie_id").distinct().select("movie_id", F.explode(F.array(F.lit("Brand#1"), F.lit("Brand#2"))).alias("character")).withColumn("aliases", F.array(F.lower("character")))
    out = beat_story.candidates(told, roles)
    return out.select(F.col("movie_id").alias("movie"), "character", "scene_id", "beat_index", "salient_development", "candidate_score")


@query("""WITH c AS (SELECT l_orderkey AS movie, l_suppkey % 10 AS scene, l_linenumber AS beat, max(l_quantity) AS score, arg_min('d' || CAST(l_partkey AS VARCHAR), (-l_quantity, 'd' || CAST(l_partkey AS VARCHAR))) AS dev FROM lineitem GROUP BY 1, 2, 3),
n AS (SELECT l_orderkey AS movie, l_suppkey % 10 AS scene, CASE WHEN l_partkey % 9 = 0 THEN 0 ELSE l_linenumber END AS beat, l_partkey AS pos, CASE WHEN l_partkey % 2 = 0 THEN 'own' ELSE '' END AS dev, CASE WHEN l_partkey % 3 = 0 THEN 'core' ELSE '' END AS imp FROM lineitem),
f AS (SELECT *, row_number() OVER (PARTITION BY movie, scene, beat ORDER BY pos) AS k FROM n)
SELECT movie, CAST(f.scene AS VARCHAR) AS scene_id, f.beat AS beat_index, CASE WHEN f.dev <> '' THEN f.dev ELSE c.dev END AS salient_development, CASE WHEN f.imp <> '' THEN f.imp ELSE 'supporting' END AS importance, CAST(c.score AS INTEGER) AS candidate_score FROM f JOIN c USING (movie, scene, beat) WHERE k = 1""")
def backed_nodes(table):
    """A model's nodes joined to candidates on scene and beat; the first of a beat stays, empty fields are the candidate's."""
    line = table("lineitem")
    role = [F.col("l_orderkey").alias("movie_id"), F.lit("c").alias("character"), (F.col("l_suppkey") % 10).cast("string").alias("scene_id")]
    nothing = [F.lit(None).cast("string").alias(c) for c in ("role_in_context", "goal_state", "resulting_state", "unresolved_issue")]
    backing = line.select(*role, F.col("l_linenumber").alias("beat_index"), F.col("l_quantity").cast("int").alias("candidate_score"), F.concat(F.lit("d"), "l_partkey").alias("salient_development"), F.lit("supporting").alias("importance"), *nothing)
    beat = F.when(F.col("l_partkey") % 9 == 0, "none").otherwise(F.col("l_linenumber").cast("string"))
    nodes = line.select(*role, beat.alias("beat_index"), F.col("l_partkey").alias("pos"), F.when(F.col("l_partkey") % 2 == 0, " own ").otherwise(" ").alias("salient_development"), F.when(F.col("l_partkey") % 3 == 0, "core").alias("importance"), *nothing)
    return beat_story.back(nodes, backing).select(F.col("movie_id").alias("movie"), "scene_id", "beat_index", "salient_development", "importance", "candidate_score")


@query("""SELECT l_orderkey, sum(CASE WHEN l_linenumber % 2 = 0 THEN l_partkey ELSE 0 END)::BIGINT AS prompt_tokens, sum(l_suppkey)::BIGINT AS completion_tokens, 0::BIGINT AS total_tokens FROM lineitem GROUP BY l_orderkey""")
def usage_totals(table):
    usage = F.create_map(F.lit("prompt_tokens"), F.when(F.col("l_linenumber") % 2 == 0, F.col("l_partkey").cast("string")).otherwise("1.5"), F.lit("completion_tokens"), F.col("l_suppkey").cast("string"), F.lit("total_tokens"), F.lit("many"))
    return summaries.usage_totals(table("lineitem").select("l_orderkey", usage.alias("u")), ["l_orderkey"], "u")


@query("""WITH n AS (SELECT c_nationkey AS movie, count(DISTINCT o_custkey) AS c, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1), a AS (SELECT s_nationkey AS movie, count(*) AS a FROM supplier GROUP BY 1)
SELECT movie, coalesce(c, 0) AS selected_focal_character_count, coalesce(n, 0) AS timeline_node_count, coalesce(a, 0) AS arc_count FROM n FULL JOIN a USING (movie)""")
def build_totals(table):
    nodes = table("orders").join(table("customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_nationkey").alias("movie"), "o_custkey")
    return summaries.build_totals(nodes, table("supplier").select(F.col("s_nationkey").alias("movie")), "movie", "o_custkey")


@query("""SELECT coalesce(CAST(lang AS VARCHAR), 'all') AS lang, count(DISTINCT source) AS movies, count(DISTINCT source || '|' || CAST(n_chars % 10 AS VARCHAR)) AS characters, count(*) AS samples FROM documents GROUP BY ROLLUP (lang)""")
def role_stats(table):
    return summaries.role_stats(table("documents").select("lang", "source", (F.col("n_chars") % 10).alias("c")), "lang", "source", "c")


@query("""SELECT event_id, CASE WHEN event_type <> 'error' THEN value END AS score, CASE WHEN event_type = 'click' THEN value WHEN event_type IN ('view', 'error') THEN 2.0::DOUBLE END AS path_score, CASE WHEN event_id % 2 = 0 THEN 1.0::DOUBLE END AS hit_at_k, NULL::DOUBLE AS recall_at_k FROM events""")
def run_outputs(table):
    e, v = F.col("event_type"), F.col("value").cast("string")
    rows = table("events").select("event_id", F.when(e == "error", "n/a").otherwise(v).alias("core_score"), F.when(e == "click", v).alias("path_score"), F.when(e.isin("click", "view", "error"), "2").otherwise("x").alias("legacy_path_score"), F.when(F.col("event_id") % 2 == 0, "1").alias("hit_at_k"), F.lit("none").alias("recall_at_k"))
    return summaries.run_outputs(rows, ["event_id"])


@query("""SELECT count(*) AS movies, sum(l_linenumber)::BIGINT AS changed_nodes, sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END)::BIGINT AS changed_summaries, 0::BIGINT AS added_arcs FROM lineitem""")
def repair_totals(table):
    rows = table("lineitem").select(F.col("l_linenumber").alias("changed_nodes"), (F.col("l_returnflag") == "R").cast("int").alias("changed_summaries"), F.lit(0).alias("added_arcs"))
    return summaries.repair_totals(rows, ["changed_nodes", "changed_summaries", "added_arcs"])


@query("""SELECT l_orderkey, md5('Character: ' || CAST(l_orderkey AS VARCHAR) || chr(10) || 'Timeline summary: ' || chr(10) || string_agg('[' || CAST(i AS VARCHAR) || '] scene_id=' || CAST(l_suppkey AS VARCHAR) || ' | scene_order=' || CAST(l_linenumber AS VARCHAR) || ' | scene_title= | role= | development=' || l_linestatus || CASE WHEN l_returnflag = 'R' THEN ' | goal=g' ELSE '' END || CASE WHEN l_tax > 0.04 THEN ' | pressure=p q' ELSE '' END, chr(10) ORDER BY i)) AS digest
FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, l_partkey, l_linestatus, l_returnflag, l_tax) AS i FROM lineitem) GROUP BY l_orderkey""")
def timeline_texts(table):
    none = F.lit(None).cast("string")
    node = F.struct("l_linenumber", F.col("l_suppkey").alias("scene_id"), "l_partkey", "l_linestatus", "l_returnflag", "l_tax")
    rows = table("lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(node)).alias("n"))
    nodes = F.transform("n", lambda x: F.struct(x["scene_id"].alias("scene_id"), x["l_linenumber"].alias("scene_order"), F.lit(" ").alias("scene_title"), none.alias("role_in_context"), x["l_linestatus"].alias("salient_development"), F.when(x["l_returnflag"] == "R", "g").alias("goal_state"), none.alias("resulting_state"), F.when(x["l_tax"] > 0.04, " p  q").alias("unresolved_issue")))
    return rows.select("l_orderkey", F.md5(evaluation.timeline_text(F.col("l_orderkey").cast("string"), F.lit(None).cast("string"), nodes).cast("binary")).alias("digest"))


@query(f"""SELECT doc_id, lower({_clean('text')}) AS match, lower(replace({_clean("source || '_' || lang")}, '_', ' ')) AS character, md5(coalesce(source, '') || chr(10) || coalesce(lang, '') || chr(10) || coalesce(substr(text, 1, 1800), '')) AS index_text, coalesce(substr(text, 1, 700), '') AS card, substr({_clean('text')}, 1, 900) AS excerpt FROM documents""")
def scene_texts(table):
    t = F.col("text")
    index = F.concat_ws("\n", F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit("")), T.excerpt("text", 1800))
    return table("documents").select("doc_id", T.match_key(t).alias("match"), T.character_key(F.concat_ws("_", "source", "lang")).alias("character"), F.md5(index.cast("binary")).alias("index_text"), T.excerpt("text", 700).alias("card"), T.excerpt(T.clean_text("text"), 900).alias("excerpt"))


@query("""SELECT s_suppkey, array_to_string(list_sort(list_distinct(['Supplier ' || s_suppkey, 'Supplier', s_name])), '|') AS aliases FROM supplier""")
def role_aliases(table):
    names = T.aliases_of(F.concat(F.lit("Supplier "), "s_suppkey"), F.array(F.lit(""), F.col("s_name")))
    return table("supplier").select("s_suppkey", F.array_join(F.array_sort(names), "|").alias("aliases"))


@query("""SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9'']+|[\\x{4E00}-\\x{9FFF}]+'), lambda w: length(w) >= 3 OR regexp_matches(w, '^[\\x{4E00}-\\x{9FFF}]')))), ' ') AS words FROM documents""")
def feature_words(table):
    return table("documents").select("doc_id", F.array_join(F.array_sort(T.feature_tokens("text")), " ").alias("words"))


@query(f"""SELECT doc_id, CASE WHEN {_clean('text')} = '' OR starts_with({_clean('text')}, 'Milestone-based timeline for ') THEN true WHEN lang = 'zh' THEN NOT length({_clean('text')}) BETWEEN 20 AND 140 ELSE NOT len(string_split({_clean('text')}, ' ')) BETWEEN 12 AND 110 END AS weak FROM documents""")
def weak_summaries(table):
    return table("documents").select("doc_id", T.summary_needs_repair("text", F.col("lang")).alias("weak"))


@query("""SELECT p_partkey, h AS heading, regexp_matches(upper(h), '^([A-Z0-9''" .-]{0,8})?(INT\\.|EXT\\.|INT/EXT\\.|I/E\\.|EST\\.|OMITTED|TITLE:)') AND length(trim(h, ' .:-')) >= 6 AND length(regexp_replace(h, '[^A-Z]', '', 'g')) > 0.7 * length(regexp_replace(h, '[^A-Za-z]', '', 'g')) AS slug
FROM (SELECT p_partkey, CASE p_size % 6 WHEN 0 THEN '12 INT. ' || upper(p_name) WHEN 1 THEN 'EXT. ' || p_name WHEN 2 THEN 'EST. ' || upper(p_type) || ' -' WHEN 3 THEN 'FADE TO ' || p_type WHEN 4 THEN 'INT. A' ELSE 'TITLE: ' || upper(p_name) END AS h FROM part)""")
def heading_lines(table):
    k, name = F.col("p_size") % 6, F.upper("p_name")
    h = F.when(k == 0, F.concat(F.lit("12 INT. "), name)).when(k == 1, F.concat(F.lit("EXT. "), "p_name")).when(k == 2, F.concat(F.lit("EST. "), F.upper("p_type"), F.lit(" -"))).when(k == 3, F.concat(F.lit("FADE TO "), "p_type")).when(k == 4, F.lit("INT. A")).otherwise(F.concat(F.lit("TITLE: "), name))
    return table("part").select("p_partkey", h.alias("heading")).withColumn("slug", T.is_slug_line("heading"))


@query("""SELECT l_orderkey, round(CASE WHEN n > 0 AND m > 0 THEN d / (sqrt(n) * sqrt(m)) ELSE 0.0::DOUBLE END, 9) AS cosine FROM (SELECT l_orderkey, sum(a * b) AS d, sum(a * a) AS n, sum(b * b) AS m FROM (SELECT l_orderkey, l_quantity AS a, CASE WHEN l_orderkey % 5 = 0 THEN 0 ELSE l_linenumber END AS b FROM lineitem) GROUP BY l_orderkey)""")
def cosines(table):
    b = F.when(F.col("l_orderkey") % 5 == 0, 0).otherwise(F.col("l_linenumber"))
    rows = table("lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("l_quantity").alias("a"), b.cast("double").alias("b"))).alias("x"))
    return rows.select("l_orderkey", F.round(V.cosine(F.col("x.a"), F.col("x.b")), 9).alias("cosine"))


@query("""SELECT event_id, coalesce(CASE WHEN event_type = 'click' THEN '- a' || chr(10) || '- b c' WHEN event_type = 'view' THEN '- none' WHEN event_type = 'error' THEN '- ' || props END, '- none') AS bullets FROM events""")
def bullet_lists(table):
    e = F.col("event_type")
    items = F.when(e == "click", F.array(F.lit(" a"), F.lit(""), F.lit("b  c"))).when(e == "view", F.array(F.lit(" "))).when(e == "error", F.array("props"))
    return table("events").select("event_id", T.bullets(items).alias("bullets"))


@query("""SELECT p_partkey, p_name || CASE WHEN p_size % 3 > 0 THEN chr(10) || 'Grounded facts: ' || CASE p_size % 3 WHEN 1 THEN p_type ELSE p_type || ' ' || p_brand END ELSE '' END || CASE WHEN p_size % 2 = 0 THEN chr(10) || 'Tags: ' || p_brand || ', x' ELSE '' END AS document FROM part""")
def memory_documents(table):
    k = F.col("p_size")
    facts = F.when(k % 3 == 1, F.array("p_type", F.lit(" "))).when(k % 3 == 2, F.array("p_type", "p_brand"))
    tags = F.when(k % 2 == 0, F.array("p_brand", F.lit("\n x ")))
    return table("part").select("p_partkey", retrieval.memory_document(F.concat(F.lit(" "), "p_name"), facts, tags).alias("document"))


@query("""SELECT user_id, 'Traits: ' || array_to_string(t[1:6], ', ') || chr(10) || 'Constraints: ' || array_to_string(t[1:3], ' ') AS persona, 'Traits: ' || array_to_string(t[1:6], ', ') || chr(10) || 'Constraints: ' || array_to_string(t[1:3], ' ') || chr(10) || chr(10)
|| CASE WHEN user_id % 2 = 0 THEN 'Dialogue history:' || chr(10) || 'a: ' || t[1] || chr(10) || 'b c: ' || t[2] || chr(10) || chr(10) ELSE '' END || 'Current user turn:' || chr(10) || CAST(n AS VARCHAR) AS query
FROM (SELECT user_id, list_sort(list(DISTINCT event_type || CAST(event_id % 3 AS VARCHAR))) AS t, count(*) AS n FROM events GROUP BY user_id) WHERE len(t) >= 3""")
def memory_queries(table):
    rows = table("events").groupBy("user_id").agg(F.array_sort(F.collect_set(F.concat("event_type", F.col("event_id") % 3))).alias("t"), F.count("*").alias("n")).where(F.size("t") >= 3)
    persona = retrieval.persona_summary(F.col("t"), F.array(F.lit(" ")), F.col("t"))
    line = lambda s, t: F.struct(s.alias("speaker"), t.alias("text"))
    history = F.when(F.col("user_id") % 2 == 0, F.array(line(F.lit("a"), F.col("t")[0]), line(F.lit("nobody"), F.lit("  ")), line(F.lit(" b  c"), F.concat(F.col("t")[1], F.lit(" ")))))
    return rows.select("user_id", persona.alias("persona"), retrieval.memory_query(persona, history, F.concat(F.lit("  "), "n")).alias("query"))


@query("""SELECT s_suppkey, 'r' || CAST(s_suppkey AS VARCHAR) || '|' || s_name || '|' || CASE WHEN s_suppkey % 2 = 0 THEN 'kin' ELSE 'of ' || CAST(s_nationkey AS VARCHAR) END || '|' || 'of ' || CAST(s_nationkey AS VARCHAR) AS relation FROM supplier""")
def relation_contexts(table):
    summary = F.concat(F.lit("of  "), "s_nationkey")
    one = F.struct(F.concat(F.lit("r"), "s_suppkey").alias("relation_id"), F.concat("s_name", F.lit(" ")).alias("target_character"), F.when(F.col("s_suppkey") % 2 == 0, "kin").alias("relation"), summary.alias("relation_summary"))
    r = retrieval.relation_context(F.array(one))[0]
    return table("supplier").select("s_suppkey", F.concat_ws("|", r["relation_id"], r["target_character"], r["relation"], r["relation_summary"]).alias("relation"))


@query("""WITH u AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), v AS (SELECT vec_id, label, list_transform(e, lambda x: x / greatest(sqrt(list_sum(list_transform(e, lambda y: y * y))), 1e-12)) AS e FROM u),
s AS (SELECT q.vec_id AS query, d.vec_id AS vec_id, list_sum(list_transform(list_zip(d.e, q.e), lambda z: z[1] * z[2])) AS score, abs(d.vec_id - q.vec_id) AS far FROM v d, v q WHERE q.vec_id % 100 = 0),
l AS (SELECT query, vec_id, 'vector' AS src, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, vec_id) AS rank FROM s UNION ALL SELECT query, vec_id, 'near', row_number() OVER (PARTITION BY query ORDER BY far, vec_id) FROM s),
f AS (SELECT query, vec_id, sum(1.0::DOUBLE / (60 + rank)) AS score, string_agg(src, '+' ORDER BY src) AS trace FROM l WHERE rank <= 8 GROUP BY ALL)
SELECT query, vec_id, trace, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, vec_id) AS rank FROM f) WHERE rank <= 8""")
def vector_fusion(table):
    """The stated queries against all rows, by vectors and by a second list, fused."""
    rows = table("embeddings").select("vec_id", F.col("embedding").alias("vector"))
    asked = rows.where("vec_id % 100 = 0").withColumnRenamed("vec_id", "query")
    at = F.explode(F.sequence(F.col("query") - 8, F.col("query") + 8)).alias("vec_id")
    near = asked.select("query", at).join(rows.select("vec_id"), "vec_id").withColumn("score", -F.abs(F.col("vec_id") - F.col("query")).cast("double"))
    lists = retrieval.top_k(near, ["query"], 8, "vec_id").withColumn("source", F.lit("near"))
    fused = retrieval.with_vectors(lists, rows, asked, [], "vec_id", "query", 8)
    return retrieval.reciprocal_rank_fusion(fused, ["query"], "vec_id", 8).select("query", "vec_id", "trace", F.col("rank").cast("long").alias("rank"))


@query("""SELECT p_partkey, array_to_string(list_sort(list_distinct([p_name, p_name || ' decision conflict', p_name || ' relationship change', p_name || ' goal failure success', p_brand, p_type])), '|') AS queries FROM part""")
def role_queries(table):
    q = timeline.queries_of(F.col("p_name"), F.array("p_brand", "p_type", F.lit("more")))
    return table("part").select("p_partkey", F.array_join(F.array_sort(q), "|").alias("queries"))
