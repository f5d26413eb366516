"""Queries over the driver's tables that exercise the engine's operators, with SQL for those that SQL can express.

documents are scenes (source: movie, doc_id: place), conversations episodes, embeddings vectors of memories, events a
job log (user_id: role, event_type: status), labels votes, benchmark quotes, orders and lineitem predicted and gold sets.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from fabula.functions import text as T
from fabula.functions import values as V
from fabula.functions.jsonx import extract_json
from fabula.operators import beats as B
from fabula.operators import folds, matching, retrieval, sequence, summaries
from fabula.registry import query
from fabula.streaming import dialogue, status

_WS = r"[\s\x0B\x85\xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
_CLEAN = f"trim(regexp_replace(coalesce(text, ''), '{_WS}', ' ', 'g'))"


@query(f"SELECT doc_id, {_CLEAN} AS clean, CAST(length({_CLEAN}) AS BIGINT) AS n FROM documents")
def text_clean(table):
    c = T.clean_text("text")
    return table("documents").select("doc_id", c.alias("clean"), F.char_length(c).cast("long").alias("n"))


@query(r"SELECT s_suppkey, trim(regexp_replace(lower(s_name), '[^a-z0-9\x{4E00}-\x{9FFF}]+', ' ', 'g')) AS key, regexp_replace(lower(s_name), '[^a-z0-9\x{4E00}-\x{9FFF}]+', '', 'g') AS compact, regexp_replace(s_name, '[^\p{L}\p{N}_-]', '_', 'g') AS file FROM supplier")
def name_keys(table):
    return table("supplier").select("s_suppkey", T.name_key("s_name").alias("key"), T.compact_key("s_name").alias("compact"), T.safe_name("s_name").alias("file"))


@query("SELECT doc_id, 'scene_' || substr(md5(source || '||' || CAST(doc_id AS VARCHAR) || '||' || lang), 1, 16) AS stable_id FROM documents")
def stable_ids(table):
    return table("documents").select("doc_id", T.stable_id("scene", F.col("source"), F.col("doc_id"), F.col("lang")).alias("stable_id"))


@query("""SELECT source, lang, count(*) AS n_docs, CAST(sum(len(t)) AS BIGINT) AS n_tokens, CAST(max(len(t)) AS BIGINT) AS most
FROM (SELECT source, lang, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9'']+') AS t FROM documents) GROUP BY source, lang""")
def token_totals(table):
    n = F.size(T.tokens("text", F.col("lang"))).cast("long")
    return table("documents").select("source", "lang", n.alias("t")).groupBy("source", "lang").agg(F.count("*").alias("n_docs"), F.sum("t").alias("n_tokens"), F.max("t").alias("most"))


@query("""SELECT doc_id, array_to_string(list_sort(list_filter(list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9'']+')), lambda w: length(w) > 2 AND NOT list_contains(string_split(
'the a an and or but to of for in on at by with from is are was were be been being that this these those his her their them he she they it as into over under after before during while through about because when then than very more most just still', ' '), w))), ' ') AS words FROM documents""")
def keyword_sets(table):
    return table("documents").select("doc_id", F.array_join(T.keyword_set("text", F.col("lang")), " ").alias("words"))


@query("""SELECT coalesce(CAST(lang AS VARCHAR), 'all') AS lang, n, mean_quality, mean_toxic FROM (
SELECT lang, count(*) AS n, avg(coalesce(quality, 0)) AS mean_quality, avg(coalesce(toxic, 0)) AS mean_toxic FROM documents LEFT JOIN labels USING (doc_id) GROUP BY ROLLUP (lang))""")
def language_rollup_nullzero(table):
    rows = table("documents").select("doc_id", "lang").join(table("labels"), "doc_id", "left").withColumns({c: F.col(c).cast("double") for c in ("quality", "toxic")})
    return summaries.rollup_means(rows, "lang", ["quality", "toxic"], missing_is_zero=True)


@query("""SELECT coalesce(CAST(lang AS VARCHAR), 'all') AS lang, count(*) AS n, avg(quality) AS mean_quality, avg(toxic) AS mean_toxic FROM documents LEFT JOIN labels USING (doc_id) GROUP BY ROLLUP (lang)""")
def language_rollup_nullskip(table):
    rows = table("documents").select("doc_id", "lang").join(table("labels"), "doc_id", "left").withColumns({c: F.col(c).cast("double") for c in ("quality", "toxic")})
    return summaries.rollup_means(rows, "lang", ["quality", "toxic"], missing_is_zero=False)


_STATUS = ["click", "purchase", "error", "signup", "view"]


@query("SELECT user_id, count(*) AS total, " + ", ".join(f"count(*) FILTER (event_type = '{s}') AS n_{s}" for s in _STATUS) + " FROM events GROUP BY user_id")
def status_histogram(table):
    return summaries.status_counts(table("events"), ["user_id"], "event_type", _STATUS)


@query("""WITH e AS (SELECT event_type AS status, 'm' || CAST(event_id % 4 AS VARCHAR) AS mode, CAST(user_id % 50 AS VARCHAR) AS role, floor(value) AS score FROM events)
SELECT CASE WHEN grouping(status) = 0 THEN 'status' WHEN grouping(role) = 0 AND grouping(mode) = 0 THEN 'role_mode' WHEN grouping(mode) = 0 THEN 'mode' ELSE 'role' END AS level,
status, mode, role, count(*) AS n, avg(CASE WHEN s IN ('purchase', 'view') THEN score END) AS mean_score FROM (SELECT *, status AS s FROM e) GROUP BY GROUPING SETS ((status), (mode), (role), (role, mode))""")
def grouping_sets_summary(table):
    rows = table("events").select(F.col("event_type").alias("status"), F.concat(F.lit("m"), F.col("event_id") % 4).alias("mode"), (F.col("user_id") % 50).cast("string").alias("role"), F.floor("value").cast("double").alias("score"))
    return summaries.run_summary(rows, "status", "mode", "role", "score", ["purchase", "view"])


@query("""WITH g AS (SELECT DISTINCT l_returnflag, l_partkey, l_linenumber FROM lineitem WHERE l_linestatus = 'O'), p AS (SELECT DISTINCT l_returnflag, l_partkey, l_linenumber FROM lineitem WHERE l_linestatus = 'F'),
n AS (SELECT l_returnflag, count(g) AS n_gold, count(p) AS n_pred, count(g + p) AS n_match FROM (SELECT *, 1 AS g FROM g) FULL JOIN (SELECT *, 1 AS p FROM p) USING (l_returnflag, l_partkey, l_linenumber) GROUP BY l_returnflag),
r AS (SELECT *, n_match / greatest(1, n_pred) AS precision, n_match / greatest(1, n_gold) AS recall FROM n)
SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1 FROM r""")
def set_prf_by_group(table):
    rows = table("lineitem").select("l_returnflag", "l_partkey", "l_linenumber", "l_linestatus")
    return summaries.set_prf(rows.where("l_linestatus = 'O'"), rows.where("l_linestatus = 'F'"), ["l_returnflag"], ["l_partkey", "l_linenumber"])


@query("""WITH t AS (SELECT doc_id, list_distinct(list_filter(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9'']+'), lambda w: length(w) > 2)) AS w FROM documents),
p AS (SELECT doc_id, w, lead(w) OVER (PARTITION BY source ORDER BY doc_id) AS x FROM t JOIN (SELECT doc_id, source FROM documents) USING (doc_id))
SELECT doc_id, CASE WHEN len(list_distinct(list_concat(w, x))) > 0 THEN len(list_intersect(w, x)) / len(list_distinct(list_concat(w, x))) ELSE 0.0 END AS jaccard FROM p WHERE x IS NOT NULL""")
def jaccard_sets(table):
    words = F.array_distinct(F.filter(T.tokens("text", F.lit("en")), lambda w: F.length(w) > 2))
    rows = table("documents").select("doc_id", "source", words.alias("w")).withColumn("x", F.lead("w").over(Window.partitionBy("source").orderBy("doc_id")))
    return rows.where("x IS NOT NULL").select("doc_id", V.jaccard(F.col("w"), F.col("x")).alias("jaccard"))


@query("""WITH s AS (SELECT o_custkey AS sample, list(DISTINCT o_orderkey % 40) AS sources FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), x AS (SELECT o_custkey AS sample, list(DISTINCT o_orderkey % 40) AS selected FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1)
SELECT sample, CASE WHEN len(list_intersect(selected, coalesce(sources, []))) > 0 THEN 1.0::DOUBLE ELSE 0.0 END AS hit, CASE WHEN len(sources) > 0 THEN len(list_intersect(selected, sources)) / len(sources) END AS recall FROM x LEFT JOIN s USING (sample)""")
def support_recall_at_k(table):
    rows = table("orders").select(F.col("o_custkey").alias("sample"), (F.col("o_orderkey") % 40).alias("m"), "o_orderstatus")
    each = lambda cond, name: rows.where(cond).groupBy("sample").agg(F.collect_set("m").alias(name))
    both = each("o_orderstatus <> 'F'", "selected").join(each("o_orderstatus = 'F'", "sources"), "sample", "left").withColumn("sources", F.coalesce("sources", F.array().cast("array<bigint>")))
    hit, recall = summaries.support_at_k(F.col("selected"), F.col("sources"))
    return both.select("sample", hit.alias("hit"), recall.alias("recall"))


@query("""WITH g AS (SELECT k, max_by(s_suppkey, s_suppkey) AS gold_id FROM (SELECT s_suppkey, unnest([lower(s_name), 'nation ' || CAST(s_nationkey AS VARCHAR)]) AS k FROM supplier) GROUP BY k),
p AS (SELECT c_custkey, 'nation ' || CAST(c_nationkey AS VARCHAR) AS k FROM customer)
SELECT c_custkey, k, gold_id FROM (SELECT *, row_number() OVER (PARTITION BY gold_id ORDER BY c_custkey, k) AS n FROM p JOIN g USING (k)) WHERE n = 1""")
def entity_match_first_come(table):
    gold = table("supplier").select(F.lit(1).alias("movie"), F.col("s_suppkey").alias("gold_id"), F.col("s_suppkey").alias("pos"), F.array(F.lower("s_name"), F.concat(F.lit("nation "), "s_nationkey")).alias("keys"))
    pred = table("customer").select(F.lit(1).alias("movie"), "c_custkey", F.concat(F.lit("nation "), "c_nationkey").alias("k"))
    return matching.match_entities(pred, gold, ["movie"], "k", "c_custkey", "keys", "gold_id", "pos").select("c_custkey", "k", "gold_id")


@query("""WITH l AS (SELECT l_orderkey, l_suppkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey) AS p FROM lineitem), f AS (SELECT l_orderkey, s_nationkey, min(p) AS p FROM l JOIN supplier ON l_suppkey = s_suppkey GROUP BY l_orderkey, s_nationkey)
SELECT o_orderkey, coalesce(string_agg(CAST(s_nationkey AS VARCHAR), ',' ORDER BY p, s_nationkey), '') AS nations FROM orders LEFT JOIN f ON o_orderkey = l_orderkey GROUP BY o_orderkey""")
def bridge_links(table):
    lines = table("lineitem").groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_suppkey"))), lambda x: x["l_suppkey"]).alias("links"))
    owners = table("orders").select("o_orderkey").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", "links")
    out = matching.bridge_links(owners, "o_orderkey", "links", table("supplier").select(F.col("s_suppkey").alias("node"), "s_nationkey"), "node", "s_nationkey")
    return out.select("o_orderkey", F.array_join("s_nationkeys", ",").alias("nations"))


@query("""WITH s AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS o FROM documents), h AS (SELECT s.source, o FROM s JOIN labels USING (doc_id) WHERE toxic = 1)
SELECT DISTINCT s.doc_id, s.source, s.o FROM s JOIN h ON s.source = h.source AND s.o BETWEEN h.o - 2 AND h.o + 2""")
def band_neighbours(table):
    rows = table("documents").select("doc_id", "source", F.row_number().over(Window.partitionBy("source").orderBy("doc_id")).cast("long").alias("o"))
    return matching.band_neighbours(rows.join(table("labels").where("toxic = 1").select("doc_id"), "doc_id"), rows, ["source"], "o")


@query("""WITH c AS (SELECT event_id, user_id, ts, CAST(floor(value) AS BIGINT) % 6 AS score, CASE WHEN event_type = 'error' THEN 'absent' ELSE event_type END AS role FROM events),
w AS (SELECT *, greatest(coalesce(lag(score) OVER x, 0), coalesce(lead(score) OVER x, 0)) AS beside FROM c WINDOW x AS (PARTITION BY user_id ORDER BY event_id))
SELECT event_id, CASE WHEN score < 2 AND beside >= 4 THEN 2 ELSE score END AS score, CASE WHEN score < 2 AND beside >= 4 AND role = 'absent' THEN 'indirect' ELSE role END AS role FROM w""")
def adjacent_promotion(table):
    cards = table("events").select("event_id", "user_id", (F.floor("value").cast("long") % 6).alias("score"), F.when(F.col("event_type") == "error", "absent").otherwise(F.col("event_type")).alias("role"))
    return sequence.promote_neighbours(cards, ["user_id"], "event_id", "score", "role").select("event_id", F.col("score").cast("long").alias("score"), "role")


@query("""SELECT a.conv_id, a.turn, a.text AS said, b.text AS answer FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1""")
def strict_turn_join(table):
    turns = table("conversations").select("conv_id", "turn", "text")
    last = Window.partitionBy("conv_id")
    asked = turns.withColumn("n", F.max("turn").over(last)).where("turn < n").select("conv_id", "turn", F.col("text").alias("said"), (F.col("turn") + 1).alias("next"))
    return matching.strict_join(asked, turns.select("conv_id", F.col("turn").alias("next"), F.col("text").alias("answer")), ["conv_id", "next"]).select("conv_id", "turn", "said", "answer")


_MODES = ["persona_only", "full_memory_all_in", "bm25_topk", "embedding_topk"]


@query(f"""WITH m AS (SELECT unnest([{', '.join(f"'{m}'" for m in _MODES)}]) AS mode), r AS (SELECT DISTINCT c_custkey AS role FROM customer), e AS (SELECT o_custkey AS role, o_orderkey AS episode FROM orders)
SELECT role, episode, mode, 'planned' AS status FROM r JOIN e USING (role), m UNION ALL SELECT role, NULL, NULL, 'no_episodes' FROM r WHERE role NOT IN (SELECT role FROM e)""")
def job_matrix_cross(table):
    roles = table("customer").select(F.col("c_custkey").alias("role")).distinct()
    return matching.episode_jobs(roles, table("orders").select(F.col("o_custkey").alias("role"), F.col("o_orderkey").alias("episode")), ["role"], "episode", _MODES)


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linestatus = 'F')")
def skip_finished_anti(table):
    done = table("lineitem").where("l_linestatus = 'F'").select(F.col("l_orderkey").alias("o_orderkey")).distinct()
    return matching.skip_finished(table("orders").select("o_orderkey", "o_custkey"), done, ["o_orderkey"])


@query("""WITH l AS (SELECT l_orderkey, l_suppkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey) AS p FROM lineitem), k AS (SELECT l_orderkey, l_suppkey, min(p) AS p FROM l JOIN supplier ON l_suppkey = s_suppkey WHERE s_acctbal > 0 GROUP BY 1, 2)
SELECT l_orderkey, string_agg(CAST(l_suppkey AS VARCHAR), ',' ORDER BY p) AS links FROM k GROUP BY 1 HAVING count(*) >= 2""")
def semi_valid_links(table):
    arcs = table("lineitem").groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_suppkey"))), lambda x: x["l_suppkey"]).alias("links")).withColumn("g", F.lit(1))
    known = table("supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("node"), F.lit(1).alias("g"))
    return matching.valid_links(arcs, "links", known, ["g"], "node").select("l_orderkey", F.array_join("links", ",").alias("links"))


@query("""WITH n AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS o FROM events)
SELECT a.event_id AS a, b.event_id AS b FROM n a JOIN n b ON a.user_id = b.user_id AND b.o > a.o AND b.o - a.o <= 4 AND (b.o - a.o <= 2 AND a.event_type = b.event_type OR a.event_type = 'purchase' AND b.event_type IN ('purchase', 'signup'))""")
def theta_mini_arc(table):
    n = table("events").select("user_id", "event_id", "event_type", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).alias("o"))
    reach = n.select("user_id", F.col("event_id").alias("a"), F.col("event_type").alias("ta"), F.col("o").alias("oa"), F.explode(F.sequence(F.col("o") + 1, F.col("o") + 4)).alias("o"))
    both = reach.join(n, ["user_id", "o"])
    gap = F.col("o") - F.col("oa")
    return both.where(((gap <= 2) & (F.col("ta") == F.col("event_type"))) | ((F.col("ta") == "purchase") & F.col("event_type").isin("purchase", "signup"))).select("a", F.col("event_id").alias("b"))


@query("""WITH q AS (SELECT DISTINCT item_id, unnest(string_split(text, chr(10))) AS quote FROM benchmark)
SELECT doc_id, item_id, quote, (length(text) - length(replace(text, quote, ''))) // length(quote) AS n FROM documents JOIN q ON quote <> '' AND contains(text, quote)""")
def substring_quotes(table):
    """Which lines of the benchmark's texts stand in which documents, and how often."""
    quotes = table("benchmark").select("item_id", F.explode(F.split("text", "\n")).alias("quote")).distinct()
    times = ((F.length("text") - F.length(F.replace("text", F.col("quote"), F.lit("")))) / F.length("quote")).cast("long")
    return matching.substring_quotes(table("documents").select("doc_id", "text"), "text", quotes, "quote", []).select("doc_id", "item_id", "quote", times.alias("n"))


_PLACE = "SELECT doc_id, source, o, max(o) OVER (PARTITION BY source) AS m FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS o FROM documents)"


def _scenes(table):
    return table("documents").withColumn("o", F.row_number().over(Window.partitionBy("source").orderBy("doc_id")))


@query(f"""SELECT doc_id, CASE WHEN m <= 1 THEN 'middle' WHEN (greatest(1, o) - 1) / greatest(1, m - 1) < 0.34 THEN 'early' WHEN (greatest(1, o) - 1) / greatest(1, m - 1) < 0.67 THEN 'middle' ELSE 'late' END AS temporal,
CASE WHEN m <= 0 THEN 'middle' WHEN o / m <= 0.34 THEN 'early' WHEN o / m <= 0.67 THEN 'middle' ELSE 'late' END AS phase FROM ({_PLACE})""")
def story_buckets(table):
    return sequence.with_buckets(_scenes(table), ["source"], "o").select("doc_id", "temporal", "phase")


@query(f"""WITH b AS (SELECT doc_id, source, CASE WHEN m <= 1 THEN 'middle' WHEN (o - 1) / greatest(1, m - 1) < 0.34 THEN 'early' WHEN (o - 1) / greatest(1, m - 1) < 0.67 THEN 'middle' ELSE 'late' END AS temporal FROM ({_PLACE}))
SELECT source, temporal, doc_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY source, temporal ORDER BY n_chars DESC, doc_id) AS rank FROM b JOIN (SELECT doc_id, n_chars FROM documents) USING (doc_id)) WHERE rank <= 3""")
def bucket_quota_topn(table):
    rows = sequence.with_buckets(_scenes(table), ["source"], "o")
    return sequence.top_of_bucket(rows, ["source"], "temporal", [F.desc("n_chars"), "doc_id"], 3).select("source", "temporal", "doc_id", F.col("rank").cast("long").alias("rank"))


@query(f"""WITH c AS (SELECT p.*, n_chars % 6 AS score, n_chars AS pri, CASE WHEN n_chars % 5 = 0 THEN 'absent' ELSE 'active' END AS role, (o - 1) // (CASE WHEN m >= 54 THEN 3 WHEN m >= 24 THEN 2 ELSE 1 END) AS w FROM ({_PLACE}) p JOIN documents USING (doc_id))
SELECT source, w AS win, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY source, w ORDER BY score >= 2 DESC, pri DESC, o) AS n FROM c WHERE score >= 2 OR role <> 'absent') WHERE n = 1""")
def coverage_window_best(table):
    cards = _scenes(table).select("doc_id", "source", "o", (F.col("n_chars") % 6).alias("score"), F.col("n_chars").alias("pri"), F.when(F.col("n_chars") % 5 == 0, "absent").otherwise("active").alias("role"))
    return sequence.best_of_windows(cards, ["source"], "o", "pri", "score", "role").select("source", F.col("window").alias("win"), "doc_id")


_NODES = """n AS (SELECT l_orderkey AS role, (l_linenumber * 10000000 + l_partkey) * 100000 + l_suppkey AS node_id, l_suppkey AS scene_id, CAST(l_linenumber * 2 + l_suppkey % 3 AS BIGINT) AS scene_order, CASE WHEN l_returnflag = 'R' THEN 'core' ELSE 'supporting' END AS importance,
CASE WHEN l_linestatus = 'O' THEN 'g' ELSE '' END AS goal, CASE WHEN l_quantity > 25 THEN 'r' ELSE '' END AS res, CASE WHEN l_discount > 0.05 THEN 'u' ELSE '' END AS issue, CAST(l_partkey % 100 AS INTEGER) AS d, CAST(l_quantity AS INTEGER) % 4 AS q FROM lineitem)"""


_PAIRS = """s AS (SELECT *, 2 * (importance = 'core')::INT + (goal <> '')::INT + (res <> '')::INT + (issue <> '')::INT + (d >= 80)::INT + (q >= 2)::INT AS sal, importance <> 'core' AND goal = '' AND res = '' AND issue = '' AND d < 70 AS thin, max(scene_order) OVER (PARTITION BY role) AS m FROM n),
p AS (SELECT *, CASE WHEN scene_order / m <= 0.34 THEN 'early' WHEN scene_order / m <= 0.67 THEN 'middle' ELSE 'late' END AS phase FROM s),
x AS (SELECT role, node_id AS prev_id, lead(node_id) OVER w AS next_id, scene_order AS prev_order, lead(scene_order) OVER w AS next_order, greatest(0, lead(scene_order) OVER w - scene_order) AS gap, phase, lead(phase) OVER w AS phase2, importance = 'core' AS c1, lead(importance) OVER w = 'core' AS c2, sal, lead(sal) OVER w AS sal2, thin, lead(thin) OVER w AS thin2, res, lead(goal) OVER w AS goal2, lead(res) OVER w AS res2, lead(issue) OVER w AS issue2 FROM p WINDOW w AS (PARTITION BY role ORDER BY scene_order, node_id)),
pairs AS (SELECT role, prev_id, next_id, prev_order, next_order, gap AS scene_gap, CASE WHEN phase = phase2 THEN phase ELSE phase || '->' || phase2 END AS phase_label, phase AS prev_phase, phase2 AS next_phase, c1 AS prev_core, c2 AS next_core, res, goal2, res2, issue2,
CAST(2 * (c1 OR c2)::INT + (c1 AND c2)::INT + greatest(sal, sal2) + (res <> '')::INT + (goal2 <> '')::INT + (res2 <> '')::INT + (issue2 <> '')::INT + (phase <> phase2)::INT + (gap BETWEEN 2 AND 12)::INT - (NOT c1 AND NOT c2)::INT - (gap > 12)::INT - (gap <= 1 AND phase = phase2)::INT - (thin AND thin2)::INT AS BIGINT) AS pair_score
FROM x WHERE next_id IS NOT NULL)"""


@query(f"WITH {_NODES}, {_PAIRS} SELECT role, prev_id, next_id, scene_gap, phase_label, pair_score FROM pairs")
def transition_pairs(table):
    return sequence.transition_pairs(_nodes(table), ["role"]).select("role", "prev_id", "next_id", F.col("scene_gap").cast("long").alias("scene_gap"), "phase_label", F.col("pair_score").cast("long").alias("pair_score"))


def _nodes(table):
    some = lambda cond, x: F.when(F.expr(cond), x).otherwise("")
    return table("lineitem").select(
        F.col("l_orderkey").alias("role"), ((F.col("l_linenumber").cast("long") * 10000000 + F.col("l_partkey")) * 100000 + F.col("l_suppkey")).alias("node_id"), F.col("l_suppkey").alias("scene_id"), (F.col("l_linenumber") * 2 + F.col("l_suppkey") % 3).alias("scene_order"), F.lit(0).alias("beat_index"), F.when(F.col("l_returnflag") == "R", "core").otherwise("supporting").alias("importance"),
        some("l_linestatus = 'O'", "g").alias("goal_state"), some("l_quantity > 25", "r").alias("resulting_state"), some("l_discount > 0.05", "u").alias("unresolved_issue"), F.repeat(F.lit("d"), (F.col("l_partkey") % 100).cast("int")).alias("salient_development"), (F.col("l_quantity").cast("int") % 4).alias("n_quotes"),
    )


@query(r"""SELECT doc_id, md5(k) AS k FROM (SELECT doc_id, k, row_number() OVER (PARTITION BY source, k ORDER BY doc_id) AS n FROM (SELECT doc_id, source, trim(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9\x{4E00}-\x{9FFF}]+', ' ', 'g')) AS k FROM documents)) WHERE n = 1""")
def dedup_first(table):
    rows = table("documents").select("doc_id", "source", F.md5(T.name_key("text").cast("binary")).alias("k"))
    return sequence.first_of_equals(rows, ["source", "k"], ["doc_id"]).select("doc_id", "k")


_TOK = "SELECT source, doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9'']+') AS t FROM documents"
_QTOK = "SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9'']+') AS t FROM benchmark"
_BM25 = f"""d AS ({_TOK}), st AS (SELECT source, count(*) AS nd, avg(len(t)) AS al FROM d GROUP BY source), tf AS (SELECT source, doc_id, dl, w, count(*) AS tf FROM (SELECT source, doc_id, len(t) AS dl, unnest(t) AS w FROM d) GROUP BY ALL),
df AS (SELECT source, w, count(*) AS df FROM tf GROUP BY ALL), i0 AS (SELECT source, w, al, ln(nd - df + 0.5) - ln(df + 0.5) AS idf FROM df JOIN st USING (source)), mi AS (SELECT source, avg(idf) AS mi FROM i0 GROUP BY source),
idf AS (SELECT source, w, al, CASE WHEN idf < 0 THEN 0.25 * mi ELSE idf END AS idf FROM i0 JOIN mi USING (source)), q AS (SELECT item_id, w, count(*) AS qn FROM (SELECT item_id, unnest(t) AS w FROM ({_QTOK})) GROUP BY ALL),
bm AS (SELECT source, item_id, doc_id, sum(qn * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / al))) AS score FROM tf JOIN idf USING (source, w) JOIN q USING (w) GROUP BY ALL),
bmr AS (SELECT source, item_id, doc_id, row_number() OVER (PARTITION BY source, item_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM bm)"""


def _bm25(table):
    docs = table("documents").select("source", "doc_id", T.tokens("text", F.lit("en")).alias("tokens"))
    sources = table("documents").select("source").distinct()
    asked = sources.crossJoin(F.broadcast(table("benchmark").select("item_id", T.tokens("text", F.lit("en")).alias("tokens"))))  # the stated queries of each index
    return retrieval.bm25_scores(docs, asked, ["source"], "doc_id", "item_id")


@query(f"WITH {_BM25} SELECT * FROM bmr WHERE rank <= 4")
def bm25_topk(table):
    return retrieval.top_k(_bm25(table), ["source", "item_id"], 4, "doc_id").select("source", "item_id", "doc_id", F.col("rank").cast("long").alias("rank"))


_VEC = """u AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), v AS (SELECT vec_id, label, list_transform(e, lambda x: x / greatest(sqrt(list_sum(list_transform(e, lambda y: y * y))), 1e-12)) AS e FROM u),
vs AS (SELECT q.vec_id AS query, d.vec_id AS vec_id, list_sum(list_transform(list_zip(d.e, q.e), lambda z: z[1] * z[2])) AS score FROM v d JOIN v q USING (label) WHERE q.vec_id % 100 = 0),
vr AS (SELECT query, vec_id, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, vec_id) AS rank FROM vs)"""


def _vectors(table, k):
    rows = table("embeddings")
    scores = retrieval.vector_scores(rows, rows.where("vec_id % 100 = 0").withColumnRenamed("vec_id", "query"), ["label"], "vec_id", "query", "embedding")  # the stated query set
    return retrieval.top_k(scores, ["query"], k, "vec_id")


@query(f"WITH {_VEC} SELECT * FROM vr WHERE rank <= 5")
def vector_topk(table):
    return _vectors(table, 5).select("query", "vec_id", F.col("rank").cast("long").alias("rank"))


@query(f"""WITH {_BM25}, wr AS (SELECT source, item_id, doc_id, row_number() OVER (PARTITION BY source, item_id ORDER BY round(n, 9) DESC, doc_id) AS rank FROM (SELECT source, item_id, doc_id, CAST(count(*) AS DOUBLE) AS n FROM tf JOIN q USING (w) GROUP BY ALL)),
f AS (SELECT source, item_id, doc_id, sum(1.0::DOUBLE / (60 + rank)) AS score, string_agg(src, '+' ORDER BY src) AS trace FROM (SELECT *, 'bm25' AS src FROM bmr WHERE rank <= 12 UNION ALL SELECT *, 'overlap' FROM wr WHERE rank <= 12) GROUP BY ALL)
SELECT source, item_id, doc_id, trace, rank FROM (SELECT *, row_number() OVER (PARTITION BY source, item_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM f) WHERE rank <= 12""")
def rrf_fusion(table):
    """BM25 and word overlap of one pass over the documents, fused by rank."""
    own = Window.partitionBy("source", "item_id")
    place = lambda c: F.row_number().over(own.orderBy(F.desc(c), "doc_id"))
    scores = _bm25(table).select("source", "item_id", "doc_id", place(F.round("score", 9)).alias("a"), place(F.col("overlap")).alias("b")).where("a <= 12 OR b <= 12")
    lists = F.explode(F.array(F.struct(F.col("a").alias("rank"), F.lit("bm25").alias("list")), F.struct(F.col("b").alias("rank"), F.lit("overlap").alias("list"))))
    ranked = scores.select(F.col("source").alias("movie"), "item_id", "doc_id", lists.alias("x")).where("x.rank <= 12").select("movie", "item_id", "doc_id", "x.rank", F.col("x.list").alias("source"))
    out = retrieval.reciprocal_rank_fusion(ranked, ["movie", "item_id"], "doc_id", 12)
    return out.select(F.col("movie").alias("source"), "item_id", "doc_id", "trace", F.col("rank").cast("long").alias("rank"))


@query("""WITH m AS (SELECT c_custkey AS role, o_orderkey AS memory, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderkey % 11 END AS o, CASE WHEN o_orderkey % 3 = 0 THEN 0.0 ELSE floor(o_totalprice / 10000) END AS s FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT role, memory, 'bm25_topk' AS mode, rank FROM (SELECT *, row_number() OVER (PARTITION BY role ORDER BY s DESC, coalesce(o, 0), memory) AS rank FROM m) WHERE rank <= 4 UNION ALL
SELECT role, memory, 'full_memory_all_in', row_number() OVER (PARTITION BY role ORDER BY coalesce(o, 1000000000), memory) FROM m""")
def memory_modes(table):
    own = table("orders").join(table("customer").select(F.col("c_custkey").alias("o_custkey")), "o_custkey")
    m = own.select(F.col("o_custkey").alias("role"), F.col("o_orderkey").alias("memory"), F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderkey") % 11).alias("o"))
    scores = own.where("o_orderkey % 3 <> 0").select(F.col("o_custkey").alias("role"), F.col("o_orderkey").alias("memory"), F.floor(F.col("o_totalprice") / 10000).cast("double").alias("score"))
    out = None
    for mode in ("bm25_topk", "full_memory_all_in", "persona_only"):
        part = retrieval.select_memories(m, scores, ["role"], "memory", "o", mode).select("role", "memory", F.lit(mode).alias("mode"), F.col("rank").cast("long").alias("rank"))
        out = part if out is None else out.unionByName(part)
    return out


@query(f"""WITH s AS (SELECT p.*, CASE WHEN n_chars % 3 = 0 THEN 0 ELSE n_chars % 9 END AS score FROM ({_PLACE}) p JOIN documents USING (doc_id)), h AS (SELECT *, CASE WHEN m <= 1 THEN 'middle' WHEN (o - 1) / greatest(1, m - 1) < 0.34 THEN 'early' WHEN (o - 1) / greatest(1, m - 1) < 0.67 THEN 'middle' ELSE 'late' END AS b FROM s WHERE score > 0),
n AS (SELECT DISTINCT s.source, s.doc_id FROM s JOIN h ON s.source = h.source AND h.score >= 6 AND s.o BETWEEN h.o - 2 AND h.o + 2 UNION SELECT source, doc_id FROM h), big AS (SELECT source FROM n GROUP BY source HAVING count(*) > 120),
r AS (SELECT *, row_number() OVER (PARTITION BY source, b ORDER BY score DESC, o) AS r FROM h), k AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY r > 24, score DESC, o) AS k FROM r)
SELECT source, doc_id FROM n WHERE source NOT IN (SELECT source FROM big) UNION ALL SELECT source, doc_id FROM k WHERE k <= 120 AND source IN (SELECT source FROM big)""")
def shortlist_capped(table):
    rows = _scenes(table).select("source", "doc_id", F.col("o").cast("long").alias("o"), F.when(F.col("n_chars") % 3 == 0, 0).otherwise(F.col("n_chars") % 9).alias("score"))
    return retrieval.shortlist(rows, ["source"], "o", "score").select("source", "doc_id")


_ROLES = "CASE event_type WHEN 'click' THEN 'foreground' WHEN 'view' THEN 'active' WHEN 'purchase' THEN 'indirect' ELSE 'absent' END"


@query(f"""WITH c AS (SELECT user_id, CAST(floor(value) AS BIGINT) % 6 AS s, {_ROLES} AS r FROM events), n AS (SELECT user_id, count(*) AS n, count(*) FILTER (s >= 3) AS medium, count(*) FILTER (s >= 4) AS high, count(*) FILTER (s >= 5) AS very_high, count(*) FILTER (r IN ('foreground', 'active')) AS active FROM c GROUP BY user_id)
SELECT *, least(14, 9 + (n >= 18)::BIGINT + (n >= 30)::BIGINT + (medium >= 8)::BIGINT + (high >= 5)::BIGINT + (active >= 12)::BIGINT) AS budget, least(24, 20 + (n >= 18)::BIGINT + (n >= 28)::BIGINT + (n >= 40)::BIGINT + (medium >= 10)::BIGINT + (high >= 8)::BIGINT + (very_high >= 5)::BIGINT + (active >= 16)::BIGINT) AS budget_wide FROM n""")
def node_budgets(table):
    part = F.when(F.col("event_type") == "click", "foreground").when(F.col("event_type") == "view", "active").when(F.col("event_type") == "purchase", "indirect").otherwise("absent")
    out = summaries.budgets(table("events").select("user_id", (F.floor("value").cast("long") % 6).alias("s"), part.alias("r")), ["user_id"], "s", "r")
    return out.withColumns({c: F.col(c).cast("long") for c in ("budget", "budget_wide")})


@query("""SELECT l_orderkey, l_linenumber, CAST(l_quantity % 6 AS BIGINT) + CASE l_returnflag WHEN 'R' THEN 4 WHEN 'A' THEN 3 ELSE 0 END + (l_linenumber > 2)::BIGINT + (length(l_linestatus || CAST(l_partkey AS VARCHAR)) > 40)::BIGINT + (l_linestatus = 'O')::BIGINT + (l_tax > 0.04)::BIGINT AS rank_score FROM lineitem""")
def rank_scores(table):
    kind = F.when(F.col("l_returnflag") == "R", "status_win").when(F.col("l_returnflag") == "A", "career_move").otherwise("other")
    score = V.rank_score((F.col("l_quantity") % 6).cast("long"), kind, F.greatest(F.lit(0), F.col("l_linenumber") - 2), F.concat("l_linestatus", F.col("l_partkey").cast("string")), F.when(F.col("l_linestatus") == "O", "g").otherwise(""), F.when(F.col("l_tax") > 0.04, "r").otherwise(" "))
    return table("lineitem").select("l_orderkey", "l_linenumber", score.alias("rank_score"))


@query("""SELECT event_id, greatest(1, least(5, coalesce(CAST(round_even(TRY_CAST(s AS DOUBLE), 0) AS INTEGER), 1))) AS score, CASE WHEN t IN ('click', 'view') THEN t ELSE 'other' END AS kind, CASE WHEN a IN ('true', 'yes', '1') THEN true WHEN a IN ('false', 'no', '0') THEN false ELSE contains(a, 'true') AND NOT contains(a, 'false') END AS verdict
FROM (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'n/a' ELSE CAST(floor(value) / 2 AS VARCHAR) END AS s, event_type AS t, CASE event_type WHEN 'click' THEN 'true.' WHEN 'view' THEN 'yes!' WHEN 'signup' THEN 'yes' WHEN 'error' THEN 'mostly true' ELSE 'no' END AS a FROM events)""")
def judged_values(table):
    s = F.when(F.col("event_id") % 5 == 0, "n/a").otherwise((F.floor("value") / 2).cast("string"))
    answer = F.when(F.col("event_type") == "click", "True.").when(F.col("event_type") == "view", "yes!").when(F.col("event_type") == "signup", " YES ").when(F.col("event_type") == "error", "mostly true").otherwise("No")
    return table("events").select("event_id", V.score_clamp(s).alias("score"), V.enum_clamp(F.upper("event_type"), ["click", "view"], "other").alias("kind"), V.parse_bool(answer).alias("verdict"))


@query("""SELECT l_returnflag, l_linestatus, n, a AS share_large, b AS share_cheap, (a + b) / 2 AS overall FROM (SELECT l_returnflag, l_linestatus, count(*) AS n, count(*) FILTER (l_quantity > 25) / count(*) AS a, count(*) FILTER (l_discount > 0.05) / count(*) AS b FROM lineitem GROUP BY ALL)""")
def vote_means(table):
    rows = table("lineitem").select("l_returnflag", "l_linestatus", (F.col("l_quantity") > 25).alias("large"), (F.col("l_discount") > 0.05).alias("cheap"))
    return summaries.vote_means(rows, ["l_returnflag", "l_linestatus"], ["large", "cheap"])


@query("""WITH t AS (SELECT conv_id, turn, [o % 5 for o in range(turn, turn + 3)] AS sel, CASE WHEN turn % 2 = 0 THEN [turn % 5, (turn + 4) % 5] ELSE [] END AS src FROM conversations)
SELECT conv_id, count(*) AS n_turns, avg(3.0) AS mean_selected, avg(turn) AS mean_tokens, count(*) FILTER (len(src) > 0) AS n_with_sources, avg(CASE WHEN len(src) > 0 THEN (len(list_intersect(sel, src)) > 0)::INT END) AS hit_at_k, avg(CASE WHEN len(src) > 0 THEN len(list_intersect(sel, src)) / len(list_distinct(src)) END) AS recall_at_k FROM t GROUP BY conv_id""")
def retrieval_summary(table):
    t = F.col("turn")
    rows = table("conversations").select("conv_id", t, F.array(t % 5, (t + 1) % 5, (t + 2) % 5).alias("sel"), F.when(t % 2 == 0, F.array(t % 5, (t + 4) % 5)).otherwise(F.array().cast("array<bigint>")).alias("src"))
    return summaries.retrieval_summary(rows, ["conv_id"], "sel", "src", t.cast("double"))


@query("""WITH x AS (SELECT conv_id, turn, role || ': ' || text AS line FROM conversations) SELECT conv_id, string_agg(line, chr(10) ORDER BY turn, line) AS transcript, count(*) AS n_turns FROM x GROUP BY conv_id""")
def episode_transcripts(table):
    return dialogue.transcript(table("conversations"), ["conv_id"], "turn", "role", "text")


@query("""SELECT user_id, max_by(event_type, ts) AS event_type, max(ts) AS ts FROM (SELECT user_id, event_type, ts FROM events QUALIFY row_number() OVER (PARTITION BY user_id, ts ORDER BY event_id) = 1) GROUP BY user_id""")
def latest_status(table):
    one = sequence.first_of_equals(table("events").select("user_id", "event_type", "ts", "event_id"), ["user_id", "ts"], ["event_id"])
    return status.latest_status(one, "user_id", "ts", "event_type")


@query("""SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN p_type ELSE p_name END AS p_name, p_size % 3 = 0 AND p_type <> p_name AS changed FROM part""")
def merge_updates(table):
    rows, new = table("part").select("p_partkey", "p_name"), table("part").select("p_partkey", F.when(F.col("p_size") % 3 == 0, F.col("p_type")).otherwise("").alias("p_name"))
    return matching.merge_updates(rows, new, "p_partkey", ["p_name"])


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_orderkey + 1 AS VARCHAR) ELSE 'x' || CAST(o_orderkey AS VARCHAR) END AS scene_id FROM orders""")
def public_scene_ids(table):
    k = F.col("o_orderkey").cast("string")
    return table("orders").select("o_orderkey", T.public_scene_id(F.when(F.col("o_orderkey") % 2 == 0, k).otherwise(F.concat(F.lit("x"), k))).alias("scene_id"))


def _card_rows(table):
    """Cards of roles (users) from the job log, with texts that hit the tags."""
    e = F.col("event_type")
    words = F.when(e == "purchase", "decides to lock the window").when(e == "error", "a secret is discovered").when(e == "signup", "belief and comfort").otherwise("introduced as an observer")
    own = Window.partitionBy("role")
    rows = table("events").select(F.col("user_id").alias("role"), F.col("event_id").cast("string").alias("scene_id"), "event_id", (F.floor("value").cast("int") % 6).alias("score"), F.when(e == "click", "foreground").otherwise("active").alias("scene_role"), words.alias("role_in_scene"), F.when(F.col("event_id") % 2 == 0, words).otherwise("").alias("goal_shift"), F.when(F.col("event_id") % 3 == 0, words).otherwise("").alias("relation_shift"))
    return rows.withColumn("scene_order", F.row_number().over(own.orderBy("event_id")).cast("long"))


@query()
def milestone_select(table):
    return folds.milestones(_card_rows(table).withColumn("budget", F.lit(10)), ["role"], wide=False)


@query()
def milestone_select_wide(table):
    return folds.milestones(_card_rows(table).withColumn("budget", F.lit(20)), ["role"], wide=True, checks=14)


def _candidate_rows(table, role="l_partkey % 500"):
    return table("lineitem").select(F.expr(role).alias("role"), F.col("l_suppkey").cast("string").alias("scene_id"), (F.col("l_orderkey") % 97 + 1).alias("scene_order"), F.col("l_linenumber").alias("beat_index"), (F.col("l_quantity") % 9).cast("int").alias("rank"), (F.col("l_quantity") % 7).cast("int").alias("candidate_score"), F.when(F.col("l_returnflag") == "R", "other").otherwise("career_move").alias("change_type"), (F.col("l_linenumber") % 2).alias("n_quotes"), "l_orderkey")


_CANDIDATES = """SELECT l_partkey % 500 AS role, CAST(l_suppkey AS VARCHAR) AS scene_id, l_orderkey % 97 + 1 AS scene_order, l_linenumber AS beat_index, CAST(l_quantity % 9 AS INTEGER) AS rank, CAST(l_quantity % 7 AS INTEGER) AS candidate_score,
CASE WHEN l_returnflag = 'R' THEN 'other' ELSE 'career_move' END AS change_type, l_linenumber % 2 AS n_quotes, l_orderkey FROM lineitem"""


@query(f"""WITH RECURSIVE c AS (SELECT *, max(scene_order) OVER (PARTITION BY role) AS m FROM ({_CANDIDATES})),
u AS (SELECT *, CASE WHEN m <= 1 THEN 2 WHEN (greatest(1, scene_order) - 1) / greatest(1, m - 1) < 0.34 THEN 1 WHEN (greatest(1, scene_order) - 1) / greatest(1, m - 1) < 0.67 THEN 2 ELSE 3 END AS third,
      row_number() OVER (PARTITION BY role ORDER BY rank DESC, scene_order DESC, beat_index DESC, l_orderkey, scene_id, candidate_score, change_type, n_quotes) AS i FROM c WHERE change_type <> 'other' OR n_quotes > 0),
q AS (SELECT role, CASE WHEN count(DISTINCT third) = 3 THEN 3 ELSE 2 END AS quota FROM u GROUP BY role),
a AS (SELECT role, phase, i, scene_id, scene_id || '/' || beat_index AS place, row_number() OVER (PARTITION BY role ORDER BY phase, i) AS k FROM (SELECT *, third AS phase FROM u UNION ALL SELECT *, 4 AS phase FROM u)),
r AS (SELECT role, 0::BIGINT AS k, 0 AS phase, 0 AS n, []::BIGINT[] AS kept, []::VARCHAR[] AS places, []::VARCHAR[] AS scenes FROM q
      UNION ALL SELECT role, k, phase, n + f::INT, CASE WHEN f THEN list_append(kept, i) ELSE kept END, CASE WHEN f THEN list_append(places, place) ELSE places END, CASE WHEN f THEN list_append(scenes, scene_id) ELSE scenes END
      FROM (SELECT *, len(kept) < 14 AND NOT list_contains(places, place) AND len(list_filter(scenes, lambda x: x = scene_id)) < 2 AND (phase = 4 OR n < quota) AS f
            FROM (SELECT r.role, a.k, a.phase, CASE WHEN a.phase = r.phase THEN r.n ELSE 0 END AS n, kept, places, scenes, a.i, a.place, a.scene_id, quota FROM r JOIN a ON a.role = r.role AND a.k = r.k + 1 JOIN q ON q.role = r.role))),
f AS (SELECT role, unnest(arg_max(kept, k)) AS i FROM r GROUP BY role)
SELECT role, scene_id, scene_order, beat_index, rank, candidate_score, change_type, n_quotes, l_orderkey FROM u JOIN f USING (role, i)""")
def prune_candidates(table):
    order = ["scene_order", "beat_index", "l_orderkey", "scene_id", "candidate_score", "change_type", "n_quotes"]
    return folds.per_role(folds.prune_pool(_candidate_rows(table), ["role"], order), ["role"], folds.prune, order)


@query()
def repair_nodes(table):
    def fold(rows: list[dict]) -> list[dict]:
        return folds.repair([r for r in rows if r["change_type"] == "other"], [r for r in rows if r["change_type"] != "other"])

    return folds.per_role(_candidate_rows(table, "l_partkey"), ["role"], fold, ["scene_order", "beat_index", "l_orderkey"])


def _important_sql() -> str:
    """The picks one after the other: across thirds, not trivial, early to middle, middle to late, one of each third, then the best left."""
    fits = ["near AND prev_phase <> next_phase", "near AND scene_gap >= 2", "near AND phase_label = 'early->middle'", "near AND phase_label = 'middle->late'"]
    fits += [f"near AND (phase_label = '{b}' OR prev_phase = '{b}')" for b in ("early", "middle", "late")] + ["true"] * 4
    steps = ["k0 AS MATERIALIZED (SELECT role, i FROM m WHERE false)"]
    for n, fit in enumerate(fits, 1):
        room = "" if n <= 4 else f" AND (SELECT count(*) FROM k{n - 1} k WHERE k.role = m.role) < {'4' if n <= 7 else 'least(4, pairs)'}"
        steps.append(f"k{n} AS MATERIALIZED (SELECT * FROM k{n - 1} UNION ALL SELECT role, arg_max(i, key) FROM m WHERE pool AND {fit} AND NOT EXISTS (SELECT 1 FROM k{n - 1} k WHERE k.role = m.role AND k.i = m.i){room} GROUP BY role)")
    return f"""WITH {_NODES}, {_PAIRS},
g AS (SELECT *, res <> '' OR goal2 <> '' OR res2 <> '' OR issue2 <> '' AS anchored, row_number() OVER (PARTITION BY role ORDER BY prev_order, prev_id) AS i, count(*) OVER (PARTITION BY role) AS pairs FROM pairs),
h AS (SELECT *, anchored AND scene_gap BETWEEN 1 AND 6 AS near, scene_gap <= CASE WHEN phase_label = 'early->late' THEN 6 ELSE 10 END AND (scene_gap > 0 OR anchored) AS usable FROM g),
m AS MATERIALIZED (SELECT *, CASE WHEN bool_or(usable AND near) OVER (PARTITION BY role) THEN usable AND near WHEN bool_or(usable) OVER (PARTITION BY role) THEN usable ELSE true END AS pool,
     (anchored::INT, (scene_gap BETWEEN 1 AND 6)::INT, (scene_gap <> 0)::INT, (scene_gap < 8)::INT, pair_score, (prev_phase <> next_phase AND scene_gap <= 8)::INT, prev_core::INT, next_core::INT, -scene_gap, -i) AS key FROM h),
{', '.join(steps)},
z AS (SELECT role, i, row_number() OVER (PARTITION BY role ORDER BY i) AS n FROM k{len(fits)})
SELECT role, prev_id, next_id, prev_order, next_order, scene_gap, phase_label, prev_phase, next_phase, pair_score, anchored, prev_core, next_core FROM m JOIN z USING (role, i) WHERE n <= 4"""


@query(_important_sql())
def important_pairs(table):
    pairs = sequence.transition_pairs(_nodes(table), ["role"])
    out = folds.per_role(pairs, ["role"], lambda rows: [rows[i] for i in folds.important_pairs(rows)], ["prev_order", "prev_id"])
    return out.withColumns({c: F.col(c).cast("long") for c in ("prev_order", "next_order", "scene_gap", "pair_score")})


@query("""WITH RECURSIVE c AS (SELECT g.l_orderkey, g.l_linenumber AS gi, p.l_linenumber AS pi, 1 - abs(g.l_quantity - p.l_quantity) / 50 AS score FROM lineitem g JOIN lineitem p USING (l_orderkey) WHERE g.l_returnflag <> 'N' AND p.l_returnflag <> 'R'),
s AS (SELECT DISTINCT l_orderkey, gi, pi, score FROM c WHERE score >= 0.35), o AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY score DESC, gi DESC, pi DESC) AS k FROM s),
r AS (SELECT l_orderkey, 0::BIGINT AS k, []::INTEGER[] AS gs, []::INTEGER[] AS ps, []::STRUCT(gi INTEGER, pi INTEGER, score DOUBLE)[] AS kept FROM (SELECT DISTINCT l_orderkey FROM o)
      UNION ALL SELECT r.l_orderkey, r.ok, CASE WHEN f THEN list_append(gs, gi) ELSE gs END, CASE WHEN f THEN list_append(ps, pi) ELSE ps END, CASE WHEN f THEN list_append(kept, {gi: gi, pi: pi, score: score}) ELSE kept END
      FROM (SELECT r.*, o.k AS ok, o.gi, o.pi, o.score, NOT list_contains(gs, o.gi) AND NOT list_contains(ps, o.pi) AS f FROM r JOIN o ON o.l_orderkey = r.l_orderkey AND o.k = r.k + 1) r)
SELECT l_orderkey, x.gi AS gi, x.pi AS pi, x.score AS score FROM (SELECT l_orderkey, unnest(arg_max(kept, k)) AS x FROM r GROUP BY l_orderkey)""")
def greedy_match(table):
    rows = table("lineitem").select("l_orderkey", F.col("l_linenumber").alias("i"), "l_quantity", "l_returnflag")
    gold, pred = rows.where("l_returnflag <> 'N'").select("l_orderkey", F.col("i").alias("gi"), F.col("l_quantity").alias("a")), rows.where("l_returnflag <> 'R'").select("l_orderkey", F.col("i").alias("pi"), F.col("l_quantity").alias("b"))
    scores = gold.join(pred, "l_orderkey").select("l_orderkey", "gi", "pi", (1 - F.abs(F.col("a") - F.col("b")) / 50).alias("score"))
    return matching.greedy_pairs(scores, ["l_orderkey"])


@query()
def scene_beats(table):
    return B.beats(table("documents"), "doc_id", "source", "text")


@query()
def fuzzy_names(table):
    left = table("supplier").select(F.col("s_nationkey").alias("n"), T.name_key("s_name").alias("a"))
    right = table("customer").select(F.col("c_nationkey").alias("n"), T.name_key(F.regexp_replace("c_name", "Customer", "Supplier")).alias("b"))
    return matching.fuzzy_names(left, right, ["n"], "a", "b")


@query(rf"""WITH RECURSIVE t AS (SELECT conv_id, turn, role, trim(regexp_replace(text, '{_WS}', ' ', 'g')) AS x FROM conversations),
r AS (SELECT conv_id, turn, '- none' || chr(10) || 'user: ' || x AS prompt FROM t WHERE turn = 0
      UNION ALL SELECT t.conv_id, t.turn, '- ' || b.role || ': ' || b.x || chr(10) || '- model: ' || substr(sha256(r.prompt), 1, 16) || chr(10) || 'user: ' || t.x FROM r JOIN t ON t.conv_id = r.conv_id AND t.turn = r.turn + 1 JOIN t b ON b.conv_id = r.conv_id AND b.turn = r.turn)
SELECT conv_id, turn, prompt, substr(sha256(prompt), 1, 16) AS answer FROM r""")
def dialogue_fold(table):
    """Every turn is answered after a history of the turn before and the model's own answer to it."""
    turns = table("conversations")
    w = Window.partitionBy("conv_id").orderBy("turn")
    line = lambda speaker, text, fill: F.struct(speaker.alias("speaker"), text.alias("text"), F.lit(fill).cast("string").alias("fill_with"), (F.col("turn") - 1).alias("source_turn_index"))
    before = F.array(line(F.lag("role").over(w), F.lag("text").over(w), None), line(F.lit("model"), F.lit(""), dialogue.ANSWER))
    turns = turns.withColumn("history", F.when(F.col("turn") > 0, before))
    return dialogue.play_episodes(turns, ["conv_id"], "turn", "text", "history")


@query("""SELECT event_id, '{' || string_agg('"' || k || '":' || json_extract(props, '$.' || k), ',' ORDER BY k) || '}' AS json FROM (SELECT event_id, props, unnest(json_keys(props)) AS k FROM events) GROUP BY event_id""")
def tolerant_json(table):
    broken = F.concat(F.lit("Here it is:\n```json\n"), F.regexp_replace("props", r"\}$", ",}"), F.lit("\n```"))
    return table("events").select("event_id", extract_json(broken).alias("json"))
