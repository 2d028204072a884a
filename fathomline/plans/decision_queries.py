"""Queries over stage scores, observations, answers, episodes and headline windows; with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import expressions as x
from ..operators import decisions as d
from ..operators import intervals, tables
from ..operators.documents import newest
from ..sources.bridge import DECISIONS_SQL, TELEMETRY_SQL, WINDOWS_SQL, decisions, telemetry, windows
from ..sources.tables import table
from .retrieval_queries import MOVES, move_scores
from .scoring_queries import MATCHED, matched

QUERIES: dict = {}
SQL: dict = {}


def query(name: str, sql: str):
    def add(f):
        QUERIES[name] = f
        SQL[name] = f"WITH {sql}"
        return f

    return add


@query("stage_merge", """c AS (SELECT l_suppkey AS k, CAST(max(l_linenumber) AS DOUBLE) AS score FROM lineitem WHERE l_returnflag = 'R' GROUP BY k),
t AS (SELECT l_suppkey AS k, CAST(count(*) AS DOUBLE) AS score FROM lineitem WHERE l_linestatus = 'F' AND l_linenumber = 7 GROUP BY k)
SELECT s_suppkey AS k, coalesce(c.score, 0) AS catalog, coalesce(t.score, 0) AS text FROM supplier LEFT JOIN c ON c.k = s_suppkey LEFT JOIN t ON t.k = s_suppkey""")
def stage_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").withColumnRenamed("l_suppkey", "k")
    catalog = li.where("l_returnflag = 'R'").groupBy("k").agg(F.max("l_linenumber").cast("double").alias("score"))
    text = li.where("l_linestatus = 'F' and l_linenumber = 7").groupBy("k").agg(F.count(F.lit(1)).cast("double").alias("score"))
    return d.merge_stages(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k")), {"catalog": catalog, "text": text}, "k")


@query("catalog_stage", f"""{MOVES}
SELECT event, fault, round(score + CASE WHEN event % 5 IN (fault % 5, fault % 7) THEN 0.15 ELSE 0 END + CASE WHEN event % 7 IN (fault % 5, fault % 7) OR event % 3 IN (fault % 5, fault % 7) THEN 0.05 ELSE 0 END, 5) AS score FROM sc""")
def catalog_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    filed = F.array(F.col("fault") % 5, F.col("fault") % 7)
    beside = F.array(F.col("event") % 7, F.col("event") % 3)
    score = d.catalog_score(F.col("score"), filed, F.col("event") % 5, beside)
    return move_scores(spark, sf_dir).select("event", "fault", F.round(score, 5).alias("score"))


@query("observation_choice", """o AS (SELECT l_suppkey AS event, l_orderkey * 8 + l_linenumber AS index, l_partkey % 3 = 0 AS named, l_returnflag = 'R' AS moving, l_quantity AS magnitude FROM lineitem),
r AS (SELECT event, index, row_number() OVER (PARTITION BY event ORDER BY named DESC, magnitude DESC, index) AS place FROM o WHERE named OR moving) SELECT event, index, place FROM r WHERE place <= 12""")
def observation_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    seen = li.select(F.col("l_suppkey").alias("event"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("index"), (F.col("l_partkey") % 3 == 0).alias("named"), (F.col("l_returnflag") == "R").alias("moving"), F.col("l_quantity").alias("magnitude"))
    return d.choose_observations(seen, "event").select("event", "index", "place")


@query("display_probabilities", f"""{MOVES}, e AS (SELECT event, CAST(fault AS VARCHAR) AS option, score FROM sc UNION ALL SELECT event, 'none_of_these', 1 - greatest(0, max(score)) FROM sc GROUP BY event)
SELECT event, option, round(score / sum(score) OVER (PARTITION BY event), 5) AS probability FROM e""")
def display_probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = move_scores(spark, sf_dir).select("event", F.col("fault").cast("string").alias("option"), "score")
    return d.display_probabilities(s, "event", "option", "score").withColumn("probability", F.round("probability", 5))


ANSWERS = """m AS (SELECT o_orderkey AS k, (o_orderkey * 37 % 101) / 100 AS a, (o_custkey * 53 % 101) / 100 AS b, (o_orderkey * 11 % 101) / 100 AS n, (o_custkey * 7 % 10) / 10 AS sa, (o_orderkey * 3 % 10) / 10 AS sb,
    (o_orderkey % 3) / 2 AS v0, (o_custkey % 4) / 2 AS v3 FROM orders),
r AS (SELECT *, list_sort([{'l': -a, 'o': 'a'}, {'l': -b, 'o': 'b'}, {'l': -n, 'o': 'none_of_these'}]) AS s FROM m),
t AS (SELECT *, s[1].o AS one, s[2].o AS two, s[2].l - s[1].l > 0.05 AS apart FROM r),
u AS (SELECT *, CASE one WHEN 'a' THEN sa WHEN 'b' THEN sb END AS s1, CASE two WHEN 'a' THEN sa WHEN 'b' THEN sb END AS s2 FROM t),
w AS (SELECT *, CASE WHEN apart OR s1 IS NULL OR s2 IS NULL OR s1 = s2 THEN one WHEN s2 > s1 THEN two ELSE one END AS decided FROM u)"""


@query("answer_reading", f"""{ANSWERS} SELECT k, decided, decided <> one AS tie_broken, coalesce(CASE decided WHEN 'a' THEN sa WHEN 'b' THEN sb END < 0.4, false) AS inconsistent, CASE WHEN v3 > v0 THEN 'critical' ELSE 'low' END AS level FROM w""")
def answer_reading(spark: SparkSession, sf_dir: str) -> DataFrame:
    ok, ck = F.col("o_orderkey"), F.col("o_custkey")
    of = lambda *kv: F.create_map(*[v if isinstance(v, F.Column) else F.lit(v) for v in kv])
    m = table(spark, sf_dir, "orders").select(
        ok.alias("k"),
        of("a", ok * 37 % 101 / 100, "b", ck * 53 % 101 / 100, d.NONE_OF_THESE, ok * 11 % 101 / 100).alias("probabilities"),
        of("a", ck * 7 % 10 / 10, "b", ok * 3 % 10 / 10).alias("support"),
        of("0", ok % 3 / 2, "3", ck % 4 / 2).alias("severity"),
    )
    likeliest = F.array_sort(F.transform(F.map_entries("probabilities"), lambda e: F.struct(-e["value"], e["key"].alias("key"))))[0]["key"]
    return d.read_answers(m.withColumn("choice", likeliest)).select("k", "decided", "tie_broken", "inconsistent", "level")


@query("worst_hint", """h AS (SELECT o_custkey, max(CASE o_orderpriority WHEN '1-URGENT' THEN 3 WHEN '2-HIGH' THEN 2 WHEN '3-MEDIUM' THEN 1 ELSE 0 END) AS s FROM orders GROUP BY o_custkey)
SELECT o_custkey, CASE s WHEN 3 THEN 'critical' WHEN 2 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS severity FROM h""")
def worst_hint(spark: SparkSession, sf_dir: str) -> DataFrame:
    fired = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias("rules"))
    hints = {"1-URGENT": "critical", "2-HIGH": "high", "3-MEDIUM": "medium", "5-LOW": "low"}
    return fired.select("o_custkey", d.worst_hint(F.col("rules"), hints).alias("severity"))


@query("gate_abstention", f"""{DECISIONS_SQL}, c AS (SELECT decision_id, confidence, CASE WHEN starts_with(choice, '4') THEN 'none_of_these' ELSE choice END AS choice FROM dec)
SELECT decision_id, CASE WHEN choice = 'none_of_these' THEN 'log' WHEN confidence >= 0.85 THEN 'ticket' WHEN confidence >= 0.6 THEN 'review' ELSE 'log' END AS outcome, choice = 'none_of_these' AND confidence >= 0.6 AS abstained FROM c""")
def gate_abstention(spark: SparkSession, sf_dir: str) -> DataFrame:
    choice = F.when(F.col("choice").startswith("4"), d.NONE_OF_THESE).otherwise(F.col("choice"))
    c = decisions(spark, sf_dir).withColumn("choice", choice)
    return c.select("decision_id", x.gate(F.col("confidence"), F.col("choice") == d.NONE_OF_THESE).alias("outcome"), d.abstained(F.col("choice"), F.col("confidence")).alias("abstained"))


@query("recordset_insert", """c AS (SELECT o_orderkey AS decision_id, unnest([1, 2]) AS rank, unnest(['F' || (o_orderkey % 5), 'F' || (o_custkey % 3)]) AS fault_id, unnest([o_custkey % 10 / 10, 0.25]) AS probability FROM orders),
f AS (SELECT *, row_number() OVER (PARTITION BY decision_id, fault_id ORDER BY rank) AS n FROM c)
SELECT decision_id, fault_id, CASE WHEN decision_id % 7 = 0 AND fault_id = 'F0' THEN 0 ELSE rank END AS rank, CASE WHEN decision_id % 7 = 0 AND fault_id = 'F0' THEN 1.0 ELSE probability END AS probability FROM f WHERE n = 1
UNION ALL SELECT o_orderkey, 'F0', 0, 1.0 FROM orders WHERE o_orderkey % 7 = 0 AND o_orderkey % 5 <> 0 AND o_custkey % 3 <> 0""")
def recordset_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates that came as one JSON array a decision, inserted unless the decision has the fault already."""
    o = table(spark, sf_dir, "orders")
    text = F.format_string('[{"rank": 1, "fault_id": "F%d", "probability": %s, "more": null}, {"rank": 2, "fault_id": "F%d", "probability": 0.25}]', F.col("o_orderkey") % 5, (F.col("o_custkey") % 10 / 10).cast("string"), F.col("o_custkey") % 3)
    came = d.recordset(o.select(F.col("o_orderkey").alias("decision_id"), text.alias("doc")), ["decision_id"], "doc", "rank int, fault_id string, probability double")
    old = o.where("o_orderkey % 7 = 0").select(F.col("o_orderkey").alias("decision_id"), F.lit(0).alias("rank"), F.lit("F0").alias("fault_id"), F.lit(1.0).alias("probability"))
    return tables.insert_ignore(old, came, ["decision_id", "fault_id"]).select("decision_id", "fault_id", "rank", "probability")


@query("live_episodes", """e AS (SELECT c_custkey AS episode_id, CASE WHEN c_custkey % 3 = 0 THEN 'closed' ELSE 'open' END AS status, CASE WHEN c_custkey % 5 = 0 THEN c_custkey * 100 END AS ticket_id, c_custkey % 11 = 0 AS closed_by_technician FROM customer),
t AS (SELECT o_custkey AS episode_id, min(o_orderkey) AS ticket_id FROM orders GROUP BY o_custkey), u AS (SELECT *, CASE ticket_id % 3 WHEN 0 THEN 'open' WHEN 1 THEN 'review' ELSE 'closed' END AS st FROM t)
SELECT episode_id, e.status, coalesce(e.ticket_id, u.ticket_id) AS ticket_id, closed_by_technician OR coalesce(st, '') = 'closed' AS closed_by_technician FROM e LEFT JOIN u USING (episode_id) WHERE e.status = 'open' OR coalesce(st, '') IN ('review', 'open')""")
def live_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    e = table(spark, sf_dir, "customer").select(k.alias("episode_id"), F.when(k % 3 == 0, "closed").otherwise("open").alias("status"), F.when(k % 5 == 0, k * 100).alias("ticket_id"), (k % 11 == 0).alias("closed_by_technician"))
    t = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("episode_id")).agg(F.min("o_orderkey").alias("ticket_id"))
    state = F.when(F.col("ticket_id") % 3 == 0, "open").when(F.col("ticket_id") % 3 == 1, "review").otherwise("closed")
    return d.live_episodes(e, t.withColumn("status", state))


@query("symptom_merge", """s AS (SELECT DISTINCT o_custkey AS episode_id, unnest([o_orderpriority, o_orderstatus]) AS v FROM orders) SELECT episode_id, string_agg(v, ',' ORDER BY v) AS symptom_keys FROM s GROUP BY episode_id""")
def symptom_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("episode_id"), F.array("o_orderpriority", "o_orderstatus").alias("symptom_keys"))
    return d.merged_sets(o, "episode_id", "symptom_keys").withColumn("symptom_keys", F.array_join("symptom_keys", ","))


@query("missing_ids", "n AS (SELECT 1) SELECT c_custkey AS id, NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) AS missing FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus <> 'F')")
def missing_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected ids without a good run: those that never ran are missing, the others failed."""
    runs = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.bool_or(F.col("o_orderstatus") != "F").alias("good"))
    every = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    return every.join(runs, "id", "left").where("good is null or not good").select("id", F.col("good").isNull().alias("missing"))


@query("dirty_between", f"""{TELEMETRY_SQL}, {WINDOWS_SQL},
p AS (SELECT window_id, unit_id, to_ts, lead(from_ts) OVER (PARTITION BY unit_id ORDER BY from_ts, window_id) AS next_ts FROM win)
SELECT window_id, count(seq) AS dirty FROM p LEFT JOIN tel t ON t.unit_id = p.unit_id AND tag = 'error' AND sim_ts > to_ts AND sim_ts <= next_ts GROUP BY window_id""")
def dirty_between(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bad instants in (end, next start] of each window of a unit, found by unit and hour."""
    after = F.lead("from_ts").over(Window.partitionBy("unit_id").orderBy("from_ts", "window_id"))
    w = windows(spark, sf_dir).withColumn("next_ts", after)
    step = F.expr("interval 1 microsecond")
    holes = w.where("next_ts > to_ts").select("window_id", "unit_id", (F.col("to_ts") + step).alias("from_ts"), (F.col("next_ts") + step).alias("to_ts"))
    bad = telemetry(spark, sf_dir).where("tag = 'error'").select("unit_id", "sim_ts", "seq")
    n = intervals.points_in(bad, "sim_ts", holes).groupBy("window_id").agg(F.count(F.lit(1)).alias("dirty"))
    return w.select("window_id").join(n, "window_id", "left").fillna(0, ["dirty"])


@query("headline_check", f"""{MATCHED}, hd AS (SELECT DISTINCT window_id, window_id IN (SELECT window_id FROM mt WHERE verdict = 'tp') AS hit FROM win WHERE starts_with(accepted, '1'))
SELECT coalesce(string_agg(CAST(window_id AS VARCHAR), ',' ORDER BY window_id) FILTER (hit), '') AS detected, coalesce(string_agg(CAST(window_id AS VARCHAR), ',' ORDER BY window_id) FILTER (NOT hit), '') AS missed, count(*) > 0 AND count(*) FILTER (NOT hit) = 0 AS pass FROM hd""")
def headline_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = windows(spark, sf_dir).where(F.col("accepted").startswith("1"))
    out = d.headline_check(wanted, matched(spark, sf_dir).where("verdict = 'tp'"), "window_id")
    return out.select(F.array_join(F.col("detected").cast("array<string>"), ",").alias("detected"), F.array_join(F.col("missed").cast("array<string>"), ",").alias("missed"), "pass")


@query("document_replace", """l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS chunk FROM documents WHERE text IS NOT NULL),
b AS (SELECT doc_id, chunk, line, 0 AS batch, false AS deleted FROM l UNION ALL SELECT doc_id, chunk, 'v2 ' || line, 1, false FROM l WHERE doc_id % 5 = 0 AND chunk % 2 = 1 UNION ALL SELECT doc_id, NULL, NULL, 2, true FROM documents WHERE doc_id % 15 = 0),
n AS (SELECT *, max(batch) OVER (PARTITION BY doc_id) AS last FROM b)
SELECT doc_id, count(*) AS chunks, max(batch) AS batch, sum(length(line)) AS chars FROM n WHERE batch = last AND NOT deleted GROUP BY doc_id""")
def document_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth document is replaced by its odd lines, every fifteenth is deleted after that."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    lines = docs.where("text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("chunk", "line"))
    row = lambda df, line, batch, gone: df.select("doc_id", "chunk", line.alias("line"), F.lit(batch).alias("batch"), F.lit(gone).alias("deleted"))
    again = lines.where("doc_id % 5 = 0 and chunk % 2 = 0")
    gone = docs.where("doc_id % 15 = 0").select("doc_id", F.lit(None).cast("int").alias("chunk"))
    rows = row(lines, F.col("line"), 0, False).union(row(again, F.concat(F.lit("v2 "), "line"), 1, False)).union(row(gone, F.lit(None).cast("string"), 2, True))
    return newest(rows, "doc_id").groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunks"), F.max("batch").alias("batch"), F.sum(F.length("line")).alias("chars"))
