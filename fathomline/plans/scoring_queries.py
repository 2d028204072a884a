"""Queries over intervals, tickets, decisions, costs and tables: labels, matching, rates, ledger, paging, sinks; with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import expressions as x
from ..operators import costs, intervals, tables
from ..sources.bridge import CALLS_SQL, DECISIONS_SQL, TELEMETRY_SQL, TICKETS_SQL, WINDOWS_SQL, calls, decisions, telemetry, tickets, windows
from ..sources.tables import table

QUERIES: dict = {}
SQL: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = f"WITH {sql}"
        return f

    return add


def excluded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The windows of low priority stand in for the excluded spans."""
    return windows(spark, sf_dir).where(F.col("accepted").startswith("5"))


@query("label_instants", f"""{TELEMETRY_SQL}, {WINDOWS_SQL}
SELECT unit_id, seq, CASE WHEN EXISTS (SELECT 1 FROM win w WHERE w.unit_id = t.unit_id AND NOT starts_with(accepted, '5') AND sim_ts >= from_ts AND sim_ts < to_ts) THEN 'failure'
  WHEN EXISTS (SELECT 1 FROM win w WHERE w.unit_id = t.unit_id AND starts_with(accepted, '5') AND sim_ts >= from_ts AND sim_ts < to_ts) THEN 'excluded' ELSE 'negative' END AS label
FROM tel t""")
def label_instants(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = windows(spark, sf_dir)
    return intervals.label_instants(telemetry(spark, sf_dir), "sim_ts", w.where(~F.col("accepted").startswith("5")), excluded(spark, sf_dir)).select("unit_id", "seq", "label")


@query("slice_cut", f"""{TELEMETRY_SQL}, {WINDOWS_SQL}
SELECT window_id, count(*) AS n, min(seq) AS first_seq, max(seq) AS last_seq FROM win w JOIN tel t ON w.unit_id = t.unit_id AND sim_ts >= from_ts AND sim_ts < to_ts GROUP BY window_id""")
def slice_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.points_in(telemetry(spark, sf_dir), "sim_ts", windows(spark, sf_dir)).groupBy("window_id").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))


@query("window_overlap_clip", f"""{WINDOWS_SQL}
SELECT a.unit_id, a.window_id AS a_id, b.window_id AS b_id, epoch_us(greatest(a.from_ts, b.from_ts)) AS from_us, epoch_us(least(a.to_ts, b.to_ts)) AS to_us
FROM win a JOIN win b ON a.unit_id = b.unit_id AND a.from_ts < b.to_ts AND a.to_ts > b.from_ts AND starts_with(b.accepted, '5') AND NOT starts_with(a.accepted, '5')""")
def window_overlap_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = windows(spark, sf_dir)
    o = intervals.overlaps(w.where(~F.col("accepted").startswith("5")), excluded(spark, sf_dir))
    return o.select("unit_id", "a_id", "b_id", F.unix_micros("from_ts").alias("from_us"), F.unix_micros("to_ts").alias("to_us"))


ISLANDS = f"""{WINDOWS_SQL},
i0 AS (SELECT *, CASE WHEN from_ts > max(to_ts) OVER (PARTITION BY unit_id ORDER BY from_ts, to_ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) OR row_number() OVER (PARTITION BY unit_id ORDER BY from_ts, to_ts) = 1 THEN 1 ELSE 0 END AS fresh FROM win),
i1 AS (SELECT *, sum(fresh) OVER (PARTITION BY unit_id ORDER BY from_ts, to_ts ROWS UNBOUNDED PRECEDING) AS island FROM i0),
isl AS (SELECT unit_id, island, min(from_ts) AS from_ts, max(to_ts) AS to_ts FROM i1 GROUP BY unit_id, island)"""


@query("interval_union", f"{ISLANDS} SELECT unit_id, epoch_us(from_ts) AS from_us, epoch_us(to_ts) AS to_us FROM isl")
def interval_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.union(windows(spark, sf_dir)).select("unit_id", F.unix_micros("from_ts").alias("from_us"), F.unix_micros("to_ts").alias("to_us"))


@query("interval_holes", f"""{ISLANDS}
SELECT unit_id, epoch_us(to_ts) AS from_us, epoch_us(nxt) AS to_us FROM (SELECT *, lead(from_ts) OVER (PARTITION BY unit_id ORDER BY from_ts) AS nxt FROM isl) WHERE nxt IS NOT NULL""")
def interval_holes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.holes(intervals.union(windows(spark, sf_dir))).select("unit_id", F.unix_micros("from_ts").alias("from_us"), F.unix_micros("to_ts").alias("to_us"))


@query("negative_days", f"{ISLANDS} SELECT unit_id, round(sum(epoch_us(to_ts) - epoch_us(from_ts)) / 86400000000.0, 6) AS covered_days, round(30 - sum(epoch_us(to_ts) - epoch_us(from_ts)) / 86400000000.0, 6) AS negative_days FROM isl GROUP BY unit_id")
def negative_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = F.sum(F.unix_micros("to_ts") - F.unix_micros("from_ts")) / 86400000000
    return intervals.union(windows(spark, sf_dir)).groupBy("unit_id").agg(F.round(days, 6).alias("covered_days"), F.round(30 - days, 6).alias("negative_days"))


MATCHED = f"""{WINDOWS_SQL}, {TICKETS_SQL},
h AS (SELECT t.*, window_id, accepted, from_ts, fault = accepted AS acc FROM tic t JOIN win w ON t.unit_id = w.unit_id AND opened >= from_ts AND opened < to_ts),
o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ticket_id ORDER BY acc DESC, from_ts, window_id) AS k FROM h) WHERE k = 1),
v AS (SELECT ticket_id, window_id, CASE WHEN NOT acc THEN 'misdiagnosed' WHEN row_number() OVER (PARTITION BY window_id, acc ORDER BY opened, ticket_id) = 1 THEN 'tp' ELSE 'duplicate' END AS verdict FROM o),
mt AS (SELECT t.*, v.window_id, coalesce(verdict, 'fp') AS verdict FROM tic t LEFT JOIN v USING (ticket_id))"""


def matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.match_tickets(tickets(spark, sf_dir), windows(spark, sf_dir))


@query("ticket_match", f"{MATCHED} SELECT ticket_id, window_id, verdict FROM mt")
def ticket_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matched(spark, sf_dir).select("ticket_id", "window_id", "verdict")


PR = f"""{MATCHED},
a AS (SELECT fault, count(*) FILTER (verdict = 'tp') AS tp, count(*) FILTER (verdict IN ('fp', 'misdiagnosed')) AS fp FROM mt GROUP BY fault),
b AS (SELECT accepted AS fault, count(*) FILTER (window_id NOT IN (SELECT window_id FROM mt WHERE verdict = 'tp')) AS fn FROM win GROUP BY accepted),
pr AS (SELECT fault, coalesce(tp, 0) AS tp, coalesce(fp, 0) AS fp, coalesce(fn, 0) AS fn FROM a FULL JOIN b USING (fault)),
pq AS (SELECT *, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall FROM pr)"""


@query("precision_recall", f"{PR} SELECT * FROM pq")
def precision_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.precision_recall(matched(spark, sf_dir), windows(spark, sf_dir))


@query("micro_macro", f"""{PR} SELECT round(sum(tp) / nullif(sum(tp) + sum(fp), 0), 6) AS micro_precision, round(sum(tp) / nullif(sum(tp) + sum(fn), 0), 6) AS micro_recall, round(avg(precision), 5) AS macro_precision, round(avg(recall), 5) AS macro_recall FROM pq""")
def micro_macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.sum
    return precision_recall(spark, sf_dir).agg(F.round(F.try_divide(s("tp"), s("tp") + s("fp")), 6).alias("micro_precision"), F.round(F.try_divide(s("tp"), s("tp") + s("fn")), 6).alias("micro_recall"), F.round(F.avg("precision"), 5).alias("macro_precision"), F.round(F.avg("recall"), 5).alias("macro_recall"))


@query("lead_time", f"""{TELEMETRY_SQL}, {WINDOWS_SQL}
SELECT window_id, arg_min(seq, (sim_ts, seq)) AS first_seq, round((epoch_us(any_value(to_ts)) - epoch_us(min(sim_ts))) / 60000000.0, 4) AS lead_min, round((epoch_us(min(sim_ts)) - epoch_us(any_value(from_ts))) / 60000000.0, 4) AS latency_min
FROM win w JOIN tel t ON w.unit_id = t.unit_id AND sim_ts >= from_ts AND sim_ts < to_ts AND tag = 'error' GROUP BY window_id""")
def lead_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first alarm in each window: how long before its end, and how long after its start."""
    hit = intervals.points_in(telemetry(spark, sf_dir).where("tag = 'error'"), "sim_ts", windows(spark, sf_dir))
    first = F.unix_micros(F.min("sim_ts"))
    return hit.groupBy("window_id").agg(F.min_by("seq", F.struct("sim_ts", "seq")).alias("first_seq"), F.round((F.unix_micros(F.min("to_ts")) - first) / 60000000, 4).alias("lead_min"), F.round((first - F.unix_micros(F.min("from_ts"))) / 60000000, 4).alias("latency_min"))


@query("abstention", f"""{DECISIONS_SQL}, c AS (SELECT episode_id, bool_and(NOT (confidence >= 0.6 AND starts_with(choice, '1'))) AS fine FROM dec GROUP BY episode_id) SELECT count(*) AS cases, count(*) FILTER (fine) AS correct, round(avg(CASE WHEN fine THEN 1.0 ELSE 0 END), 6) AS accuracy FROM c""")
def abstention(spark: SparkSession, sf_dir: str) -> DataFrame:
    wrong = (F.col("confidence") >= 0.6) & F.col("choice").startswith("1")
    c = decisions(spark, sf_dir).groupBy("episode_id").agg(F.bool_and(~wrong).alias("fine"))
    return c.agg(F.count(F.lit(1)).alias("cases"), F.count_if("fine").alias("correct"), F.round(F.avg(F.when(F.col("fine"), 1.0).otherwise(0.0)), 6).alias("accuracy"))


@query("ticket_rates", f"""{MATCHED} SELECT unit_id, count(*) FILTER (verdict = 'fp') AS false_tickets, round(count(*) FILTER (verdict = 'fp') / 30.0, 6) AS per_day FROM mt GROUP BY unit_id""")
def ticket_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.count_if(F.col("verdict") == "fp")
    return matched(spark, sf_dir).groupBy("unit_id").agg(n.alias("false_tickets"), F.round(n / 30, 6).alias("per_day"))


@query("gate_outcome", f"""{DECISIONS_SQL} SELECT decision_id, CASE WHEN starts_with(choice, '4') THEN 'log' WHEN confidence >= 0.85 THEN 'ticket' WHEN confidence >= 0.6 THEN 'review' ELSE 'log' END AS outcome FROM dec""")
def gate_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decisions(spark, sf_dir).select("decision_id", x.gate(F.col("confidence"), F.col("choice").startswith("4")).alias("outcome"))


@query("threshold_sweep", f"""{DECISIONS_SQL},
g AS (SELECT t / 20.0 AS ticket, r / 20.0 AS review FROM range(10, 20) a(t) CROSS JOIN range(6, 20) b(r) WHERE r < t)
SELECT round(ticket, 2) AS ticket, round(review, 2) AS review, count(*) FILTER (confidence >= ticket) AS tickets, count(*) FILTER (confidence >= review AND confidence < ticket) AS reviews FROM dec CROSS JOIN g GROUP BY ALL""")
def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes of every pair of thresholds, from one histogram of the confidences rather than a pass a pair."""
    hist = decisions(spark, sf_dir).groupBy("confidence").agg(F.count(F.lit(1)).alias("n"))
    grid = spark.range(10, 20).select((F.col("id") / 20).alias("ticket")).crossJoin(spark.range(6, 20).select((F.col("id") / 20).alias("review"))).where("review < ticket")
    hit = hist.crossJoin(F.broadcast(grid))
    return hit.groupBy(F.round("ticket", 2).alias("ticket"), F.round("review", 2).alias("review")).agg(F.coalesce(F.sum(F.when(F.col("confidence") >= F.col("ticket"), F.col("n"))), F.lit(0)).alias("tickets"), F.coalesce(F.sum(F.when((F.col("confidence") >= F.col("review")) & (F.col("confidence") < F.col("ticket")), F.col("n"))), F.lit(0)).alias("reviews"))


@query("core_gate", f"""{MATCHED}, s AS (SELECT accepted, count(*) AS n, count(*) FILTER (window_id IN (SELECT window_id FROM mt WHERE verdict = 'tp')) AS hit FROM win GROUP BY accepted)
SELECT count(*) AS faults, count(*) FILTER (hit >= 1) AS passed, count(*) FILTER (hit >= 1) >= 4 AS ok FROM s""")
def core_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = matched(spark, sf_dir).where("verdict = 'tp'").select("window_id").distinct().withColumn("_hit", F.lit(1))
    s = windows(spark, sf_dir).join(hit, "window_id", "left").groupBy("accepted").agg(F.count("_hit").alias("hit"))
    return s.agg(F.count(F.lit(1)).alias("faults"), F.count_if(F.col("hit") >= 1).alias("passed"), (F.count_if(F.col("hit") >= 1) >= 4).alias("ok"))


@query("compare_pivot", f"""{DECISIONS_SQL}
SELECT metric, round(max(v) FILTER (backend = 'F'), 6) AS f, round(max(v) FILTER (backend = 'O'), 6) AS o, round(max(v) FILTER (backend = 'P'), 6) AS p FROM (
  SELECT backend, 'mean_confidence' AS metric, avg(confidence) AS v FROM dec GROUP BY backend UNION ALL SELECT backend, 'tickets' AS metric, count(*) FILTER (confidence >= 0.85) AS v FROM dec GROUP BY backend) GROUP BY metric""")
def compare_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = decisions(spark, sf_dir).groupBy("backend").agg(F.avg("confidence").alias("mean_confidence"), F.count_if(F.col("confidence") >= 0.85).cast("double").alias("tickets"))
    long = per.unpivot("backend", ["mean_confidence", "tickets"], "metric", "v")
    wide = long.groupBy("metric").pivot("backend", ["F", "O", "P"]).agg(F.max("v"))
    return wide.select("metric", *[F.round(c, 6).alias(c.lower()) for c in ("F", "O", "P")])


@query("confusion_counters", f"""{WINDOWS_SQL}, {TICKETS_SQL},
po AS (SELECT * FROM win WHERE accepted <> '5-LOW'),
h AS (SELECT t.*, window_id, from_ts, fault = accepted AS acc FROM tic t JOIN po w ON t.unit_id = w.unit_id AND opened >= from_ts AND opened < to_ts),
o AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY ticket_id ORDER BY acc DESC, from_ts, window_id) = 1),
v AS (SELECT *, CASE WHEN acc THEN CASE WHEN row_number() OVER (PARTITION BY window_id, acc ORDER BY opened, ticket_id) = 1 THEN 'tp' ELSE 'duplicate' END WHEN fault = '4-NOT SPECIFIED' THEN 'benign' ELSE 'misdiagnosed' END AS verdict FROM o),
r AS (SELECT ticket_id, unit_id, verdict, verdict = 'tp' AND EXISTS (SELECT 1 FROM v m WHERE m.window_id = v.window_id AND m.verdict = 'misdiagnosed' AND (m.opened, m.ticket_id) < (v.opened, v.ticket_id)) AS recovered FROM v
  UNION ALL SELECT ticket_id, unit_id, CASE WHEN EXISTS (SELECT 1 FROM win e WHERE accepted = '5-LOW' AND e.unit_id = t.unit_id AND opened >= from_ts AND opened < to_ts) THEN 'ignored' WHEN fault = '4-NOT SPECIFIED' THEN 'benign' ELSE 'fp' END, false
  FROM tic t WHERE ticket_id NOT IN (SELECT ticket_id FROM v))
SELECT unit_id, verdict, recovered, count(*) AS tickets FROM r GROUP BY ALL""")
def confusion_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of one fault are excluded spans here, another fault is benign."""
    w = windows(spark, sf_dir)
    judged = intervals.confusion(tickets(spark, sf_dir), w.where("accepted <> '5-LOW'"), w.where("accepted = '5-LOW'"), ["4-NOT SPECIFIED"])
    return judged.groupBy("unit_id", "verdict", "recovered").agg(F.count(F.lit(1)).alias("tickets"))


@query("backend_comparison", f"""{DECISIONS_SQL},
c AS (SELECT backend, choice, avg(confidence) AS confidence, avg(CASE WHEN confidence < 0.6 THEN 1.0 ELSE 0.0 END) AS log_share, count(*) FILTER (confidence >= 0.85) AS tickets FROM dec GROUP BY ALL),
l AS (UNPIVOT (SELECT backend, choice, confidence, CAST(log_share AS DOUBLE) AS log_share, CAST(tickets AS DOUBLE) AS tickets FROM c) ON confidence, log_share, tickets INTO NAME metric VALUE v),
m AS (SELECT metric, backend, count(*) AS cases, round(avg(v), 9) AS mean FROM l GROUP BY ALL)
SELECT metric, backend, cases, mean, CAST(rank() OVER (PARTITION BY metric ORDER BY CASE WHEN metric = 'log_share' THEN mean ELSE -mean END) AS INTEGER) AS place FROM m""")
def backend_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each choice is a case; a low share of logged decisions is better."""
    per = decisions(spark, sf_dir).groupBy("backend", F.col("choice").alias("case")).agg(F.avg("confidence").alias("confidence"), F.avg(F.when(F.col("confidence") < 0.6, 1.0).otherwise(0.0)).alias("log_share"), F.count_if(F.col("confidence") >= 0.85).cast("double").alias("tickets"))
    return intervals.comparison(per.unpivot(["backend", "case"], ["confidence", "log_share", "tickets"], "metric", "v"), ["log_share"])


COST = f"""{CALLS_SQL}, led AS (SELECT *, CAST((CAST(tokens_in AS DECIMAL(12,0)) * price_in + CAST(tokens_out AS DECIMAL(12,0)) * price_out) / 1000000 AS DOUBLE) AS cost FROM cal)"""


@query("cost_ledger", f"{COST} SELECT call_id, round(cost, 8) AS cost FROM led")
def cost_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return costs.ledger(calls(spark, sf_dir)).select("call_id", F.round(F.col("cost").cast("double"), 8).alias("cost"))


@query("cost_by_backend_argmax", f"""{COST}, m AS (SELECT backend, model, count(*) AS calls, sum(tokens_in) AS tin, sum(cost) AS cost FROM led GROUP BY ALL)
SELECT backend, CAST(sum(calls) AS BIGINT) AS calls, CAST(sum(tin) AS BIGINT) AS tokens_in, round(sum(cost), 8) AS cost, arg_min(model, (-calls, model)) AS top_model FROM m GROUP BY backend""")
def cost_by_backend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return costs.by_backend(costs.ledger(calls(spark, sf_dir)))


@query("cost_by_day", f"""{COST} SELECT strftime("at", '%Y-%m-%d') AS day, count(*) AS calls, round(sum(cost), 8) AS cost FROM led GROUP BY 1""")
def cost_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return costs.ledger(calls(spark, sf_dir)).groupBy(F.date_format("at", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("calls"), F.round(F.sum("cost").cast("double"), 8).alias("cost"))


@query("cost_latest_price", f"""{COST} SELECT backend, model, CAST(arg_max(price_in, ("at", call_id)) AS DOUBLE) AS price_in, CAST(arg_max(price_out, ("at", call_id)) AS DOUBLE) AS price_out, count(*) AS calls FROM led GROUP BY ALL""")
def cost_latest_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = lambda c: F.max_by(c, F.struct("at", "call_id")).cast("double").alias(c)
    return calls(spark, sf_dir).groupBy("backend", "model").agg(last("price_in"), last("price_out"), F.count(F.lit(1)).alias("calls"))


@query("cumulative_cost", f"""{COST}, d AS (SELECT backend, strftime("at", '%Y-%m-%d') AS day, sum(cost) AS cost FROM led GROUP BY ALL)
SELECT backend, day, round(sum(cost) OVER (PARTITION BY backend ORDER BY day ROWS UNBOUNDED PRECEDING), 8) AS running FROM d""")
def cumulative_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return costs.cumulative(costs.ledger(calls(spark, sf_dir)))


@query("cost_totals", f"{COST} SELECT count(*) AS calls, CAST(coalesce(sum(tokens_in), 0) AS BIGINT) AS tokens_in, CAST(coalesce(sum(tokens_out), 0) AS BIGINT) AS tokens_out, round(coalesce(sum(cost), 0), 4) AS cost FROM led")
def cost_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return costs.ledger(calls(spark, sf_dir)).agg(F.count(F.lit(1)).alias("calls"), total("tokens_in").alias("tokens_in"), total("tokens_out").alias("tokens_out"), F.round(total("cost").cast("double"), 4).alias("cost"))


@query("cost_per_decision", f"{COST} SELECT model, round(sum(cost) / nullif(count(DISTINCT backend), 0), 4) AS per_backend, round(sum(cost) / nullif(count(*) FILTER (tokens_in > 4000), 0), 6) AS per_long_call FROM led GROUP BY model")
def cost_per_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    cost = F.sum("cost").cast("double")
    return costs.ledger(calls(spark, sf_dir)).groupBy("model").agg(F.round(F.try_divide(cost, F.countDistinct("backend")), 4).alias("per_backend"), F.round(F.try_divide(cost, F.count_if(F.col("tokens_in") > 4000)), 6).alias("per_long_call"))


@query("keyset_page", f"""{DECISIONS_SQL} SELECT decision_id, epoch_us(sim_ts) AS t_us FROM dec WHERE (sim_ts, decision_id) < (TIMESTAMP '1998-06-01', 500) ORDER BY sim_ts DESC, decision_id DESC LIMIT 51""")
def keyset_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = tables.page(decisions(spark, sf_dir), "sim_ts", "decision_id", 50, ("1998-06-01", 500))
    return page.select("decision_id", F.unix_micros("sim_ts").alias("t_us"))


@query("latest_child", """c AS (SELECT c_custkey, c_name FROM customer), k AS (SELECT o_custkey, max(o_orderkey) AS o_orderkey FROM orders GROUP BY o_custkey)
SELECT c_custkey, c_name, k.o_orderkey AS latest, o_orderstatus AS status FROM c LEFT JOIN k ON c_custkey = o_custkey LEFT JOIN orders o ON o.o_orderkey = k.o_orderkey""")
def latest_child(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderkey").alias("latest"), F.max_by("o_orderstatus", "o_orderkey").alias("status"))
    return table(spark, sf_dir, "customer").select("c_custkey", "c_name").join(o, "c_custkey", "left")


@query("semi_in_subquery", "big AS (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING sum(l_quantity) > 150) SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM big)")
def semi_in_subquery(spark: SparkSession, sf_dir: str) -> DataFrame:
    big = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_quantity").alias("q")).where("q > 150")
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").join(big, "o_orderkey", "left_semi")


@query("anti_not_exists", "n AS (SELECT 1) SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def anti_not_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(o, "c_custkey", "left_anti")


@query("scalar_min_subquery", "n AS (SELECT 1) SELECT o_orderkey, (SELECT min(l_shipdate) FROM lineitem WHERE l_orderkey = o_orderkey) IS NOT NULL AS shipped, (SELECT min(l_linenumber) FROM lineitem WHERE l_orderkey = o_orderkey) AS first_line FROM orders")
def scalar_min_subquery(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min("l_shipdate").isNotNull().alias("shipped"), F.min("l_linenumber").alias("first_line"))
    return table(spark, sf_dir, "orders").select("o_orderkey").join(li, "o_orderkey", "left").withColumn("shipped", F.coalesce("shipped", F.lit(False)))


@query("link_table_join", "l AS (SELECT l_partkey, l_suppkey, min(l_linenumber) AS ordinal FROM lineitem GROUP BY ALL) SELECT p_brand, s_nationkey, count(*) AS links, min(ordinal) AS first_ordinal FROM part JOIN l ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey GROUP BY ALL")
def link_table_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    link = table(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.min("l_linenumber").alias("ordinal"))
    p, s = table(spark, sf_dir, "part").select("p_partkey", "p_brand"), table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    return link.join(p, F.col("l_partkey") == F.col("p_partkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey")).groupBy("p_brand", "s_nationkey").agg(F.count(F.lit(1)).alias("links"), F.min("ordinal").alias("first_ordinal"))


@query("injection_windows", """s AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'signup'), p AS (SELECT event_id - 1 AS event_id, ts AS stop_ts FROM events WHERE event_type = 'purchase')
SELECT s.event_id AS instance_id, epoch_us(ts) AS from_us, epoch_us(coalesce(stop_ts, ts + INTERVAL 1 HOUR)) AS to_us FROM s LEFT JOIN p USING (event_id)""")
def injection_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Starts with their stops, and a fallback end where none was recorded."""
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    s = e.where("event_type = 'signup'").select(F.col("event_id").alias("instance_id"), "ts")
    p = e.where("event_type = 'purchase'").select((F.col("event_id") - 1).alias("instance_id"), F.col("ts").alias("stop_ts"))
    return s.join(p, "instance_id", "left").select("instance_id", F.unix_micros("ts").alias("from_us"), F.coalesce(F.unix_micros("stop_ts"), F.unix_micros("ts") + 3600000000).alias("to_us"))


@query("composite_join", f"{DECISIONS_SQL}, n AS (SELECT o_custkey AS episode_id, o_orderpriority AS choice, max(o_totalprice) AS support FROM orders GROUP BY ALL) SELECT decision_id, support FROM dec JOIN n USING (episode_id, choice) WHERE confidence >= 0.6")
def composite_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("episode_id"), F.col("o_orderpriority").alias("choice")).agg(F.max("o_totalprice").alias("support"))
    return decisions(spark, sf_dir).where("confidence >= 0.6").join(n, ["episode_id", "choice"]).select("decision_id", "support")


@query("latest_decision", f"{DECISIONS_SQL} SELECT episode_id, arg_max(decision_id, (sim_ts, decision_id)) AS decision_id, arg_min(choice, (sim_ts, decision_id)) AS first_choice, arg_max(choice, (sim_ts, decision_id)) AS last_choice, max(confidence) AS most FROM dec GROUP BY episode_id")
def latest_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.struct("sim_ts", "decision_id")
    return decisions(spark, sf_dir).groupBy("episode_id").agg(F.max_by("decision_id", key).alias("decision_id"), F.min_by("choice", key).alias("first_choice"), F.max_by("choice", key).alias("last_choice"), F.max("confidence").alias("most"))


@query("upsert_last_wins", "u AS (SELECT o_orderkey AS k, 1 AS ver, o_totalprice AS v FROM orders UNION ALL SELECT o_orderkey, 2, o_totalprice + 1 FROM orders WHERE o_orderstatus = 'F') SELECT k, arg_max(v, ver) AS v, CAST(max(ver) AS INTEGER) AS ver FROM u GROUP BY k")
def upsert_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    old = o.select(F.col("o_orderkey").alias("k"), F.lit(1).alias("ver"), F.col("o_totalprice").alias("v"))
    new = o.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("k"), F.lit(2).alias("ver"), (F.col("o_totalprice") + 1).alias("v"))
    return tables.upsert(old, new, ["k"], ["ver"]).select("k", "v", "ver")


@query("insert_ignore", "n AS (SELECT 1) SELECT o_orderkey AS k, CASE WHEN o_orderstatus = 'F' THEN 'old' ELSE 'new' END AS s FROM orders")
def insert_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    old = o.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("k"), F.lit("old").alias("s"))
    return tables.insert_ignore(old, o.select(F.col("o_orderkey").alias("k"), F.lit("new").alias("s")), ["k"])


@query("retention_prune", f"{TELEMETRY_SQL} SELECT unit_id, seq FROM tel WHERE sim_ts >= (SELECT max(sim_ts) FROM tel) - INTERVAL 7 DAY")
def retention_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.retain(telemetry(spark, sf_dir), "sim_ts", 7).select("unit_id", "seq")


@query("json_paths", "n AS (SELECT 1) SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, json_extract(props, '$.missing') IS NULL AS absent FROM events")
def json_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), F.get_json_object("props", "$.missing").isNull().alias("absent"))


@query("page_cursor", f"""{DECISIONS_SQL} SELECT decision_id, translate(base64(encode(epoch_us(sim_ts) || '|' || decision_id)), '+/=', '-_') AS cursor FROM dec""")
def page_cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decisions(spark, sf_dir).select("decision_id", x.cursor(F.col("sim_ts"), F.col("decision_id")).alias("cursor"))


@query("preregistered_choice", f"""{DECISIONS_SQL}, g AS (SELECT backend, choice, decision_id % 5 AS fold, avg(confidence) AS a FROM dec GROUP BY ALL),
w AS (SELECT backend, choice, min(a) AS worst, quantile_cont(a, 0.5) AS med FROM g GROUP BY ALL) SELECT backend, choice, round(worst, 6) AS worst, round(med, 6) AS med FROM w ORDER BY worst DESC, med DESC, backend, choice LIMIT 1""")
def preregistered_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pair whose worst resample is best; ties by median, then by name."""
    g = decisions(spark, sf_dir).groupBy("backend", "choice", (F.col("decision_id") % 5).alias("fold")).agg(F.avg("confidence").alias("a"))
    w = g.groupBy("backend", "choice").agg(F.min("a").alias("worst"), F.percentile("a", 0.5).alias("med"))
    return w.orderBy(F.desc("worst"), F.desc("med"), "backend", "choice").limit(1).select("backend", "choice", F.round("worst", 6).alias("worst"), F.round("med", 6).alias("med"))


@query("ticket_fold", f"""{DECISIONS_SQL}, f AS (SELECT episode_id, max(CASE WHEN confidence >= 0.85 THEN 2 WHEN confidence >= 0.6 THEN 1 ELSE 0 END) AS lvl, count(*) AS n, count(*) FILTER (confidence >= 0.6) AS updates FROM dec GROUP BY episode_id)
SELECT episode_id, CASE lvl WHEN 2 THEN 'open' WHEN 1 THEN 'review' ELSE 'none' END AS status, n, updates FROM f""")
def ticket_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The highest state an episode's decisions promote its ticket to, and its live updates."""
    level = F.when(F.col("confidence") >= 0.85, 2).when(F.col("confidence") >= 0.6, 1).otherwise(0)
    f = decisions(spark, sf_dir).groupBy("episode_id").agg(F.max(level).alias("lvl"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("confidence") >= 0.6).alias("updates"))
    return f.select("episode_id", F.when(F.col("lvl") == 2, "open").when(F.col("lvl") == 1, "review").otherwise("none").alias("status"), "n", "updates")
