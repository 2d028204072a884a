"""Queries of scenario verdicts, the core gate and the design reading, with SQL."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import preregistered as pre
from ..operators import verdicts as v
from ..operators.decisions import NONE_OF_THESE
from ..sources.tables import table
from .signal_queries import _U, _bytes, _fold, _number

QUERIES: dict = {}
SQL: dict = {}


def query(name: str, sql: str):
    def add(f):
        QUERIES[name], SQL[name] = f, f"WITH {sql}"
        return f

    return add


DAY = 86_400_000_000
#: A customer is a scenario; its orders are windows (a year long), suspects, tickets and decisions by their key.
BASE = f"""
o AS (SELECT o_custkey AS scenario, o_orderkey AS k, epoch_us(CAST(o_orderdate AS TIMESTAMP)) AS t, o_orderpriority AS fault FROM orders),
sc AS (SELECT DISTINCT scenario, CASE scenario % 3 WHEN 0 THEN 'negative' WHEN 1 THEN 'positive' ELSE 'benign' END AS kind, scenario % 3 = 0 AS expect_none, scenario % 4 AS max_false,
         CASE scenario % 5 WHEN 0 THEN 'any' WHEN 1 THEN 'benign_or_none' ELSE 'listed' END AS fault, CASE WHEN scenario % 2 = 0 THEN 883612800000000 END AS deadline FROM o),
wi AS (SELECT scenario, k, t AS a, t + 365 * {DAY} AS b, CASE WHEN k % 15 = 0 THEN [fault, '5-LOW'] ELSE [fault] END AS accepted, CASE WHEN k % 2 = 0 THEN t + 100 * {DAY} END AS due FROM o WHERE k % 5 = 0),
su AS (SELECT scenario, t FROM o WHERE k % 5 = 4),
ti AS (SELECT scenario, k, t, CASE WHEN k % 5 = 1 THEN 'review' ELSE 'ticket' END AS level, fault, fault = '1-URGENT' AS benign FROM o WHERE k % 5 BETWEEN 1 AND 3)"""


def relations(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    k, fault = F.col("o_orderkey"), F.col("o_orderpriority")
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("scenario"), k, F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("t_us"), fault)
    s = F.col("scenario")
    kind = F.when(s % 3 == 0, "negative").when(s % 3 == 1, "positive").otherwise("benign")
    named = F.when(s % 5 == 0, "any").when(s % 5 == 1, "benign_or_none").otherwise("listed")
    scenarios = o.select("scenario").distinct().select("scenario", kind.alias("kind"), (s % 3 == 0).alias("expect_none"), (s % 4).alias("max_false"), named.alias("fault"), F.when(s % 2 == 0, 883612800000000).alias("deadline_us"))
    accepted = F.when(k % 15 == 0, F.array(fault, F.lit("5-LOW"))).otherwise(F.array(fault))
    windows = o.where(k % 5 == 0).select("scenario", k.alias("window_id"), F.col("t_us").alias("from_us"), (F.col("t_us") + 365 * DAY).alias("to_us"), accepted.alias("accepted"), F.when(k % 2 == 0, F.col("t_us") + 100 * DAY).alias("deadline_us"))
    tickets = o.where((k % 5).between(1, 3)).select("scenario", k.alias("ticket_id"), F.col("t_us").alias("opened_us"), F.when(k % 5 == 1, "review").otherwise("ticket").alias("level"), fault.alias("fault"), (fault == "1-URGENT").alias("benign"))
    return {"orders": o, "scenarios": scenarios, "windows": windows, "suspects": o.where(k % 5 == 4).select("scenario", "t_us"), "tickets": tickets}


VERDICTS = f"""{BASE},
tf AS (SELECT ti.*, EXISTS (SELECT 1 FROM wi WHERE wi.scenario = ti.scenario AND ti.t >= a AND ti.t < b) AS inside, EXISTS (SELECT 1 FROM wi WHERE wi.scenario = ti.scenario AND ti.t >= a AND ti.t < b AND list_contains(accepted, ti.fault)) AS hit FROM ti),
fi AS (SELECT scenario, arg_min(hit, (t, k)) AS hit, arg_min(benign, (t, k)) AS benign, min(t) AS t FROM tf WHERE inside AND level = 'ticket' GROUP BY scenario),
re AS (SELECT *, CASE WHEN expect_none THEN fp = 0 ELSE tp AND fp <= max_false END AS review FROM (
  SELECT sc.*, EXISTS (SELECT 1 FROM tf WHERE tf.scenario = sc.scenario AND hit AND (deadline IS NULL OR t <= deadline)) AS tp, (SELECT count(*) FROM tf WHERE tf.scenario = sc.scenario AND NOT hit AND NOT benign) AS fp FROM sc)),
ve AS (SELECT re.scenario, kind, CASE kind
    WHEN 'positive' THEN EXISTS (SELECT 1 FROM su JOIN wi ON su.scenario = wi.scenario AND su.t >= a AND su.t < b AND (due IS NULL OR su.t <= due) WHERE su.scenario = re.scenario)
    WHEN 'negative' THEN NOT EXISTS (SELECT 1 FROM su WHERE su.scenario = re.scenario AND NOT EXISTS (SELECT 1 FROM wi WHERE wi.scenario = su.scenario AND su.t >= a AND su.t < b)) ELSE review END AS detection,
  review AS review_diagnosis,
  review AND (expect_none OR coalesce((deadline IS NULL OR fi.t <= deadline) AND CASE re.fault WHEN 'any' THEN fi.t IS NOT NULL WHEN 'benign_or_none' THEN fi.benign ELSE fi.hit END, false)) AS diagnosis
  FROM re LEFT JOIN fi USING (scenario))"""


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = relations(spark, sf_dir)
    return v.scenario_verdicts(r["scenarios"], r["windows"], r["suspects"], r["tickets"])


@query("scenario_verdicts", f"{VERDICTS} SELECT * FROM ve")
def scenario_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts(spark, sf_dir)


@query(
    "core_gates",
    f"""{VERDICTS}, ex AS (SELECT c_custkey // 10 AS gate, c_custkey AS scenario, c_custkey % 10 < 6 AS positive FROM customer)
SELECT gate, count(*) FILTER (detection) AS passed, count(*) AS total, count(*) FILTER (detection AND positive) AS positives_passed, count(*) FILTER (kind IS NULL) AS missing,
       count(*) FILTER (detection) >= 8 AND count(*) FILTER (detection AND positive) >= 5 AS "pass" FROM ex LEFT JOIN ve USING (scenario) GROUP BY gate""",
)
def core_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten expected scenarios a gate, six of them positives."""
    c = F.col("c_custkey")
    expected = table(spark, sf_dir, "customer").select(F.floor(c / 10).alias("gate"), c.alias("scenario"), (c % 10 < 6).alias("positive"))
    return v.core_gate(verdicts(spark, sf_dir), expected, "detection")


DESIGN = f"""{BASE}, ta AS (SELECT DISTINCT scenario, CASE WHEN scenario % 2 = 0 THEN ['1-URGENT', '2-HIGH'] ELSE ['3-MEDIUM'] END AS accepted FROM o),
ep AS (SELECT scenario, a, b FROM wi WHERE k % 10 = 0),
tt AS (SELECT ti.*, list_contains(accepted, fault) AS hit, EXISTS (SELECT 1 FROM ep WHERE ep.scenario = ti.scenario AND t >= a AND t < b) AS inside FROM ti JOIN ta USING (scenario)),
lv AS (SELECT scenario, unnest(['review', 'ticket']) AS level FROM ta)"""


def targets(o: DataFrame) -> DataFrame:
    accepted = F.when(F.col("scenario") % 2 == 0, F.array(F.lit("1-URGENT"), F.lit("2-HIGH"))).otherwise(F.array(F.lit("3-MEDIUM")))
    return o.select("scenario").distinct().withColumn("accepted", accepted)


@query(
    "design_reading",
    f"""{DESIGN} SELECT lv.scenario, lv.level, count(*) FILTER (inside AND hit) AS on_target, count(*) FILTER (inside AND NOT hit AND NOT benign) AS off_target, count(*) FILTER (inside AND NOT hit AND benign) AS benign,
  count(*) FILTER (NOT inside) AS outside, arg_min(k, (t, k)) FILTER (inside) AS first_ticket, coalesce(arg_min(hit, (t, k)) FILTER (inside), false) AS met
FROM lv LEFT JOIN tt ON tt.scenario = lv.scenario AND (lv.level = 'review' OR tt.level = 'ticket') GROUP BY lv.scenario, lv.level""",
)
def design_reading(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = relations(spark, sf_dir)
    return v.design_reading(targets(r["orders"]), r["windows"].where("window_id % 10 = 0"), r["tickets"])


@query(
    "design_choices",
    f"""{DESIGN}, de AS (SELECT scenario, k, t, CASE WHEN k % 11 = 0 THEN '{NONE_OF_THESE}' ELSE fault END AS choice FROM o)
SELECT scenario, choice, count(*) AS n, bool_or(choice <> '{NONE_OF_THESE}' AND list_contains(accepted, choice)) AS on_target FROM de JOIN ta USING (scenario)
WHERE EXISTS (SELECT 1 FROM ep WHERE ep.scenario = de.scenario AND de.t >= a AND de.t < b) GROUP BY scenario, choice""",
)
def design_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = relations(spark, sf_dir)
    choice = F.when(F.col("o_orderkey") % 11 == 0, NONE_OF_THESE).otherwise(F.col("o_orderpriority"))
    decided = r["orders"].select("scenario", F.col("o_orderkey").alias("decision_id"), "t_us", choice.alias("choice"))
    return v.design_choices(targets(r["orders"]), r["windows"].where("window_id % 10 = 0"), decided)


#: The grid, the incumbent and the limits of the choice; a decision is right on urgent orders.
GRID = [(p, t, r) for p in (0, 1, 2) for t in (0.8, 0.85, 0.9) for r in (0.5, 0.6)]
INCUMBENT, SEED, RESAMPLES = (1, 0.85, 0.6), "choice-1", 20
LIMITS = (0.9, 2.0)
_draw = _U(_fold(f"list_concat({_bytes('sd')}, {_number('resample')}, {_number('day')}, {_number('resample')})"))
_steps = " ".join(f"WHEN u < {sum(1 / math.factorial(i) for i in range(k + 1)) * math.exp(-1)!r}::DOUBLE THEN {k}" for k in range(pre.MOST_COPIES))


@query(
    "preregistered_triple",
    f"""g(persist, ticket, review) AS (VALUES {", ".join(f"({p}, {t}::DOUBLE, {r}::DOUBLE)" for p, t, r in GRID)}),
de AS (SELECT date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS day, o_orderkey * 37 % 100 / 100 AS c, o_orderkey % 3 AS held, o_orderpriority = '1-URGENT' AS good FROM orders),
bd AS (SELECT persist, ticket, review, day, count(*) FILTER (good AND held >= persist AND c >= review) AS pos, count(*) FILTER (NOT good AND held >= persist AND c >= ticket) AS ft,
         count(*) FILTER (NOT good AND held >= persist AND c >= review AND c < ticket) AS fr FROM de CROSS JOIN g GROUP BY ALL),
dr AS (SELECT day, resample, {_draw} AS u FROM (SELECT DISTINCT day, 'choice-1' AS sd FROM de) CROSS JOIN (SELECT unnest(range({RESAMPLES})) AS resample)),
w AS (SELECT day, resample, CASE {_steps} ELSE {pre.MOST_COPIES} END AS w FROM dr),
ra AS (SELECT persist, ticket, review, resample, sum(w * pos) / sum(w) AS pos, sum(w * ft) / sum(w) AS ft, sum(w * fr) / sum(w) AS fr FROM bd JOIN w USING (day) GROUP BY ALL),
fi AS (SELECT persist, ticket, review, round(max(ft), 9) AS worst_tickets, round(max(fr), 9) AS worst_reviews, round(quantile_cont(pos, 0.5), 9) AS median_positives, round(quantile_cont(fr, 0.5), 9) AS mr, round(quantile_cont(ft, 0.5), 9) AS mt FROM ra GROUP BY ALL),
ju AS (SELECT *, worst_tickets <= {LIMITS[0]} AND worst_reviews <= {LIMITS[1]} AS qualifies, persist <> {INCUMBENT[0]} AS other, round(abs(ticket - {INCUMBENT[1]}) + abs(review - {INCUMBENT[2]}), 9) AS far FROM fi)
SELECT persist, ticket, review, worst_tickets, worst_reviews, median_positives, qualifies,
       CASE WHEN qualifies THEN CAST(row_number() OVER (PARTITION BY qualifies ORDER BY median_positives DESC, mr, mt, other, far, ticket DESC, review DESC, persist DESC) AS INTEGER) END AS rank FROM ju""",
)
def preregistered_triple(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All triples of the grid, judged on twenty resamples of days; the grid is a parameter of so many rows."""
    k = F.col("o_orderkey")
    grid = F.explode(F.array(*[F.struct(F.lit(p).alias("persist"), F.lit(t).alias("ticket"), F.lit(r).alias("review")) for p, t, r in GRID]))
    de = table(spark, sf_dir, "orders").select(F.date_diff(F.col("o_orderdate").cast("date"), F.lit("1970-01-01").cast("date")).alias("day"), (k * 37 % 100 / 100).alias("c"), (k % 3).alias("held"), (F.col("o_orderpriority") == "1-URGENT").alias("good"))
    held = de.select("*", grid.alias("g")).select("*", "g.*")
    kept = F.col("held") >= F.col("persist")
    by_day = held.groupBy(*pre.TRIPLE, "day").agg(
        F.count_if(F.col("good") & kept & (F.col("c") >= F.col("review"))).alias("positives"),
        F.count_if(~F.col("good") & kept & (F.col("c") >= F.col("ticket"))).alias("false_tickets"),
        F.count_if(~F.col("good") & kept & (F.col("c") >= F.col("review")) & (F.col("c") < F.col("ticket"))).alias("false_reviews"),
    )
    figures = ["positives", "false_tickets", "false_reviews"]
    sums = pre.resampled(by_day, figures, RESAMPLES, SEED)
    rates = sums.select(*pre.TRIPLE, "resample", *[(F.col(c) / F.col("days")).alias(c) for c in figures])
    return pre.triple_verdicts(rates, INCUMBENT, *LIMITS)
