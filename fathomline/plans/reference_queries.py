"""Queries of the reference operation and of recorded overlay messages, with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.overlay_records import counters, recorded
from ..operators.reference_operation import reference_operation as reference
from ..sources.bridge import TELEMETRY_SQL, telemetry
from ..sources.tables import table
from .telemetry_queries import CYCLES

QUERIES: dict = {}
SQL: dict = {}


def query(name: str, sql: str):
    def add(f):
        QUERIES[name], SQL[name] = f, sql
        return f

    return add


RATE = "(arg_max(v, (sim_ts, seq)) FILTER ({0}) - arg_min(v, (sim_ts, seq)) FILTER ({0})) / nullif(arg_max(t, (sim_ts, seq)) FILTER ({0}) - arg_min(t, (sim_ts, seq)) FILTER ({0}), 0) * 60"
FIGURES = {"cut_in_typical": ("cut_in", 0.5), "cut_out_typical": ("cut_out", 0.5), "loaded_typical": ("loaded_s", 0.5), "loaded_low": ("loaded_s", 0.05), "loaded_high": ("loaded_s", 0.95), "unloaded_typical": ("unloaded_s", 0.5), "off_typical": ("off_s", 0.5), "rise_typical": ("rise", 0.5), "decay_typical": ("decay", 0.5), "decay_low": ("decay", 0.05), "decay_high": ("decay", 0.95)}


@query(
    "reference_operation",
    f"""WITH {TELEMETRY_SQL}{CYCLES},
k AS (SELECT unit_id, cycle, min(sim_ts) AS start, arg_min(v, (sim_ts, seq)) AS cut_in, arg_max(v, (sim_ts, seq)) FILTER (mode = 'loaded') AS cut_out,
        sum(ahead) FILTER (mode = 'loaded') AS loaded_s, sum(ahead) FILTER (mode = 'unloaded') AS unloaded_s, sum(ahead) FILTER (mode = 'off') AS off_s,
        {RATE.format("mode = 'loaded'")} AS rise, {RATE.format("mode <> 'loaded'")} AS decay, NOT bool_or(gap AND t > 0) AS clean
      FROM d GROUP BY unit_id, cycle),
c2 AS (SELECT * FROM (SELECT *, max(cycle) OVER (PARTITION BY unit_id) AS last FROM k) WHERE cycle < last),
g AS (SELECT unit_id, date_trunc('week', start) AS period, count(*) AS n_cycles, count(*) FILTER (clean) AS n_clean, {", ".join(f"quantile_cont({c}, {p}) FILTER (clean) AS {name}" for name, (c, p) in FIGURES.items())} FROM c2 GROUP BY ALL),
h AS (SELECT unit_id, date_trunc('week', sim_ts) AS period, sum(least(dt, 3600)) / 3600 AS hours FROM r GROUP BY ALL),
e AS (SELECT unit_id, date_trunc('week', sim_ts) AS period, quantile_cont(motor_current - v, 0.5) AS discharge_minus_line FROM d WHERE mode = 'loaded' AND t >= 60 GROUP BY ALL)
SELECT unit_id, epoch_us(period) AS period_us, n_cycles, n_clean, round(n_cycles / hours, 6) AS cycles_per_hour, {", ".join(f"round({name}, 6) AS {name}" for name in FIGURES)}, round(discharge_minus_line, 6) AS discharge_minus_line
FROM g JOIN h USING (unit_id, period) JOIN e USING (unit_id, period) WHERE n_clean > 0 AND hours > 0 AND decay_typical IS NOT NULL AND discharge_minus_line IS NOT NULL""",
)
def reference_operation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reference(telemetry(spark, sf_dir), 3600, 60)


def overlay_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as messages: catalogs, injections of customers with starts and stops, active lists and markers."""
    key, status = F.col("o_orderkey"), F.col("o_orderstatus")
    word = F.get(F.array(*map(F.lit, ("jump", "reset", "loop", "start", "stop", "other"))), F.floor(key / 4).cast("int") % 6)
    kind = F.get(F.array(*map(F.lit, ("catalog", "injection", "injection_active", "marker"))), (key % 4).cast("int"))
    event = F.when((kind == "injection") & (status == "F"), "stop").when((kind == "injection") & (status == "O"), "start").otherwise(word)
    return table(spark, sf_dir, "orders").select(
        key.alias("message_id"), kind.alias("kind"), (F.col("o_custkey") % 4).alias("unit_id"), F.col("o_custkey").alias("instance_id"), event.alias("event"),
        F.when(status == "F", "expired").alias("reason"), F.when(status == "F", F.sha2((F.col("o_custkey") % 90).cast("string"), 256)).alias("source_sha256"), F.concat(F.lit("menu "), F.col("o_orderpriority")).alias("payload"),
    )


MESSAGES_SQL = """b AS (SELECT *, o_orderkey AS message_id, (['catalog', 'injection', 'injection_active', 'marker'])[o_orderkey % 4 + 1] AS kind, (['jump', 'reset', 'loop', 'start', 'stop', 'other'])[o_orderkey // 4 % 6 + 1] AS word FROM orders),
msg AS (SELECT message_id, kind, o_custkey % 4 AS unit_id, o_custkey AS instance_id, CASE WHEN kind = 'injection' AND o_orderstatus = 'F' THEN 'stop' WHEN kind = 'injection' AND o_orderstatus = 'O' THEN 'start' ELSE word END AS event,
  CASE WHEN kind = 'catalog' THEN CASE WHEN o_orderstatus = 'F' THEN sha256(CAST(o_custkey % 90 AS VARCHAR)) ELSE sha256('menu ' || o_orderpriority) END END AS digest FROM b),
rec AS (SELECT *, CASE WHEN kind = 'injection' AND event NOT IN ('start', 'stop') OR kind = 'marker' AND event NOT IN ('jump', 'reset', 'loop') THEN 'invalid' WHEN kind = 'injection_active' THEN 'kept' WHEN kind = 'marker' THEN 'stored' END AS settled FROM msg),
fate AS (SELECT *, coalesce(settled, CASE WHEN row_number() OVER (PARTITION BY kind, settled, digest, CASE WHEN kind = 'injection' THEN [CAST(unit_id AS VARCHAR), CAST(instance_id AS VARCHAR), event] END ORDER BY message_id) = 1 THEN 'stored' ELSE 'duplicate' END) AS fate FROM rec)"""


@query("overlay_record", f"WITH {MESSAGES_SQL} SELECT message_id, kind, digest, fate FROM fate")
def overlay_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recorded(overlay_messages(spark, sf_dir)).select("message_id", "kind", "digest", "fate")


@query("overlay_counters", f"WITH {MESSAGES_SQL} SELECT kind, count(*) FILTER (fate <> 'invalid') AS received, count(*) FILTER (fate = 'stored') AS stored, count(*) FILTER (fate = 'duplicate') AS duplicates, count(*) FILTER (fate = 'invalid') AS invalid FROM fate GROUP BY kind")
def overlay_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counters(recorded(overlay_messages(spark, sf_dir)))
