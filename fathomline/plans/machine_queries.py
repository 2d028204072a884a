"""Queries of alarm messages and of the day history, with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import alarms as al
from ..operators import day_history as dh
from ..operators import telemetry as t
from ..sources.bridge import TELEMETRY_SQL, telemetry
from ..sources.tables import table

QUERIES: dict = {}
SQL: dict = {}


def query(name: str, sql: str):
    def add(f):
        QUERIES[name], SQL[name] = f, f"WITH {sql}"
        return f

    return add


SETTINGS = {"value_high": 60.0}
MESSAGES = [
    {"code": "A01", "bit": 0, "signal": "v", "op": "gt", "threshold": "value_high", "hysteresis": 20, "delay_s": 600},
    {"code": "A02", "bit": 3, "signal": "v", "op": "lt", "threshold": 20, "hysteresis": 5, "guard": "running", "mask_s": 3600},
    {"code": "A03", "bit": 1, "signal": "motor_current", "op": "ge", "threshold": 9, "delay_s": 300, "reset": "manual"},
    {"code": "A04", "bit": 2, "signal": "motor_current", "op": "le", "threshold": 1, "hysteresis": 0.5, "guard": "not_loaded"},
]
ALARMS = f"""{TELEMETRY_SQL},
s0 AS (SELECT unit_id, seq, epoch_us(sim_ts) AS t, v, motor_current, CASE WHEN NOT intake_closed AND load_valve THEN 'loaded' WHEN motor_current >= 1.0 THEN 'unloaded' ELSE 'off' END AS mode,
         epoch_us(sim_ts) - lag(epoch_us(sim_ts)) OVER (PARTITION BY unit_id ORDER BY sim_ts, seq) AS dt FROM tel),
s1 AS (SELECT *, sum(CASE WHEN dt > 3600000000 OR dt < 0 THEN 1 ELSE 0 END) OVER (PARTITION BY unit_id ORDER BY t, seq ROWS UNBOUNDED PRECEDING) AS seg FROM s0),
s2 AS (SELECT *, CASE WHEN mode <> 'off' AND lag(mode) OVER (PARTITION BY unit_id, seg ORDER BY t, seq) = 'off' THEN t END AS st FROM s1),
s3 AS (SELECT *, last_value(st IGNORE NULLS) OVER (PARTITION BY unit_id, seg ORDER BY t, seq ROWS UNBOUNDED PRECEDING) AS start FROM s2),
c0 AS (
  SELECT unit_id, seg, seq, t, 'A01' AS code, coalesce(v > 60, false) AS pl, coalesce(v > 40, false) AS wi, 600000000 AS de, false AS ma FROM s3
  UNION ALL SELECT unit_id, seg, seq, t, 'A02', coalesce(v < 20, false) AND ok, coalesce(v < 25, false) AND ok, 0, false FROM (SELECT *, mode <> 'off' AND (start IS NULL OR t - start >= 3600000000) AS ok FROM s3)
  UNION ALL SELECT unit_id, seg, seq, t, 'A03', coalesce(motor_current >= 9, false), coalesce(motor_current >= 9, false), 300000000, true FROM s3
  UNION ALL SELECT unit_id, seg, seq, t, 'A04', coalesce(motor_current <= 1, false) AND mode <> 'loaded', coalesce(motor_current <= 1.5, false) AND mode <> 'loaded', 0, false FROM s3),
c1 AS (SELECT *, sum(CASE WHEN pl THEN 0 ELSE 1 END) OVER (PARTITION BY unit_id, seg, code ORDER BY t, seq ROWS UNBOUNDED PRECEDING) AS isl FROM c0),
c2 AS (SELECT *, CASE WHEN pl AND t - min(CASE WHEN pl THEN t END) OVER (PARTITION BY unit_id, seg, code, isl) >= de THEN 1 WHEN NOT wi THEN 0 END AS word FROM c1),
c3 AS (SELECT *, coalesce(last_value(word IGNORE NULLS) OVER (PARTITION BY unit_id, code ORDER BY t, seq ROWS UNBOUNDED PRECEDING), 0) AS ac FROM c2),
c4 AS (SELECT *, CASE WHEN ma THEN max(ac) OVER (PARTITION BY unit_id, seg, code ORDER BY t, seq ROWS UNBOUNDED PRECEDING) ELSE ac END = 1 AS lit FROM c3),
c5 AS (SELECT *, coalesce(lag(lit) OVER (PARTITION BY unit_id, code ORDER BY t, seq), false) AS was FROM c4)"""


def states(spark: SparkSession, sf_dir: str) -> DataFrame:
    tel = t.with_steps_in_parts(t.with_state(telemetry(spark, sf_dir)).drop("tag", "intake_closed", "load_valve"), 3600)
    wide = tel.select("unit_id", "chunk", "segment", "seq", F.unix_micros("sim_ts").alias("t_us"), "mode", "v", "motor_current")
    return al.alarm_states(wide, al.alarm_registry(spark, MESSAGES, SETTINGS), ["v", "motor_current"])


@query("alarm_changes", f'{ALARMS} SELECT unit_id, code, seq, t AS t_us, lit AS "on" FROM c5 WHERE lit <> was')
def alarm_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return al.alarm_changes(states(spark, sf_dir))


@query(
    "alarm_code_lists",
    f"""{ALARMS} SELECT unit_id, seq, coalesce(string_agg(code, ',' ORDER BY CASE code WHEN 'A01' THEN 0 WHEN 'A03' THEN 1 WHEN 'A04' THEN 2 ELSE 3 END) FILTER (lit), '') AS codes FROM c5 GROUP BY unit_id, seq""",
)
def alarm_code_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return al.alarm_codes(states(spark, sf_dir)).select("unit_id", "seq", F.array_join("codes", ",").alias("codes"))


#: An event closes a cycle of its user: unit_id, cutout_us, end_us, idle_s, decay, fast.
QUIET = (0, 1, 2, 3, 4, 5, 22, 23)
DAY = f"""
e0 AS (SELECT user_id AS unit_id, epoch_us(ts) AS e, CAST(value * 300 AS BIGINT) AS idle_s, value / 100 AS decay FROM events QUALIFY row_number() OVER (PARTITION BY user_id, ts ORDER BY event_id) = 1),
e1 AS (SELECT unit_id, e, decay, decay > 0.2 AS fast, (e - idle_s * 500000) // 3600000000 % 24 IN {QUIET} AS q, row_number() OVER (PARTITION BY unit_id ORDER BY e) AS i FROM e0 WHERE decay IS NOT NULL AND idle_s <= 21600),
e2 AS (SELECT *, fast AND lead(fast) OVER w AND lead(fast, 2) OVER w AS f3, lead(e, 2) OVER w AS e3 FROM e1 WINDOW w AS (PARTITION BY unit_id ORDER BY e)),
fr AS (SELECT n.unit_id, n.e AS now, j.e, j.decay, j.q, CASE WHEN j.f3 AND j.e3 <= n.e THEN j.e END AS first FROM e2 n JOIN e2 j ON j.unit_id = n.unit_id AND j.e <= n.e AND j.e > n.e - 86400000000),
si AS (SELECT *, min(first) OVER (PARTITION BY unit_id, now) AS onset FROM fr),
ra AS (SELECT *, row_number() OVER (PARTITION BY unit_id, now, q ORDER BY e DESC) AS k, count(*) OVER (PARTITION BY unit_id, now, q) AS n FROM si WHERE onset IS NULL OR e >= onset)
SELECT unit_id, now AS end_us, any_value(onset) AS onset_us, round(quantile_cont(decay, 0.5) FILTER (q AND n >= 3 AND k <= 5), 6) AS quiet, round(quantile_cont(decay, 0.5) FILTER (NOT q AND n >= 3 AND k <= 5), 6) AS busy FROM ra GROUP BY unit_id, now"""


@query("day_decay", DAY)
def day_decay(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("unit_id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("end_us")).agg(F.min_by("value", "event_id").alias("value"))
    idle = F.round(F.col("value") * 300).cast("long")
    cycles = e.select("unit_id", "end_us", (F.col("end_us") - idle * 1_000_000).alias("cutout_us"), idle.alias("idle_s"), (F.col("value") / 100).alias("decay"), (F.col("value") / 100 > 0.2).alias("fast"))
    out = dh.day_decay(cycles, F.array(*map(F.lit, QUIET)))
    return out.withColumns({"quiet": F.round("quiet", 6), "busy": F.round("busy", 6)})


@query(
    "cycle_quiet_hours",
    """h AS (SELECT event_type AS tag, hour(ts) AS h, count(*) AS n FROM events GROUP BY ALL),
f AS (SELECT tag, x.h, coalesce(n, 0) AS n FROM (SELECT DISTINCT tag FROM h) CROSS JOIN (SELECT unnest(range(24)) AS h) x LEFT JOIN h USING (tag, h)),
m AS (SELECT tag, min(n) AS lo, quantile_cont(n, 0.5) AS md FROM f GROUP BY tag)
SELECT tag, coalesce(string_agg(CAST(h AS VARCHAR), ',' ORDER BY h) FILTER (md > lo AND n < (lo + md) / 2), '') AS hours FROM f JOIN m USING (tag) GROUP BY tag""",
)
def cycle_quiet_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quiet hours of each kind of event by its counts an hour."""
    counts = F.array(*[F.count_if(F.hour("ts") == h) for h in range(24)])
    of = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("tag")).agg(counts.alias("counts"))
    return of.select("tag", F.array_join(dh.quiet_hours_of(F.col("counts")), ",").alias("hours"))
