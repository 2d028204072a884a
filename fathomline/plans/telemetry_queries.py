"""Queries over telemetry: folds, states, cycles, frames, rules, sessions, series and overlays; with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import expressions as x
from ..functions.conditions import compile_condition
from ..operators import chunks, series
from ..operators import rules as rules_
from ..operators import telemetry as t
from ..sources import recordings
from ..sources.bridge import TELEMETRY_SQL, telemetry

HOURS6 = 6 * 3600
QUERIES: dict = {}
SQL: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = f"WITH {TELEMETRY_SQL}{sql}"
        return f

    return add


MODE = "CASE WHEN NOT intake_closed AND load_valve THEN 'loaded' WHEN motor_current >= 1.0 THEN 'unloaded' ELSE 'off' END"
MODED = f", m AS (SELECT *, {MODE} AS mode FROM tel)"
#: Runs of equal modes by unit.
RUNS = f"""{MODED},
s AS (SELECT *, epoch_us(sim_ts) / 1000000.0 AS sec, coalesce(epoch_us(sim_ts) / 1000000.0 - lag(epoch_us(sim_ts) / 1000000.0) OVER u, 10) AS dt,
        CASE WHEN mode IS DISTINCT FROM lag(mode) OVER u OR row_number() OVER u = 1 THEN 1 ELSE 0 END AS chg
      FROM m WINDOW u AS (PARTITION BY unit_id ORDER BY sim_ts, seq)),
r AS (SELECT *, sum(chg) OVER (PARTITION BY unit_id ORDER BY sim_ts, seq ROWS UNBOUNDED PRECEDING) AS run_id, dt > 3600 OR dt < 0 AS gap FROM s)"""


@query("minute_aggregate", """
SELECT unit_id, CAST(floor(epoch_us(sim_ts) / 1000000.0 / 60) * 60 AS BIGINT) AS minute, tag, count(v) AS n, min(v) AS min_v, max(v) AS max_v,
       round(avg(v), 6) AS avg_v, arg_max(v, (sim_ts, seq)) AS last_v, round(avg(CASE WHEN v <> 0 THEN 1.0 ELSE 0.0 END), 6) AS duty
FROM tel WHERE v IS NOT NULL AND isfinite(v) GROUP BY ALL""")
def minute_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.minute_aggregate(telemetry(spark, sf_dir))


@query("machine_state", f"{MODED} SELECT unit_id, seq, mode, CASE WHEN motor_current >= 4.6 THEN 'loaded' WHEN motor_current >= 1 THEN 'unloaded' ELSE 'off' END AS by_current FROM m")
def machine_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.with_state(telemetry(spark, sf_dir)).select("unit_id", "seq", "mode", x.current_state(F.col("motor_current")).alias("by_current"))


@query("state_runs", f"""{RUNS}
SELECT unit_id, CAST(run_id AS BIGINT) AS run_id, mode, count(*) AS n, epoch_us(min(sim_ts)) AS first_us, epoch_us(max(sim_ts)) AS last_us,
       arg_min(v, (sim_ts, seq)) AS first_v, arg_max(v, (sim_ts, seq)) AS last_v, min(v) AS min_v, max(v) AS max_v,
       round(quantile_cont(v, 0.5), 6) AS median_v, bool_or(gap) AS has_gap
FROM r GROUP BY unit_id, run_id, mode""")
def state_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.state_runs(telemetry(spark, sf_dir), 3600)


CYCLES = f"""{RUNS},
c AS (SELECT *, sum(CASE WHEN mode = 'loaded' AND chg = 1 THEN 1 ELSE 0 END) OVER u AS cycle, lead(sec) OVER u2 - sec AS ahead
      FROM r WINDOW u AS (PARTITION BY unit_id ORDER BY sim_ts, seq ROWS UNBOUNDED PRECEDING), u2 AS (PARTITION BY unit_id ORDER BY sim_ts, seq)),
d AS (SELECT *, sec - min(sec) OVER (PARTITION BY unit_id, cycle) AS t FROM c WHERE cycle > 0),
y AS (SELECT unit_id, CAST(cycle AS BIGINT) AS cycle, epoch_us(min(sim_ts)) AS start_us, count(*) AS n,
        round(coalesce(sum(ahead) FILTER (mode = 'loaded'), 0), 3) AS loaded_s, round(coalesce(sum(ahead) FILTER (mode = 'unloaded'), 0), 3) AS unloaded_s,
        round(coalesce(sum(ahead) FILTER (mode = 'off'), 0), 3) AS off_s, arg_max(v, (sim_ts, seq)) FILTER (mode = 'loaded') AS cutout_v,
        max(v) FILTER (mode = 'loaded') AS peak_v, round(quantile_cont(v, 0.5), 6) AS median_v,
        CASE WHEN count(*) >= 6 THEN round(regr_slope(v, t) * 60, 6) END AS slope, bool_or(gap AND t > 0) AS dirty
      FROM d GROUP BY unit_id, cycle),
z AS (SELECT * FROM (SELECT *, max(cycle) OVER (PARTITION BY unit_id) AS last FROM y) WHERE cycle < last)"""


@query("load_cycles", f"{CYCLES} SELECT * EXCLUDE (last) FROM z")
def load_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.load_cycles(telemetry(spark, sf_dir), 3600)


@query("cycle_behaviour", f"""{CYCLES}
SELECT unit_id, cycle, round(quantile_cont(loaded_s, 0.5) OVER (PARTITION BY unit_id ORDER BY cycle ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), 4) AS before,
       CASE WHEN count(*) OVER w < 5 THEN NULL WHEN loaded_s > 1.5 * quantile_cont(loaded_s, 0.5) OVER w THEN 'rising' WHEN loaded_s < 0.5 * quantile_cont(loaded_s, 0.5) OVER w THEN 'falling' ELSE 'flat' END AS trend
FROM z WINDOW w AS (PARTITION BY unit_id ORDER BY cycle ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)""")
def cycle_behaviour(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("unit_id").orderBy("cycle").rowsBetween(-5, -1)
    before = F.percentile("loaded_s", F.lit(0.5)).over(w)
    trend = F.when(F.count("loaded_s").over(w) < 5, None).when(F.col("loaded_s") > 1.5 * before, "rising").when(F.col("loaded_s") < 0.5 * before, "falling").otherwise("flat")
    return t.load_cycles(telemetry(spark, sf_dir), 3600).select("unit_id", "cycle", F.round(before, 4).alias("before"), trend.alias("trend"))


@query("rolling_median_capped", f"""{CYCLES},
p AS (SELECT quantile_cont(loaded_s, 0.5) AS p50 FROM z WHERE start_us < 1704672000000000),
w AS (SELECT unit_id, cycle, count(*) OVER f AS n, quantile_cont(loaded_s, 0.5) OVER f AS med FROM z WINDOW f AS (PARTITION BY unit_id ORDER BY start_us RANGE BETWEEN 172800000000 PRECEDING AND CURRENT ROW))
SELECT unit_id, cycle, CASE WHEN n >= 5 THEN round(least(med, 2 * p50), 4) END AS rolling, round(greatest(200.0, 1.5 * coalesce(CASE WHEN n >= 5 THEN least(med, 2 * p50) END, 0)), 6) AS threshold
FROM w CROSS JOIN p""")
def rolling_median_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two-day median of loaded times, capped at twice the first week's, and the threshold from it."""
    cycles = t.load_cycles(telemetry(spark, sf_dir), 3600)
    first = cycles.where(F.col("start_us") < 1704672000000000).agg(F.percentile("loaded_s", 0.5).alias("p50"))
    df = chunks.with_medians(cycles.select("unit_id", "cycle", "start_us", "loaded_s"), ("unit_id",), F.col("start_us"), {"med": ("loaded_s", 172800000000)})
    df = chunks.over_frames(df, ("unit_id",), F.col("start_us"), 172800000000, {"n": chunks.count(F.col("loaded_s"))}).crossJoin(F.broadcast(first))
    rolling = F.when(F.col("n") >= 5, F.least("med", 2 * F.col("p50")))
    return df.select("unit_id", "cycle", F.round(rolling, 4).alias("rolling"), F.round(F.greatest(F.lit(200.0), 1.5 * F.coalesce(rolling, F.lit(0.0))), 6).alias("threshold"))


@query("cycles_per_hour", f"""{CYCLES}
SELECT unit_id, cycle, round(CASE WHEN max(start_us) OVER f > min(start_us) OVER f THEN (count(*) OVER f - 1) * 3600000000.0 / (max(start_us) OVER f - min(start_us) OVER f) END, 6) AS rate
FROM z WINDOW f AS (PARTITION BY unit_id ORDER BY start_us RANGE BETWEEN 21600000000 PRECEDING AND CURRENT ROW)""")
def cycles_per_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.col("start_us")
    df = chunks.over_frames(t.load_cycles(telemetry(spark, sf_dir), 3600), ("unit_id",), start, HOURS6 * 1_000_000, {"_n": chunks.count(start), "_first": chunks.least(start), "_last": chunks.greatest(start)})
    span = F.col("_last") - F.col("_first")
    return df.select("unit_id", "cycle", F.round(F.when(span > 0, (F.col("_n") - 1) * 3600000000.0 / span), 6).alias("rate"))


@query("frozen_runs", """,
s AS (SELECT *, CASE WHEN tag IS DISTINCT FROM lag(tag) OVER u OR row_number() OVER u = 1 THEN 1 ELSE 0 END AS chg FROM tel WINDOW u AS (PARTITION BY unit_id ORDER BY sim_ts, seq)),
r AS (SELECT *, sum(chg) OVER (PARTITION BY unit_id ORDER BY sim_ts, seq ROWS UNBOUNDED PRECEDING) AS run FROM s)
SELECT unit_id, tag, epoch_us(min(sim_ts)) AS from_us, epoch_us(max(sim_ts)) AS to_us, count(*) AS n FROM r GROUP BY unit_id, run, tag HAVING count(*) >= 3""")
def frozen_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = t.with_runs(telemetry(spark, sf_dir), "tag")
    return runs.groupBy("unit_id", "run_id", "tag").agg(t.micros(F.min("sim_ts")).alias("from_us"), t.micros(F.max("sim_ts")).alias("to_us"), F.count(F.lit(1)).alias("n")).where("n >= 3").drop("run_id")


@query("gap_islands", """,
h AS (SELECT DISTINCT unit_id, CAST(floor(epoch_us(sim_ts) / 3600000000.0) AS BIGINT) AS hour FROM tel),
i AS (SELECT unit_id, hour, hour - row_number() OVER (PARTITION BY unit_id ORDER BY hour) AS g FROM h)
SELECT unit_id, min(hour) AS first_hour, max(hour) AS last_hour, count(*) AS hours FROM i GROUP BY unit_id, g""")
def gap_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    hours = telemetry(spark, sf_dir).select("unit_id", F.floor(F.unix_seconds("sim_ts") / 3600).alias("hour")).distinct()
    g = F.col("hour") - F.row_number().over(Window.partitionBy("unit_id").orderBy("hour"))
    return hours.withColumn("g", g).groupBy("unit_id", "g").agg(F.min("hour").alias("first_hour"), F.max("hour").alias("last_hour"), F.count(F.lit(1)).alias("hours")).drop("g")


@query("gap_table", """,
g AS (SELECT unit_id, lag(sim_ts) OVER (PARTITION BY unit_id ORDER BY sim_ts, seq) AS a, sim_ts AS b FROM tel)
SELECT unit_id, epoch_us(a) AS from_us, epoch_us(b) AS to_us FROM g WHERE epoch_us(b) - epoch_us(a) > 3600000000""")
def gap_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = telemetry(spark, sf_dir).select("unit_id", t.micros(F.lag("sim_ts").over(t.by_unit())).alias("from_us"), t.micros("sim_ts").alias("to_us"))
    return df.where(F.col("to_us") - F.col("from_us") > 3600000000)


@query("window_metrics", f"""{RUNS}
SELECT unit_id, round(sum(least(dt, 900)) / 3600, 4) AS covered_h, round(avg(CASE WHEN mode = 'loaded' THEN 1.0 ELSE 0 END), 6) AS loaded, round(avg(CASE WHEN mode = 'off' THEN 1.0 ELSE 0 END), 6) AS "off",
       round(quantile_cont(v, 0.95) FILTER (mode = 'loaded'), 6) AS loaded_p95, count(*) FILTER (mode = 'loaded' AND chg = 1) AS cut_ins
FROM r GROUP BY unit_id""")
def window_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = t.with_runs(t.with_steps(t.with_state(telemetry(spark, sf_dir)), 3600), "mode")
    share = lambda m: F.round(F.avg(F.when(F.col("mode") == m, 1.0).otherwise(0.0)), 6)
    loaded = F.col("mode") == "loaded"
    return df.groupBy("unit_id").agg(F.round(F.sum(F.least(F.col("dt"), F.lit(900.0))) / 3600, 4).alias("covered_h"), share("loaded").alias("loaded"), share("off").alias("off"), F.round(F.percentile(F.when(loaded, F.col("v")), 0.95), 6).alias("loaded_p95"), F.countDistinct(F.when(loaded, F.col("run_id"))).alias("cut_ins"))


@query("daily_table", f"""{RUNS}
SELECT unit_id, CAST(CAST(sim_ts AS DATE) AS VARCHAR) AS day, count(*) AS n, round(avg(v), 6) AS avg_v, round(stddev_samp(v), 6) AS std_v, count(*) FILTER (chg = 1) AS runs, count(*) FILTER (gap) AS gaps
FROM r GROUP BY unit_id, CAST(sim_ts AS DATE)""")
def daily_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = t.by_unit()
    df = t.with_steps(t.with_state(telemetry(spark, sf_dir)), 3600)
    df = df.withColumn("chg", ~F.col("mode").eqNullSafe(F.lag("mode").over(w)))
    return df.groupBy("unit_id", F.date_format("sim_ts", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("v"), 6).alias("avg_v"), F.round(F.stddev_samp("v"), 6).alias("std_v"), F.count_if("chg").alias("runs"), F.count_if("gap").alias("gaps"))


BANDS = """, b AS (SELECT tag, quantile_cont(v, 0.01) AS p1, quantile_cont(v, 0.05) AS p5, quantile_cont(v, 0.5) AS p50, quantile_cont(v, 0.95) AS p95, quantile_cont(v, 0.99) AS p99, avg(v) AS mean_v, stddev_samp(v) AS std_v
  FROM tel WHERE sim_ts < TIMESTAMP '2024-01-08' GROUP BY tag)"""


def bands(tel: DataFrame) -> DataFrame:
    p = F.percentile("v", F.array(*map(F.lit, (0.01, 0.05, 0.5, 0.95, 0.99))))
    df = tel.where(F.col("sim_ts") < F.lit("2024-01-08").cast("timestamp")).groupBy("tag").agg(p.alias("p"), F.avg("v").alias("mean_v"), F.stddev_samp("v").alias("std_v"))
    return df.select("tag", *[F.col("p")[i].alias(n) for i, n in enumerate(("p1", "p5", "p50", "p95", "p99"))], "mean_v", "std_v")


@query("quantile_bands", f"{BANDS} SELECT tag, round(p1, 6) AS p1, round(p5, 6) AS p5, round(p50, 6) AS p50, round(p95, 6) AS p95, round(p99, 6) AS p99, round(mean_v, 6) AS mean_v, round(std_v, 6) AS std_v FROM b")
def quantile_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = bands(telemetry(spark, sf_dir))
    return b.select("tag", *[F.round(c, 6).alias(c) for c in b.columns[1:]])


@query("level_bucket", f"""{BANDS}
SELECT unit_id, seq, CASE WHEN v < p1 - 0.4 THEN 'very_low' WHEN v < p5 - 0.4 THEN 'low' WHEN v > p99 + 0.4 THEN 'very_high' WHEN v > p95 + 0.4 THEN 'high' WHEN v IS NOT NULL THEN 'normal' END AS level FROM tel JOIN b USING (tag)""")
def level_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    tel = telemetry(spark, sf_dir)
    return tel.join(bands(tel), "tag").select("unit_id", "seq", x.level_bucket(F.col("v"), F.col("p1"), F.col("p5"), F.col("p95"), F.col("p99"), 0.4).alias("level"))


@query("digital_level", f"""{MODED}
SELECT tag, round(avg(CASE WHEN load_valve THEN 1.0 ELSE 0 END), 6) AS share, CASE WHEN avg(CASE WHEN load_valve THEN 1.0 ELSE 0 END) >= 0.2 THEN 'normal' WHEN avg(CASE WHEN load_valve THEN 1.0 ELSE 0 END) < 0.001 THEN 'rare' ELSE 'seldom' END AS level FROM m GROUP BY tag""")
def digital_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    share = F.avg(F.when(F.col("load_valve"), 1.0).otherwise(0.0))
    return telemetry(spark, sf_dir).groupBy("tag").agg(F.round(share, 6).alias("share"), F.when(share >= 0.2, "normal").when(share < 0.001, "rare").otherwise("seldom").alias("level"))


@query("trailing_features", """,
s AS (SELECT *, (epoch_us(sim_ts) - min(epoch_us(sim_ts)) OVER (PARTITION BY unit_id, tag)) / 1000000.0 AS t FROM tel)
SELECT unit_id, tag, seq, count(v) OVER f AS n, min(v) OVER f AS min_v, max(v) OVER f AS max_v, CASE WHEN count(v) OVER f >= 3 THEN round(quantile_cont(v, 0.5) OVER f, 6) END AS median_v,
       CASE WHEN count(v) OVER f >= 3 THEN round(stddev_samp(v) OVER f, 5) END AS spread, CASE WHEN count(v) OVER f >= 3 THEN round(regr_slope(v, t) OVER f * 60, 5) END AS slope
FROM s WINDOW f AS (PARTITION BY unit_id, tag ORDER BY epoch_us(sim_ts) RANGE BETWEEN 43200000000 PRECEDING AND CURRENT ROW)""")
def trailing_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.trailing(telemetry(spark, sf_dir), 12 * 3600)


@query("duration_ambient_buckets", """
SELECT unit_id, seq, CASE WHEN v * 1000 < 60 THEN 'momentary' WHEN v * 1000 < 1800 THEN 'minutes' WHEN v * 1000 < 7200 THEN 'under_2h' WHEN v * 1000 < 43200 THEN 'hours' WHEN v * 1000 < 129600 THEN 'day' ELSE 'days' END AS duration,
       CASE WHEN v < 10 THEN 'cold' WHEN v < 25 THEN 'mild' WHEN v < 32 THEN 'warm' ELSE 'hot' END AS ambient FROM tel WHERE v IS NOT NULL""")
def duration_ambient_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry(spark, sf_dir).where("v is not null").select("unit_id", "seq", x.duration_bucket(F.col("v") * 1000).alias("duration"), x.ambient_bucket(F.col("v")).alias("ambient"))


@query("seconds_since_change", """,
s AS (SELECT *, CASE WHEN tag IS DISTINCT FROM lag(tag) OVER u OR row_number() OVER u = 1 THEN 1 ELSE 0 END AS chg FROM tel WINDOW u AS (PARTITION BY unit_id ORDER BY sim_ts, seq)),
r AS (SELECT *, sum(chg) OVER (PARTITION BY unit_id ORDER BY sim_ts, seq ROWS UNBOUNDED PRECEDING) AS run FROM s)
SELECT unit_id, seq, tag, round((epoch_us(sim_ts) - min(epoch_us(sim_ts)) OVER (PARTITION BY unit_id, run)) / 1000000.0, 6) AS since_s,
       row_number() OVER (PARTITION BY unit_id, run ORDER BY sim_ts, seq) AS place, CAST(run - 1 AS BIGINT) AS changes FROM r""")
def seconds_since_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.since_change(telemetry(spark, sf_dir))


@query("derived_quantities", f"""{RUNS}
SELECT unit_id, seq, round(v - lag(v) OVER u, 6) AS delta, round(abs(v - lag(v) OVER u), 6) AS abs_delta, round(sum(CASE WHEN mode = 'loaded' THEN dt ELSE 0 END) OVER (PARTITION BY unit_id ORDER BY sim_ts, seq ROWS UNBOUNDED PRECEDING), 3) AS loaded_total,
       count(*) FILTER (chg = 1) OVER (PARTITION BY unit_id ORDER BY epoch_us(sim_ts) RANGE BETWEEN 21600000000 PRECEDING AND CURRENT ROW) AS events
FROM r WINDOW u AS (PARTITION BY unit_id ORDER BY sim_ts, seq)""")
def derived_quantities(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = t.by_unit()
    df = t.with_steps(t.with_state(telemetry(spark, sf_dir)), 3600)
    df = df.withColumn("chg", (~F.col("mode").eqNullSafe(F.lag("mode").over(w))).cast("int"))
    delta = F.col("v") - F.lag("v").over(w)
    total = F.sum(F.when(F.col("mode") == "loaded", F.col("dt")).otherwise(0.0)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    df = df.select("unit_id", "seq", "sim_ts", "chg", F.round(delta, 6).alias("delta"), F.round(F.abs(delta), 6).alias("abs_delta"), F.round(total, 3).alias("loaded_total"))
    df = chunks.over_frames(df, ("unit_id",), t.micros("sim_ts"), HOURS6 * 1_000_000, {"events": chunks.total(F.col("chg"))})
    return df.select("unit_id", "seq", "delta", "abs_delta", "loaded_total", "events")


FRAMES = f"""{RUNS},
f AS (SELECT unit_id, seq, sim_ts, mode, v, round(sec - min(sec) OVER (PARTITION BY unit_id, run_id), 3) AS run_s, count(v) OVER w AS n, round(quantile_cont(v, 0.5) OVER w, 6) AS median_v, min(v) OVER w AS min_v,
        sum(CASE WHEN tag = 'error' THEN 1 ELSE 0 END) OVER w AS errors
      FROM r WINDOW w AS (PARTITION BY unit_id ORDER BY epoch_us(sim_ts) RANGE BETWEEN 21600000000 PRECEDING AND CURRENT ROW)),
g AS (SELECT *, list_filter([CASE WHEN mode = 'loaded' AND run_s > 600 THEN 'stuck_loaded' END, CASE WHEN errors >= 6 THEN 'frequent_errors' END, CASE WHEN median_v > 60 THEN 'value_high' END,
        CASE WHEN mode = 'loaded' AND median_v < 30 THEN 'value_low' END, CASE WHEN n >= 3 AND min_v > 10 THEN 'floor_raised' END], lambda x: x IS NOT NULL) AS ids FROM f)"""


def rules() -> dict:
    """A registry of predicates over the frame; order decides ties."""
    c = F.col
    return {
        "stuck_loaded": (c("mode") == "loaded") & (c("run_s") > 600),
        "frequent_errors": c("errors") >= 6,
        "value_high": c("median_v") > 60,
        "value_low": (c("mode") == "loaded") & (c("median_v") < 30),
        "floor_raised": (c("n") >= 3) & (c("min_v") > 10),
    }


def fired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.fired(t.frames(telemetry(spark, sf_dir), HOURS6), rules())


@query("rule_raw_conditions", f"{FRAMES} SELECT unit_id, seq, array_to_string(ids, ',') AS rule_ids FROM g WHERE len(ids) > 0")
def rule_raw_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fired(spark, sf_dir).where(F.size("rule_ids") > 0).select("unit_id", "seq", F.array_join("rule_ids", ",").alias("rule_ids"))


@query("rule_hold_islands", f"""{FRAMES},
o AS (SELECT *, coalesce(median_v > 60, false) AS hit FROM g),
k AS (SELECT *, sum(CASE WHEN hit IS DISTINCT FROM p THEN 1 ELSE 0 END) OVER (PARTITION BY unit_id ORDER BY sim_ts, seq ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT *, lag(hit) OVER (PARTITION BY unit_id ORDER BY sim_ts, seq) AS p FROM o))
SELECT unit_id, epoch_us(min(sim_ts)) AS from_us, epoch_us(max(sim_ts)) AS to_us, count(*) AS n FROM k WHERE hit GROUP BY unit_id, run HAVING epoch_us(max(sim_ts)) - epoch_us(min(sim_ts)) >= 1800000000""")
def rule_hold_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.held(t.frames(telemetry(spark, sf_dir), HOURS6), rules()["value_high"], 1800).drop("run_id")


@query("suspect_new_keys", f"""{FRAMES},
n AS (SELECT unit_id, seq, list_sort(list_filter(ids, lambda x: NOT list_contains(coalesce(p, []), x))) AS fresh FROM (SELECT *, lag(ids) OVER (PARTITION BY unit_id ORDER BY sim_ts, seq) AS p FROM g))
SELECT unit_id, seq, array_to_string(fresh, ',') AS fresh FROM n WHERE len(fresh) > 0""")
def suspect_new_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = fired(spark, sf_dir)
    before = F.coalesce(F.lag("rule_ids").over(t.by_unit()), F.array().cast("array<string>"))
    df = df.withColumn("fresh", F.sort_array(F.array_except("rule_ids", before)))
    return df.where(F.size("fresh") > 0).select("unit_id", "seq", F.array_join("fresh", ",").alias("fresh"))


@query("alarm_transitions", f"""{FRAMES},
n AS (SELECT unit_id, seq, list_filter(ids, lambda x: NOT list_contains(coalesce(p, []), x)) AS up, list_filter(coalesce(p, []), lambda x: NOT list_contains(ids, x)) AS down FROM (SELECT *, lag(ids) OVER (PARTITION BY unit_id ORDER BY sim_ts, seq) AS p FROM g))
SELECT unit_id, seq, unnest(up) AS code, 'raise' AS kind FROM n UNION ALL SELECT unit_id, seq, unnest(down) AS code, 'clear' AS kind FROM n""")
def alarm_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = F.coalesce(F.lag("rule_ids").over(t.by_unit()), F.array().cast("array<string>"))
    df = fired(spark, sf_dir).withColumn("before", before)
    up = df.select("unit_id", "seq", F.explode(F.array_except("rule_ids", "before")).alias("code"), F.lit("raise").alias("kind"))
    return up.unionByName(df.select("unit_id", "seq", F.explode(F.array_except("before", "rule_ids")).alias("code"), F.lit("clear").alias("kind")))


EPISODES = f"""{FRAMES},
h AS (SELECT unit_id, seq, sim_ts, v, unnest(ids) AS symptom FROM g),
e AS (SELECT *, sum(CASE WHEN epoch_us(sim_ts) - epoch_us(p) > 7200000000 OR p IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY unit_id, symptom ORDER BY sim_ts, seq ROWS UNBOUNDED PRECEDING) AS episode
      FROM (SELECT *, lag(sim_ts) OVER (PARTITION BY unit_id, symptom ORDER BY sim_ts, seq) AS p FROM h))"""


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fired(spark, sf_dir).select("unit_id", "seq", "sim_ts", "v", F.explode("rule_ids").alias("symptom"))


@query("episode_sessions", f"""{EPISODES}
SELECT unit_id, symptom, CAST(episode AS BIGINT) AS episode, epoch_us(min(sim_ts)) AS opened_us, epoch_us(max(sim_ts)) AS last_us, count(*) AS firings, max(v) AS peak_v FROM e GROUP BY unit_id, symptom, episode""")
def episode_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.sessions(hits(spark, sf_dir), 7200)


@query("evidence_persistence", f"""{EPISODES}
SELECT unit_id, symptom, seq, round((epoch_us(sim_ts) - min(epoch_us(sim_ts)) OVER (PARTITION BY unit_id, symptom, episode)) / 60000000.0, 4) AS minutes FROM e""")
def evidence_persistence(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("unit_id", "symptom").orderBy(*t.ORDER)
    new = F.coalesce(t.seconds("sim_ts") - F.lag(t.seconds("sim_ts")).over(w) > 7200, F.lit(True))
    df = hits(spark, sf_dir).withColumn("_n", new.cast("int")).withColumn("_e", F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    start = F.min(t.micros("sim_ts")).over(Window.partitionBy("unit_id", "symptom", "_e"))
    return df.select("unit_id", "symptom", "seq", F.round((t.micros("sim_ts") - start) / 60000000, 4).alias("minutes"))


@query("quiet_hours", """,
c AS (SELECT hour(sim_ts) AS h, count(*) AS n FROM tel WHERE load_valve GROUP BY 1)
SELECT CAST(h AS BIGINT) AS hour, n, n < ((SELECT min(n) FROM c) + (SELECT quantile_cont(n, 0.5) FROM c)) / 2 AS quiet FROM c""")
def quiet_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = telemetry(spark, sf_dir).where("load_valve").groupBy(F.hour("sim_ts").cast("long").alias("hour")).agg(F.count(F.lit(1)).alias("n"))
    mid = c.agg(((F.min("n") + F.percentile("n", 0.5)) / 2).alias("mid"))
    return c.crossJoin(F.broadcast(mid)).select("hour", "n", (F.col("n") < F.col("mid")).alias("quiet"))


ENV = "CASE WHEN seq % 100 < 0 OR seq % 100 >= 90 THEN 0.0 WHEN seq % 100 < 20 THEN (seq % 100) / 20 WHEN seq % 100 < 60 THEN 1.0 ELSE (90 - seq % 100) / 30 END"


@query("overlay_envelope", f""", o AS (SELECT unit_id, seq, v, ['offset', 'scale', 'ramp', 'dropout', 'stuck'][CAST(seq % 5 AS INTEGER) + 1] AS op, {ENV} AS w FROM tel)
SELECT unit_id, seq, op, round(w, 6) AS weight, round(CASE WHEN w = 0 THEN v WHEN op = 'offset' THEN v + 1.5 * w WHEN op = 'scale' THEN v * (1 + 0.5 * w) WHEN op = 'ramp' THEN v + 1.5 * w * w WHEN op = 'dropout' THEN NULL ELSE v END, 5) AS v FROM o""")
def overlay_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    ops = F.array(*map(F.lit, ("offset", "scale", "ramp", "dropout", "stuck")))
    df = telemetry(spark, sf_dir).withColumn("op", F.element_at(ops, (F.col("seq") % 5).cast("int") + 1)).withColumn("w", x.envelope(F.col("seq") % 100, 20, 40, 30))
    return df.select("unit_id", "seq", "op", F.round("w", 6).alias("weight"), F.round(x.overlay(F.col("v"), F.col("op"), F.lit(1.5), F.col("w")), 5).alias("v"))


@query("quantise_int16", "SELECT unit_id, seq, least(greatest(round(v * 100), -32768), 32767) / 100 AS q FROM tel")
def quantise_int16(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry(spark, sf_dir).select("unit_id", "seq", x.quantise(F.col("v"), 100.0).alias("q"))


SQL["quantise_int16"] = f"WITH {TELEMETRY_SQL} SELECT unit_id, seq, least(greatest(round(v * 100), -32768), 32767) / 100 AS q FROM tel"


@query("ambient_seasonal", """ SELECT unit_id, seq, round(15 + 7 * sin(2 * pi() * (dayofyear(sim_ts) - 105) / 365) + 4 * sin(2 * pi() * (hour(sim_ts) - 9) / 24), 6) AS degrees FROM tel""")
def ambient_seasonal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry(spark, sf_dir).select("unit_id", "seq", F.round(x.ambient_seasonal(F.col("sim_ts")), 6).alias("degrees"))


@query("step_rounding", """ SELECT unit_id, seq, round(floor(round(v / 0.25, 9)) * 0.25, 9) AS down, round(ceil(round(v / 0.25, 9)) * 0.25, 9) AS up, round(floor(round(v / 0.25, 9) + 0.5) * 0.25, 9) AS half FROM tel""")
def step_rounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("v")
    return telemetry(spark, sf_dir).select("unit_id", "seq", x.step_round(v, 0.25, "floor").alias("down"), x.step_round(v, 0.25, "ceil").alias("up"), x.step_round(v, 0.25, "half").alias("half"))


@query("series_minmax", """,
b AS (SELECT tag, CAST(floor((epoch_us(sim_ts) - 1704067200000000) / 21600000000.0) AS BIGINT) AS bucket, sim_ts, seq, v FROM tel),
p AS (SELECT tag, bucket, arg_min(seq, (v, sim_ts, seq)) AS lo, arg_max(seq, (v, -epoch_us(sim_ts), -seq)) AS hi FROM b GROUP BY tag, bucket)
SELECT DISTINCT b.tag, b.bucket, b.seq, epoch_us(b.sim_ts) AS t_us, b.v FROM b JOIN p ON b.tag = p.tag AND b.bucket = p.bucket AND b.seq IN (p.lo, p.hi)""")
def series_minmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.minmax(telemetry(spark, sf_dir), 1704067200000000, HOURS6 * 1_000_000)


@query("series_edges", """,
e AS (SELECT unit_id, seq, sim_ts, load_valve, lag(load_valve) OVER (PARTITION BY unit_id ORDER BY sim_ts, seq) AS p FROM tel)
SELECT unit_id, seq, epoch_us(sim_ts) AS t_us, load_valve AS v FROM e WHERE p IS DISTINCT FROM load_valve""")
def series_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.edges(telemetry(spark, sf_dir), "load_valve")


@query("series_minutes", """,
m AS (SELECT unit_id, tag, CAST(floor(epoch_us(sim_ts) / 60000000.0) AS BIGINT) AS minute, avg(v) AS a, min(v) AS lo, max(v) AS hi FROM tel GROUP BY ALL),
r AS (SELECT *, CAST(ceil(row_number() OVER (PARTITION BY unit_id, tag ORDER BY minute) / 8.0) AS BIGINT) AS part FROM m)
SELECT unit_id, tag, part, min(minute) AS minute, round(avg(a), 6) AS avg_v, min(lo) AS min_v, max(hi) AS max_v FROM r GROUP BY unit_id, tag, part""")
def series_minutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.minutes(telemetry(spark, sf_dir), 8)


#: Picks follow one another by bucket; px: the points kept.
LTTB = """,
pa AS (SELECT unit_id, tag, seq, epoch_us(sim_ts) AS t, v, row_number() OVER (PARTITION BY unit_id, tag ORDER BY sim_ts, seq) - 1 AS i, count(*) OVER (PARTITION BY unit_id, tag) AS n FROM tel WHERE v IS NOT NULL),
pb AS (SELECT *, CASE WHEN i = 0 THEN -1 WHEN i = n - 1 THEN 98 ELSE (SELECT max(k) FROM range(98) x(k) WHERE k * (n - 2) // 98 <= i - 1) END AS b FROM pa WHERE n > 100),
pm AS (SELECT unit_id, tag, b, avg(t) AS mt, avg(v) AS mv FROM pb GROUP BY ALL),
pr AS (
  SELECT unit_id, tag, CAST(-1 AS BIGINT) AS b, CAST(seq AS BIGINT) AS seq, CAST(t AS BIGINT) AS t, v FROM pb WHERE i = 0
  UNION ALL
  SELECT unit_id, tag, b, ps, pt, pv FROM (
    SELECT r.unit_id, r.tag, CAST(r.b + 1 AS BIGINT) AS b, p.seq AS ps, p.t AS pt, p.v AS pv, p.i AS pi, abs((r.t - mt) * (p.v - r.v) - (r.t - p.t) * (mv - r.v)) AS a
    FROM pr r JOIN pb p ON p.unit_id = r.unit_id AND p.tag = r.tag AND p.b = r.b + 1 JOIN pm m ON m.unit_id = r.unit_id AND m.tag = r.tag AND m.b = r.b + 2)
  QUALIFY row_number() OVER (PARTITION BY unit_id, tag, b ORDER BY a DESC, pi) = 1),
px AS (SELECT unit_id, tag, seq, t, v FROM pr UNION ALL SELECT unit_id, tag, seq, t, v FROM pb WHERE i = n - 1 UNION ALL SELECT unit_id, tag, seq, t, v FROM pa WHERE n <= 100)"""


@query("series_lttb")
def series_lttb(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.lttb(telemetry(spark, sf_dir), 100)


@query("series_lttb_broken")
def series_lttb_broken(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The decimated series with breaks where points are over six hours apart."""
    return series.broken_at_gaps(series.lttb(telemetry(spark, sf_dir), 100), HOURS6 * 1_000_000)


SQL["series_lttb"] = f"WITH RECURSIVE {TELEMETRY_SQL}{LTTB} SELECT unit_id, tag, seq, t AS t_us, v FROM px"
SQL["series_lttb_broken"] = f"""WITH RECURSIVE {TELEMETRY_SQL}{LTTB},
pg AS (SELECT *, lag(t) OVER (PARTITION BY unit_id, tag ORDER BY t, seq) AS p FROM px)
SELECT unit_id, tag, seq, t AS t_us, v FROM px UNION ALL SELECT unit_id, tag, NULL, p + (t - p) // 2, NULL FROM pg WHERE t - p > {HOURS6 * 1_000_000}"""


@query("dedup_sequence", """ SELECT unit_id, seq, epoch_us(min(sim_ts)) AS t_us FROM tel GROUP BY unit_id, seq""")
def dedup_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    tel = telemetry(spark, sf_dir)
    return t.dedup_sequence(tel.unionByName(tel)).select("unit_id", "seq", t.micros("sim_ts").alias("t_us"))


@query("start_peak", f"""{RUNS},
q AS (SELECT unit_id, run_id, sec, v, min(sec) OVER (PARTITION BY unit_id, run_id) AS s0 FROM r WHERE mode = 'loaded'),
k AS (SELECT unit_id, run_id, max(v) AS peak FROM q WHERE sec <= s0 + 1800 GROUP BY unit_id, run_id)
SELECT unit_id, count(*) AS starts, round(quantile_cont(peak, 0.5), 6) AS p50, round(quantile_cont(peak, 0.95), 6) AS p95 FROM k GROUP BY unit_id""")
def start_peak(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = t.with_runs(t.with_state(telemetry(spark, sf_dir)), "mode").where("mode = 'loaded'")
    start = F.min(t.seconds("sim_ts")).over(Window.partitionBy("unit_id", "run_id"))
    peaks = runs.withColumn("_s", start).where(t.seconds("sim_ts") <= F.col("_s") + 1800).groupBy("unit_id", "run_id").agg(F.max("v").alias("peak"))
    return peaks.groupBy("unit_id").agg(F.count(F.lit(1)).alias("starts"), F.round(F.percentile("peak", 0.5), 6).alias("p50"), F.round(F.percentile("peak", 0.95), 6).alias("p95"))


TREE = {"all": [{"any": [{"signal": "v", "op": "gt", "value": "limit"}, {"signal": "motor_current", "minus": "v", "op": "lt", "value": -50.0}]}, {"state": "not_loaded"}]}


@query("condition_tree", f"{MODED} SELECT unit_id, seq, (v > 70 OR motor_current - v < -50) AND mode IN ('unloaded', 'off') AS fires FROM m")
def condition_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.with_state(telemetry(spark, sf_dir)).select("unit_id", "seq", compile_condition(TREE, {"limit": 70.0}).alias("fires"))


CODES = ["A01", "A02", "A03", "A04"]


@query("register_codec", """ SELECT unit_id, seq, CAST(least(greatest(round((v - 50) * 100), -32768), 32767) AS INTEGER) & 65535 AS word, least(greatest(round((v - 50) * 100), -32768), 32767) / 100 AS back,
       array_to_string(list_filter([CASE WHEN seq & 1 = 1 THEN 'A01' END, CASE WHEN (seq >> 1) & 1 = 1 THEN 'A02' END, CASE WHEN (seq >> 2) & 1 = 1 THEN 'A03' END, CASE WHEN (seq >> 3) & 1 = 1 THEN 'A04' END], lambda x: x IS NOT NULL), ',') AS codes FROM tel""")
def register_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = recordings.word(F.col("v") - 50, 100.0)
    return telemetry(spark, sf_dir).select("unit_id", "seq", w.alias("word"), recordings.from_word(w, 100.0).alias("back"), F.array_join(recordings.codes_of(F.col("seq"), CODES), ",").alias("codes"))


@query("sequence_drops", """, s AS (SELECT unit_id, seq, seq - lag(seq) OVER (PARTITION BY unit_id ORDER BY sim_ts, seq) AS step FROM tel)
SELECT unit_id, seq, CASE WHEN step > 1 THEN step - 1 ELSE 0 END AS lost, coalesce(step <= 0, false) AS restart FROM s""")
def sequence_drops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recordings.drops(telemetry(spark, sf_dir)).select("unit_id", "seq", "lost", "restart")


@query("carry_forward", """ SELECT unit_id, seq, last_value(CASE WHEN v > 20 THEN v END IGNORE NULLS) OVER (PARTITION BY unit_id ORDER BY sim_ts, seq ROWS UNBOUNDED PRECEDING) AS v FROM tel""")
def carry_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings of 20 or less stand in for missing cells."""
    df = telemetry(spark, sf_dir).withColumn("v", F.when(F.col("v") > 20, F.col("v")))
    return recordings.carried(df, ["v"], ["unit_id"], ["sim_ts", "seq"]).select("unit_id", "seq", "v")
