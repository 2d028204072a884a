"""The feature frame, its emission and the sixteen rules over it; the SQL works all of it out on its own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import rules as r
from ..sources.bridge import telemetry

QUERIES: dict = {}
SQL: dict = {}


def query(name: str, sql: str):
    def add(f):
        QUERIES[name], SQL[name] = f, f"WITH {sql}"
        return f

    return add


#: Time runs sixty times as fast as the events', so that samples are seconds apart; a gap is over four minutes.
GAP_S = 240
_SEG = "PARTITION BY u, seg ORDER BY t, seq"
_RUN = f"({_SEG} ROWS UNBOUNDED PRECEDING)"
_f = lambda s: f"(PARTITION BY u, seg ORDER BY t RANGE BETWEEN {s}000000 PRECEDING AND CURRENT ROW)"
_roll = lambda c, name: f"CASE WHEN count({c}) OVER two >= 20 THEN least(quantile_cont({c}, 0.5) OVER two, {2 * r.FIRST_MONTH[name]}) END"
FRAME = f"""
b0 AS (SELECT user_id % 4 AS u, event_id AS seq, epoch_us(ts) // 60 AS t, event_type AS tag, value AS v FROM events),
b1 AS (SELECT *, t / 1000000.0 AS s, v / 10 AS mc, v / 10 + 0.05 AS tp2, v / 10 AS tp3, v / 11 AS h1, v / 100 AS dvp, v / 10 + CASE WHEN tag = 'error' THEN 0.5 ELSE 0.0 END AS res,
         seq % 2 AS tow, seq % 3 = 0 AS pul, CASE WHEN tag = 'purchase' THEN 'loaded' WHEN v / 10 >= 1.0 THEN 'unloaded' ELSE 'off' END AS mode FROM b0),
b2 AS (SELECT *, coalesce(s - lag(s) OVER (PARTITION BY u ORDER BY t, seq), 10) AS dt FROM b1),
b3 AS (SELECT *, CASE WHEN dt > {GAP_S} OR dt < 0 THEN 1 ELSE 0 END AS reset, mode = 'loaded' AS ld, mode = 'loaded' AND dvp > 0.5 AS pur FROM b2),
b4 AS (SELECT *, sum(reset) OVER (PARTITION BY u ORDER BY t, seq ROWS UNBOUNDED PRECEDING) AS seg FROM b3),
b5 AS (SELECT *, CASE WHEN mode IS DISTINCT FROM lag(mode) OVER w THEN 1 ELSE 0 END AS c1, CASE WHEN (v, tag, tow, pul) IS DISTINCT FROM (lag(v) OVER w, lag(tag) OVER w, lag(tow) OVER w, lag(pul) OVER w) THEN 1 ELSE 0 END AS c2,
         CASE WHEN pul IS DISTINCT FROM lag(pul) OVER w THEN 1 ELSE 0 END AS c3, CASE WHEN pur IS DISTINCT FROM lag(pur) OVER w THEN 1 ELSE 0 END AS c4,
         CASE WHEN ld AND NOT coalesce(lag(ld) OVER w, true) THEN 1 ELSE 0 END AS cut, row_number() OVER w AS samples FROM b4 WINDOW w AS ({_SEG})),
b6 AS (SELECT *, sum(c1) OVER {_RUN} AS r1, sum(c2) OVER {_RUN} AS r2, sum(c3) OVER {_RUN} AS r3, sum(c4) OVER {_RUN} AS r4, sum(cut) OVER {_RUN} AS cyc, s - min(s) OVER (PARTITION BY u, seg) AS tt FROM b5),
b7 AS (SELECT *, s - min(s) OVER (PARTITION BY u, seg, r1) AS run_s, row_number() OVER (PARTITION BY u, seg, r2 ORDER BY t, seq) AS frozen_n, s - min(s) OVER (PARTITION BY u, seg, r3) AS pulse_s,
         CASE WHEN pur THEN row_number() OVER (PARTITION BY u, seg, r4 ORDER BY t, seq) ELSE 0 END AS purge_n,
         CASE WHEN count(tp3) OVER {_f(300)} >= 3 THEN regr_slope(tp3, tt) OVER {_f(300)} * 60 END AS tp3_slope,
         CASE WHEN count(v) OVER {_f(7200)} >= 60 THEN regr_slope(v, tt) OVER {_f(7200)} * 3600 END AS oil_slope,
         CASE WHEN tt >= 1800 THEN min(v) OVER {_f(1800)} END AS oil_min, quantile_cont(mc, 0.5) OVER {_f(60)} AS cur, quantile_cont(tp2 - tp3, 0.5) OVER {_f(60)} AS tp_gap, quantile_cont(res - tp3, 0.5) OVER {_f(300)} AS res_gap,
         min(CASE WHEN NOT ld THEN s END) OVER (PARTITION BY u, seg, cyc) AS cut_out, min(CASE WHEN NOT ld AND h1 >= tp3 - {r.H1_MARGIN} THEN s END) OVER (PARTITION BY u, seg, cyc) AS back,
         ld AND tow = 0 AND s - min(s) OVER (PARTITION BY u, seg, cyc) <= {r.PULSE_WINDOW_S} AS low FROM b6),
b8 AS (SELECT *, sum(CASE WHEN c5 THEN 1 ELSE 0 END) OVER {_RUN} AS r5 FROM (SELECT *, low IS DISTINCT FROM lag(low) OVER ({_SEG}) AS c5 FROM b7)),
b9 AS (SELECT *, CASE WHEN low THEN sum(dt) OVER (PARTITION BY u, seg, cyc, r5) END AS low_s FROM b8),
cy AS (SELECT u, seg, cyc, min(t) AS start, sum(dt) AS period, min(back) - min(cut_out) AS h1_back, sum(dt) FILTER (ld) AS loaded_s, sum(dt) FILTER (mode = 'off') AS off_s,
         CASE WHEN count(*) FILTER (NOT ld) >= 6 THEN -60 * regr_slope(tp3, CASE WHEN NOT ld THEN tt END) END AS decay, coalesce(max(low_s) >= {r.PULSE_LEAST_S}, false) AS pulsed FROM b9 WHERE cyc > 0 GROUP BY u, seg, cyc),
c2 AS (SELECT *, count(decay) OVER l3 AS dn, min(decay) OVER l3 AS dmin, list(loaded_s) OVER l5 AS loads, count(*) OVER l3 AS pn, bool_or(pulsed) OVER l3 AS pany, quantile_cont(off_s, 0.5) OVER l5 AS off_median,
         max(start) OVER sp - min(start) OVER sp AS width, count(*) OVER sp AS spn, CASE WHEN period > 0 THEN 3600 / period END AS own_rate FROM cy
       WINDOW l3 AS (PARTITION BY u, seg ORDER BY cyc ROWS 2 PRECEDING), l5 AS (PARTITION BY u, seg ORDER BY cyc ROWS 4 PRECEDING), sp AS (PARTITION BY u, seg ORDER BY start RANGE BETWEEN 7200000000 PRECEDING AND CURRENT ROW)),
c3 AS (SELECT *, CASE WHEN width > 0 THEN (spn - 1) * 3600000000 / width END AS rate, {_roll("decay", "decay")} AS roll_decay, {_roll("loaded_s", "run")} AS roll_run, {_roll("own_rate", "rate")} AS roll_rate
       FROM c2 WINDOW two AS (PARTITION BY u, seg ORDER BY start RANGE BETWEEN 172800000000 PRECEDING AND CURRENT ROW)),
fr AS (SELECT b.*, c.* EXCLUDE (u, seg, cyc, start, period, decay, pulsed, own_rate, loaded_s, off_s, width, spn),
         CASE WHEN b.cyc > 0 AND b.s >= b.cut_out THEN least(b.s, b.back) - b.cut_out ELSE c.h1_back END AS h1_return_s,
         CASE WHEN samples < 30 THEN 'warm_up' WHEN frozen_n >= 60 THEN 'frozen' WHEN mode = 'off' AND tp3 < 2.0 THEN 'parked' END AS guard
       FROM b9 b LEFT JOIN c3 c ON c.u = b.u AND c.seg = b.seg AND c.cyc + 1 = b.cyc),
em AS (SELECT * FROM fr QUALIFY (floor(s / 60), mode) IS DISTINCT FROM (lag(floor(s / 60)) OVER (PARTITION BY u ORDER BY t, seq), lag(mode) OVER (PARTITION BY u ORDER BY t, seq)) OR reset = 1)"""
#: Each rule's hold time and predicate over fr.
PREDICATES = f"""stuck_loaded|0|ld AND run_s > 600 AND tp3_slope < 0.1
purge_pressure_high|0|purge_n >= 6
fast_decay|0|dn = 3 AND dmin > greatest({r.FLOORS["decay"]}, {r.FACTORS["decay"]} * coalesce(roll_decay, 0))
frequent_cycling|0|coalesce(rate > greatest({r.FLOORS["rate"]}, {r.FACTORS["rate"]} * coalesce(roll_rate, 0)), false) OR coalesce(off_median < {r.FLOORS["off"]}, false)
long_loaded_runs|0|len(list_filter(loads, lambda x: x > greatest({r.FLOORS["run"]}, {r.FACTORS["run"]} * coalesce(roll_run, 0)))) >= 3
low_pressure_switch|60|tag = 'error' AND mc >= 1.0
oil_temperature_high|1800|oil_min > 75
oil_temperature_rising|7200|oil_slope > 4 AND rate BETWEEN {r.NORMAL_RATE[0]} AND {r.NORMAL_RATE[1]}
motor_current_high|60|ld AND cur > 6.5
motor_current_low|60|ld AND run_s > 30 AND cur < 5.2
discharge_differential_low|60|ld AND tp_gap < 0.1
dryer_tower_not_switching|0|pn = 3 AND NOT pany
separator_not_venting|0|h1_return_s > {r.H1_RETURN_S}
reservoir_pressure_mismatch|300|abs(res_gap) > 0.3
low_oil_level|300|tag = 'signup' AND mc >= 1.0
flow_pulses_missing|600|ld AND pulse_s > 600"""
_RULES = [line.split("|") for line in PREDICATES.split("\n")]
RULED = f"""{FRAME},
st AS (SELECT *, guard IS NOT NULL OR (row_number() OVER w > 1 AND (v, mc) IS NOT DISTINCT FROM (lag(v) OVER w, lag(mc) OVER w)) AS gd FROM em WINDOW w AS ({_SEG})),
ep AS (SELECT *, sum(tu) OVER {_RUN} AS epoch FROM (SELECT *, CASE WHEN gd IS DISTINCT FROM lag(gd) OVER ({_SEG}) THEN 1 ELSE 0 END AS tu FROM st)),
lo AS ({" UNION ALL ".join(f"SELECT u, seg, epoch, t, seq, s, {k} AS k, '{name}' AS rule, {hold} AS hold, coalesce({p}, false) AND NOT gd AS raw FROM ep" for k, (name, hold, p) in enumerate(_RULES))}),
l1 AS (SELECT *, sum(ch) OVER (PARTITION BY u, seg, epoch, k ORDER BY t, seq ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT *, CASE WHEN raw IS DISTINCT FROM lag(raw) OVER (PARTITION BY u, seg, epoch, k ORDER BY t, seq) THEN 1 ELSE 0 END AS ch FROM lo)),
l2 AS (SELECT *, CASE WHEN s - min(s) OVER (PARTITION BY u, seg, epoch, k, run) >= hold THEN raw END AS said FROM l1),
l3 AS (SELECT *, coalesce(last_value(said IGNORE NULLS) OVER (PARTITION BY u, seg, epoch, k ORDER BY t, seq ROWS UNBOUNDED PRECEDING), false) AS fires FROM l2)"""


def wide_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide samples whose tags all follow from an event's value, type and number."""
    tel, v = telemetry(spark, sf_dir), F.col("v")
    tags = {"tp2": v / 10 + 0.05, "tp3": v / 10, "h1": v / 11, "dv_pressure": v / 100, "reservoirs": v / 10 + F.when(F.col("tag") == "error", 0.5).otherwise(0.0), "oil_temperature": v, "comp": F.col("intake_closed").cast("int"), "dv_eletric": F.col("load_valve").cast("int")}
    tags |= {"towers": (F.col("seq") % 2).cast("int"), "lps": (F.col("tag") == "error").cast("int"), "oil_level": (F.col("tag") != "signup").cast("int"), "caudal_impulses": (F.col("seq") % 3 == 0).cast("int")}
    return tel.select("unit_id", "seq", F.timestamp_micros(F.expr("unix_micros(sim_ts) div 60")).alias("sim_ts"), "motor_current", *[c.alias(n) for n, c in tags.items()])


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.emitted(r.feature_frame(wide_samples(spark, sf_dir), gap_s=GAP_S))


@query("emitted_frames", f"""{FRAME} SELECT u AS unit_id, seq, mode, CAST(seg AS BIGINT) AS segment, coalesce(guard, '') AS guard, round(run_s, 4) AS run_s, purge_n, round(pulse_s, 4) AS pulse_s, CAST(cyc AS BIGINT) AS cycle,
round(tp3_slope, 4) AS tp3_slope, round(oil_slope, 3) AS oil_slope, oil_min, round(cur, 6) AS current, round(res_gap, 6) AS res_gap, round(rate, 6) AS rate, round(off_median, 4) AS off_median, round(h1_return_s, 4) AS h1_return_s FROM em""")
def emitted_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The frames that are handed on: at a minute, a change of state or a reset."""
    f = frames(spark, sf_dir)
    rounded = {"run_s": 4, "pulse_s": 4, "tp3_slope": 4, "oil_slope": 3, "current": 6, "res_gap": 6, "rate": 6, "off_median": 4, "h1_return_s": 4}
    return f.select("unit_id", "seq", "mode", "segment", F.coalesce("guard", F.lit("")).alias("guard"), F.col("purge_n").cast("long").alias("purge_n"), "cycle", "oil_min", *[F.round(c, n).alias(c) for c, n in rounded.items()])


@query("feature_rules", f"{RULED} SELECT u AS unit_id, seq, string_agg(rule, ',' ORDER BY k) AS rule_ids FROM l3 WHERE fires GROUP BY u, seq")
def feature_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sixteen rules over emitted frames; guarded and stale frames clear their timers."""
    out = r.evaluate(frames(spark, sf_dir), r.registry(), stale=True)
    return out.where(F.size("rule_ids") > 0).select("unit_id", "seq", F.array_join("rule_ids", ",").alias("rule_ids"))


@query("rule_firing_counts", f"{RULED} SELECT rule AS rule_id, count(*) AS frames, count(DISTINCT u) AS units FROM l3 WHERE fires GROUP BY rule")
def rule_firing_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many frames and units each rule fires at."""
    out = r.evaluate(frames(spark, sf_dir), r.registry(), stale=True).select("unit_id", F.explode("rule_ids").alias("rule_id"))
    return out.groupBy("rule_id").agg(F.count(F.lit(1)).alias("frames"), F.countDistinct("unit_id").alias("units"))
