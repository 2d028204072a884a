"""The compressor's feature frame over wide 10-second samples, and its sixteen rules as predicates over it.

``feature_frame`` needs one row an instant: unit_id, seq, sim_ts and the tags of ``TAGS``. Cycle
figures come from closed cycles only and are met by an as-of window, not by a join a sample.
A null feature satisfies no rule.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import machine_state
from . import chunks

TAGS = "tp2 tp3 h1 dv_pressure reservoirs oil_temperature motor_current".split()
DIGITAL = "comp dv_eletric towers lps oil_level caudal_impulses".split()
#: Floors and factors of the adaptive thresholds.
FLOORS = {"decay": 0.25, "rate": 5.0, "run": 200.0, "off": 250.0}
FACTORS = {"decay": 2.0, "rate": 1.8, "run": 1.5}
#: The first month's medians, at twice which a rolling median is capped, and its band of the cycle rate.
FIRST_MONTH = {"decay": 0.069, "rate": 1.968, "run": 109.0}
NORMAL_RATE = (1.1979, 2.1646)
#: The separator is back at the line less a margin; a changeover is so long a low of the towers in the first part of a load.
H1_MARGIN, H1_RETURN_S = 0.3, 120
PULSE_WINDOW_S, PULSE_LEAST_S = 120, 20
#: Fixed value: rolling medians of cycles look back so long.
TWO_DAYS_US = 172_800_000_000


@dataclass(frozen=True)
class Rule:
    """A predicate over the frame with its hold time, symptom and severity; ``on`` is whether it runs by default.

    A rule that fires goes on until its predicate has been false for as long as it had to hold.
    """

    predicate: Column
    hold_s: int
    symptom: str
    severity: str
    on: bool = True


def _seconds() -> Column:
    return F.unix_micros("sim_ts") / 1_000_000


def feature_frame(wide: DataFrame, gap_s: float = 60.0, warm_up: int = 30, frozen: int = 60, parked_below: float = 2.0) -> DataFrame:
    """Features, guards and cycle figures at every sample; a gap or a step back starts a new segment."""
    unit = Window.partitionBy("unit_id").orderBy("sim_ts", "seq")
    df = wide.withColumn("dt", F.coalesce(_seconds() - F.lag(_seconds()).over(unit), F.lit(10.0)))
    df = df.withColumn("reset", ((F.col("dt") > gap_s) | (F.col("dt") < 0)).cast("int"))
    df = df.withColumn("segment", F.sum("reset").over(unit.rowsBetween(Window.unboundedPreceding, 0)))
    df = df.withColumn("mode", machine_state(F.col("comp") == 1, F.col("dv_eletric") == 1, F.col("motor_current")))
    seg = Window.partitionBy("unit_id", "segment").orderBy("sim_ts", "seq")

    def run_of(value: Column, name: str) -> None:
        nonlocal df
        changed = (~value.eqNullSafe(F.lag(value).over(seg))).cast("int")
        df = df.withColumn(name, changed).withColumn(name, F.sum(name).over(seg.rowsBetween(Window.unboundedPreceding, 0)))

    same = F.struct(*TAGS, *DIGITAL)
    run_of(F.col("mode"), "_mode_run")
    run_of(same, "_same_run")
    run_of(F.col("caudal_impulses"), "_pulse_run")
    run_of((F.col("mode") == "loaded") & (F.col("dv_pressure") > 0.5), "_purge_run")
    since = lambda run: _seconds() - F.min(_seconds()).over(Window.partitionBy("unit_id", "segment", run))
    place = lambda run: F.row_number().over(Window.partitionBy("unit_id", "segment", run).orderBy("sim_ts", "seq"))
    base = F.min(_seconds()).over(Window.partitionBy("unit_id", "segment"))
    df = df.withColumn("_t", _seconds() - base)
    loaded = F.col("mode") == "loaded"
    df = df.withColumns(
        {
            "_tp_gap": F.col("tp2") - F.col("tp3"),
            "_res_gap": F.col("reservoirs") - F.col("tp3"),
            "run_s": since("_mode_run"),
            "frozen_n": place("_same_run"),
            "pulse_s": since("_pulse_run"),
            "purge_n": F.when(loaded & (F.col("dv_pressure") > 0.5), place("_purge_run")).otherwise(0),
            "samples": F.row_number().over(seg),
        }
    )
    # cycles: cut-in to cut-in within a segment, closed ones only
    cut_in = loaded & ~F.coalesce(F.lag(loaded).over(seg), F.lit(True))
    df = df.withColumn("_cut", cut_in.cast("int")).withColumn("cycle", F.sum("_cut").over(seg.rowsBetween(Window.unboundedPreceding, 0)))
    of_cycle = Window.partitionBy("unit_id", "segment", "cycle")
    back = ~loaded & (F.col("h1") >= F.col("tp3") - H1_MARGIN)
    df = df.withColumns(
        {
            "_cut_out": F.min(F.when(~loaded, _seconds())).over(of_cycle),
            "_back": F.min(F.when(back, _seconds())).over(of_cycle),
            "_low": loaded & (F.col("towers") == 0) & (_seconds() - F.min(_seconds()).over(of_cycle) <= PULSE_WINDOW_S),
        }
    )
    run_of(F.col("_low"), "_low_run")
    df = df.withColumn("_low_s", F.when(F.col("_low"), F.sum("dt").over(Window.partitionBy("unit_id", "segment", "cycle", "_low_run"))))
    cyc = df.where("cycle > 0").groupBy("unit_id", "segment", "cycle").agg(
        F.min("sim_ts").alias("start"),
        F.sum("dt").alias("period"),
        (F.min("_back") - F.min("_cut_out")).alias("h1_back"),
        F.sum(F.when(loaded, F.col("dt"))).alias("loaded_s"),
        F.sum(F.when(F.col("mode") == "off", F.col("dt"))).alias("off_s"),
        F.when(F.count(F.when(~loaded, 1)) >= 6, -60 * F.regr_slope("tp3", F.when(~loaded, F.col("_t")))).alias("decay"),
        F.coalesce(F.max("_low_s") >= PULSE_LEAST_S, F.lit(False)).alias("pulsed"),
    )
    order = Window.partitionBy("unit_id", "segment").orderBy("cycle")
    last = lambda c, n: F.collect_list(c).over(order.rowsBetween(1 - n, 0))
    cyc = cyc.withColumn("_own_rate", F.when(F.col("period") > 0, 3600 / F.col("period")))
    cyc = cyc.withColumns({"decays": last("decay", 3), "loads": last("loaded_s", 5), "pulses": last("pulsed", 3), "off_median": F.percentile("off_s", F.lit(0.5)).over(order.rowsBetween(-4, 0))})
    # a new segment starts with nothing to look back on
    segment, start = ("unit_id", "segment"), F.unix_micros("start")
    cyc = chunks.over_frames(cyc, segment, start, 7_200_000_000, {"_n": chunks.count(F.col("start")), "_first": chunks.least(start), "_last": chunks.greatest(start)})
    width = F.col("_last") - F.col("_first")
    cyc = cyc.withColumn("rate", F.when(width > 0, (F.col("_n") - 1) * 3_600_000_000 / width))
    rolled = {"decay": "decay", "run": "loaded_s", "rate": "_own_rate"}
    cyc = chunks.with_medians(cyc, segment, start, {f"_med_{name}": (c, TWO_DAYS_US) for name, c in rolled.items()})
    cyc = chunks.over_frames(cyc, segment, start, TWO_DAYS_US, {f"_n_{name}": chunks.count(F.col(c)) for name, c in rolled.items()})
    cyc = cyc.withColumns({f"roll_{name}": F.when(F.col(f"_n_{name}") >= 20, F.least(f"_med_{name}", F.lit(2 * FIRST_MONTH[name]))) for name in rolled})
    # a cycle's figures hold from the next cut-in on, when it is closed
    figures = cyc.select("unit_id", "segment", (F.col("cycle") + 1).alias("cycle"), "decays", "loads", "pulses", "off_median", "rate", "roll_decay", "roll_run", "roll_rate", "h1_back")
    df = df.join(figures, ["unit_id", "segment", "cycle"], "left")
    # trailing figures, worked out once the cycles have met their samples, so that they are not made for both sides of that join
    at, x = F.unix_micros("sim_ts"), F.col("_t")
    df = chunks.with_medians(df, segment, at, {"current": ("motor_current", 60_000_000), "tp_gap": ("_tp_gap", 60_000_000), "res_gap": ("_res_gap", 300_000_000)})
    df = chunks.over_frames(df, segment, at, 300_000_000, {"_n": chunks.count(F.col("tp3")), "_slope": chunks.slope(F.col("tp3"), x)})
    df = df.withColumn("tp3_slope", F.when(F.col("_n") >= 3, F.col("_slope")) * 60).drop("_n", "_slope")
    df = chunks.over_frames(df, segment, at, 1_800_000_000, {"_least": chunks.least(F.col("oil_temperature"))})
    df = df.withColumn("oil_min", F.when(x >= 1800, F.col("_least"))).drop("_least")
    df = chunks.over_frames(df, segment, at, 7_200_000_000, {"_n": chunks.count(F.col("oil_temperature")), "_slope": chunks.slope(F.col("oil_temperature"), x)})
    df = df.withColumn("oil_slope", F.when(F.col("_n") >= 60, F.col("_slope")) * 3600).drop("_n", "_slope")
    # since the cut-out until the separator is back, growing while it isn't; while loaded, what the last closed cycle took
    open_ = (F.col("cycle") > 0) & (_seconds() >= F.col("_cut_out"))
    df = df.withColumn("h1_return_s", F.when(open_, F.least(_seconds(), F.col("_back")) - F.col("_cut_out")).otherwise(F.col("h1_back")))
    guard = F.when(F.col("samples") < warm_up, "warm_up").when(F.col("frozen_n") >= frozen, "frozen").when((F.col("mode") == "off") & (F.col("tp3") < parked_below), "parked")
    return df.withColumn("guard", guard).drop("_mode_run", "_same_run", "_pulse_run", "_purge_run", "_tp_gap", "_res_gap", "_cut", "_t", "_cut_out", "_back", "_low", "_low_run", "_low_s", "h1_back")


def adaptive(name: str, rolling: str | None = None) -> Column:
    """The greater of the floor and the factor times the rolling median, where there is one."""
    floor = F.lit(FLOORS[name])
    return F.greatest(floor, FACTORS[name] * F.coalesce(F.col(rolling), F.lit(0.0))) if rolling else floor


def registry() -> dict[str, Rule]:
    """The rules in registry order, which decides ties."""
    c = F.col
    loaded, running = c("mode") == "loaded", c("motor_current") >= 1.0
    return {
        "stuck_loaded": Rule(loaded & (c("run_s") > 600) & (c("tp3_slope") < 0.1), 0, "continuous_load", "high"),
        "purge_pressure_high": Rule(c("purge_n") >= 6, 0, "purge_pressure_high", "high"),
        "fast_decay": Rule((F.size("decays") == 3) & F.forall("decays", lambda d: d > adaptive("decay", "roll_decay")), 0, "low_line_pressure", "medium"),
        "frequent_cycling": Rule((c("rate") > adaptive("rate", "roll_rate")) | (c("off_median") < FLOORS["off"]), 0, "frequent_cycling", "medium"),
        "long_loaded_runs": Rule(F.size(F.filter("loads", lambda s: s > adaptive("run", "roll_run"))) >= 3, 0, "frequent_cycling", "medium"),
        "low_pressure_switch": Rule((c("lps") == 1) & running, 60, "low_line_pressure", "critical"),
        "oil_temperature_high": Rule(c("oil_min") > 75, 1800, "oil_temperature_high", "medium"),
        "oil_temperature_rising": Rule((c("oil_slope") > 4) & c("rate").between(*NORMAL_RATE), 7200, "oil_temperature_high", "low"),
        "motor_current_high": Rule(loaded & (c("current") > 6.5), 60, "motor_current_high", "medium"),
        "motor_current_low": Rule(loaded & (c("run_s") > 30) & (c("current") < 5.2), 60, "motor_current_low", "medium"),
        "discharge_differential_low": Rule(loaded & (c("tp_gap") < 0.1), 60, "motor_current_low", "medium"),
        "dryer_tower_not_switching": Rule((F.size("pulses") == 3) & F.forall("pulses", lambda p: ~p), 0, "dryer_changeover_fault", "low"),
        "separator_not_venting": Rule(c("h1_return_s") > H1_RETURN_S, 0, "separator_pressure_abnormal", "medium"),
        "reservoir_pressure_mismatch": Rule(F.abs("res_gap") > 0.3, 300, "reservoir_deviation", "low"),
        "low_oil_level": Rule((c("oil_level") == 0) & running, 300, "oil_level_low", "medium"),
        "flow_pulses_missing": Rule(loaded & (c("pulse_s") > 600), 600, "no_flow_signal", "low", on=False),
    }


#: A frame that repeats these of the one before is stale.
FROZEN = ("tp2", "tp3", "h1", "oil_temperature", "motor_current")


def emitted(frame: DataFrame) -> DataFrame:
    """The samples at which a frame is handed on: the first of a minute, of a machine state or of a segment."""
    unit = Window.partitionBy("unit_id").orderBy("sim_ts", "seq")
    minute = F.floor(_seconds() / 60)
    changed = ~minute.eqNullSafe(F.lag(minute).over(unit)) | ~F.col("mode").eqNullSafe(F.lag("mode").over(unit)) | (F.col("reset") == 1)
    return frame.withColumn("_emit", changed).where("_emit").drop("_emit")


def evaluate(frame: DataFrame, rules: dict[str, Rule] | None = None, stale: bool = False) -> DataFrame:
    """The frame with ``rule_ids``, the rules that fire at each sample in registry order.

    A rule fires once its predicate has held for its hold time, and until it has been false for as
    long; a gap or a guarded sample clears every timer, and with ``stale`` a frame that repeats the one before does. A null
    predicate is false.
    """
    rules = rules or {k: r for k, r in registry().items() if r.on}
    seg = Window.partitionBy("unit_id", "segment").orderBy("sim_ts", "seq")
    repeats = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.lag(c).over(seg)) for c in FROZEN]) & (F.row_number().over(seg) > 1)
    frame = frame.withColumn("_guarded", F.col("guard").isNotNull() | (repeats if stale else F.lit(False)))
    guarded = F.col("_guarded")
    turned = (~guarded.eqNullSafe(F.lag(guarded).over(seg))).cast("int")
    frame = frame.withColumn("_turned", turned).withColumn("_epoch", F.sum("_turned").over(seg.rowsBetween(Window.unboundedPreceding, 0)))
    epoch = Window.partitionBy("unit_id", "segment", "_epoch").orderBy("sim_ts", "seq")
    for name, rule in rules.items():
        on = F.col(f"_on_{name}")
        frame = frame.withColumn(f"_on_{name}", F.coalesce(rule.predicate, F.lit(False)) & ~guarded)
        if rule.hold_s:
            changed = (~on.eqNullSafe(F.lag(on).over(epoch))).cast("int")
            frame = frame.withColumn("_run", changed).withColumn("_run", F.sum("_run").over(epoch.rowsBetween(Window.unboundedPreceding, 0)))
            long_enough = _seconds() - F.min(_seconds()).over(Window.partitionBy("unit_id", "segment", "_epoch", "_run")) >= rule.hold_s
            # the last island that was long enough decides, be it one of true or of false samples
            frame = frame.withColumn("_said", F.when(long_enough, on))
            fires = F.last("_said", ignorenulls=True).over(epoch.rowsBetween(Window.unboundedPreceding, 0))
            frame = frame.withColumn(f"_on_{name}", F.coalesce(fires, F.lit(False))).drop("_run", "_said")
    ids = F.array_compact(F.array(*[F.when(F.col(f"_on_{n}"), F.lit(n)) for n in rules]))
    return frame.withColumn("rule_ids", ids).drop("_turned", "_epoch", "_guarded", *[f"_on_{n}" for n in rules])


def any_of(names: list[str]) -> Column:
    """Whether one of the named rules is among rule_ids."""
    return reduce(lambda a, b: a | b, [F.array_contains("rule_ids", n) for n in names])
