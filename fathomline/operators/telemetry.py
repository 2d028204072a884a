"""Telemetry operators: folds, runs, cycles, trailing frames, rules and sessions.

Everything is partitioned by unit (and by segment or run within it). Trailing frames are worked out by blocks and chunks of
time too (``chunks``), at a cost that does not grow with the rows in a frame.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import machine_state
from . import chunks

ORDER = ("sim_ts", "seq")


def micros(c: str | Column) -> Column:
    return F.unix_micros(c)


def seconds(c: str | Column) -> Column:
    return F.unix_micros(c) / 1_000_000


def by_unit() -> Window:
    return Window.partitionBy("unit_id").orderBy(*ORDER)


def minute_aggregate(tel: DataFrame, minutes: int = 1) -> DataFrame:
    """Count, least, greatest, mean, last and duty by unit, minute and tag; non-finite values don't count."""
    fine = tel.where(F.col("v").isNotNull() & ~F.isnan("v") & (F.abs("v") < float("inf")))
    minute = F.floor(seconds("sim_ts") / (60 * minutes)) * 60 * minutes
    return fine.groupBy("unit_id", minute.alias("minute"), "tag").agg(
        F.count("v").alias("n"),
        F.min("v").alias("min_v"),
        F.max("v").alias("max_v"),
        F.round(F.avg("v"), 6).alias("avg_v"),
        F.max_by("v", F.struct(*ORDER)).alias("last_v"),
        F.round(F.avg(F.when(F.col("v") != 0, 1.0).otherwise(0.0)), 6).alias("duty"),
    )


def with_state(tel: DataFrame) -> DataFrame:
    return tel.withColumn("mode", machine_state(F.col("intake_closed"), F.col("load_valve"), F.col("motor_current")))


def with_steps(tel: DataFrame, gap_s: float, first_s: float = 10.0) -> DataFrame:
    """Seconds since the unit's last sample, gap flag and segment number; time going back is a gap too."""
    w = by_unit()
    dt = F.coalesce(seconds("sim_ts") - F.lag(seconds("sim_ts")).over(w), F.lit(first_s))
    df = tel.withColumn("dt", dt)
    df = df.withColumn("gap", (F.col("dt") > gap_s) | (F.col("dt") < 0))
    return df.withColumn("segment", F.sum(F.col("gap").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def with_steps_in_parts(tel: DataFrame, gap_s: float, first_s: float = 10.0) -> DataFrame:
    """``with_steps`` worked out by ``chunk``, a part of the unit's time, which is a column more; no task holds a unit's history."""
    df = chunks.in_parts(tel, "unit_id", micros("sim_ts"))
    own = Window.partitionBy("unit_id", "chunk").orderBy(*ORDER)
    now, is_gap = seconds("sim_ts"), lambda dt: F.coalesce((dt > gap_s) | (dt < 0), F.lit(False))
    df = df.withColumn("_before", F.lag(now).over(own))
    ends = df.groupBy("unit_id", "chunk").agg(F.min(now).alias("_first"), F.max(now).alias("_last"), F.count_if(is_gap(now - F.col("_before"))).alias("_gaps"))
    in_order = Window.partitionBy("unit_id").orderBy("chunk")
    ends = ends.withColumn("_in", F.lag("_last").over(in_order))
    gaps = F.col("_gaps") + is_gap(F.col("_first") - F.col("_in")).cast("int")
    ends = ends.select("unit_id", "chunk", "_in", F.coalesce(F.sum(gaps).over(in_order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    df = df.join(ends, ["unit_id", "chunk"], "left")
    first = F.row_number().over(own) == 1
    df = df.withColumn("dt", F.coalesce(now - F.when(first, F.col("_in")).otherwise(F.col("_before")), F.lit(first_s)))
    df = df.withColumn("gap", (F.col("dt") > gap_s) | (F.col("dt") < 0))
    so_far = F.sum(F.col("gap").cast("int")).over(own.rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("segment", so_far + F.coalesce("_base", F.lit(0))).drop("_before", "_in", "_base")


def with_runs(df: DataFrame, what: str, into: str = "run_id", partition: tuple = ("unit_id",)) -> DataFrame:
    """Number the runs of equal values; the first run is 1. Null is a value of its own."""
    w = Window.partitionBy(*partition).orderBy(*ORDER)
    before = F.lag(what).over(w)
    changed = (F.row_number().over(w) == 1) | ~F.col(what).eqNullSafe(before)
    return df.withColumn(into, changed.cast("int")).withColumn(into, F.sum(into).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def state_runs(tel: DataFrame, gap_s: float = 60.0) -> DataFrame:
    """One row a run of the machine state: bounds, counts, extremes, median, and whether it held a gap."""
    runs = with_runs(with_steps(with_state(tel), gap_s), "mode")
    return runs.groupBy("unit_id", "run_id", "mode").agg(
        F.count(F.lit(1)).alias("n"),
        micros(F.min("sim_ts")).alias("first_us"),
        micros(F.max("sim_ts")).alias("last_us"),
        F.min_by("v", F.struct(*ORDER)).alias("first_v"),
        F.max_by("v", F.struct(*ORDER)).alias("last_v"),
        F.min("v").alias("min_v"),
        F.max("v").alias("max_v"),
        F.round(F.percentile("v", 0.5), 6).alias("median_v"),
        F.bool_or("gap").alias("has_gap"),
    )


def cycle_samples(tel: DataFrame, gap_s: float) -> DataFrame:
    """Samples with mode, steps, the number of their cycle (0 before the first cut-in), seconds to the next one and since the cycle's start."""
    w = by_unit()
    df = with_steps(with_state(tel), gap_s)
    cut_in = (F.col("mode") == "loaded") & ~F.coalesce(F.lag("mode").over(w) == "loaded", F.lit(False))
    df = df.withColumn("cycle", F.sum(cut_in.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    df = df.withColumn("ahead", F.lead(seconds("sim_ts")).over(w) - seconds("sim_ts"))
    base = F.min(seconds("sim_ts")).over(Window.partitionBy("unit_id", "cycle"))
    return df.withColumn("t", seconds("sim_ts") - base)


def load_cycles(tel: DataFrame, gap_s: float = 60.0, keep: int | None = None) -> DataFrame:
    """From each cut-in to the next: times by state, samples, purge and slope; open cycles are not emitted.

    An interval belongs to the state of the sample that opens it.
    """
    df = cycle_samples(tel, gap_s)
    in_state = lambda m: F.round(F.coalesce(F.sum(F.when(F.col("mode") == m, F.col("ahead"))), F.lit(0.0)), 3)
    loaded = F.col("mode") == "loaded"
    cycles = df.where("cycle > 0").groupBy("unit_id", "cycle").agg(
        micros(F.min("sim_ts")).alias("start_us"),
        F.count(F.lit(1)).alias("n"),
        in_state("loaded").alias("loaded_s"),
        in_state("unloaded").alias("unloaded_s"),
        in_state("off").alias("off_s"),
        F.max_by(F.when(loaded, F.col("v")), F.when(loaded, F.struct(*ORDER))).alias("cutout_v"),
        F.max(F.when(loaded, F.col("v"))).alias("peak_v"),
        F.round(F.percentile("v", 0.5), 6).alias("median_v"),
        F.when(F.count(F.lit(1)) >= 6, F.round(F.regr_slope("v", "t") * 60, 6)).alias("slope"),
        F.bool_or(F.col("gap") & (F.col("t") > 0)).alias("dirty"),
    )
    last = F.max("cycle").over(Window.partitionBy("unit_id"))
    closed = cycles.withColumn("_last", last).where("cycle < _last").drop("_last")
    if keep:
        newest = F.row_number().over(Window.partitionBy("unit_id").orderBy(F.desc("cycle")))
        closed = closed.withColumn("_k", newest).where(F.col("_k") <= keep).drop("_k")
    return closed


def trailing(tel: DataFrame, secs: float, at_least: int = 3) -> DataFrame:
    """Framed count, least, greatest, median, spread and slope a minute of each unit's tag."""
    keys, us = ("unit_id", "tag"), int(secs * 1_000_000)
    base = F.min(seconds("sim_ts")).over(Window.partitionBy(*keys))
    df = tel.select("unit_id", "tag", "seq", "sim_ts", "v", (seconds("sim_ts") - base).alias("t"))
    df = chunks.with_medians(df, keys, micros("sim_ts"), {"median_v": ("v", us)})
    v = F.col("v")
    figures = {"n": chunks.count(v), "min_v": chunks.least(v), "max_v": chunks.greatest(v), "spread": chunks.spread(v), "slope": chunks.slope(v, F.col("t"))}
    df = chunks.over_frames(df, keys, micros("sim_ts"), us, figures)
    enough = lambda c, digits: F.when(F.col("n") >= at_least, F.round(c, digits))
    return df.select("unit_id", "tag", "seq", "n", "min_v", "max_v", enough("median_v", 6).alias("median_v"), enough("spread", 5).alias("spread"), enough(F.col("slope") * 60, 5).alias("slope"))


def since_change(tel: DataFrame, what: str = "tag") -> DataFrame:
    """Seconds since ``what`` last changed, its place in the run, and transitions so far, by unit."""
    runs = with_runs(tel, what)
    run = Window.partitionBy("unit_id", "run_id").orderBy(*ORDER)
    start = F.min(seconds("sim_ts")).over(Window.partitionBy("unit_id", "run_id"))
    return runs.select("unit_id", "seq", what, F.round(seconds("sim_ts") - start, 6).alias("since_s"), F.row_number().over(run).alias("place"), (F.col("run_id") - 1).cast("long").alias("changes"))


def frames(tel: DataFrame, secs: float) -> DataFrame:
    """The feature frame the rules read: state, run time and trailing figures at every sample."""
    df = with_runs(with_state(tel), "mode")
    start = F.min(seconds("sim_ts")).over(Window.partitionBy("unit_id", "run_id"))
    us = int(secs * 1_000_000)
    df = df.select("unit_id", "seq", "sim_ts", "tag", "mode", "v", F.round(seconds("sim_ts") - start, 3).alias("run_s"))
    df = chunks.with_medians(df, ("unit_id",), micros("sim_ts"), {"median_v": ("v", us)}).withColumn("median_v", F.round("median_v", 6))
    figures = {"n": chunks.count(F.col("v")), "min_v": chunks.least(F.col("v")), "errors": chunks.total((F.col("tag") == "error").cast("int"))}
    return chunks.over_frames(df, ("unit_id",), micros("sim_ts"), us, figures).drop("tag")


def fired(frame: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """The ids of the rules that hold at each frame, in registry order; a null predicate does not hold."""
    ids = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in rules.items()]))
    return frame.withColumn("rule_ids", ids)


def held(frame: DataFrame, condition: Column, hold_s: float) -> DataFrame:
    """Islands of a condition that lasted ``hold_s`` or longer, dated from when it first held."""
    df = with_runs(frame.withColumn("_on", F.coalesce(condition, F.lit(False))), "_on")
    runs = df.where("_on").groupBy("unit_id", "run_id").agg(micros(F.min("sim_ts")).alias("from_us"), micros(F.max("sim_ts")).alias("to_us"), F.count(F.lit(1)).alias("n"))
    return runs.where(F.col("to_us") - F.col("from_us") >= hold_s * 1_000_000)


def sessions(hits: DataFrame, silence_s: float) -> DataFrame:
    """Episodes: firings of a unit's symptom no further apart than ``silence_s``."""
    w = Window.partitionBy("unit_id", "symptom").orderBy(*ORDER)
    new = F.coalesce(seconds("sim_ts") - F.lag(seconds("sim_ts")).over(w) > silence_s, F.lit(True))
    df = hits.withColumn("_n", new.cast("int")).withColumn("episode", F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return df.groupBy("unit_id", "symptom", "episode").agg(micros(F.min("sim_ts")).alias("opened_us"), micros(F.max("sim_ts")).alias("last_us"), F.count(F.lit(1)).alias("firings"), F.max("v").alias("peak_v"))


def dedup_sequence(tel: DataFrame) -> DataFrame:
    """One row for each unit and sequence number: the first delivered."""
    w = Window.partitionBy("unit_id", "seq").orderBy("sim_ts")
    return tel.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")
