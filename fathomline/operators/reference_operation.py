"""What a unit's load cycles look like when nothing is wrong: typical times, rates and bands by period, from clean cycles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .telemetry import ORDER, cycle_samples, micros


def _rate(at: Column) -> Column:
    """The change of v per minute between the first and the last sample at which ``at`` holds; null without two times."""
    order = F.when(at, F.struct(*ORDER))
    last, first = F.max_by(F.when(at, F.struct("v", "t")), order), F.min_by(F.when(at, F.struct("v", "t")), order)
    return (last["v"] - first["v"]) / F.nullif(last["t"] - first["t"], F.lit(0.0)) * 60


def reference_cycles(samples: DataFrame) -> DataFrame:
    """Closed cycles of ``cycle_samples``: start, pressures at cut-in and cut-out, times by state, rates, and whether a gap lies inside.

    A time is null where the cycle never was in that state.
    """
    loaded = F.col("mode") == "loaded"
    time = lambda m: F.sum(F.when(F.col("mode") == m, F.col("ahead")))
    cycles = samples.where("cycle > 0").groupBy("unit_id", "cycle").agg(
        F.min("sim_ts").alias("start"),
        F.min_by("v", F.struct(*ORDER)).alias("cut_in"),
        F.max_by(F.when(loaded, F.col("v")), F.when(loaded, F.struct(*ORDER))).alias("cut_out"),
        time("loaded").alias("loaded_s"),
        time("unloaded").alias("unloaded_s"),
        time("off").alias("off_s"),
        _rate(loaded).alias("rise"),
        _rate(~loaded).alias("decay"),
        (~F.bool_or(F.col("gap") & (F.col("t") > 0))).alias("clean"),
    )
    return cycles.withColumn("_last", F.max("cycle").over(Window.partitionBy("unit_id"))).where("cycle < _last").drop("_last")


def reference_operation(tel: DataFrame, gap_s: float, settle_s: float, period: str = "week", discharge: str = "motor_current") -> DataFrame:
    """One row a unit and period: counts, medians and 5 to 95 % bands of clean cycles, cycles per covered hour, discharge over line pressure.

    A cycle counts for the period it starts in, covered time is cut at ``gap_s`` a step, and the pressure difference is taken over loaded
    samples from ``settle_s`` seconds after the cut-in on. Periods without a clean cycle, a measured decay, covered time or a settled
    loaded sample have no reference and no row. Percentiles are exact; a group is a unit's period, so its size does not grow with the history.
    """
    samples = cycle_samples(tel, gap_s)
    since = lambda c: F.date_trunc(period, c)
    settled = (F.col("mode") == "loaded") & (F.col("cycle") > 0) & (F.col("t") >= settle_s)
    by_period = samples.groupBy("unit_id", since("sim_ts").alias("period")).agg(
        (F.sum(F.least("dt", F.lit(float(gap_s)))) / 3600).alias("hours"),
        F.percentile(F.when(settled, F.col(discharge) - F.col("v")), 0.5).alias("discharge_minus_line"),
    )
    clean = lambda c, p: F.percentile(F.when(F.col("clean"), F.col(c)), p)
    figures = {
        "cut_in_typical": clean("cut_in", 0.5),
        "cut_out_typical": clean("cut_out", 0.5),
        "loaded_typical": clean("loaded_s", 0.5),
        "loaded_low": clean("loaded_s", 0.05),
        "loaded_high": clean("loaded_s", 0.95),
        "unloaded_typical": clean("unloaded_s", 0.5),
        "off_typical": clean("off_s", 0.5),
        "rise_typical": clean("rise", 0.5),
        "decay_typical": clean("decay", 0.5),
        "decay_low": clean("decay", 0.05),
        "decay_high": clean("decay", 0.95),
    }
    cycles = reference_cycles(samples).groupBy("unit_id", since("start").alias("period")).agg(
        F.count(F.lit(1)).alias("n_cycles"), F.count_if("clean").alias("n_clean"), *[f.alias(name) for name, f in figures.items()]
    )
    found = cycles.join(by_period, ["unit_id", "period"]).where("n_clean > 0 AND hours > 0 AND decay_typical IS NOT NULL AND discharge_minus_line IS NOT NULL")
    rounded = [F.round(F.col(c), 6).alias(c) for c in (*figures, "discharge_minus_line")]
    return found.select("unit_id", micros("period").alias("period_us"), "n_cycles", "n_clean", F.round(F.col("n_cycles") / F.col("hours"), 6).alias("cycles_per_hour"), *rounded)
