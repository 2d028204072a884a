"""The last day of a unit's cycles: where their decay turned fast, and its level in quiet and in busy hours since.

A row looks back one day, so a (unit, day) group holds its own rows and copies of the day before, and work spreads over days
as well as units. Within it, the first of three fast cycles in a row is an island inside each row's range frame.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .chunks import look_back_chunks

#: The look-back, the cycles that make an onset or a level, those whose median counts, and the longest idle phase.
DAY_US = 86_400_000_000
LEAST, RECENT, MAX_IDLE_S = 3, 5, 6 * 3600


def quiet_hours_of(counts: Column) -> Column:
    """The hours (0 to 23) with fewer cycles than half way from the fewest to the median of 24 counts; none where those are equal."""
    s = F.array_sort(counts)
    middle = (F.array_min(counts) + (F.get(s, 11) + F.get(s, 12)) / 2) / 2
    quiet = F.filter(F.sequence(F.lit(0), F.lit(23)), lambda h: F.get(counts, h) < middle)
    return F.when((F.get(s, 11) + F.get(s, 12)) / 2 > F.array_min(counts), quiet).otherwise(F.array().cast("array<int>"))


def _median(values: Column) -> Column:
    s, n = F.array_sort(values), F.size(values)
    return (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2


def day_decay(cycles: DataFrame, quiet_hours: Column) -> DataFrame:
    """(unit_id, end_us, onset_us, quiet, busy) at the close of each cycle that has a decay and no overlong idle phase.

    ``cycles`` has unit_id, cutout_us, end_us (unique in a unit), idle_s, decay and fast; ``quiet_hours`` is an array of hours.
    quiet and busy are medians of the last five decays since the onset, or in the day where there is none, from three on.
    """
    middle = F.timestamp_micros(((F.col("cutout_us") + F.col("end_us")) / 2).cast("long"))
    entries = cycles.where(F.col("decay").isNotNull() & (F.col("idle_s") <= MAX_IDLE_S))
    entries = entries.select("unit_id", "end_us", "decay", "fast", F.array_contains(quiet_hours, F.hour(middle)).alias("_quiet"))
    df = look_back_chunks(entries, "end_us", DAY_US, DAY_US)
    group = Window.partitionBy("unit_id", "chunk").orderBy("end_us")
    frame = group.rangeBetween(1 - DAY_US, 0)
    fast = [F.coalesce(F.lag("fast", k).over(group), F.lit(False)) for k in range(LEAST)]
    third = F.when(fast[0] & fast[1] & fast[2], F.lag("end_us", LEAST - 1).over(group))
    df = df.withColumn("_first", third)
    df = df.withColumn("_firsts", F.collect_list("_first").over(frame))
    of = lambda side: F.collect_list(F.when(F.col("_quiet") == side, F.struct("end_us", "decay"))).over(frame)
    df = df.withColumns({"_q": of(True), "_b": of(False)}).where("own")
    # an onset counts where all three of its cycles lie in the look-back
    df = df.withColumn("onset_us", F.array_min(F.filter("_firsts", lambda x: x > F.col("end_us") - DAY_US)))

    def level(column: str) -> Column:
        since = F.filter(column, lambda e: F.col("onset_us").isNull() | (e["end_us"] >= F.col("onset_us")))
        last = F.slice(F.array_sort(since), -F.greatest(F.lit(1), F.least(F.size(since), F.lit(RECENT))), F.lit(RECENT))
        return F.when(F.size(since) >= LEAST, _median(F.transform(last, lambda e: e["decay"])))

    return df.select("unit_id", "end_us", "onset_us", level("_q").alias("quiet"), level("_b").alias("busy"))
