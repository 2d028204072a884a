"""Interval algebra, labels and scoring. Intervals are half-open.

Point-in-interval and overlap joins are bucketed by hour: an interval is entered in every hour it
touches, so the join is an equi-join on unit and hour with the bounds as a residual, and no side
has to fit in a broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

HOUR = 3600


def hour_of(ts):
    return F.floor(F.unix_seconds(ts) / HOUR)


def by_hours(intervals: DataFrame, start: str = "from_ts", end: str = "to_ts") -> DataFrame:
    """The intervals in every hour they touch; empty ones in none."""
    last = F.floor((F.unix_micros(end) - 1) / (HOUR * 1_000_000))
    return intervals.where(F.col(start) < F.col(end)).withColumn("_hour", F.explode(F.sequence(hour_of(F.col(start)), last)))


def points_in(points: DataFrame, ts: str, intervals: DataFrame) -> DataFrame:
    """Each point with each interval of its unit that holds it."""
    b = by_hours(intervals)
    p = points.withColumn("_hour", hour_of(F.col(ts)))
    return p.join(b, ["unit_id", "_hour"]).where((F.col(ts) >= F.col("from_ts")) & (F.col(ts) < F.col("to_ts"))).drop("_hour")


def union(intervals: DataFrame) -> DataFrame:
    """Merge a unit's touching and overlapping intervals into islands."""
    w = Window.partitionBy("unit_id").orderBy("from_ts", "to_ts")
    reach = F.max("to_ts").over(w.rowsBetween(Window.unboundedPreceding, -1))
    df = intervals.where(F.col("from_ts") < F.col("to_ts")).withColumn("_new", F.coalesce(F.col("from_ts") > reach, F.lit(True)).cast("int"))
    df = df.withColumn("island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return df.groupBy("unit_id", "island").agg(F.min("from_ts").alias("from_ts"), F.max("to_ts").alias("to_ts"))


def holes(islands: DataFrame) -> DataFrame:
    """What lies between a unit's consecutive islands."""
    w = Window.partitionBy("unit_id").orderBy("from_ts")
    return islands.select("unit_id", F.col("to_ts").alias("from_ts"), F.lead("from_ts").over(w).alias("to_ts")).where("to_ts is not null")


def overlaps(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs of overlapping intervals of a unit, clipped: a_id, b_id, from_ts, to_ts."""
    x = by_hours(a.withColumnsRenamed({"window_id": "a_id", "from_ts": "a_from", "to_ts": "a_to"}).select("unit_id", "a_id", "a_from", "a_to"), "a_from", "a_to")
    y = by_hours(b.withColumnsRenamed({"window_id": "b_id", "from_ts": "b_from", "to_ts": "b_to"}).select("unit_id", "b_id", "b_from", "b_to"), "b_from", "b_to")
    both = x.join(y, ["unit_id", "_hour"]).where("a_from < b_to AND a_to > b_from")
    return both.select("unit_id", "a_id", "b_id", F.greatest("a_from", "b_from").alias("from_ts"), F.least("a_to", "b_to").alias("to_ts")).distinct()


def label_instants(points: DataFrame, ts: str, failures: DataFrame, excluded: DataFrame, key: str = "seq") -> DataFrame:
    """Each point as failure, excluded or negative, in this order of precedence."""
    # islands first: a point is then met once a label, however many intervals overlap
    f = points_in(points.select("unit_id", key, ts), ts, union(failures)).select("unit_id", key, F.lit(2).alias("_l"))
    x = points_in(points.select("unit_id", key, ts), ts, union(excluded)).select("unit_id", key, F.lit(1).alias("_l"))
    best = f.unionByName(x).groupBy("unit_id", key).agg(F.max("_l").alias("_l"))
    label = F.when(F.col("_l") == 2, "failure").when(F.col("_l") == 1, "excluded").otherwise("negative")
    return points.join(best, ["unit_id", key], "left").withColumn("label", label).drop("_l")


def match_tickets(tickets: DataFrame, windows: DataFrame) -> DataFrame:
    """Each ticket's window and verdict: tp, duplicate, misdiagnosed or fp.

    A ticket belongs to the first window that holds it and accepts its fault, else to the first that
    holds it. A window's first accepted ticket is its true positive, later ones are duplicates.
    """
    held = points_in(tickets, "opened", windows)
    accepts = F.col("fault") == F.col("accepted")
    first = Window.partitionBy("ticket_id").orderBy(F.desc(accepts.cast("int")), "from_ts", "window_id")
    own = held.withColumn("accepts", accepts).withColumn("_k", F.row_number().over(first)).where("_k = 1")
    turn = F.row_number().over(Window.partitionBy("window_id", "accepts").orderBy("opened", "ticket_id"))
    own = own.withColumn("verdict", F.when(~F.col("accepts"), "misdiagnosed").when(turn == 1, "tp").otherwise("duplicate"))
    return tickets.join(own.select("ticket_id", "window_id", "accepted", "verdict"), "ticket_id", "left").withColumn("verdict", F.coalesce("verdict", F.lit("fp")))


def confusion(tickets: DataFrame, windows: DataFrame, excluded: DataFrame, benign: list[str]) -> DataFrame:
    """(ticket_id, unit_id, window_id, verdict, recovered) of each ticket against positive windows.

    In a window: tp, duplicate, ``benign`` for a benign fault that the window doesn't accept, else misdiagnosed; a true positive after
    a misdiagnosis of its window is recovered. Elsewhere: ``ignored`` in an excluded span (unit_id, from_ts, to_ts), ``benign``, else fp.
    """
    own = match_tickets(tickets, windows)
    spared = points_in(tickets.select("unit_id", "ticket_id", "opened"), "opened", excluded).select("ticket_id", F.lit(True).alias("_spared")).distinct()
    harmless, held = F.col("fault").isin(benign), F.col("window_id").isNotNull()
    verdict = (
        F.when(held & harmless & (F.col("verdict") == "misdiagnosed"), "benign")
        .when(held, F.col("verdict"))
        .when(F.col("_spared"), "ignored")
        .when(harmless, "benign")
        .otherwise("fp")
    )
    own = own.join(spared, "ticket_id", "left").withColumn("verdict", verdict)
    # tickets of no window are windows of their own here, so that none of these groups is larger than a window's tickets
    group = F.coalesce(F.col("window_id").cast("string"), F.concat(F.lit("t"), F.col("ticket_id").cast("string")))
    before = Window.partitionBy(group).orderBy("opened", "ticket_id").rowsBetween(Window.unboundedPreceding, -1)
    wrong = F.coalesce(F.bool_or(F.col("verdict") == "misdiagnosed").over(before), F.lit(False))
    return own.withColumn("recovered", (F.col("verdict") == "tp") & wrong).select("ticket_id", "unit_id", "window_id", "verdict", "recovered")


def comparison(figures: DataFrame, lower_is_better: list[str]) -> DataFrame:
    """(metric, backend, cases, mean, place) of figures (backend, case, metric, v): the mean over cases of each case's mean, and its place among backends.

    Place 1 is the best, equal means share a place; a metric that is better low is ranked from the least. Null figures don't count.
    """
    case = figures.where("v is not null").groupBy("metric", "backend", "case").agg(F.avg("v").alias("v"))
    mean = case.groupBy("metric", "backend").agg(F.count(F.lit(1)).alias("cases"), F.round(F.avg("v"), 9).alias("mean"))
    good = F.when(F.col("metric").isin(lower_is_better), -F.col("mean")).otherwise(F.col("mean"))
    return mean.withColumn("place", F.rank().over(Window.partitionBy("metric").orderBy(good.desc())))


def precision_recall(matched: DataFrame, windows: DataFrame) -> DataFrame:
    """Counts, precision and recall by fault; null where a denominator is zero."""
    said = matched.groupBy("fault").agg(F.count_if(F.col("verdict") == "tp").alias("tp"), F.count_if(F.col("verdict").isin("fp", "misdiagnosed")).alias("fp"))
    hit = matched.where("verdict = 'tp'").select("window_id").distinct().withColumn("_hit", F.lit(True))
    missed = windows.join(hit, "window_id", "left").groupBy(F.col("accepted").alias("fault")).agg(F.count_if(F.col("_hit").isNull()).alias("fn"))
    both = said.join(missed, "fault", "full").na.fill(0, ["tp", "fp", "fn"])
    return both.select("fault", "tp", "fp", "fn", F.round(F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), 6).alias("precision"), F.round(F.try_divide(F.col("tp"), F.col("tp") + F.col("fn")), 6).alias("recall"))
