"""Largest triangles against a plain loop over each series, with batches that cut buckets, and breaks at gaps."""

import random

import pytest
from pyspark.sql import functions as F

from fathomline.operators import series


def plain(points, keep):
    n = len(points)
    if n <= keep:
        return points
    edge = lambda k: k * (n - 2) // (keep - 2) + 1
    out = [points[0]]
    for b in range(keep - 2):
        after = points[edge(b + 1) : edge(b + 2)] if b + 1 < keep - 2 else points[-1:]
        nt, nv = sum(p[0] for p in after) / len(after), sum(p[1] for p in after) / len(after)
        at, av = out[-1]
        out.append(max(points[edge(b) : edge(b + 1)], key=lambda p: abs((at - nt) * (p[1] - av) - (at - p[0]) * (nv - av))))  # noqa: B023
    return [*out, points[-1]]


@pytest.mark.parametrize(("keep", "batch"), [(3, 10_000), (10, 7), (25, 10_000), (40, 13)])
def test_lttb_equals_a_loop(spark, keep, batch):
    r = random.Random(keep)
    rows, want = [], {}
    for unit, n in enumerate([1, 2, 3, 10, 11, 40, 41, 100, 333]):
        t, points = 0, []
        for _ in range(n):
            t += r.choice([1, 5, 60])
            points.append((t * 1_000_000, float(r.choice([0, 1, 5, 5, 9]) + r.random())))
        want[unit] = plain(points, keep)
        rows += [(unit, "x", k, t, v) for k, (t, v) in enumerate(points)] + [(unit, "x", 999, 1, None), (unit, "x", 998, 1, float("nan"))]
    df = spark.createDataFrame(rows, "unit_id long, tag string, seq long, t_us long, v double").withColumn("sim_ts", F.timestamp_micros("t_us"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        got = series.lttb(df, keep).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for unit, points in want.items():
        assert sorted((p.t_us, p.v) for p in got if p.unit_id == unit) == points
    with pytest.raises(ValueError):
        series.lttb(df, 2)


def test_breaks(spark):
    points = spark.createDataFrame([(1, "x", 0, 0, 1.0), (1, "x", 1, 10, 2.0), (1, "x", 2, 31, 3.0), (2, "x", 3, 500, 1.0)], series.SERIES)
    got = [(r.unit_id, r.t_us, r.v) for r in series.broken_at_gaps(points, 20).orderBy("unit_id", "t_us").collect()]
    assert got == [(1, 0, 1.0), (1, 10, 2.0), (1, 20, None), (1, 31, 3.0), (2, 500, 1.0)]
