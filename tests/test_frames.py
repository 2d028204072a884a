"""Trailing frames: figures against brute force, and a cost that does not grow with the rows in a frame."""

import statistics
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathomline.operators import chunks
from fathomline.operators import telemetry as t

LENGTH = 100
ROWS = [("a", 0, 1.0), ("a", 0, 5.0), ("a", 40, None), ("a", 100, 7.0), ("a", 101, 7.0), ("a", 199, 2.0), ("a", 200, 9.0), ("a", 200, None), ("a", 950, 3.0), ("a", -30, 4.0), ("b", 100, 8.0), ("a", None, 6.0), ("a", None, 2.0)]


def in_frame(key, at):
    return [v for k, x, v in ROWS if k == key and (x is None if at is None else x is not None and at - LENGTH <= x <= at)]


@pytest.fixture(scope="module")
def samples(spark):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(ROWS)], "i int, k string, us long, v double")


def test_joined_figures_equal_brute_force(samples):
    v = F.col("v")
    figures = {"n": chunks.count(v), "low": chunks.least(v), "high": chunks.greatest(v), "sd": chunks.spread(v), "sum": chunks.total(v.cast("long")), "m": chunks.slope(v, F.col("us"))}
    got = {r.i: r for r in chunks.over_frames(samples, ("k",), F.col("us"), LENGTH, figures).collect()}
    assert len(got) == len(ROWS)
    for i, (k, at, _) in enumerate(ROWS):
        here = [x for x in in_frame(k, at) if x is not None]
        assert (got[i].n, got[i].low, got[i].high, got[i].sum) == (len(here), min(here, default=None), max(here, default=None), int(sum(here)) if here else None)
        assert got[i].sd == (pytest.approx(statistics.stdev(here)) if len(here) > 1 else None)
        pairs = [(x, y) for kk, x, y in ROWS if kk == k and y is not None and at is not None and x is not None and at - LENGTH <= x <= at]
        flat = len({x for x, _ in pairs}) < 2
        assert got[i].m == (None if flat else pytest.approx(np.polyfit([x for x, _ in pairs], [y for _, y in pairs], 1)[0]))


def test_equal_values_spread_by_nothing(spark):
    df = spark.range(5000).select((F.col("id") * 7).alias("us"), F.lit("a").alias("k"), F.lit(1e8 + 0.1).alias("v"))
    out = chunks.over_frames(df, ("k",), F.col("us"), 1000, {"sd": chunks.spread(F.col("v"))})
    assert out.agg(F.max("sd")).first()[0] < 1e-6


def test_medians_equal_brute_force(samples):
    got = {r.i: r.m for r in chunks.with_medians(samples, ("k",), F.col("us"), {"m": ("v", LENGTH)}).collect()}
    assert len(got) == len(ROWS)
    for i, (k, at, _) in enumerate(ROWS):
        here = [x for x in in_frame(k, at) if x is not None]
        assert got[i] == (statistics.median(here) if here else None)


def test_median_of_infinities_and_nan():
    at, v = np.arange(5), np.array([1.0, np.inf, np.nan, -np.inf, 2.0])
    out = chunks.rolling_median(at, v, np.zeros(5, bool), 2)
    assert [str(x) for x in out] == ["1.0", "inf", "inf", "inf", "2.0"]


def test_samples_without_a_time_keep_their_frames(spark):
    tel = spark.createDataFrame([(0, 1, None, "error", 3.0, True, False, 0.0), (0, 2, None, "view", 5.0, True, False, 0.0)], "unit_id long, seq long, sim_ts timestamp, tag string, v double, intake_closed boolean, load_valve boolean, motor_current double")
    assert sorted((r.seq, r.n, r.median_v, r.errors) for r in t.frames(tel, 3600).collect()) == [(1, 2, 4.0, 1), (2, 2, 4.0, 1)]


def test_cost_does_not_grow_with_the_rows_in_a_frame(spark):
    tel = spark.range(60000).select(
        F.lit(0).alias("unit_id"), F.col("id").alias("seq"), F.timestamp_micros(F.col("id") * 100_000).alias("sim_ts"), F.when(F.col("id") % 9 == 0, "error").otherwise("view").alias("tag"),
        (F.col("id") * 7919 % 10007 / 7).alias("v"), F.lit(True).alias("intake_closed"), F.lit(False).alias("load_valve"), F.lit(0.0).alias("motor_current"))
    began = time.time()
    last = t.frames(tel, 6 * 3600).where("seq = 59999").first()
    assert time.time() - began < 40
    assert (last.n, last.errors) == (60000, 6667)


@pytest.mark.parametrize("name", "emitted_frames feature_rules rule_firing_counts rolling_median_capped cycles_per_hour derived_quantities trailing_features episode_sessions".split())
def test_no_frame_of_time_slides_row_by_row(spark, name):
    from fathomline.plans import QUERIES

    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().analyzed().toString()
    assert "RangeFrame, unbounded" in plan and "RangeFrame, -" not in plan
