"""Column builders against plain Python on edge values."""

import math
from datetime import datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fathomline.functions import expressions as x
from fathomline.operators.series import lttb
from fathomline.operators.stateful import Cadence, Hysteresis, fold


def values(spark, column, rows, schema):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


def test_machine_state_is_unknown_where_an_input_is_missing(spark):
    rows = [(False, True, 5.0), (True, True, 5.0), (True, False, 0.5), (None, True, 5.0), (False, True, None), (False, False, 0.0)]
    got = values(spark, x.machine_state(F.col("i"), F.col("l"), F.col("c")), rows, "i boolean, l boolean, c double")
    assert got == ["loaded", "unloaded", "off", "unknown", "unknown", "off"]


def test_gate_compares_reals_as_doubles(spark):
    rows = [(0.85,), (0.8499,), (0.6,), (0.1,)]
    assert values(spark, x.gate(F.col("c"), F.lit(False)), rows, "c double") == ["ticket", "review", "review", "log"]
    assert values(spark, x.gate(F.col("c"), F.lit(True)), rows, "c double") == ["log"] * 4
    assert values(spark, x.gate(F.col("c"), F.lit(False)), [(0.85,)], "c float") == ["ticket"]  # 0.85f widens above


def test_levels_and_buckets(spark):
    rows = [(v, 1.0, 2.0, 8.0, 9.0) for v in (0.5, 1.5, 5.0, 8.5, 9.5, None)]
    got = values(spark, x.level_bucket(*map(F.col, ("v", "a", "b", "c", "d"))), rows, "v double, a double, b double, c double, d double")
    assert got == ["very_low", "low", "normal", "high", "very_high", None]
    assert values(spark, x.ambient_bucket(F.col("v")), [(9.9,), (10.0,), (32.0,), (None,)], "v double") == ["cold", "mild", "hot", "unknown"]


def test_envelope_codec_and_steps(spark):
    rows = [(-1.0,), (0.0,), (5.0,), (10.0,), (29.9,), (35.0,), (40.0,)]
    assert values(spark, F.round(x.envelope(F.col("t"), 10, 20, 10), 4), rows, "t double") == [0.0, 0.0, 0.5, 1.0, 1.0, 0.5, 0.0]
    assert values(spark, x.quantise(F.col("v"), 100.0), [(1.005,), (400.0,), (-400.0,)], "v double")[1:] == [327.67, -327.68]
    assert values(spark, x.step_round(F.col("v"), 0.1, "floor"), [(0.3,), (-0.04,)], "v double") == [0.3, -0.1]
    assert math.copysign(1, values(spark, x.step_round(F.col("v"), 0.5, "ceil"), [(-0.1,)], "v double")[0]) == 1


def test_money_is_exact(spark):
    rows = [(1_000_000, 0, "2.500000", "0.000000"), (1, 1, "0.000001", "0.000002")]
    df = spark.createDataFrame(rows, "i long, o long, p string, q string").select(F.col("i"), F.col("o"), F.col("p").cast("decimal(12,6)"), F.col("q").cast("decimal(12,6)"))
    got = [str(r[0]) for r in df.select(x.call_cost(*map(F.col, "iopq"))).collect()]
    assert got[0] == "2.5000000000" and float(got[1]) == 0.0


def test_cosine_of_a_zero_vector_is_null(spark):
    rows = [([1.0, 0.0], [2.0, 0.0]), ([0.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [0.0, 3.0])]
    assert values(spark, x.cosine(F.col("a"), F.col("b")), rows, "a array<float>, b array<float>") == [1.0, None, 0.0]


def test_hysteresis_machine():
    m = Hysteresis(on=10, off=5, delay_s=2, gap_s=60)
    rows = [(1, i, t * 1_000_000, v) for i, (t, v) in enumerate([(0, 11), (1, 12), (2, 12), (3, 7), (4, 4), (5, 11), (500, 11), (502, 11), (501, 11)])]
    _, out = fold(m, m.empty, rows)
    assert [(o[3], o[2] // 1_000_000) for o in out] == [("raise", 2), ("clear", 4), ("raise", 502), ("reset", 501)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 300), st.one_of(st.none(), st.floats(0, 20))), max_size=60), st.integers(0, 60))
def test_machines_may_be_cut_anywhere(samples, at):
    """A fold resumed from its state equals one that was never cut, so batch and stream agree."""
    t, rows = 0, []
    for i, (dt, v) in enumerate(samples):
        t += dt * 1_000_000
        rows.append((1, i, t, v))
    for m in (Hysteresis(10, 5, 60, 200), Cadence(8, 120, 250)):
        _, whole = fold(m, m.empty, rows)
        state, first = fold(m, m.empty, rows[:at])
        _, second = fold(m, state, rows[at:])
        assert first + second == whole


def test_largest_triangles_keep_ends_and_peaks(spark):
    df = spark.range(100).select(F.lit(1).alias("unit_id"), F.lit("x").alias("tag"), F.col("id").alias("seq"), F.timestamp_seconds("id").alias("sim_ts"), F.when(F.col("id") == 37, 50.0).otherwise(0.0).alias("v"))
    at = sorted(r.t_us // 1_000_000 for r in lttb(df, 10).collect())
    assert at[0] == 0 and at[-1] == 99 and 37 in at and len(at) == 10
    assert lttb(df.where("seq < 3"), 10).count() == 3
