"""The reference operation of clean cycles, and recorded overlay messages."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from fathomline.operators.overlay_records import counters, recorded
from fathomline.operators.reference_operation import reference_operation

TEL = "unit_id int, seq int, sim_ts timestamp, v double, intake_closed boolean, load_valve boolean, motor_current double"


def samples(shape, start, gap_at=None):
    """A sample each 10 s; ``shape`` lists (loaded, v, current)."""
    rows, at = [], start
    for i, (loaded, v, current) in enumerate(shape):
        at += timedelta(seconds=10 if i != gap_at else 500)
        rows.append((1, i, at, v, not loaded, loaded, current))
    return rows


def test_reference_operation(spark):
    cycle = [(True, 8.0, 9.0), (True, 8.5, 9.5), (True, 9.0, 10.0), (False, 9.0, 4.0), (False, 8.8, 0.1), (False, 8.4, 0.1)]
    week = datetime(2024, 1, 1)
    rows = samples(cycle * 3 + cycle[:1], week, gap_at=8)  # the second cycle has a gap inside, the last one is open
    got = reference_operation(spark.createDataFrame(rows, TEL), 60, 10).collect()
    assert len(got) == 1
    r = got[0]
    assert (r.n_cycles, r.n_clean, r.cut_in_typical, r.cut_out_typical) == (3, 2, 8.0, 9.0)
    assert (r.loaded_typical, r.loaded_low, r.loaded_high, r.unloaded_typical, r.off_typical) == (30.0, 30.0, 30.0, 10.0, 20.0)
    assert (r.rise_typical, r.decay_typical, r.discharge_minus_line) == (3.0, -1.8, 1.0)
    assert r.cycles_per_hour == round(3 / ((18 * 10 + 60) / 3600), 6)
    none = reference_operation(spark.createDataFrame(rows, TEL).where(F.col("seq") < 3), 60, 10)
    assert none.count() == 0 and reference_operation(spark.createDataFrame([], TEL), 60, 10).count() == 0


def test_recorded_overlay_messages(spark):
    shape = "message_id long, kind string, unit_id string, instance_id string, event string, reason string, source_sha256 string, payload string"
    rows = [
        (1, "catalog", "u", None, None, None, "aa", "x"),
        (2, "catalog", "u", None, None, None, "aa", "y"),  # the same files in another envelope
        (3, "catalog", "u", None, None, None, None, "x"),
        (4, "injection", "u", "i1", "start", None, None, None),
        (5, "injection", "u", "i1", "start", None, None, None),
        (6, "injection", "u", "i1", "stop", "expired", None, None),
        (7, "injection", "u", "i1", "stop", "unheard", None, None),
        (8, "injection", "u", "i1", None, None, None, None),
        (9, "marker", "u", None, "jump", None, None, None),
        (10, "marker", "u", None, "jump", None, None, None),
        (11, "injection_active", "u", None, None, None, None, None),
        (12, "elsewhere", "u", None, None, None, None, None),
        (13, None, "u", None, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, shape)
    first = recorded(df)
    want = {1: "stored", 2: "duplicate", 3: "stored", 4: "stored", 5: "duplicate", 6: "stored", 7: "invalid", 8: "invalid", 9: "stored", 10: "stored", 11: "kept", 12: "invalid", 13: "invalid"}
    assert {r.message_id: r.fate for r in first.collect()} == want
    assert {(r.kind, r.received, r.stored, r.duplicates, r.invalid) for r in counters(first).collect() if r.kind in ("catalog", "injection")} == {("catalog", 3, 2, 1, 0), ("injection", 3, 2, 1, 2)}
    again = recorded(df, first.where("fate = 'stored'"))
    assert {r.message_id for r in again.where("fate = 'stored'").collect()} == {9, 10}
    assert recorded(df.limit(0)).count() == 0
