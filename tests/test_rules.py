"""The sixteen rules on synthetic 10-second waveforms, recordings and the read functions."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from fathomline import api
from fathomline.functions.conditions import compile_condition
from fathomline.operators import rules
from fathomline.sources import recordings

T0 = datetime(2024, 1, 1)
BASE = dict(tp2=8.5, tp3=8.0, h1=7.0, dv_pressure=0.0, reservoirs=8.0, oil_temperature=60.0, motor_current=5.8, comp=0, dv_eletric=1, towers=0, lps=0, oil_level=1, caudal_impulses=0)

IDLE = {"comp": 1, "dv_eletric": 0, "motor_current": 3.5}


def wide(spark, steps):
    rows = []
    for i, over in enumerate(steps):
        r = BASE | {"tp2": 8.5 + (i % 7) * 0.01, "caudal_impulses": i % 2} | over
        rows.append((1, i, T0 + timedelta(seconds=10 * i), *[float(r[k]) for k in BASE]))
    return spark.createDataFrame(rows, "unit_id long, seq long, sim_ts timestamp, " + ", ".join(f"{k} double" for k in BASE))


def last(spark, steps, names=None):
    out = rules.evaluate(rules.feature_frame(wide(spark, steps)), {k: r for k, r in rules.registry().items() if names is None or k in names})
    return out.orderBy(F.desc("seq")).first()["rule_ids"]


@pytest.mark.parametrize(
    "name, steps",
    [
        ("stuck_loaded", [{}] * 70),
        ("purge_pressure_high", [{}] * 34 + [{"dv_pressure": 0.9}] * 6),
        ("low_pressure_switch", [{}] * 30 + [{"lps": 1}] * 8),
        ("oil_temperature_high", [{"oil_temperature": 80}] * 400),
        ("motor_current_high", [{"motor_current": 7.0}] * 50),
        ("motor_current_low", [{"motor_current": 4.8}] * 50),
        ("discharge_differential_low", [{"tp2": 8.05 + 0.001 * (i % 5)} for i in range(50)]),
        ("separator_not_venting", [IDLE] * 3 + [{}] * 20 + [IDLE | {"h1": 5.0}] * 20),
        ("separator_not_venting", [IDLE] * 3 + [{}] * 20 + [IDLE | {"h1": 5.0}] * 20 + [IDLE | {"h1": 8.0}] * 3 + [{}] * 3),  # the closed cycle's time stands
        ("long_loaded_runs", [IDLE] * 3 + ([{}] * 25 + [IDLE] * 5) * 5 + [{}]),
        ("oil_temperature_rising", [(IDLE if i % 200 >= 12 else {}) | {"oil_temperature": 40 + i / 60} for i in range(3, 2000)]),
        ("low_oil_level", [{"oil_level": 0}] * 70 + [{}] * 25),  # not clear before it has been off for 300 s
        ("reservoir_pressure_mismatch", [{"reservoirs": 8.6}] * 70),
        ("low_oil_level", [{"oil_level": 0}] * 70),
        ("flow_pulses_missing", [{"caudal_impulses": 1}] * 140),
    ],
)
def test_rule_fires(spark, name, steps):
    assert name in last(spark, steps, [name])


@pytest.mark.parametrize(
    "name, steps",
    [
        ("separator_not_venting", [IDLE] * 3 + [{}] * 20 + [IDLE | {"h1": 8.0}] * 40),
        ("low_oil_level", [{"oil_level": 0}] * 70 + [{}] * 32),
        ("low_oil_level", ([{}] * 30 + [{"oil_level": 0}] * 20) * 3),
        ("oil_temperature_rising", [{"oil_temperature": 40 + i / 60} for i in range(2000)]),  # no rate, so no normal one
        ("dryer_tower_not_switching", [IDLE] * 3 + ([{}] * 5 + [IDLE] * 8) * 6),  # the towers are low for long enough
        ("dryer_tower_not_switching", [IDLE] * 3 + ([{"towers": 1}] * 5 + [IDLE | {"towers": 1}] * 8) * 2 + [{}]),
    ],
)
def test_rule_stays_silent(spark, name, steps):
    assert last(spark, steps, [name]) == []


def test_a_rolling_rate_raises_the_threshold_up_to_its_cap(spark):
    cycle = [{"towers": 1}] * 12 + [IDLE] * 60  # 5 an hour: 1.8 times twice the first month's rate is above that, once there are 20 cycles
    frame = rules.feature_frame(wide(spark, [IDLE] * 3 + cycle * 24))
    got = [r[0] for r in frame.where("roll_rate is not null").select("roll_rate").distinct().collect()]
    assert got == [pytest.approx(2 * rules.FIRST_MONTH["rate"])]


def test_quiet_and_guarded_frames_fire_nothing(spark):
    normal = [{}] * 11 + [{"comp": 1, "dv_eletric": 0, "motor_current": 3.5}] * 8
    assert last(spark, normal * 3, ["stuck_loaded", "motor_current_low", "low_oil_level", "reservoir_pressure_mismatch"]) == []
    assert last(spark, [{"oil_level": 0}] * 20) == []  # warm-up
    frozen = [{"tp2": 8.5, "caudal_impulses": 0, "oil_level": 0}] * 120
    assert last(spark, frozen) == []


def test_cycle_rules(spark):
    cycle = [{"towers": 1}] * 5 + [{"comp": 1, "dv_eletric": 0, "motor_current": 0.0, "tp3": 8.0 - 0.1 * k} for k in range(8)]
    got = last(spark, [{"comp": 1, "dv_eletric": 0, "motor_current": 0.0}] * 3 + cycle * 6, ["fast_decay", "frequent_cycling", "dryer_tower_not_switching", "long_loaded_runs"])
    assert got == ["fast_decay", "frequent_cycling", "dryer_tower_not_switching"]


def test_recording(spark, tmp_path):
    head = ",timestamp," + ",".join([*recordings.ANALOG, *recordings.DIGITAL])
    row = lambda i, first: f"{i},2024-01-01 00:00:{i:02d},{first}," + ",".join(["1.0"] * 14)
    (tmp_path / "r.csv").write_text("\n".join([head, row(0, "2.5"), row(1, ""), row(2, "bad"), row(3, "4")]))
    got = [(r.tp2, r.missing) for r in recordings.read_recording(spark, str(tmp_path / "r.csv")).orderBy("sim_ts").collect()]
    assert got == [(2.5, False), (2.5, True), (2.5, True), (4.0, False)]
    (tmp_path / "bad.csv").write_text("timestamp,TP2\n2024-01-01 00:00:00,1")
    with pytest.raises(ValueError, match="lacks TP3"):
        recordings.read_recording(spark, str(tmp_path / "bad.csv"))


def test_conditions_are_never_null(spark):
    df = spark.createDataFrame([(1.0, None), (None, None), (9.0, "off")], "v double, mode string")
    tree = {"any": [{"signal": "v", "op": "gt", "value": "top"}, {"all": [{"state": "off"}]}]}
    assert [r[0] for r in df.select(compile_condition(tree, {"top": 5.0})).collect()] == [False, False, True]
    assert [r[0] for r in df.select(compile_condition({"all": []})).collect()] == [True] * 3


def test_api(spark):
    df = spark.createDataFrame([(i, T0 + timedelta(minutes=i // 2), "a" if i % 3 else "b") for i in range(20)], "id long, sim_ts timestamp, backend string")
    first = api.read_page(df, "sim_ts", "id", 5, backend="a").collect()
    assert len(first) == 6
    at = first[4]
    rest = api.read_page(df, "sim_ts", "id", 5, (str(at.sim_ts), at.id), backend="a").collect()
    assert rest[0] == first[5]
    with pytest.raises(ValueError):
        api.read_page(df, "sim_ts", "id", 0)


def test_frames_are_emitted_at_minutes_states_and_resets(spark):
    t0 = 1_700_000_040
    rows = [(1, k, t0 + s, mode, reset) for k, (s, mode, reset) in enumerate([(0, "off", 0), (10, "off", 0), (20, "loaded", 0), (30, "loaded", 0), (60, "loaded", 0), (70, "loaded", 1), (80, "loaded", 0), (200, None, 0), (210, None, 0)])]
    frame = spark.createDataFrame(rows, "unit_id long, seq long, t long, mode string, reset int").withColumn("sim_ts", F.timestamp_seconds("t"))
    assert [r.seq for r in rules.emitted(frame).orderBy("seq").collect()] == [0, 2, 4, 5, 7]


def test_a_stale_frame_clears_timers(spark):
    t0 = 1_700_000_040
    held = {"r": rules.Rule(F.col("v") > 0, 30, "s", "low")}
    # the value v isn't one of the frozen tuple's signals; tp2 repeats at 40
    rows = [(1, 0, k, t0 + 10 * k, 1.0, None, float(tp2)) for k, tp2 in enumerate([1, 2, 3, 4, 4, 5, 6, 7, 8])]
    frame = spark.createDataFrame(rows, "unit_id long, segment long, seq long, t long, v double, guard string, tp2 double").withColumn("sim_ts", F.timestamp_seconds("t"))
    frame = frame.withColumns({c: F.lit(1.0) for c in rules.FROZEN if c != "tp2"})
    fired = lambda stale: [r.seq for r in rules.evaluate(frame, held, stale).where(F.size("rule_ids") > 0).orderBy("seq").collect()]
    assert fired(False) == [3, 4, 5, 6, 7, 8]
    assert fired(True) == [3, 8]
