"""Alarm messages, judged moves and the day history against plain loops and hand-made cases."""

import random

import pytest
from pyspark.sql import functions as F

from fathomline.operators import alarms as al
from fathomline.operators import day_history as dh
from fathomline.operators import stateful
from fathomline.operators import decisions, retrieval
from fathomline.operators.matching import DIRECTIONS, judged_scores, verdict

S = 1_000_000
WIDE = "unit_id long, segment long, seq long, t_us long, mode string, v double"


def changes(spark, message, samples):
    """samples: (segment, second, mode, v)."""
    rows = [(1, seg, k, t * S, mode, None if v is None else float(v)) for k, (seg, t, mode, v) in enumerate(samples)]
    registry = al.alarm_registry(spark, [{"code": "A", "bit": 4, "signal": "v", "op": "gt", "threshold": 10} | message])
    states = al.alarm_states(spark.createDataFrame(rows, WIDE), registry, ["v"])
    return [(r.t_us // S, r.on) for r in al.alarm_changes(states).orderBy("t_us", "seq").collect()]


def at(*values, mode="loaded", seg=0, start=0):
    return [(seg, start + 10 * k, mode, v) for k, v in enumerate(values)]


@pytest.mark.parametrize(
    ("message", "samples", "want"),
    [
        ({}, at(10, 11, 10), [(10, True), (20, False)]),  # strictly above, at once
        ({"delay_s": 20}, at(11, 11, 9, 11, 11, 11, 9), [(50, True), (60, False)]),  # a dip starts the delay anew
        ({"hysteresis": 3}, at(11, 9, 8, 7, 9, 11), [(0, True), (30, False), (50, True)]),  # clears at the band, raises at the threshold
        ({"hysteresis": 3, "op": "lt"}, at(9, 12, 13, 12), [(0, True), (20, False)]),
        ({"hysteresis": 3, "delay_s": 20}, at(11, 9, 11, 11, 11, 8, 11, 7), [(40, True), (70, False)]),  # no band before it is on
        ({"guard": "off"}, [*at(11, 11), *at(11, mode="off", start=20), *at(11, start=30)], [(20, True), (30, False)]),
        ({"guard": "running"}, [*at(11, mode="off"), *at(11, mode="unloaded", start=10), *at(11, mode=None, start=20)], [(10, True), (20, False)]),
        ({"mask_s": 20}, [*at(11, mode="off"), *at(11, 11, 11, start=10)], [(0, True), (10, False), (30, True)]),  # hidden after a motor start
        ({"mask_s": 20}, at(11), [(0, True)]),  # no start was seen
        ({"reset": "manual"}, at(11, 0, 0), [(0, True)]),  # latches
        ({"reset": "manual"}, [*at(11, 0), *at(0, seg=1, start=1000)], [(0, True), (1000, False)]),  # until a discontinuity
        ({"delay_s": 20}, [*at(11, 11), *at(11, 11, 11, seg=1, start=20)], [(40, True)]),  # timers start anew
        ({"delay_s": 20}, [*at(11, 11, 11), *at(11, 9, seg=1, start=1000)], [(20, True), (1010, False)]),  # but what is on stays on
        ({}, at(11, None, float("nan"), 11), [(0, True), (10, False), (30, True)]),  # a missing value holds nothing
        ({}, [], []),
    ],
)
def test_one_message(spark, message, samples, want):
    assert changes(spark, message, samples) == want


def test_parts_of_time_carry_all_that_runs_through_a_history(spark, monkeypatch):
    """Whatever the cuts, states are those of one part; and no window over samples holds a unit's whole time."""
    r = random.Random(8)
    rows = []
    for unit in (1, 2, None):
        t, seg, v, mode = 0, 0, 9.0, "off"
        for k in range(300):
            step = r.choice([1, 5, 5, 5, 40])
            t, seg = t + step * S, seg + (step == 40 and r.random() < 0.3)
            v = r.choice([v, v, v, v, v, 8.0, 9.0, 11.0, 11.0, None])
            mode = r.choice([mode] * 9 + ["off", "loaded", "unloaded", None])
            rows.append((unit, seg, k, t, mode, v))
    base = {"signal": "v", "op": "gt", "threshold": 10}
    kinds = [{}, {"delay_s": 60}, {"delay_s": 30, "hysteresis": 1.5, "reset": "manual"}, {"hysteresis": 2, "delay_s": 20, "guard": "running", "mask_s": 90}, {"op": "lt", "delay_s": 25, "hysteresis": -1, "reset": "manual"}]
    registry = al.alarm_registry(spark, [{**base, "code": f"A{k}", "bit": k, **kind} for k, kind in enumerate(kinds)])
    found = []
    for parts in (1, 23, 400):
        monkeypatch.setattr("fathomline.operators.chunks.PARTS", parts)
        states = al.alarm_states(spark.createDataFrame(rows, WIDE), registry, ["v"])
        found.append((sorted(map(str, states.collect())), sorted(map(str, al.alarm_changes(states).collect()))))
    assert found[0] == found[1] == found[2] and len(found[0][1]) > 50
    from fathomline.operators import telemetry

    tel = spark.createDataFrame([(u, k, t, m) for u, _, k, t, m, _ in rows], "unit_id long, seq long, t long, mode string").selectExpr("unit_id", "seq", "timestamp_micros(t) as sim_ts")
    assert sorted(map(str, telemetry.with_steps_in_parts(tel, 30).drop("chunk").select("unit_id", "seq", "dt", "gap", "segment").collect())) == sorted(map(str, telemetry.with_steps(tel, 30).select("unit_id", "seq", "dt", "gap", "segment").collect()))


def test_codes_come_by_bit_and_registry_is_checked(spark):
    ok = [{"code": "B", "bit": 9, "signal": "v", "op": "gt", "threshold": "limit"}, {"code": "C", "bit": 2, "signal": "v", "op": "ge", "threshold": 1}]
    registry = al.alarm_registry(spark, ok, {"limit": 5})
    rows = spark.createDataFrame([(1, 0, 0, 0, "off", 9.0), (1, 0, 1, 1, "off", 2.0), (1, 0, 2, 2, "off", 0.0)], WIDE)
    assert [r.codes for r in al.alarm_codes(al.alarm_states(rows, registry, ["v"])).orderBy("seq").collect()] == [["C", "B"], ["C"], []]
    for wrong in ({"threshold": "nowhere"}, {"guard": "idle"}, {"op": "=="}, {"reset": "never"}):
        with pytest.raises(ValueError):
            al.alarm_registry(spark, [ok[1] | wrong])
    with pytest.raises(ValueError):
        al.alarm_registry(spark, [ok[1], ok[1] | {"bit": 3}])


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_hysteresis_windows_equal_the_fold(spark, seed):
    r = random.Random(seed)
    rows = []
    for unit in range(3):
        t = 0
        for k in range(400):
            t += r.choice([10, 60, 60, 60, 9000 if r.random() < 0.2 else 10])
            rows.append((unit, k, t * S, r.choice([30.0, 45.0, 55.0, 70.0, 80.0, None, float("nan")])))
    samples = spark.createDataFrame(rows, stateful.SAMPLE)
    want = stateful.run_batch(samples, stateful.Hysteresis(60.0, 40.0, 100, 3600))
    got = al.hysteresis_events(samples, 60.0, 40.0, 100, 3600)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert {x.kind for x in want.collect()} == {"raise", "clear", "reset"}


@pytest.mark.parametrize(
    ("direction", "level", "trend", "usual", "want"),
    [
        ("high", "far_above_normal", "flat", None, "match"), ("high", "below_normal", "rising", None, "contradiction"), ("high", "normal", "rising", None, "silent"),
        ("falls", "normal", "falling_sharply", None, "match"), ("falls", "above_normal", "falling", None, "match"), ("falls", "normal", "rising", None, "contradiction"), ("falls", "normal", "erratic", None, "silent"),
        ("unchanged", "normal", "flat", None, "match"), ("unchanged", "normal", "stuck", None, "contradiction"),
        ("fluctuates", "normal", "erratic", None, "match"), ("fluctuates", "above_normal", "stuck", None, "contradiction"), ("fluctuates", "normal", "rising", None, "silent"),
        ("on", "above_normal", "flat", None, "match"), ("on", "below_normal", "flat", True, "contradiction"), ("on", "normal", "flat", True, "silent"), ("on", "normal", "rising", True, "match"), ("off", "normal", "flat", None, "silent"), ("off", "normal", "flat", True, "contradiction"),
        ("stays_on", "above_normal", "rising", None, "contradiction"), ("stays_on", "above_normal", "flat", None, "match"), ("stays_off", "normal", "flat", False, "silent"),
        ("toggles", "normal", "erratic", None, "match"), ("toggles", "normal", "stuck", None, "contradiction"), ("toggles", "normal", "flat", None, "silent"), ("toggles", "above_normal", "flat", None, "contradiction"),
        ("no_pulse", "normal", "stuck", None, "match"), ("no_pulse", "normal", "falling", None, "contradiction"), ("no_pulse", "normal", "flat", None, "silent"), ("no_pulse", "below_normal", "flat", None, "match"),
        ("not_reached", "below_normal", "flat", None, "match"), ("high", None, "flat", None, "silent"), ("sideways", "normal", "flat", None, None),
    ],
)
def test_judgements(spark, direction, level, trend, usual, want):
    row = spark.createDataFrame([(direction, level, trend, usual)], "d string, l string, t string, u boolean")
    assert row.select(verdict(F.col("d"), F.col("l"), F.col("t"), F.col("u"))).first()[0] == want


def test_silence_divides_and_scores_stay_in_range(spark):
    moves = spark.createDataFrame([("F", s, d) for s, d in (("a", "high"), ("b", "high"), ("c", "rises"), ("d", "low"))] + [("G", "a", "low")], "fault string, signal string, direction string")
    seen = spark.createDataFrame([(1, "a", "above_normal", "flat", None), (1, "b", "below_normal", "flat", None), (1, "c", "normal", "flat", None)], "event int, signal string, level string, trend string, usual boolean")
    got = {r.fault: (r.matches, r.contradictions, r.silent, r.score) for r in judged_scores(moves, seen).collect()}
    assert got == {"F": (1, 1, 2, 0.125), "G": (0, 1, 0, 0.0)}
    assert len(DIRECTIONS) == 21


def plain_history(cycles, quiet):
    """The day history of one unit as a loop."""
    entries, out = [], []
    for end, cutout, idle, decay, fast in cycles:
        if decay is None or idle > 6 * 3600:
            continue
        entries.append((end, decay, (cutout + end) // 2 // S // 3600 % 24 in quiet, fast))
        entries = [e for e in entries if e[0] > end - 86400 * S]
        first = next((k for k in range(len(entries) - 2) if all(e[3] for e in entries[k : k + 3])), None)
        since = entries[first or 0 :]
        level = lambda side: sorted(e[1] for e in [x for x in since if x[2] == side][-5:]) if sum(x[2] == side for x in since) >= 3 else None  # noqa: E731, B023
        mid = lambda s: s and (s[(len(s) - 1) // 2] + s[len(s) // 2]) / 2
        out.append((end, None if first is None else entries[first][0], mid(level(True)), mid(level(False))))
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_day_history_equals_a_loop(spark, seed):
    r = random.Random(seed)
    t, cycles = 1_700_000_000, []
    for _ in range(300):
        t += r.choice([900, 3000, 6000, 80_000 if r.random() < 0.1 else 1500])
        idle = r.choice([600, 2000, 30_000 if r.random() < 0.1 else 900])
        cycles.append((t * S, (t - idle) * S, idle, None if r.random() < 0.05 else r.randrange(100) / 100, r.random() < 0.6))
    quiet = {0, 1, 2, 3, 22, 23}
    rows = [(u, c, e, i, d, f) for u in (1, 2) for e, c, i, d, f in cycles]
    got = dh.day_decay(spark.createDataFrame(rows, "unit_id long, cutout_us long, end_us long, idle_s long, decay double, fast boolean"), F.array(*map(F.lit, sorted(quiet))))
    want = plain_history(cycles, quiet)
    for unit in (1, 2):
        assert [tuple(x)[1:] for x in got.where(F.col("unit_id") == unit).orderBy("end_us").collect()] == want
    assert sum(w[1] is not None for w in want) > 50 and sum(w[2] is not None for w in want) > 20


def test_quiet_hours(spark):
    of = lambda counts: spark.createDataFrame([(counts,)], "c array<long>").select(dh.quiet_hours_of(F.col("c"))).first()[0]
    assert of([5] * 24) == []
    assert of([0, 4, 5, *[10] * 21]) == [0, 1]


def test_scores_of_an_event_are_dealt_once(spark):
    """The observations are dealt by event before they meet the moves, and what is made of an event's faults stays there."""
    moves = spark.createDataFrame([("F1", "a", "rises"), ("F1", "b", "high"), ("F2", "a", "falls")], "fault string, signal string, direction string")
    seen = spark.createDataFrame([(1, "a", "above_normal", "rising", None), (1, "b", "normal", "flat", None), (2, "a", "normal", "falling", True)], "event long, signal string, level string, trend string, usual boolean")
    scores = judged_scores(moves, seen)
    for made in (scores, retrieval.decide(scores, "event", "fault", "score"), decisions.display_probabilities(scores, "event", "fault", "score")):
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert plan.count("hashpartitioning(event#") == 1 and "SortMergeJoin" not in plan
    assert {(r.event, r.fault): (r.matches, r.contradictions, r.silent, r.score) for r in scores.collect()} == {(1, "F1"): (1, 0, 1, 0.5), (1, "F2"): (0, 1, 0, 0.0), (2, "F1"): (0, 1, 1, 0.0), (2, "F2"): (1, 0, 0, 1.0)}
