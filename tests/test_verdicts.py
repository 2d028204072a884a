"""Verdicts of scenarios by hand, at each of the three levels."""

import pytest

from fathomline.operators import verdicts as v

SCENARIO = "scenario string, kind string, expect_none boolean, max_false int, fault string, deadline_us long"
WINDOW = "scenario string, window_id int, from_us long, to_us long, accepted array<string>, deadline_us long"
TICKET = "scenario string, ticket_id int, opened_us long, level string, fault string, benign boolean"


def judged(spark, scenario, windows=(), suspects=(), tickets=()):
    case = {"kind": "positive", "expect_none": False, "max_false": 0, "fault": "listed", "deadline_us": None} | scenario
    s = spark.createDataFrame([("s", *(case[c] for c in ("kind", "expect_none", "max_false", "fault", "deadline_us")))], SCENARIO)
    w = spark.createDataFrame([("s", k, *x) for k, x in enumerate(windows)], WINDOW)
    e = spark.createDataFrame([("s", t) for t in suspects], "scenario string, t_us long")
    t = spark.createDataFrame([("s", k, *x) for k, x in enumerate(tickets)], TICKET)
    r = v.scenario_verdicts(s, w, e, t).first()
    return r.detection, r.review_diagnosis, r.diagnosis


W = [(10, 20, ["leak"], 15)]


@pytest.mark.parametrize(
    ("scenario", "windows", "suspects", "tickets", "want"),
    [
        ({}, W, [12], [(12, "ticket", "leak", False)], (True, True, True)),
        ({}, W, [12], [(12, "review", "leak", False)], (True, True, False)),  # passes at review only
        ({}, W, [16], [(20, "ticket", "leak", False)], (False, False, False)),  # too late, and behind the half-open end
        ({}, W, [12], [(12, "ticket", "belt", False), (13, "review", "leak", False)], (True, False, False)),  # one false ticket of none
        ({"max_false": 1}, W, [12], [(12, "ticket", "belt", False), (13, "review", "leak", False)], (True, True, False)),  # the first ticket names another fault
        ({"max_false": 1, "fault": "any"}, W, [12], [(12, "ticket", "belt", False), (13, "review", "leak", False)], (True, True, True)),
        ({"fault": "benign_or_none"}, W, [12], [(12, "ticket", "dust", True), (13, "review", "leak", False)], (True, True, True)),
        ({"deadline_us": 12}, W, [12], [(13, "ticket", "leak", False)], (True, False, False)),
        ({"kind": "negative", "expect_none": True}, [], [], [], (True, True, True)),
        ({"kind": "negative", "expect_none": True}, [], [5], [(5, "ticket", "dust", True)], (False, True, True)),
        ({"kind": "negative", "expect_none": True}, [], [], [(5, "ticket", "leak", False)], (True, False, False)),
        ({"kind": "benign"}, W, [], [(12, "ticket", "leak", False)], (True, True, True)),
        ({}, [*W, (11, 30, ["leak", "belt"], None)], [29], [(12, "ticket", "belt", False), (12, "ticket", "leak", False)], (True, True, True)),  # windows overlap
        ({"fault": "any"}, W, [12], [], (True, False, False)),
    ],
)
def test_scenario(spark, scenario, windows, suspects, tickets, want):
    assert judged(spark, scenario, windows, suspects, tickets) == want


def test_gate_counts_missing_as_failed(spark):
    done = spark.createDataFrame([(k, k != 9) for k in range(9)] + [(9, False)], "scenario int, detection boolean")
    expected = spark.createDataFrame([("a", k, k < 6) for k in range(10)] + [("b", k, k < 106) for k in range(100, 110)], "gate string, scenario int, positive boolean")
    got = {r.gate: tuple(r)[1:] for r in v.core_gate(done, expected, "detection").collect()}
    assert got == {"a": (9, 10, 6, 0, True), "b": (0, 10, 0, 10, False)}


def test_design_reading(spark):
    targets = spark.createDataFrame([("s", ["leak"]), ("none", ["leak"])], "scenario string, accepted array<string>")
    episodes = spark.createDataFrame([("s", 10, 20), ("s", 15, 30)], "scenario string, from_us long, to_us long")
    tickets = spark.createDataFrame([("s", 1, 16, "review", "belt", False), ("s", 2, 17, "ticket", "leak", False), ("s", 3, 18, "ticket", "dust", True), ("s", 4, 30, "ticket", "leak", False)], TICKET)
    got = {(r.scenario, r.level): tuple(r)[2:] for r in v.design_reading(targets, episodes, tickets).collect()}
    assert got == {("s", "review"): (1, 1, 1, 1, 1, False), ("s", "ticket"): (1, 0, 1, 1, 2, True), ("none", "review"): (0, 0, 0, 0, None, False), ("none", "ticket"): (0, 0, 0, 0, None, False)}
    decided = spark.createDataFrame([("s", 1, 12, "leak"), ("s", 2, 16, "leak"), ("s", 3, 16, "none_of_these"), ("s", 4, 40, "belt")], "scenario string, decision_id int, t_us long, choice string")
    assert {(r.choice, r.n, r.on_target) for r in v.design_choices(targets, episodes, decided).collect()} == {("leak", 2, True), ("none_of_these", 1, False)}


def test_parts_are_not_put_together_by_their_size(spark):
    """All joins of a scenario's tables run in one stage, so its parts stay as many as the session's."""
    tables = [spark.createDataFrame(rows, ddl) for rows, ddl in (
        ([(str(k), "positive", False, 0, "listed", None) for k in range(40)], SCENARIO),
        ([(str(k), k, 10, 20, ["leak"], 15) for k in range(40)], WINDOW),
        ([(str(k), 12) for k in range(40)], "scenario string, t_us long"),
        ([(str(k), k, 12, "ticket", "leak", False) for k in range(40)], TICKET),
    )]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        made = v.scenario_verdicts(*tables)
        assert made.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
        assert {tuple(r)[2:] for r in made.collect()} == {(True, True, True)}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
