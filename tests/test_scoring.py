"""Confusion of tickets and comparison of backends by hand."""

from datetime import datetime, timedelta

from fathomline.operators import intervals

T0 = datetime(2024, 1, 1)
H = lambda h: T0 + timedelta(hours=h)


def test_confusion(spark):
    windows = spark.createDataFrame([(1, 0, H(0), H(10), "leak"), (2, 0, H(20), H(30), "leak")], "window_id long, unit_id long, from_ts timestamp, to_ts timestamp, accepted string")
    excluded = spark.createDataFrame([(0, H(40), H(50))], "unit_id long, from_ts timestamp, to_ts timestamp")
    rows = [(1, 1, "belt"), (2, 2, "leak"), (3, 3, "leak"), (4, 4, "dust"), (5, 21, "leak"), (6, 22, "belt"), (7, 23, "leak"), (8, 45, "belt"), (9, 46, "dust"), (10, 60, "dust"), (11, 60, "leak"), (12, 10, "leak")]
    tickets = spark.createDataFrame([(k, 0, H(h), fault) for k, h, fault in rows], "ticket_id long, unit_id long, opened timestamp, fault string")
    got = {r.ticket_id: (r.verdict, r.recovered) for r in intervals.confusion(tickets, windows, excluded, ["dust"]).collect()}
    want = {1: "misdiagnosed", 2: "tp", 3: "duplicate", 4: "benign", 5: "tp", 6: "misdiagnosed", 7: "duplicate", 8: "ignored", 9: "ignored", 10: "benign", 11: "fp", 12: "fp"}
    assert got == {k: (v, k == 2) for k, v in want.items()}  # only the second comes after a misdiagnosis of its window


def test_comparison(spark):
    rows = [("a", 1, "recall", 1.0), ("a", 1, "recall", 0.0), ("a", 2, "recall", 1.0), ("b", 1, "recall", 0.75), ("c", 1, "recall", None), ("c", 1, "recall", 0.1), ("a", 1, "cost", 2.0), ("b", 1, "cost", 1.0), ("c", 1, "cost", 1.0)]
    got = {(r.metric, r.backend): (r.cases, r["mean"], r.place) for r in intervals.comparison(spark.createDataFrame(rows, "backend string, case int, metric string, v double"), ["cost"]).collect()}
    assert got == {("recall", "a"): (2, 0.75, 1), ("recall", "b"): (1, 0.75, 1), ("recall", "c"): (1, 0.1, 3), ("cost", "a"): (1, 2.0, 3), ("cost", "b"): (1, 1.0, 1), ("cost", "c"): (1, 1.0, 1)}
