"""Decisions: ties, nulls and empty inputs, by hand."""

from pyspark.sql import functions as F

from fathomline.operators import decisions as d

ANSWER = "k int, choice string, probabilities map<string,double>, support map<string,double>, severity map<string,double>"


def test_answers_break_ties_by_support(spark):
    sev = {"0": 0.4, "2": 0.4, "3": 0.2}
    rows = [
        (1, "a", {"a": 0.5, "b": 0.48}, {"a": 0.3, "b": 0.9}, sev),
        (2, "a", {"a": 0.6, "b": 0.4}, {"a": 0.3, "b": 0.9}, sev),
        (3, "a", {"a": 0.5, "none_of_these": 0.49}, {"a": 0.5}, sev),
        (4, "b", {"a": 0.5, "b": 0.5}, {"a": 0.7, "b": 0.7}, {"3": 1.0}),
        (5, "a", {"a": 1.0}, {}, None),
    ]
    out = d.read_answers(spark.createDataFrame(rows, ANSWER)).orderBy("k").collect()
    assert [(r.decided, r.tie_broken, r.inconsistent, r.level) for r in out] == [
        ("b", True, False, "low"),
        ("a", False, True, "low"),
        ("a", False, False, "low"),
        ("b", False, False, "critical"),
        ("a", False, False, None),
    ]


def test_probabilities_leave_the_rest_to_none_of_these(spark):
    s = spark.createDataFrame([(1, "a", 0.6), (1, "b", 0.2), (2, "a", 0.0)], "q int, o string, s double")
    out = {(r.q, r.o): round(r.probability, 6) for r in d.display_probabilities(s, "q", "o", "s").collect()}
    assert out == {(1, "a"): 0.5, (1, "b"): round(0.2 / 1.2, 6), (1, "none_of_these"): round(0.4 / 1.2, 6), (2, "a"): 0.0, (2, "none_of_these"): 1.0}


def test_hints_stages_and_observations(spark):
    df = spark.createDataFrame([(["x", "y"],), (["z"],), ([],)], "r array<string>")
    assert [r[0] for r in df.select(d.worst_hint(F.col("r"), {"x": "medium", "y": "high"})).collect()] == ["high", "low", "low"]
    entries = spark.createDataFrame([(1,), (2,)], "k int")
    scores = spark.createDataFrame([(2, 0.5), (3, 0.9)], "k int, score double")
    assert sorted(map(tuple, d.merge_stages(entries, {"text": scores}, "k").collect())) == [(1, 0.0), (2, 0.5)]
    seen = spark.createDataFrame([(1, 0, False, True, 9.0), (1, 1, True, False, 1.0), (1, 2, False, False, 99.0), (1, 3, False, True, 9.0)], "e int, index int, named boolean, moving boolean, magnitude double")
    assert [r["index"] for r in d.choose_observations(seen, "e", 2).orderBy("place").collect()] == [1, 0]


def test_recordset_of_null_and_damaged_text(spark):
    df = spark.createDataFrame([(1, '[{"a": 1}, {"a": null}]'), (2, None), (3, "[]"), (4, "no")], "k int, doc string")
    out = d.recordset(df, ["k"], "doc", "a int").collect()
    assert sorted((r.k, r.a or 0) for r in out if r.k < 4) == [(1, 0), (1, 1)]


def test_headlines_pass_only_if_some_are_wanted(spark):
    ids = spark.createDataFrame([("w2",), ("w1",)], "id string")
    none = ids.where("false")
    check = lambda w, f: tuple(d.headline_check(w, f, "id").first())
    assert check(ids, ids) == (["w1", "w2"], [], True)
    assert check(ids, none) == ([], ["w1", "w2"], False)
    assert check(none, ids) == ([], [], False)
