"""Query texts, ticket titles and active documents by hand."""

from pyspark.sql import functions as F

from fathomline.operators import rendering as r


def test_query_text(spark):
    events = spark.createDataFrame([(1, "oil_high", ["TP3 is 7.5 bar", " "], ["oil"], ["A2", "A9", "A1"]), (2, "no_entry", [], None, [])], "event_id int, symptom_key string, details array<string>, labels array<string>, alarm_codes array<string>")
    conditions = spark.createDataFrame([("oil_high", "Oil  hot (P4)", ["rises  (12)", None])], "symptom_key string, title string, symptoms array<string>")
    alarms = spark.createDataFrame([("A1", "first"), ("A2", "second")], "code string, title string")
    got = {x.event_id: x.text for x in r.query_texts(events, conditions, alarms).collect()}
    assert got == {1: "Oil hot (P) rises TP is . bar oil second first", 2: "no entry"}


def test_ticket_title(spark):
    entries = spark.createDataFrame([("F", "Leak", [("c1", "One"), ("c2", "Two"), ("c3", "Three")])], "fault_id string, name string, conditions array<struct<condition_id:string,title:string>>")
    rows = [(1, "F", "c3", "c2"), (2, "F", "x", "c2"), (3, "F", None, "y"), (4, "G", "c1", "c1")]
    got = r.ticket_titles(spark.createDataFrame(rows, "k int, fault_id string, ticket_symptom string, event_symptom string"), entries).orderBy("k").collect()
    assert [(x.k, x.condition_id, x.title) for x in got] == [(1, "c3", "Leak — Three"), (2, "c2", "Leak — Two"), (3, "c1", "Leak — One")]


def test_active_document(spark):
    rows = [("s", 10, 1, 5, 9, "succeeded"), ("s", 11, 2, 9, None, "succeeded"), ("s", 12, 3, 20, 30, "failed"), ("t", 13, 4, 1, 2, "running")]
    runs = spark.createDataFrame(rows, "site string, document_id int, run_id int, started long, finished long, status string")
    assert [tuple(x) for x in r.active_documents(runs, "site").collect()] == [("s", 11)]
    assert r.active_documents(runs.where(F.lit(False)), "site").count() == 0
