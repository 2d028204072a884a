"""Tickets: each transition by hand, and a stream that gives the rows of the batch."""

import random

import pytest
from pyspark.sql import functions as F

from fathomline.operators.tickets import EVENTS, ticket_changes
from fathomline.streaming.machines import read_events, ticket_stream

SCHEMA = "unit_id long, episode_id long, t_us long, seq long, kind string, choice string, outcome string"
S = 1_000_000


def changes(spark, events, **options):
    rows = [(1, e, t * S, k, kind, choice, outcome) for k, (e, t, kind, choice, outcome) in enumerate(events)]
    got = ticket_changes(spark.createDataFrame(rows, SCHEMA), **options).orderBy("t_us", "seq", F.col("action") != "merged").collect()
    return [(r.t_us // S, r.episode_id, r.ticket_id, r.action, r.status, r.fault, r.updates, r.live) for r in got]


def test_review_is_promoted_updated_and_resolved(spark):
    events = [(7, 0, "decision", "leak", "log"), (7, 1, "decision", "leak", "review"), (7, 2, "decision", None, "ticket"), (7, 3, "decision", "none_of_these", "ticket"), (7, 4, "decision", "belt", "ticket"), (7, 5, "decision", "belt", "log"), (7, 6, "end", None, None), (7, 7, "decision", "belt", "ticket"), (7, 8, "end", None, None)]
    assert changes(spark, events) == [(1, 7, 7, "opened", "review", "leak", 0, 1), (4, 7, 7, "promoted", "open", "belt", 1, 1), (5, 7, 7, "updated", "open", "belt", 2, 1), (6, 7, 7, "resolved", "resolved", "belt", 2, 0)]


def test_technician_closes_once_and_for_all(spark):
    events = [(7, 0, "close", None, None), (7, 1, "decision", "leak", "ticket"), (7, 2, "close", None, None), (7, 3, "close", None, None), (7, 4, "decision", "leak", "ticket"), (8, 5, "decision", "leak", "ticket"), (8, 6, "end", None, None), (8, 7, "close", None, None)]
    got = changes(spark, events)
    assert [(t, e, a) for t, e, _, a, *_ in got] == [(1, 7, "opened"), (2, 7, "closed"), (5, 8, "opened"), (6, 8, "resolved"), (7, 8, "closed")]


def test_same_fault_merges_until_the_target_ends(spark):
    events = [(7, 0, "decision", "leak", "ticket"), (8, 1, "decision", "leak", "log"), (8, 2, "decision", "leak", "review"), (9, 3, "decision", "belt", "review"), (8, 4, "decision", "belt", "review"), (8, 5, "end", None, None), (10, 6, "decision", "belt", "review"), (7, 7, "end", None, None), (10, 8, "decision", "belt", "review")]
    assert changes(spark, events) == [
        (0, 7, 7, "opened", "open", "leak", 0, 1),
        (2, 8, 7, "merged", "open", "leak", 0, 1),
        (2, 8, 7, "updated", "open", "leak", 1, 1),
        (3, 9, 9, "opened", "review", "belt", 0, 2),
        (4, 8, 7, "updated", "open", "belt", 2, 2),  # a merged episode stays with its target
        (6, 10, 7, "merged", "open", "belt", 2, 2),  # the first open one of that fault
        (6, 10, 7, "updated", "open", "belt", 3, 2),
        (7, 7, 7, "resolved", "resolved", "belt", 3, 1),
        (8, 10, 10, "opened", "review", "belt", 0, 2),  # its target has ended
    ]


def test_silence_ends_an_episode_at_its_moment(spark):
    events = [(7, 0, "decision", "leak", "ticket"), (8, 30, "decision", "belt", "ticket"), (8, 200, "decision", "belt", "ticket")]
    got = changes(spark, events, silence_s=100, until_us=299 * S)
    assert [(t, e, a) for t, e, _, a, *_ in got] == [(0, 7, "opened"), (30, 8, "opened"), (100, 7, "resolved"), (130, 8, "resolved")]
    assert changes(spark, [], silence_s=100, until_us=1) == []


@pytest.mark.parametrize("seed", [1, 2])
def test_stream_equals_batch(spark, tmp_path, seed):
    r = random.Random(seed)
    rows, t = [], 0
    for k in range(400):
        t += r.choice([1, 5, 20, 200])
        unit = r.randrange(6)
        kind = r.choice(["decision"] * 8 + ["end", "close"])
        rows.append((unit, unit * 1000 + k // 50 * 10 + r.randrange(3), t * S, k, kind, r.choice(["leak", "belt", "none_of_these", None]), r.choice(["ticket", "review", "log"])))
    for k in range(4):
        part = spark.createDataFrame(rows[k * 100 : k * 100 + 100], SCHEMA).withColumn("ts", F.timestamp_micros("t_us"))
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    stream = ticket_stream(read_events(spark, str(tmp_path / "in"), schema), silence_s=600, lateness="0 seconds")
    q = stream.writeStream.format("memory").queryName(f"tickets{seed}").option("checkpointLocation", str(tmp_path / "check")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    # a timer fires once the watermark is past it, in whole milliseconds
    batch = ticket_changes(spark.createDataFrame(rows, SCHEMA), silence_s=600, until_us=t * S - 1)
    names = [c for c in batch.columns]
    got = sorted(map(tuple, spark.table(f"tickets{seed}").select(names).collect()), key=repr)
    want = sorted(map(tuple, batch.collect()), key=repr)
    assert got == want
    assert {r[5] for r in want} == {"opened", "updated", "promoted", "merged", "resolved", "closed"}
    assert set(EVENTS) < set(schema.names)
