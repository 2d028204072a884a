"""Operators on small synthetic frames with expectations worked out by hand."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from fathomline.operators import intervals, retrieval, stateful, tables, telemetry
from fathomline.operators.text import chunks
from fathomline.streaming.machines import deduplicated, machine_stream, minute_stream, read_events, upsert_sink

T0 = datetime(2024, 1, 1)
SAMPLE = "unit_id long, seq long, sim_ts timestamp, tag string, v double, intake_closed boolean, load_valve boolean, motor_current double"


def waveform(spark, modes, step=10, unit=1):
    """One sample every ten seconds in the given modes."""
    rows = [(unit, i, T0 + timedelta(seconds=i * step), "p", float(i), m != "L", m == "L", {"L": 6.0, "U": 3.0, "O": 0.0}[m]) for i, m in enumerate(modes)]
    return spark.createDataFrame(rows, SAMPLE)


def test_runs_and_cycles(spark):
    tel = waveform(spark, "UULLLUUOOLLUUL")
    runs = [(r["mode"], r.n) for r in telemetry.state_runs(tel).orderBy("run_id").collect()]
    assert runs == [("unloaded", 2), ("loaded", 3), ("unloaded", 2), ("off", 2), ("loaded", 2), ("unloaded", 2), ("loaded", 1)]
    cycles = [(r.loaded_s, r.unloaded_s, r.off_s, r.cutout_v) for r in telemetry.load_cycles(tel).orderBy("cycle").collect()]
    assert cycles == [(30.0, 20.0, 20.0, 4.0), (20.0, 20.0, 0.0, 10.0)]  # the third never closed


def test_results_do_not_depend_on_partitioning(spark):
    tel = waveform(spark, "UULLLUUOOLLUUL" * 5).unionByName(waveform(spark, "LLLUUO" * 8, unit=2))
    for f in (telemetry.minute_aggregate, telemetry.state_runs, telemetry.load_cycles, telemetry.since_change):
        a, b = f(tel.repartition(1)).collect(), f(tel.orderBy(F.rand(3)).repartition(5)).collect()
        assert sorted(map(str, a)) == sorted(map(str, b))


def test_held_islands_are_dated_from_their_start(spark):
    tel = waveform(spark, "LLLLLULLU")
    out = telemetry.held(telemetry.with_state(tel), F.col("mode") == "loaded", 30).collect()
    assert [(r.n, r.to_us - r.from_us) for r in out] == [(5, 40_000_000)]


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_interval_algebra(spark):
    h = lambda x: T0 + timedelta(hours=x)
    w = frame(spark, [(1, 1, h(0), h(2), "a"), (2, 1, h(2), h(3), "b"), (3, 1, h(5), h(9), "a"), (4, 1, h(6), h(7), "b"), (5, 1, h(8), h(8), "a")], "window_id long, unit_id long, from_ts timestamp, to_ts timestamp, accepted string")
    islands = intervals.union(w)
    assert sorted((r.from_ts, r.to_ts) for r in islands.collect()) == [(h(0), h(3)), (h(5), h(9))]
    assert [(r.from_ts, r.to_ts) for r in intervals.holes(islands).collect()] == [(h(3), h(5))]
    t = frame(spark, [(10, 1, h(1), "a"), (11, 1, h(1.5), "a"), (12, 1, h(6.5), "b"), (13, 1, h(4), "a"), (14, 1, h(2), "a"), (15, 2, h(1), "a")], "ticket_id long, unit_id long, opened timestamp, fault string")
    verdict = {r.ticket_id: (r.window_id, r.verdict) for r in intervals.match_tickets(t, w).collect()}
    assert verdict == {10: (1, "tp"), 11: (1, "duplicate"), 12: (4, "tp"), 13: (None, "fp"), 14: (2, "misdiagnosed"), 15: (None, "fp")}
    scores = {r.fault: (r.tp, r.fp, r.fn, r.precision, r.recall) for r in intervals.precision_recall(intervals.match_tickets(t, w), w).collect()}
    assert scores["a"] == (1, 3, 2, 0.25, 0.333333) and scores["b"] == (1, 0, 1, 1.0, 0.5)


def test_retrieval(spark):
    s = frame(spark, [("x", 1, 0.9), ("x", 2, 0.8), ("x", 3, 0.0), ("y", 2, 0.5)], "stage string, id long, score double")
    fused = {r.id: (round(r.rrf, 6), r.stages) for r in retrieval.fuse(s, "id", "stage", "score").collect()}
    assert fused == {1: (round(1 / 61, 6), 1), 2: (round(1 / 62 + 1 / 61, 6), 2)}
    d = frame(spark, [(1, "a", 0.9), (1, "b", 0.75), (2, "a", 0.2), (3, "c", 0.5)], "event long, fault string, score double")
    got = {r.event: (r.choice, round(r.confidence, 3), r.abstained) for r in retrieval.decide(d, "event", "fault", "score").collect()}
    assert got == {1: ("a", 0.45, False), 2: ("none_of_these", 0.0, True), 3: ("c", 0.5, False)}
    c = frame(spark, [(1, "3.2.1"), (2, "3.20"), (3, "4")], "chunk long, ref string")
    filed = frame(spark, [("3.2", "leak"), ("3", "any")], "section string, cause string")
    assert sorted((r.chunk, r.cause) for r in retrieval.prefix_join(c, filed, "ref").collect()) == [(1, "any"), (1, "leak"), (2, "any")]


def test_tables(spark):
    old = frame(spark, [(1, 1, "a"), (2, 1, "b")], "k long, ver long, v string")
    new = frame(spark, [(2, 2, "c"), (3, 1, "d")], "k long, ver long, v string")
    assert sorted((r.k, r.v) for r in tables.upsert(old, new, ["k"], ["ver"]).collect()) == [(1, "a"), (2, "c"), (3, "d")]
    assert sorted((r.k, r.v) for r in tables.insert_ignore(old, new, ["k"]).collect()) == [(1, "a"), (2, "b"), (3, "d")]


def test_chunks_overlap_by_a_sentence(spark):
    docs = frame(spark, [(1, "One two three. Four five six. Seven eight. Nine."), (2, None), (3, "")], "doc_id long, text string")
    got = [(r.chunk, r.text) for r in chunks(docs, 4).orderBy("chunk").collect()]
    assert got[0] == (0, "One two three. Four five six") and got[1][1].startswith("Four five six. Seven eight")


def test_stream_equals_batch(spark, tmp_path):
    """Samples delivered file by file, one file twice, give what one batch gives."""
    tel = waveform(spark, "ULLUOLLLUUOLUULL" * 12)
    tel = tel.withColumn("v", (F.col("seq") * 37 % 23).cast("double")).withColumn("ts", F.col("sim_ts"))
    for i in range(4):
        part = tel.where((F.col("seq") >= i * 48) & (F.col("seq") < (i + 1) * 48)).coalesce(1)
        part.write.mode("append").parquet(str(tmp_path / "in"))
    stream = read_events(spark, str(tmp_path / "in"), tel.schema, 4)
    machine = stateful.Hysteresis(15, 5, 0, 3600)
    samples = lambda df: df.select("unit_id", "seq", F.unix_micros("sim_ts").alias("t_us"), "v")

    def drain(df, name):
        q = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
        return spark.table(name).collect()

    got = drain(machine_stream(samples(stream), machine), "events_out")
    want = stateful.run_batch(samples(tel), machine).collect()
    assert sorted(got) == sorted(want) and want
    twice = drain(deduplicated(stream.unionByName(stream)).select("unit_id", "seq"), "dedup_out")
    assert len(twice) == tel.count()
    minutes = {(r.minute, r.n, r.last_v) for r in drain(minute_stream(stream), "minutes_out")}
    assert minutes <= {(r.minute, r.n, r.last_v) for r in telemetry.minute_aggregate(tel).collect()}


def test_upsert_sink_keeps_the_latest(spark, tmp_path):
    write = upsert_sink(str(tmp_path), ["k"], ["ver"])
    write(frame(spark, [(1, 1, "a"), (1, 2, "b")], "k long, ver long, v string"), 0)
    write(frame(spark, [(1, 3, "c"), (2, 1, "d")], "k long, ver long, v string"), 1)
    write(frame(spark, [(1, 3, "c"), (2, 1, "d")], "k long, ver long, v string"), 1)
    assert sorted((r.k, r.v) for r in spark.read.parquet(str(tmp_path / "v1")).collect()) == [(1, "c"), (2, "d")]
