"""Seeded hashes against published vectors, draws against their distribution, overlays and delivery by hand and as a stream."""

import random

import pytest
from pyspark.sql import functions as F

from fathomline.functions import hashing as h
from fathomline.operators.delivery import accepted, accepted_stream
from fathomline.operators.overlays import overlaid
from fathomline.streaming.machines import read_events

S = 1_000_000


def test_published_vectors(spark):
    known = {"": "cbf29ce484222325", "a": "af63dc4c8601ec8c", "b": "af63df4c8601f1a5", "foobar": "85944171f73967e8", "chongo was here!\n": "46810940eff5f915"}
    rows = spark.createDataFrame([(k,) for k in [*known, None, "é"]], "t string")
    got = {r.t: r.x for r in rows.select("t", F.lower(F.lpad(F.hex(h.fnv1a(F.col("t"))), 16, "0")).alias("x")).collect()}
    want = 14695981039346656037
    for byte in "é".encode():
        want = ((want ^ byte) * 1099511628211) % 2**64
    assert got == known | {None: None, "é": f"{want:016x}"}


def test_numbers_and_texts_chain(spark):
    def plain(data):
        x = 14695981039346656037
        for byte in data:
            x = ((x ^ byte) * 1099511628211) % 2**64
        return x - (1 << 64) if x >= 1 << 63 else x

    r = spark.range(1).select(h.fnv1a_long(F.lit(1_706_614_098_567)).alias("n"), h.fnv1a_long(F.lit(7).cast("long"), h.fnv1a(F.lit("id")), 4).alias("c")).first()
    assert r.n == plain((1_706_614_098_567).to_bytes(8, "big")) and r.c == plain(b"id" + (7).to_bytes(4, "big"))


def test_draws(spark):
    df = spark.range(20_000).select(h.noise_draw(F.lit("x"), F.col("id") * 1000, 0).alias("n"), h.noise_draw(F.lit("x"), F.col("id") * 1000, 1).alias("m"), h.ambient_noise(F.col("id") * 60_000).alias("a"))
    r = df.agg(F.avg("n"), F.stddev("n"), F.corr("n", "m"), F.min("a"), F.max("a"), F.count_if(F.isnan("n"))).first()
    assert abs(r[0]) < 0.05 and abs(r[1] - 1) < 0.05 and abs(r[2]) < 0.05 and -0.3 <= r[3] < r[4] <= 0.3 and r[5] == 0
    assert df.orderBy("n").limit(5).collect() == df.repartition(7).orderBy("n").limit(5).collect()


def shown(spark, op, values, **given):
    over = {"amount": 2.0, "cap": 3.0, "value": None, "up": 0.0, "hold": 50.0, "down": 0.0} | given
    rows = [(1, "t", k, 10 * k * S, float(v) if v is not None else None, "i", op, over["amount"], over["cap"], over["value"], 20 * S, over["up"], over["hold"], over["down"]) for k, v in enumerate(values)]
    schema = "unit_id long, tag string, seq long, t_us long, v double, instance string, op string, amount double, cap double, value double, from_us long, ramp_in_s double, hold_s double, ramp_out_s double"
    return [r.shown for r in overlaid(spark.createDataFrame(rows, schema)).orderBy("seq").collect()]


def test_overlays(spark):
    v = [1, 2, 3, 4, 5, 6, 7, 8, 9]
    assert shown(spark, "stuck", v) == [1, 2, 3, 3, 3, 3, 3, 8, 9]
    assert shown(spark, "stuck", [1, 2, None, 4, 5, 6, 7, 8, 9])[2:5] == [None, 4, 4]
    assert shown(spark, "stuck", v, value=0.5) == [1, 2, 0.5, 0.5, 0.5, 0.5, 0.5, 8, 9]
    assert shown(spark, "offset", v, up=20.0, hold=10.0, down=20.0) == [1, 2, 3, 5, 7, 8, 8, 8, 9]
    assert shown(spark, "scale", v) == [1, 2, 6, 8, 10, 12, 14, 8, 9]
    assert shown(spark, "ramp", v, amount=12.0)[2:8] == [3, 6, 8, 9, 10, 8]  # 2 bar a step, 3 at most
    assert shown(spark, "dropout", v) == [1, 2, None, None, None, None, None, 8, 9]
    assert shown(spark, None, v) == v
    a, b = shown(spark, "noise", v), shown(spark, "noise", v, amount=0.0)
    assert b == v and a[:2] == [1, 2] and a[7:] == [8, 9] and all(x != y for x, y in zip(a[2:7], v[2:7], strict=True))


DELIVERED = "unit_id long, seq long, sim_ts long, arrival long, discontinuity boolean"


def test_redelivery_and_restart(spark):
    rows = [(1, s, s, k, d) for k, (s, d) in enumerate([(5, False), (6, False), (5, False), (6, None), (8, False), (1, True), (2, False), (1, False), (7, False), (7, True), (7, False), (8, False)])]
    got = accepted(spark.createDataFrame([*rows, (1, None, 0, 50, True), (2, 3, 3, 0, None)], DELIVERED)).orderBy("unit_id", "arrival").collect()
    assert [(r.unit_id, r.seq, r.segment) for r in got] == [(1, 5, 0), (1, 6, 0), (1, 8, 0), (1, 1, 1), (1, 2, 1), (1, 7, 1), (1, 7, 2), (1, 8, 2), (2, 3, 0)]


@pytest.mark.parametrize("seed", [1, 2])
def test_stream_counts_as_the_batch(spark, tmp_path, seed):
    r = random.Random(seed)
    rows, seq = [], 0
    for k in range(300):
        flag = r.random() < 0.05
        seq = r.randrange(5) if flag else seq + r.choice([1, 1, 2, -3])
        rows.append((k % 3, seq, seq, k, flag))
    for k in range(3):
        part = spark.createDataFrame(rows[k * 100 : k * 100 + 100], DELIVERED).withColumn("ts", F.timestamp_seconds("arrival"))
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    q = accepted_stream(read_events(spark, str(tmp_path / "in"), schema).drop("ts")).writeStream.format("memory").queryName(f"delivered{seed}").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    want = accepted(spark.createDataFrame(rows, DELIVERED))
    key = lambda df: sorted((x.unit_id, x.arrival, x.seq, x.segment) for x in df.collect())
    assert key(spark.table(f"delivered{seed}")) == key(want) and want.count() < 300
