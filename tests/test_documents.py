"""Documents replaced whole: a batch that died, one written twice, deletion, and how much is written."""

import os

import pytest

from fathomline.operators import documents as d

CHUNK = "doc string, chunk int, text string, deleted boolean"


def held(spark, path):
    return sorted((r.doc, r.chunk, r.text) for r in d.current(spark, path, "doc").collect())


def files(path):
    return sorted(os.path.join(root, f) for root, _, names in os.walk(path) for f in names if f.endswith(".parquet"))


def test_replace(spark, tmp_path):
    path = str(tmp_path / "t")
    with pytest.raises(ValueError):
        d.current(spark, path, "doc")
    d.put_batch(spark.createDataFrame([("a", 1, "x", None), ("a", 2, "y", None), ("b", 1, "z", False), (None, 1, "n", None)], CHUNK), path, 0)
    first = files(path)
    assert held(spark, path) == [("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")]
    new = spark.createDataFrame([("a", 1, "new", None), ("c", 1, "c", None)], CHUNK).coalesce(1)
    d.put_batch(new, path, 1)
    assert held(spark, path) == [("a", 1, "new"), ("b", 1, "z"), ("c", 1, "c")]
    assert set(first) < set(files(path)) and len(files(path)) == len(first) + 1  # only the batch's own rows are written
    d.put_batch(new, path, 1)  # a replay
    assert held(spark, path) == [("a", 1, "new"), ("b", 1, "z"), ("c", 1, "c")] and len(files(path)) == len(first) + 1
    d.put_batch(spark.createDataFrame([("b", None, None, True), ("c", None, None, True), ("c", 1, "again", None)], CHUNK), path, 2)
    assert held(spark, path) == [("a", 1, "new"), ("c", 1, "again")]
    d.compacted(spark, path, str(tmp_path / "u"), "doc")
    assert held(spark, str(tmp_path / "u")) == held(spark, path) and d.committed(spark, str(tmp_path / "u")) == [2]


def test_a_batch_that_died_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "t")
    d.put_batch(spark.createDataFrame([("a", 1, "old", None)], CHUNK), path, 0)
    d.put_batch(spark.createDataFrame([("a", 1, "half", None)], CHUNK), path, 1)
    os.remove(f"{path}/batch={1:010d}/_SUCCESS")  # as a job leaves it that ends before its commit
    assert held(spark, path) == [("a", 1, "old")] and d.committed(spark, path) == [0]
    d.put_batch(spark.createDataFrame([("a", 1, "new", None)], CHUNK), path, 1)
    assert held(spark, path) == [("a", 1, "new")]


def test_stream_sink(spark, tmp_path):
    spark.createDataFrame([("a", 1, "x", None)], CHUNK).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(CHUNK).parquet(str(tmp_path / "in"))
    run = lambda: stream.writeStream.foreachBatch(d.replace_sink(str(tmp_path / "t"))).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    run()
    spark.createDataFrame([("a", 1, "z", None), ("b", 1, "y", None)], CHUNK).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run()
    assert held(spark, str(tmp_path / "t")) == [("a", 1, "z"), ("b", 1, "y")]
