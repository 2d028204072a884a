"""Documents replaced as a whole: a batch brings all chunks of the documents it names, and deletes those it names without chunks.

A batch is a folder of its own, written by Spark's committer, whose success mark comes last. Readers take each document from the
newest batch that has the mark, so they never see half of one: a batch that dies leaves the old documents, a batch that is
written again writes the same folder, and nothing but the batch's own rows is written. ``compacted`` folds all batches into one.

Rows of a batch: the key, the chunk's columns and ``deleted``, true for a document that goes. A document that a batch both deletes
and brings is brought. Rows with a null key are left out.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def put_batch(rows: DataFrame, path: str, number: int) -> None:
    """Write one batch; numbers grow, and writing a number again replaces that batch only."""
    rows.write.mode("overwrite").parquet(f"{path}/batch={number:010d}")


def committed(spark: SparkSession, path: str) -> list[int]:
    """The numbers of the batches that are whole, ascending."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    folders = [s.getPath() for s in fs.listStatus(root) if s.isDirectory() and s.getPath().getName().startswith("batch=")]
    return sorted(int(p.getName().removeprefix("batch=")) for p in folders if fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def newest(rows: DataFrame, key: str, batch: str = "batch") -> DataFrame:
    """Of rows with a batch number, those of each document's newest batch, without deleted documents.

    The newest batch is worked out by document, pre-aggregated; chunks are joined to it and never gathered.
    """
    last = rows.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.max(batch).alias("_last"))
    kept = rows.join(last, (F.col(key) == F.col("_key")) & (F.col(batch) == F.col("_last"))).drop("_key", "_last")
    return kept.where(~F.coalesce("deleted", F.lit(False)))


def current(spark: SparkSession, path: str, key: str) -> DataFrame:
    """The documents as the whole batches under ``path`` leave them."""
    parts = [spark.read.parquet(f"{path}/batch={n:010d}").withColumn("batch", F.lit(n)) for n in committed(spark, path)]
    if not parts:
        raise ValueError(f"no batch under {path} is whole")
    return newest(reduce(DataFrame.unionByName, parts), key)


def compacted(spark: SparkSession, path: str, into: str, key: str) -> None:
    """One batch with the number of the last one, in a new table that readers may move to."""
    put_batch(current(spark, path, key).drop("batch"), into, committed(spark, path)[-1])


def replace_sink(path: str):
    """A foreachBatch function that puts each micro-batch as a batch of its own; a replayed micro-batch replaces itself."""
    return lambda batch, number: put_batch(batch, path, number)
