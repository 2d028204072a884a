"""Helpers shared by the corpus operators: shared scratch tables and Arrow batch slicing."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the cluster names it in spark.checkpoint.dir.

    Only on a single machine (a local master, as in tests) is a local folder made where the setting
    is absent; a cluster without it has no folder that every executor sees, which is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir is not set: name a folder that driver and executors share")
        named = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new name in the shared folder."""
    return f"{shared_dir(spark)}/fathomline/{label}-{uuid.uuid4().hex}"


def stash(df: DataFrame, label: str = "t") -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    Cuts the lineage and lets later readers prune columns; a lost executor costs nothing,
    since the files don't live on it.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*frames: DataFrame) -> None:
    """Delete stashed tables that nothing reads any more."""
    for df in frames:
        spark = df.sparkSession
        jvm = spark.sparkContext._jvm
        for f in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(f)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def sliced(batches: Iterator[pa.RecordBatch], column: str, chars: int = 2_000_000) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Cut Arrow batches so that one slice's texts hold about ``chars`` bytes.

    Bounds a worker's memory by the slice, or by one text where that alone is longer: only a slice's
    texts are Python strings at a time. Memory beyond need goes back when the batches end: workers live
    on and share an executor.
    """
    for batch in batches:
        at = batch.schema.get_field_index(column)
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < len(ends):
            held = ends[start - 1] if start else 0
            end = min(int(np.searchsorted(ends, held + chars)) + 1, len(ends))
            part = batch.slice(start, end - start)
            yield part, part.column(at).to_pylist()
            start = end
    give_back()


def give_back() -> None:
    """Return memory that nothing holds any more: workers live on, and share an executor with what comes after."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only where the C library has it
    if trim:
        trim(0)


def with_columns(batch: pa.RecordBatch, **columns: pa.Array) -> pa.RecordBatch:
    """The batch with columns appended."""
    return pa.RecordBatch.from_arrays([*batch.columns, *columns.values()], names=[*batch.schema.names, *columns])


def ddl_plus(df: DataFrame, more: str) -> str:
    """The schema of ``df`` with the columns of the DDL string ``more`` behind."""
    from pyspark.sql.types import StructType, _parse_datatype_string

    extra = _parse_datatype_string(more)
    return StructType([*df.schema.fields, *extra.fields])


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` worked out once a row, however often ``use`` names it.

    A lambda over an array of one element binds it; a plain column would be put in place at every
    mention, inside inner lambdas once an element.
    """
    return F.element_at(F.transform(F.array(value), use), 1)


def unused(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that ``df`` doesn't have, upper and lower case taken as equal."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def without(df: DataFrame, names: list[str], keep: list[str]) -> DataFrame:
    """Drop columns an operator is about to write, so that clashing names are replaced."""
    return df.drop(*[n for n in names if n not in keep])
