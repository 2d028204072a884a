"""Table maintenance and paging as DataFrame operations: upsert, insert-ignore, retention, keyset pages."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, key: list[str], version: list[str]) -> DataFrame:
    """Both tables, of equal keys the row of the latest version."""
    latest = Window.partitionBy(*key).orderBy(*[F.desc(v) for v in version])
    return old.unionByName(new).withColumn("_k", F.row_number().over(latest)).where("_k = 1").drop("_k")


def insert_ignore(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """The old rows, and of each key that is not there one new row: the first by its other columns.

    A key with a null in it is equal to none, so such rows are all inserted.
    """
    fresh = new.join(old.select(*key), key, "left_anti")
    whole = F.lit(True)
    for k in key:
        whole = whole & F.col(k).isNotNull()
    rest = [c for c in new.columns if c not in key] or key
    first = fresh.where(whole).withColumn("_k", F.row_number().over(Window.partitionBy(*key).orderBy(*rest))).where("_k = 1").drop("_k")
    return old.unionByName(first).unionByName(fresh.where(~whole))


def retain(df: DataFrame, ts: str, days: int) -> DataFrame:
    """Rows no older than so many days before the newest."""
    newest = df.agg(F.max(ts)).first()[0]
    if newest is None:
        return df.limit(0)
    # a literal bound reaches the scan
    return df.where(F.col(ts) >= F.lit(newest - timedelta(days=days)))


def page(df: DataFrame, ts: str, key: str, size: int, before: tuple | None = None) -> DataFrame:
    """The next ``size`` rows and one more, newest first, strictly before the cursor (time, key)."""
    if before:
        at = F.lit(before[0]).cast("timestamp")
        # the plain bound is implied, but only it reaches the scan
        df = df.where(F.col(ts) <= at).where((F.col(ts) < at) | ((F.col(ts) == at) & (F.col(key) < before[1])))
    return df.orderBy(F.desc(ts), F.desc(key)).limit(size + 1)
