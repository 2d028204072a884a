"""Read functions, one for each route of the read surface: filters, a page cursor and a limit, returning DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import costs, intervals, series, tables, telemetry

MAX_LIMIT = 500


def _filtered(df: DataFrame, from_ts: str | None = None, to_ts: str | None = None, ts: str = "sim_ts", **equal) -> DataFrame:
    """Bounds and equalities that were given; those left out do not filter."""
    if from_ts is not None:
        df = df.where(F.col(ts) >= F.lit(from_ts).cast("timestamp"))
    if to_ts is not None:
        df = df.where(F.col(ts) < F.lit(to_ts).cast("timestamp"))
    for name, value in equal.items():
        if value is not None:
            df = df.where(F.col(name).isin(*value) if isinstance(value, (list, tuple, set)) else F.col(name) == value)
    return df


def _limit(n: int) -> int:
    if n < 1:
        raise ValueError("a limit is 1 or more")
    return min(n, MAX_LIMIT)


def read_series(tel: DataFrame, tags: list[str], from_us: int, to_us: int, points: int = 600, rollup: DataFrame | None = None) -> DataFrame:
    """Decimated points of tags; from the minute roll-up where the samples do not reach back far enough."""
    oldest = tel.agg(F.min(F.unix_micros("sim_ts"))).first()[0]
    if rollup is not None and (oldest is None or oldest > from_us):
        return rollup.where(F.col("tag").isin(*tags) & F.col("minute").between(from_us // 1_000_000, to_us // 1_000_000))
    part = tel.where(F.col("tag").isin(*tags) & (F.unix_micros("sim_ts") >= from_us) & (F.unix_micros("sim_ts") < to_us))
    return series.minmax(part, from_us, max(1, (to_us - from_us) // max(1, points // 2)))


def read_features(tel: DataFrame, unit_id: int | None = None, secs: float = 300) -> DataFrame:
    return telemetry.trailing(_filtered(tel, unit_id=unit_id), secs)


def read_page(df: DataFrame, ts: str, key: str, limit: int = 50, before: tuple | None = None, **filters) -> DataFrame:
    """Suspect events, decisions, episodes, tickets, alerts and alarms: newest first, one row more than asked."""
    return tables.page(_filtered(df, ts=ts, **filters), ts, key, _limit(limit), before)


def read_one(df: DataFrame, key: str, value) -> DataFrame:
    return df.where(F.col(key) == value)


def read_cost(calls: DataFrame, from_ts: str | None = None, to_ts: str | None = None) -> dict[str, DataFrame]:
    """Totals by backend and running days."""
    led = costs.ledger(_filtered(calls, from_ts, to_ts, ts="at"))
    return {"by_backend": costs.by_backend(led), "days": costs.cumulative(led)}


def read_ledger(calls: DataFrame, limit: int = 50, before: tuple | None = None, backend: str | None = None) -> DataFrame:
    return read_page(costs.ledger(calls), "at", "call_id", limit, before, backend=backend)


def read_overlay(windows: DataFrame, from_ts: str | None = None, to_ts: str | None = None) -> DataFrame:
    """Labelled windows that touch a span."""
    if from_ts is not None:
        windows = windows.where(F.col("to_ts") > F.lit(from_ts).cast("timestamp"))
    if to_ts is not None:
        windows = windows.where(F.col("from_ts") < F.lit(to_ts).cast("timestamp"))
    return windows


def read_coverage(windows: DataFrame) -> DataFrame:
    return intervals.union(windows)


def read_status(heartbeats: DataFrame, now: str, timeout_s: int = 15) -> DataFrame:
    """The last beat of each source and whether it is overdue."""
    last = heartbeats.groupBy("source").agg(F.max("at").alias("last_at"))
    return last.withColumn("overdue", F.unix_seconds(F.lit(now).cast("timestamp")) - F.unix_seconds("last_at") > timeout_s)
