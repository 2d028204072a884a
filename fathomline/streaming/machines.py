"""Structured Streaming: the minute fold with a watermark, de-duplication, and the sequential machines."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.stateful import EVENT, fold


def read_events(spark: SparkSession, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    """A stream of Parquet files in arrival order, times as TIMESTAMP so that watermarks apply."""
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def minute_stream(samples: DataFrame, lateness: str = "10 minutes", minutes: int = 1) -> DataFrame:
    """Tumbling minute fold by unit and tag; a minute is emitted once the watermark has passed it."""
    w = F.window("sim_ts", f"{minutes} minutes")
    return samples.withWatermark("sim_ts", lateness).groupBy(w, "unit_id", "tag").agg(
        F.count("v").alias("n"), F.min("v").alias("min_v"), F.max("v").alias("max_v"), F.avg("v").alias("avg_v"), F.max_by("v", F.struct("sim_ts", "seq")).alias("last_v")
    ).select("unit_id", F.unix_seconds("window.start").alias("minute"), "tag", "n", "min_v", "max_v", "avg_v", "last_v")


def deduplicated(samples: DataFrame, lateness: str = "10 minutes") -> DataFrame:
    """Re-delivered samples dropped by unit and sequence number within the watermark."""
    return samples.withWatermark("sim_ts", lateness).dropDuplicatesWithinWatermark(["unit_id", "seq"])


def machine_stream(samples: DataFrame, machine) -> DataFrame:
    """A machine of ``operators.stateful`` over a stream of samples (unit_id, seq, t_us, v)."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.get if state.exists else machine.empty
        parts = [b for b in batches if len(b)]
        if not parts:
            return
        rows = pd.concat(parts).sort_values(["t_us", "seq"])
        now, events = fold(machine, tuple(None if x is None or x != x else x for x in now), rows[["unit_id", "seq", "t_us", "v"]].itertuples(index=False, name=None))
        state.update(now)
        yield pd.DataFrame(events, columns=["unit_id", "seq", "t_us", "kind", "since_us"])

    return samples.groupBy("unit_id").applyInPandasWithState(run, EVENT, machine.state, "append", GroupStateTimeout.NoTimeout)


def upsert_sink(path: str, key: list[str], version: list[str]):
    """A foreachBatch function that keeps a Parquet table with the latest row of each key, in a new folder a batch.

    Readers take the folder of the highest number; replaying a batch writes the same folder again.
    """
    from ..operators.tables import upsert

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = batch
        if number:
            new = upsert(spark.read.parquet(f"{path}/v{number - 1}"), batch, key, version)
        else:
            new = upsert(batch.limit(0), batch, key, version)
        new.write.mode("overwrite").parquet(f"{path}/v{number}")

    return write


def ticket_stream(events: DataFrame, silence_s: float, lateness: str = "10 minutes") -> DataFrame:
    """The fold of ``operators.tickets`` over a stream of events with a time ``ts``; an event-time timer ends silent episodes of units without events.

    Events of one micro-batch are put in order; one older than what its unit has seen counts at its own time.
    """
    from ..operators.tickets import CHANGE, COLUMNS, EVENTS, Unit

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        unit = Unit(state.get[0] if state.exists else None, silence_s)
        rows: list[tuple] = []
        for b in batches:
            rows += b[list(EVENTS)].itertuples(index=False, name=None)
        rows = [tuple(None if x is None or x != x else x for x in r) for r in rows]
        out: list[tuple] = []
        for r in sorted(rows, key=lambda r: (r[2], r[3])):
            out += unit.step(int(r[0]), int(r[1]), int(r[2]), int(r[3]), *r[4:])
        if state.hasTimedOut:
            out += unit.advance(int(key[0]), state.getCurrentWatermarkMs() * 1000)
        state.update((unit.text,))
        due = unit.next_end()
        if due is not None:
            state.setTimeoutTimestamp(max(due // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=COLUMNS)

    marked = events.withWatermark("ts", lateness)
    return marked.groupBy("unit_id").applyInPandasWithState(run, CHANGE, "text string", "append", GroupStateTimeout.EventTimeTimeout)
