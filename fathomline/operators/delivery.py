"""Samples as they are delivered: what a re-delivery repeats is left out, and a discontinuity starts the sequence anew.

A sample counts if it carries the discontinuity flag or its sequence number is greater than all that counted since the last one;
``arrival`` is the order of delivery. Equal arrivals go by time, then by sequence number.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import LongType, StructField, StructType

ORDER = ("arrival", "sim_ts", "seq")


def accepted(samples: DataFrame) -> DataFrame:
    """The samples that count, with ``segment``, the number of discontinuities up to them.

    ``samples`` has unit_id, seq, sim_ts, arrival and discontinuity; a null flag is none, a null seq never counts.
    """
    flag = F.coalesce("discontinuity", F.lit(False))
    unit = Window.partitionBy("unit_id").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, 0)
    df = samples.where("seq is not null").withColumn("segment", F.sum(flag.cast("long")).over(unit))
    before = Window.partitionBy("unit_id", "segment").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, -1)
    greatest = F.max("seq").over(before)
    return df.withColumn("_most", greatest).where(flag | F.col("_most").isNull() | (F.col("seq") > F.col("_most"))).drop("_most")


def accepted_stream(samples: DataFrame) -> DataFrame:
    """``accepted`` over a stream: the state of a unit is its last counted number and its segment."""
    names = samples.columns

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, segment = state.get if state.exists else (None, 0)
        parts = [b for b in batches if len(b)]
        kept: list[tuple] = []
        rows = [r for b in parts for r in b.sort_values(list(ORDER)).to_dict("records")]
        for r in sorted(rows, key=lambda r: tuple(r[c] for c in ORDER)):
            flag = bool(r["discontinuity"]) and r["discontinuity"] == r["discontinuity"]
            if r["seq"] != r["seq"] or not (flag or last is None or r["seq"] > last):
                continue
            last, segment = int(r["seq"]), segment + int(flag)
            kept.append((*(r[n] for n in names), segment))
        state.update((last, segment))
        yield pd.DataFrame(kept, columns=[*names, "segment"])

    schema = StructType([*samples.schema.fields, StructField("segment", LongType())])
    return samples.groupBy("unit_id").applyInPandasWithState(run, schema, "last long, segment long", "append", GroupStateTimeout.NoTimeout)
