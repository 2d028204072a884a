"""Series decimation: extremes by bucket, edges, minute groups and largest triangles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def minmax(tel: DataFrame, from_us: int, width_us: int) -> DataFrame:
    """At most two points a tag and bucket: the first least and the first greatest, in one pass."""
    bucket = F.floor((F.unix_micros("sim_ts") - from_us) / width_us)
    point = F.struct("seq", F.unix_micros("sim_ts").alias("t_us"), "v")
    lo = F.min_by(point, F.struct("v", "sim_ts", "seq"))
    hi = F.max_by(point, F.struct(F.col("v"), -F.unix_micros("sim_ts"), -F.col("seq")))
    both = tel.groupBy("tag", bucket.alias("bucket")).agg(F.array_distinct(F.array(lo, hi)).alias("p"))
    return both.select("tag", "bucket", F.inline("p"))


def edges(tel: DataFrame, what: str) -> DataFrame:
    """The points at which a digital signal changes, the first included."""
    before = F.lag(what).over(Window.partitionBy("unit_id").orderBy("sim_ts", "seq"))
    return tel.withColumn("_p", before).where(~F.col(what).eqNullSafe(F.col("_p"))).select("unit_id", "seq", F.unix_micros("sim_ts").alias("t_us"), F.col(what).alias("v"))


def minutes(tel: DataFrame, per_group: int) -> DataFrame:
    """Minute rows in groups of so many: mean of means, least and greatest."""
    minute = F.floor(F.unix_micros("sim_ts") / 60000000)
    m = tel.groupBy("unit_id", "tag", minute.alias("minute")).agg(F.avg("v").alias("a"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    part = F.ceil(F.row_number().over(Window.partitionBy("unit_id", "tag").orderBy("minute")) / per_group)
    return m.withColumn("part", part).groupBy("unit_id", "tag", "part").agg(F.min("minute").alias("minute"), F.round(F.avg("a"), 6).alias("avg_v"), F.min("lo").alias("min_v"), F.max("hi").alias("max_v"))


SERIES = "unit_id long, tag string, seq long, t_us long, v double"


def _largest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The point of each bucket that spans the largest triangle with the one picked before and the mean of the next bucket, the first of equals.

    Rows come by series and place: unit_id, tag, seq, t_us, v, bucket, next_t, next_v. What is carried over a batch is the last pick and
    the best of the open bucket.
    """
    at, anchor, best = None, None, None  # (unit, tag, bucket), (t, v), (area, row)
    for batch in batches:
        unit, tag, seq, t_us, v, bucket, next_t, next_v = (batch.column(k).to_pylist() if k < 2 else batch.column(k).to_numpy(zero_copy_only=False) for k in range(8))
        out = []
        starts = [k for k in range(batch.num_rows) if k == 0 or (unit[k], tag[k], bucket[k]) != (unit[k - 1], tag[k - 1], bucket[k - 1])]
        for a, b in zip(starts, [*starts[1:], batch.num_rows], strict=True):
            key = (unit[a], tag[a], int(bucket[a]))
            if key != at:
                if best:
                    out.append(best[1])
                    anchor = (best[1][3], best[1][4])
                if at is None or key[:2] != at[:2]:
                    anchor = (float(t_us[a]), float(v[a]))  # a series begins with its first point
                at, best = key, None
            t, value = t_us[a:b].astype(float), v[a:b]
            area = np.abs((anchor[0] - next_t[a]) * (value - anchor[1]) - (anchor[0] - t) * (next_v[a] - anchor[1]))
            k = int(area.argmax())
            if best is None or area[k] > best[0]:
                best = (area[k], (unit[a], tag[a], int(seq[a + k]), int(t_us[a + k]), float(value[k])))
        yield _points(out)
    if best:
        yield _points([best[1]])


def _points(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.float64()]
    columns = list(zip(*rows, strict=True)) or [[]] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["unit_id", "tag", "seq", "t_us", "v"])


def lttb(tel: DataFrame, points: int) -> DataFrame:
    """Largest-triangle decimation of each unit's tag to ``points`` (3 or more): both ends, and one of each bucket of equally many points between.

    Places, buckets and their means are windows and sums; only the picks follow one another, in a pass over sorted
    rows that holds a batch. A series of no more points stays whole; missing values are left out.
    """
    if points < 3:
        raise ValueError("a decimated series has three points at least")
    series = Window.partitionBy("unit_id", "tag")
    df = tel.where("v is not null and not isnan(v)").select("unit_id", "tag", "seq", F.unix_micros("sim_ts").alias("t_us"), "v")
    df = df.withColumns({"i": F.row_number().over(series.orderBy("t_us", "seq")) - 1, "n": F.count(F.lit(1)).over(series)})
    whole = df.where(F.col("n") <= points)
    # the bucket k of the points between: floor(k * (n - 2) / (points - 2)) <= i - 1, in whole numbers
    inner = F.expr(f"(i * {points - 2} + n - 3) div (n - 2) - 1")
    placed = df.where(F.col("n") > points).withColumn("bucket", F.when(F.col("i") == 0, -1).when(F.col("i") == F.col("n") - 1, points - 2).otherwise(inner))
    means = placed.groupBy("unit_id", "tag", (F.col("bucket") - 1).alias("bucket")).agg(F.avg("t_us").alias("next_t"), F.avg("v").alias("next_v"))
    # the ends are buckets of one point, whose triangles nobody compares
    rows = placed.join(means, ["unit_id", "tag", "bucket"], "left").fillna(0.0, ["next_t", "next_v"])
    parts = int(tel.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.select("unit_id", "tag", "seq", "t_us", "v", "bucket", "next_t", "next_v", "i").repartition(parts, "unit_id", "tag").sortWithinPartitions("unit_id", "tag", "i")
    return whole.select("unit_id", "tag", "seq", "t_us", "v").union(ordered.drop("i").mapInArrow(_largest, SERIES))


def broken_at_gaps(points: DataFrame, gap_us: int) -> DataFrame:
    """The points of each series, and where two of them are over ``gap_us`` apart one without value half way, so that a chart draws no line."""
    w = Window.partitionBy("unit_id", "tag").orderBy("t_us", "seq")
    before = F.lag("t_us").over(w)
    gaps = points.select("unit_id", "tag", F.lit(None).cast("long").alias("seq"), F.expr("t_us").alias("_t"), before.alias("_p")).where(F.col("_t") - F.col("_p") > gap_us)
    return points.union(gaps.select("unit_id", "tag", "seq", (F.col("_p") + F.floor((F.col("_t") - F.col("_p")) / 2)).alias("t_us"), F.lit(None).cast("double").alias("v")))
