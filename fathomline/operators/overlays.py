"""Overlays of a recorded signal: offset, scale, ramp, dropout, noise and stuck, faded by a trapezoid.

An overlay has instance, op, amount, cap, from_us and the envelope's three lengths in seconds. Noise is a seeded draw, so a replay gives the
same values wherever a row is worked on; stuck holds the value with which its stretch begins, or the overlay's own where given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import noise_draw


def overlaid(samples: DataFrame, transform: int = 0) -> DataFrame:
    """``samples`` (unit_id, tag, seq, t_us, v and an overlay's columns, null where none applies) with ``weight`` and ``shown``.

    Without overlay, or outside its envelope, the value is shown as it is; a dropout shows null.
    """
    t = (F.col("t_us") - F.col("from_us")) / 1_000_000
    up, held, down = F.col("ramp_in_s"), F.col("hold_s"), F.col("ramp_out_s")
    end = up + held + down
    weight = F.when((t < 0) | (t >= end), 0.0).when(t < up, t / up).when(t < up + held, 1.0).otherwise((end - t) / down)
    df = samples.withColumn("weight", F.coalesce(F.when((t < 0) | (t >= end), 0.0).otherwise(weight), F.lit(0.0)))
    # stuck is whole from its first sample on: the envelope's edges don't fade it
    inside = (t >= 0) & (t < end)
    stretch = Window.partitionBy("unit_id", "tag", "instance").orderBy("t_us", "seq").rowsBetween(Window.unboundedPreceding, 0)
    first = F.first(F.when(inside, F.col("v")), ignorenulls=True).over(stretch)
    df = df.withColumn("_held", F.coalesce(F.col("value"), first))
    v, m, amount, op = F.col("v"), F.col("weight"), F.col("amount"), F.col("op")
    minutes = t / 60
    ramp = F.greatest(-F.col("cap"), F.least(F.col("cap"), amount * minutes * m))
    noise = noise_draw(F.col("instance"), F.floor(F.col("t_us") / 1000), transform) * amount * m
    shown = F.when(op.isNull() | ~inside, v).when(op == "offset", v + amount * m).when(op == "scale", v * (1 + (amount - 1) * m)).when(op == "ramp", v + ramp).when(op == "noise", v + noise).when(op == "stuck", F.col("_held")).when(op == "dropout", F.lit(None).cast("double")).otherwise(v)
    return df.withColumn("shown", shown).drop("_held")
