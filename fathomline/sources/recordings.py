"""Recordings: CSV telemetry, sequence checks, binary registers and YAML-like registries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ANALOG = "TP2 TP3 H1 DV_pressure Reservoirs Oil_temperature Motor_current".split()
DIGITAL = "COMP DV_eletric Towers MPG LPS Pressure_switch Oil_level Caudal_impulses".split()


def read_recording(spark: SparkSession, path: str, unit_id: int = 0) -> DataFrame:
    """A recording with a header: its columns are found by name, a missing one fails at once, an index column is left out.

    Cells that are empty or no numbers are missing: the last value is carried and the row flagged.
    """
    raw = spark.read.option("header", True).csv(path)
    lacking = [c for c in ["timestamp", *ANALOG, *DIGITAL] if c not in raw.columns]
    if lacking:
        raise ValueError(f"the recording lacks {', '.join(lacking)}")
    cells = [F.expr(f"try_cast(`{c}` AS double)").alias(c.lower()) for c in [*ANALOG, *DIGITAL]]
    df = raw.select(F.lit(unit_id).cast("long").alias("unit_id"), F.to_timestamp("timestamp", "yyyy-MM-dd HH:mm:ss").alias("sim_ts"), *cells)
    names = [c.lower() for c in [*ANALOG, *DIGITAL]]
    missing = F.greatest(*[F.col(n).isNull().cast("int") for n in names]) == 1
    df = df.withColumn("missing", missing)
    return carried(df, names, ["unit_id"], ["sim_ts"])


def carried(df: DataFrame, names: list[str], by: list[str], order: list[str]) -> DataFrame:
    """Missing values replaced by the last one before them."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({n: F.last(n, ignorenulls=True).over(w) for n in names})


def drops(samples: DataFrame, capacity: int = 256) -> DataFrame:
    """Sequence numbers lost before each sample of a ring of ``capacity``; a number going back is a restart."""
    w = Window.partitionBy("unit_id").orderBy("sim_ts", "seq")
    step = F.col("seq") - F.lag("seq").over(w)
    return samples.withColumn("lost", F.when(step > 1, step - 1).otherwise(0)).withColumn("restart", F.coalesce(step <= 0, F.lit(False))).withColumn("overflow", F.coalesce(step > capacity, F.lit(False)))


def out_of_order(samples: DataFrame) -> DataFrame:
    """Samples whose time is not after the one before in delivery order."""
    w = Window.partitionBy("unit_id").orderBy("seq")
    return samples.withColumn("_p", F.lag("sim_ts").over(w)).where(F.col("sim_ts") <= F.col("_p")).drop("_p")


def word(value: Column, scale: float) -> Column:
    """A value as the unsigned 16-bit word of a signed scaled register, half away from zero and clamped."""
    n = F.least(F.greatest(F.round(value * scale), F.lit(-32768.0)), F.lit(32767.0)).cast("int")
    return F.when(n < 0, n + 65536).otherwise(n)


def from_word(w: Column, scale: float) -> Column:
    """The value of such a word."""
    return F.when(w >= 32768, w - 65536).otherwise(w) / scale


def codes_of(bits: Column, codes: list[str]) -> Column:
    """The alarm codes whose bits are set, from the lowest."""
    return F.array_compact(F.array(*[F.when(F.shiftright(bits, i).bitwiseAND(F.lit(1)) == 1, F.lit(c)) for i, c in enumerate(codes)]))


def registry(spark: SparkSession, entries: list[dict], schema: str, settings: dict[str, float] | None = None) -> DataFrame:
    """A small registry as a table; a string that names a setting is replaced by its value."""
    resolve = lambda v: settings[v] if settings and isinstance(v, str) and v in settings else v
    return spark.createDataFrame([{k: resolve(v) for k, v in e.items()} for e in entries], schema)
