"""The cost ledger: exact money by call, and its roll-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import call_cost


def ledger(calls: DataFrame) -> DataFrame:
    """Calls with their generated cost as DECIMAL(16,10)."""
    return calls.withColumn("cost", call_cost(F.col("tokens_in"), F.col("tokens_out"), F.col("price_in"), F.col("price_out")))


def by_backend(led: DataFrame) -> DataFrame:
    """Two-level roll-up: totals by backend, and its most called model, ties by name."""
    per = led.groupBy("backend", "model").agg(F.count(F.lit(1)).alias("calls"), F.sum("tokens_in").alias("tokens_in"), F.sum("cost").alias("cost"))
    return per.groupBy("backend").agg(
        F.sum("calls").alias("calls"),
        F.sum("tokens_in").alias("tokens_in"),
        F.round(F.sum("cost").cast("double"), 8).alias("cost"),
        F.min_by("model", F.struct(-F.col("calls"), F.col("model"))).alias("top_model"),
    )


def cumulative(led: DataFrame) -> DataFrame:
    """Running daily cost by backend; days are summed before they are ordered."""
    days = led.groupBy("backend", F.date_format("at", "yyyy-MM-dd").alias("day")).agg(F.sum("cost").alias("cost"))
    w = Window.partitionBy("backend").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    return days.select("backend", "day", F.round(F.sum("cost").over(w).cast("double"), 8).alias("running"))
