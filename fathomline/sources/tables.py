"""Parquet tables by name; missing optional columns are not invented here."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` under ``sf_dir``, with every row and column."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
