"""The given star-schema tables as the engine's own relations.

The bridge is a plain projection; every duration and threshold of the operators is a parameter, so
the same operators run on real 10-second telemetry and on these sparser events.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import table

UNITS = 4


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples in long form: unit_id, seq, sim_ts, tag, v and the three machine inputs."""
    e = table(spark, sf_dir, "events")
    return e.select(
        (F.col("user_id") % UNITS).alias("unit_id"),
        F.col("event_id").alias("seq"),
        F.col("ts").cast("timestamp").alias("sim_ts"),
        F.col("event_type").alias("tag"),
        F.col("value").alias("v"),
        (F.col("event_type") != "purchase").alias("intake_closed"),
        F.col("event_type").isin("purchase", "view").alias("load_valve"),
        (F.col("value") / 10).alias("motor_current"),
    )


#: The same projection for the oracle.
TELEMETRY_SQL = """tel AS (
  SELECT user_id % 4 AS unit_id, event_id AS seq, ts AS sim_ts, event_type AS tag, value AS v,
         event_type <> 'purchase' AS intake_closed, event_type IN ('purchase', 'view') AS load_valve, value / 10 AS motor_current
  FROM events)"""


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled intervals from all orders, one a unit, day and priority: window_id, unit_id, from_ts, to_ts (half-open), accepted."""
    o = table(spark, sf_dir, "orders")
    unit, day = F.col("o_orderkey") % UNITS, F.col("o_orderkey") % 30
    g = o.groupBy(unit.alias("unit_id"), day.alias("day"), F.col("o_orderpriority").alias("accepted")).agg(F.min("o_orderkey").alias("window_id"), F.min("o_custkey").alias("c"), F.count(F.lit(1)).alias("n"))
    start = F.timestamp_add("HOUR", (F.col("day") * 24 + F.col("c") % 12).cast("int"), F.lit("2024-01-01").cast("timestamp"))
    return g.select("window_id", "unit_id", start.alias("from_ts"), F.timestamp_add("HOUR", (1 + F.col("n") % 12).cast("int"), start).alias("to_ts"), "accepted")


WINDOWS_SQL = """win AS (
  SELECT window_id, unit_id, TIMESTAMP '2024-01-01' + to_hours(CAST(day * 24 + c % 12 AS INTEGER)) AS from_ts,
         TIMESTAMP '2024-01-01' + to_hours(CAST(day * 24 + c % 12 + 1 + n % 12 AS INTEGER)) AS to_ts, accepted
  FROM (SELECT o_orderkey % 4 AS unit_id, o_orderkey % 30 AS day, o_orderpriority AS accepted, min(o_orderkey) AS window_id, min(o_custkey) AS c, count(*) AS n FROM orders GROUP BY ALL))"""


def tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tickets from all orders: ticket_id, unit_id, opened, fault, confidence."""
    o = table(spark, sf_dir, "orders")
    day = F.lit("2024-01-01").cast("timestamp")
    opened = F.timestamp_add("MINUTE", (F.col("o_custkey") * 37 % 43200).cast("int"), day)
    return o.select(F.col("o_orderkey").alias("ticket_id"), (F.col("o_orderkey") % UNITS).alias("unit_id"), opened.alias("opened"), F.col("o_orderpriority").alias("fault"), (F.col("o_orderkey") * 37 % 100 / 100).alias("confidence"))


TICKETS_SQL = """tic AS (
  SELECT o_orderkey AS ticket_id, o_orderkey % 4 AS unit_id, TIMESTAMP '2024-01-01' + to_minutes(CAST(o_custkey * 37 % 43200 AS INTEGER)) AS opened,
         o_orderpriority AS fault, (o_orderkey * 37 % 100) / 100 AS confidence
  FROM orders)"""


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions from orders: decision_id, episode_id, sim_ts, choice, confidence."""
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("decision_id"), F.col("o_custkey").alias("episode_id"), F.col("o_orderdate").cast("timestamp").alias("sim_ts"), F.col("o_orderpriority").alias("choice"), (F.col("o_orderkey") * 37 % 100 / 100).alias("confidence"), F.col("o_orderstatus").alias("backend"))


DECISIONS_SQL = """dec AS (
  SELECT o_orderkey AS decision_id, o_custkey AS episode_id, o_orderdate AS sim_ts, o_orderpriority AS choice,
         (o_orderkey * 37 % 100) / 100 AS confidence, o_orderstatus AS backend
  FROM orders)"""


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model calls from lineitem: call_id parts, backend, model, tokens in and out, prices, day."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("call_id"),
        F.col("l_returnflag").alias("backend"),
        F.col("l_linestatus").alias("model"),
        (F.col("l_quantity") * 100).cast("long").alias("tokens_in"),
        (F.col("l_linenumber") * 7).cast("long").alias("tokens_out"),
        F.col("l_shipdate").cast("timestamp").alias("at"),
        (F.col("l_discount") * 100).cast("decimal(12,6)").alias("price_in"),
        (F.col("l_tax") * 100).cast("decimal(12,6)").alias("price_out"),
    )


CALLS_SQL = """cal AS (
  SELECT l_orderkey * 8 + l_linenumber AS call_id, l_returnflag AS backend, l_linestatus AS model,
         CAST(trunc(l_quantity * 100) AS BIGINT) AS tokens_in, CAST(l_linenumber * 7 AS BIGINT) AS tokens_out, l_shipdate AS "at",
         CAST(l_discount * 100 AS DECIMAL(12,6)) AS price_in, CAST(l_tax * 100 AS DECIMAL(12,6)) AS price_out
  FROM lineitem)"""
