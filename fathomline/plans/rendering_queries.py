"""Queries of query texts, ticket titles and active documents, with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import rendering as r
from ..sources.tables import table

QUERIES: dict = {}
SQL: dict = {}


def query(name: str, sql: str):
    def add(f):
        QUERIES[name], SQL[name] = f, f"WITH {sql}"
        return f

    return add


@query(
    "query_texts",
    r"""e AS (SELECT o_orderkey AS event_id, o_custkey % 7 AS rk, 'line_' || lower(o_orderpriority) AS symptom_key, ['code ' || o_orderkey || ' (12) fired', ' '] AS details, [o_orderstatus] AS labels, o_orderkey % 30 AS a1, o_orderkey % 11 AS a2 FROM orders),
p AS (SELECT event_id, list_concat([CASE WHEN r_name IS NULL THEN replace(symptom_key, '_', ' ') ELSE r_name END], CASE WHEN r_name IS NULL THEN [] ELSE [lower(r_name), 'P4 ( 7 ) drops'] END, details, labels, list_filter([x.n_name, y.n_name], lambda t: t IS NOT NULL)) AS parts
  FROM e LEFT JOIN region ON r_regionkey = rk LEFT JOIN nation x ON x.n_nationkey = a1 LEFT JOIN nation y ON y.n_nationkey = a2)
SELECT event_id, trim(regexp_replace(regexp_replace(regexp_replace(array_to_string(list_filter(parts, lambda t: trim(t) <> ''), ' '), '[0-9]+', '', 'g'), '\(\s*\)', ' ', 'g'), '\s+', ' ', 'g')) AS text FROM p""",
)
def query_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as events, regions as the conditions of five of seven symptoms, nations as alarm titles."""
    key = F.col("o_orderkey")
    e = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "region"), F.col("o_custkey") % 7 == F.col("r_regionkey"), "left")
    named = F.concat(F.lit("line_"), F.lower("o_orderpriority"))
    symptom = F.coalesce(F.concat(F.lit("region_"), F.col("r_regionkey").cast("string")), named)
    details = F.array(F.concat(F.lit("code "), key.cast("string"), F.lit(" (12) fired")), F.lit(" "))
    events = e.select(key.alias("event_id"), symptom.alias("symptom_key"), details.alias("details"), F.array("o_orderstatus").alias("labels"), F.array(key % 30, key % 11).alias("alarm_codes"))
    conditions = table(spark, sf_dir, "region").select(F.concat(F.lit("region_"), F.col("r_regionkey").cast("string")).alias("symptom_key"), F.col("r_name").alias("title"), F.array(F.lower("r_name"), F.lit("P4 ( 7 ) drops")).alias("symptoms"))
    alarms = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("code"), F.col("n_name").alias("title"))
    return r.query_texts(events, conditions, alarms)


@query(
    "ticket_titles",
    """d AS (SELECT l_orderkey, l_linenumber, l_partkey, 'SIZE' || l_linenumber % 5 AS k1, CASE l_returnflag WHEN 'R' THEN 'ECONOMY' WHEN 'A' THEN 'SMALL' ELSE 'none' END AS k2 FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN 'SIZE' || p_size % 5 = k1 THEN k1 ELSE p_type END AS condition_id,
       p_name || ' — ' || CASE WHEN 'SIZE' || p_size % 5 = k1 THEN 'size ' || p_size ELSE p_brand END AS title
FROM d JOIN part ON p_partkey = l_partkey""",
)
def ticket_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A part is an entry with two conditions, its type and its size class; the ticket's symptom is a size class."""
    size = F.concat(F.lit("SIZE"), (F.col("p_size") % 5).cast("string"))
    pair = lambda key, title: F.struct(key.alias("condition_id"), title.alias("title"))
    entries = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("fault_id"), F.col("p_name").alias("name"), F.array(pair(F.col("p_type"), F.col("p_brand")), pair(size, F.concat(F.lit("size "), F.col("p_size").cast("string")))).alias("conditions"))
    flag = F.col("l_returnflag")
    decided = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("fault_id"), F.concat(F.lit("SIZE"), (F.col("l_linenumber") % 5).cast("string")).alias("ticket_symptom"), F.when(flag == "R", "ECONOMY").when(flag == "A", "SMALL").otherwise("none").alias("event_symptom"))
    return r.ticket_titles(decided, entries).select("l_orderkey", "l_linenumber", "condition_id", "title")


@query(
    "active_documents",
    """r AS (SELECT l_suppkey AS site, l_partkey AS document_id, l_orderkey * 8 + l_linenumber AS run_id, l_shipdate AS started, CASE WHEN l_linenumber % 3 > 0 THEN l_shipdate + to_days(CAST(l_linenumber AS INTEGER)) END AS finished, l_linestatus = 'O' AS ok FROM lineitem)
SELECT site, arg_max(document_id, (coalesce(finished, started), run_id)) AS document_id FROM r WHERE ok GROUP BY site""",
)
def active_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    started = F.col("l_shipdate").cast("timestamp")
    finished = F.when(F.col("l_linenumber") % 3 > 0, F.timestamp_add("DAY", F.col("l_linenumber").cast("int"), started))
    runs = li.select(F.col("l_suppkey").alias("site"), F.col("l_partkey").alias("document_id"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("run_id"), started.alias("started"), finished.alias("finished"), F.when(F.col("l_linestatus") == "O", "succeeded").otherwise("failed").alias("status"))
    return r.active_documents(runs, "site")
