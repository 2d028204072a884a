"""Queries of the ticket machine; the SQL runs it event by event as a recursion over each unit's list of episodes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.decisions import NONE_OF_THESE
from ..operators.tickets import ticket_changes
from ..sources.tables import table

QUERIES: dict = {}
SQL: dict = {}


def query(name: str, sql: str):
    def add(f):
        QUERIES[name], SQL[name] = f, f"WITH RECURSIVE {sql}"
        return f

    return add


def ticket_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events from all orders: the customer is the unit, with three episodes a quarter."""
    o = table(spark, sf_dir, "orders")
    key, score = F.col("o_orderkey"), F.col("o_orderkey") * 37 % 100
    decided = F.pmod(key, F.lit(10)) > 1
    quarter = F.year("o_orderdate") * 4 + F.quarter("o_orderdate")
    choice = F.when(key % 7 == 0, F.lit(None)).when(key % 11 == 0, NONE_OF_THESE).otherwise(F.col("o_orderpriority"))
    return o.select(
        F.col("o_custkey").alias("unit_id"),
        (quarter * 3 + key % 3).cast("long").alias("episode_id"),
        F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("t_us"),
        key.alias("seq"),
        F.when(key % 10 == 0, "end").when(key % 10 == 1, "close").otherwise("decision").alias("kind"),
        F.when(decided, choice).alias("choice"),
        F.when(decided, F.when(score >= 60, "ticket").when(score >= 30, "review").otherwise("log")).alias("outcome"),
    )


#: rec: one row a unit and event, with the episodes after it. s is the touched episode, m whom it is merged with, w whose ticket a decision reaches.
FOLD = f"""
ev AS (
  SELECT o_custkey AS unit_id, CAST((year(o_orderdate) * 4 + quarter(o_orderdate)) * 3 + o_orderkey % 3 AS BIGINT) AS ep, epoch_us(CAST(o_orderdate AS TIMESTAMP)) AS t_us, o_orderkey AS seq,
         CASE o_orderkey % 10 WHEN 0 THEN 'end' WHEN 1 THEN 'close' ELSE 'decision' END AS kind,
         CASE WHEN o_orderkey % 10 > 1 AND o_orderkey % 7 <> 0 THEN CASE WHEN o_orderkey % 11 = 0 THEN '{NONE_OF_THESE}' ELSE o_orderpriority END END AS choice,
         CASE WHEN o_orderkey * 37 % 100 >= 60 THEN 'ticket' WHEN o_orderkey * 37 % 100 >= 30 THEN 'review' ELSE 'log' END AS gate,
         row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n
  FROM orders),
rec AS (
  SELECT DISTINCT unit_id, CAST(0 AS BIGINT) AS n, CAST([] AS STRUCT(ep BIGINT, up BOOLEAN, mg BIGINT, st VARCHAR, fa VARCHAR, k BIGINT)[]) AS eps,
         CAST(NULL AS BIGINT) AS t_us, CAST(NULL AS BIGINT) AS seq, CAST(NULL AS BIGINT) AS ep, CAST([] AS VARCHAR[]) AS acts, CAST(NULL AS BIGINT) AS target
  FROM ev
  UNION ALL
  SELECT unit_id, n, list_transform(eps, lambda x: CASE
           WHEN kind = 'close' AND x.ep = ep AND x.st IS NOT NULL THEN {{'ep': x.ep, 'up': x.up, 'mg': x.mg, 'st': 'closed', 'fa': x.fa, 'k': x.k}}
           WHEN kind = 'end' AND x.ep = ep THEN {{'ep': x.ep, 'up': false, 'mg': x.mg, 'st': CASE WHEN x.st IN ('open', 'review') THEN 'resolved' ELSE x.st END, 'fa': x.fa, 'k': x.k}}
           WHEN named AND s.up THEN {{'ep': x.ep, 'up': x.up, 'mg': CASE WHEN x.ep = ep THEN m ELSE x.mg END,
             'st': CASE WHEN x.ep <> w THEN x.st WHEN x.st IS NULL THEN CASE gate WHEN 'ticket' THEN 'open' WHEN 'review' THEN 'review' END WHEN x.st = 'review' AND gate = 'ticket' THEN 'open' ELSE x.st END,
             'fa': CASE WHEN x.ep = w AND (x.st IN ('open', 'review') OR (x.st IS NULL AND gate <> 'log')) THEN choice ELSE x.fa END,
             'k': CASE WHEN x.ep = w AND x.st IN ('open', 'review') THEN x.k + 1 ELSE x.k END}}
           ELSE x END), t_us, seq, ep,
         CASE WHEN kind = 'close' THEN CASE WHEN s.st IS NOT NULL AND s.st <> 'closed' THEN ['closed'] ELSE [] END
              WHEN NOT s.up THEN []
              WHEN kind = 'end' THEN CASE WHEN s.st IN ('open', 'review') THEN ['resolved'] ELSE [] END
              WHEN NOT named THEN []
              ELSE list_concat(CASE WHEN m IS NOT NULL AND s.mg IS NULL THEN ['merged'] ELSE [] END,
                CASE WHEN z.st IS NULL THEN CASE WHEN gate = 'log' THEN [] ELSE ['opened'] END WHEN z.st = 'review' AND gate = 'ticket' THEN ['promoted'] WHEN z.st IN ('open', 'review') THEN ['updated'] ELSE [] END) END,
         CASE WHEN named AND s.up THEN w ELSE ep END
  FROM (SELECT *, list_filter(eps, lambda x: x.ep = w)[1] AS z FROM (
    SELECT *, coalesce(list_filter(eps, lambda x: x.ep = m AND x.up)[1].ep, ep) AS w FROM (
      SELECT *, coalesce(s.mg, CASE WHEN named AND gate <> 'log' AND s.st IS NULL AND s.up THEN
               list_filter(eps, lambda x: x.ep <> ep AND x.up AND x.mg IS NULL AND x.st IS NOT NULL AND x.st <> 'closed' AND x.fa = choice)[1].ep END) AS m FROM (
        SELECT *, list_filter(eps, lambda x: x.ep = ep)[1] AS s, kind = 'decision' AND choice IS NOT NULL AND choice <> '{NONE_OF_THESE}' AS named FROM (
          SELECT e.unit_id, e.n, e.ep, e.t_us, e.seq, e.kind, e.choice, e.gate,
                 CASE WHEN len(list_filter(r.eps, lambda x: x.ep = e.ep)) > 0 THEN r.eps ELSE list_append(r.eps, {{'ep': e.ep, 'up': true, 'mg': NULL, 'st': NULL, 'fa': NULL, 'k': 0}}) END AS eps
          FROM rec r JOIN ev e ON e.unit_id = r.unit_id AND e.n = r.n + 1)))))
)"""


@query(
    "ticket_lifecycle",
    f"""{FOLD}, ac AS (SELECT unit_id, t_us, seq, ep, target, eps, unnest(acts) AS action, unnest(range(1, len(acts) + 1)) AS i, len(acts) AS of FROM rec WHERE n > 0 AND len(acts) > 0)
SELECT unit_id, t_us, seq, ep AS episode_id, target AS ticket_id, action FROM ac""",
)
def ticket_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every change of every ticket."""
    return ticket_changes(ticket_events(spark, sf_dir)).select("unit_id", "t_us", "seq", "episode_id", "ticket_id", "action")


@query(
    "ticket_outcomes",
    f"""{FOLD}, la AS (SELECT unit_id, arg_max(eps, n) AS eps FROM rec GROUP BY unit_id),
ti AS (SELECT unit_id, unnest(eps) AS e FROM la)
SELECT unit_id, e.ep AS ticket_id, e.st AS status, e.fa AS fault, e.k AS updates FROM ti WHERE e.st IS NOT NULL""",
)
def ticket_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each ticket as its last change leaves it, by the greatest change a ticket: no window over a unit."""
    changes = ticket_changes(ticket_events(spark, sf_dir))
    last = F.max_by(F.struct("status", "fault", "updates"), F.struct("t_us", "seq", F.when(F.col("action") == "merged", 0).otherwise(1)))
    return changes.groupBy("unit_id", "ticket_id").agg(last.alias("last")).select("unit_id", "ticket_id", "last.status", "last.fault", "last.updates")
