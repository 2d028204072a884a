"""Queries of seeded hashes and noise, overlays and delivery, with SQL in 128-bit arithmetic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expressions as x
from ..functions import hashing as h
from ..operators.delivery import accepted
from ..operators.overlays import overlaid
from ..sources.bridge import TELEMETRY_SQL, telemetry
from ..sources.tables import table

QUERIES: dict = {}
SQL: dict = {}


def query(name: str, sql: str):
    def add(f):
        QUERIES[name], SQL[name] = f, f"WITH {sql}"
        return f

    return add


def _fold(values: str, start: str = "14695981039346656037") -> str:
    """The hash of a list of byte values."""
    return f"list_reduce(list_prepend(CAST({start} AS UHUGEINT), {values}), lambda a, b: xor(a, b) * CAST(1099511628211 AS UHUGEINT) % CAST(18446744073709551616 AS UHUGEINT))"


def _bytes(text: str) -> str:
    return f"list_transform(range(1, strlen({text}) + 1), lambda i: CAST('0x' || substr(hex(encode({text})), 2 * i - 1, 2) AS UHUGEINT))"


def _number(value: str, size: int = 8) -> str:
    return f"list_transform(range({size}), lambda i: CAST({value} AS UHUGEINT) // CAST(pow(256, {size - 1} - i) AS UHUGEINT) % CAST(256 AS UHUGEINT))"


_U = lambda hashed: f"(CAST({hashed} // CAST(2048 AS UHUGEINT) AS DOUBLE) / 9007199254740992.0)"


@query("fnv_hashes", f"n AS (SELECT DISTINCT p_name AS name FROM part UNION SELECT DISTINCT c_name FROM customer) SELECT name, lower(lpad(hex(CAST({_fold(_bytes('name'))} AS UBIGINT)), 16, '0')) AS fnv FROM n")
def fnv_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "part").select(F.col("p_name").alias("name")).union(table(spark, sf_dir, "customer").select("c_name")).distinct()
    return names.select("name", F.lower(F.lpad(F.hex(h.fnv1a(F.col("name"))), 16, "0")).alias("fnv"))


@query(
    "ambient_temperature",
    f"""{TELEMETRY_SQL}, u AS (SELECT unit_id, seq, sim_ts, {_U(_fold(_number("epoch_us(sim_ts) // 1000")))} AS u FROM tel)
SELECT unit_id, seq, round(15 + 7 * sin(2 * pi() * (dayofyear(sim_ts) - 105) / 365) + 4 * sin(2 * pi() * (hour(sim_ts) - 9) / 24) + (2 * u - 1) * {h.AMBIENT_NOISE}, 6) AS degrees FROM u""",
)
def ambient_temperature(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Season, day and the deterministic noise."""
    ts = F.col("sim_ts")
    return telemetry(spark, sf_dir).select("unit_id", "seq", F.round(x.ambient_seasonal(ts) + h.ambient_noise(F.floor(F.unix_micros(ts) / 1000)), 6).alias("degrees"))


OPS = ("offset", "scale", "ramp", "noise", "stuck", "dropout")
OVERLAY = f"""{TELEMETRY_SQL},
o AS (SELECT unit_id, tag, seq, epoch_us(sim_ts) AS t_us, v, epoch_us(sim_ts) // 86400000000 AS day, {list(OPS)}[CAST(epoch_us(sim_ts) // 86400000000 % 6 AS INTEGER) + 1] AS op FROM tel),
p AS (SELECT *, 'day-' || day AS instance, (t_us - day * 86400000000) / 1000000.0 - 7200 AS t FROM o),
w AS (SELECT *, t >= 0 AND t < 43200 AS ins, CASE WHEN t < 0 OR t >= 43200 THEN 0.0 WHEN t < 7200 THEN t / 7200 WHEN t < 36000 THEN 1.0 ELSE (43200 - t) / 7200 END AS m FROM p),
d0 AS (SELECT *, {_fold(f"list_concat({_bytes('instance')}, {_number('t_us // 1000')}, {_number('0', 4)})")} AS seed FROM w),
d1 AS (SELECT *, {_U("seed")} AS u1, {_U(_fold(_number("seed")))} AS u2,
         first_value(CASE WHEN ins THEN v END IGNORE NULLS) OVER (PARTITION BY unit_id, tag, day ORDER BY t_us, seq ROWS UNBOUNDED PRECEDING) AS held FROM d0)"""


@query(
    "overlay_series",
    f"""{OVERLAY} SELECT unit_id, seq, op, round(m, 6) AS weight, round(CASE WHEN NOT ins THEN v WHEN op = 'offset' THEN v + 1.5 * m WHEN op = 'scale' THEN v * (1 + 0.5 * m) WHEN op = 'ramp' THEN v + greatest(-20, least(20, 1.5 * (t / 60) * m))
  WHEN op = 'noise' THEN v + sqrt(-2 * ln(1 - u1)) * cos(2 * pi() * u2) * 1.5 * m WHEN op = 'stuck' THEN held WHEN op = 'dropout' THEN NULL END, 5) AS shown FROM d1""",
)
def overlay_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every day has one overlay from two in the morning on, over ten hours and two of fading."""
    tel = telemetry(spark, sf_dir).select("unit_id", "tag", "seq", F.unix_micros("sim_ts").alias("t_us"), "v")
    day = F.expr("t_us div 86400000000")
    op = F.element_at(F.array(*map(F.lit, OPS)), (day % 6).cast("int") + 1)
    given = {"instance": F.concat(F.lit("day-"), day.cast("string")), "op": op, "amount": F.lit(1.5), "cap": F.lit(20.0), "value": F.lit(None).cast("double"), "from_us": day * 86_400_000_000 + 7_200_000_000, "ramp_in_s": F.lit(7200.0), "hold_s": F.lit(28800.0), "ramp_out_s": F.lit(7200.0)}
    return overlaid(tel.withColumns(given)).select("unit_id", "seq", "op", F.round("weight", 6).alias("weight"), F.round("shown", 5).alias("shown"))


@query(
    "accepted_samples",
    f"""{TELEMETRY_SQL},
d AS (SELECT unit_id, tag, sim_ts, seq % 700 AS seq, seq * 2 AS arrival, seq % 700 < 4 AS disc FROM tel UNION ALL SELECT unit_id, tag, sim_ts, seq % 700, seq * 2 + 41, false FROM tel WHERE seq % 3 = 0),
g AS (SELECT *, sum(CASE WHEN disc THEN 1 ELSE 0 END) OVER (PARTITION BY unit_id ORDER BY arrival, sim_ts, seq ROWS UNBOUNDED PRECEDING) AS segment FROM d),
m AS (SELECT *, max(seq) OVER (PARTITION BY unit_id, segment ORDER BY arrival, sim_ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS most FROM g)
SELECT unit_id, CAST(segment AS BIGINT) AS segment, seq, arrival FROM m WHERE disc OR most IS NULL OR seq > most""",
)
def accepted_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers that start anew every 700 samples, with every third sample delivered again."""
    tel = telemetry(spark, sf_dir)
    once = tel.select("unit_id", "sim_ts", (F.col("seq") % 700).alias("seq"), (F.col("seq") * 2).alias("arrival"), (F.col("seq") % 700 < 4).alias("discontinuity"))
    again = tel.where("seq % 3 = 0").select("unit_id", "sim_ts", F.col("seq") % 700, F.col("seq") * 2 + 41, F.lit(False))
    return accepted(once.union(again)).select("unit_id", "segment", "seq", "arrival")
