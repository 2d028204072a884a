"""Windows that look back a bounded time, at a cost that grows with the rows and not with the rows of a frame.

Spark works a sliding frame out anew at every row, so its cost is rows times rows a frame. Here, figures that two parts of a frame give
together come from running windows: time is cut into blocks as long as the look-back, and a frame is the end of one block and the
beginning of the next. Medians come from a rolling pass over chunks of time that hold copies of the frame before them.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pandas.api.indexers import BaseIndexer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

#: A chunk is so many look-backs long.
CHUNKS = 8


def look_back_chunks(df: DataFrame, t_us: str, chunk_us: int, look_back_us: int) -> DataFrame:
    """``df`` with ``chunk`` and ``own``: each row in its own chunk of time, and copied into those where some row may look back to it.

    Windows by (key, chunk) whose range frame is no longer than ``look_back_us`` are whole on rows that are ``own``; the others go
    after them. Only the end of a chunk is copied, so a chunk several times as long as the look-back costs little. Rows without a time
    have neither chunk nor owner.
    """
    at = F.expr(f"floor({t_us} / {chunk_us})")
    last = F.expr(f"floor(({t_us} + {look_back_us}) / {chunk_us})")
    return df.withColumn("chunk", F.explode_outer(F.sequence(at, last))).withColumn("own", F.col("chunk") == at)


#: A unit's whole time is cut into so many equally long parts, where something is carried through all of it.
PARTS = 256


def in_parts(df: DataFrame, unit: str, t_us: Column) -> DataFrame:
    """``df`` with ``chunk``, the part of its unit's time that a row lies in; rows without a time are part -1, and those without a unit.

    What runs through a unit's history is worked out by part, so that no task holds a history: each part's end in few rows, those
    from part to part, then every row from what its part begins with.
    """
    span = df.groupBy(unit).agg(F.min(t_us).alias("_least"), F.max(t_us).alias("_most"))
    part = F.expr(f"(_us - _least) * {PARTS} div (_most - _least + 1)")
    return df.withColumn("_us", t_us).join(span, unit, "left").withColumn("chunk", F.coalesce(part, F.lit(-1))).drop("_us", "_least", "_most")


class Figure:
    """A frame's figure from those of its two parts: ``parts`` are aggregates over one, ``whole`` joins two lists of them."""

    def __init__(self, parts, whole):
        self.parts, self.whole = parts, whole


def _or_zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0.0))


def count(v: Column) -> Figure:
    return Figure(lambda own: [F.count(F.when(own, v))], lambda a, b: a[0] + b[0])


def least(v: Column) -> Figure:
    return Figure(lambda own: [F.min(F.when(own, v))], lambda a, b: F.least(a[0], b[0]))


def greatest(v: Column) -> Figure:
    return Figure(lambda own: [F.max(F.when(own, v))], lambda a, b: F.greatest(a[0], b[0]))


def total(v: Column) -> Figure:
    """The sum of whole numbers; null where there is none."""
    return Figure(lambda own: [F.sum(F.when(own, v))], lambda a, b: F.when(a[0].isNull(), b[0]).when(b[0].isNull(), a[0]).otherwise(a[0] + b[0]))


def _deviations(n: tuple, x: tuple, y: tuple, s: tuple) -> Column:
    """The sum of products of deviations over both parts, from their counts, means and own sums. Running totals are not subtracted, which would lose small spreads."""
    return _or_zero(s[0]) + _or_zero(s[1]) + _or_zero((x[1] - x[0]) * (y[1] - y[0]) * n[0] * n[1] / F.nullif(n[0] + n[1], F.lit(0)))


def spread(v: Column) -> Figure:
    """The sample's standard deviation."""
    parts = lambda own: [F.count(F.when(own, v)), F.avg(F.when(own, v)), F.var_pop(F.when(own, v))]

    def whole(a, b):
        n, mean = (a[0], b[0]), (a[1], b[1])
        return F.when(a[0] + b[0] > 1, F.sqrt(_deviations(n, mean, mean, (a[2] * a[0], b[2] * b[0])) / (a[0] + b[0] - 1)))

    return Figure(parts, whole)


def slope(y: Column, x: Column) -> Figure:
    """The slope of the least-squares line; null where x does not vary."""

    def parts(own):
        p = (F.when(own, y), F.when(own, x))
        return [F.regr_count(*p), F.regr_avgx(*p), F.regr_avgy(*p), F.regr_sxx(*p), F.regr_sxy(*p)]

    def whole(a, b):
        n, mx, my, xx, xy = zip(a, b)
        width = _deviations(n, mx, mx, xx)
        return F.when(width > 0, _deviations(n, mx, my, xy) / width)

    return Figure(parts, whole)


def over_frames(df: DataFrame, keys: tuple, t_us: Column, length_us: int, figures: dict[str, Figure]) -> DataFrame:
    """``df`` with a column for each of ``figures`` over [t - length, t] of its keys; rows of one time are peers, those without one too.

    A row stands in its own block and, later by the length, in the next one, where it counts for as long as frames still reach it.
    """
    block = F.floor(t_us / length_us)
    place = lambda at, own: F.struct(F.floor(at / length_us).alias("_block"), at.alias("_at"), F.lit(own).alias("_own"))
    places = F.when(block.isNull(), F.array(place(t_us, True))).otherwise(F.array(place(t_us, True), place(t_us + length_us, False)))
    both = df.withColumn("_place", F.explode(places)).select("*", "_place.*").drop("_place")
    group = Window.partitionBy(*keys, "_block")
    begun = group.orderBy("_at").rangeBetween(Window.unboundedPreceding, 0)
    left = group.orderBy(F.desc("_at")).rangeBetween(Window.unboundedPreceding, 0)
    names, part = {}, {}
    for name, f in figures.items():
        for side, own, w in (("b", F.col("_own"), begun), ("l", ~F.col("_own"), left)):
            made = {f"_{side}{i}_{name}": c.over(w) for i, c in enumerate(f.parts(own))}
            part |= made
            names[side, name] = [F.col(c) for c in made]
    both = both.withColumns(part).where("_own")
    return both.withColumns({name: f.whole(names["l", name], names["b", name]) for name, f in figures.items()}).drop(*part, "_block", "_at", "_own")


class _Bounds(BaseIndexer):
    def get_window_bounds(self, num_values=0, min_periods=None, center=None, closed=None, step=None):
        return self.start, self.end


def rolling_median(t: np.ndarray, v: np.ndarray, missing: np.ndarray, length: int) -> np.ndarray:
    """The median of [t - length, t] at every place, for ascending ``t``; NaN counts as greatest, missing values don't count. Masked where there is none."""
    bounds = _Bounds(start=np.searchsorted(t, t - length, "left"), end=np.searchsorted(t, t, "right"))
    at = lambda values: pd.Series(np.where(missing, np.nan, values)).rolling(bounds, min_periods=1)
    if np.isfinite(v[~missing]).all():
        out = at(v).median().to_numpy()
        return np.ma.masked_array(out, np.isnan(out))
    # pandas takes no infinities: ranks stand in
    order = np.argsort(v, kind="stable")
    rank = np.empty(len(v))
    rank[order] = np.arange(len(v))
    low, high = (at(rank).quantile(0.5, interpolation=side).to_numpy() for side in ("lower", "higher"))
    none = np.isnan(low)
    low, high = (v[order[np.where(none, 0, r).astype(np.int64)]] for r in (low, high))
    with np.errstate(invalid="ignore"):
        return np.ma.masked_array(np.where(low == high, low, 0.5 * low + 0.5 * high), none)


def with_medians(df: DataFrame, keys: tuple, t_us: Column, medians: dict[str, tuple[str, int]]) -> DataFrame:
    """``df`` with medians: name -> (column, look-back in microseconds). A task holds one key's chunk of ``CHUNKS`` look-backs of the longest one."""
    longest = max(us for _, us in medians.values())
    typed = df.withColumns({"_us": t_us, **{f"_v_{name}": F.col(c).cast("double") for name, (c, _) in medians.items()}})
    parts = look_back_chunks(typed, "_us", CHUNKS * longest, longest)
    # rows without a time are a chunk of their own, peers of one another
    parts = parts.withColumns({"own": F.coalesce("own", F.lit(True)), "_us": F.coalesce("_us", F.lit(0))})
    carried = df.columns
    schema = StructType([*df.schema.fields, *[StructField(name, DoubleType()) for name in medians]])

    def run(group: pa.Table) -> pa.Table:
        t = group.column("_us").to_numpy()
        order = np.argsort(t, kind="stable")
        own = group.column("own").to_numpy(zero_copy_only=False)
        made = []
        for name, (_, us) in medians.items():
            column = group.column(f"_v_{name}").combine_chunks()
            missing = column.is_null().to_numpy(zero_copy_only=False)
            found = rolling_median(t[order], column.fill_null(0.0).to_numpy(zero_copy_only=False)[order], missing[order], us)
            back = np.empty(len(t)), np.ones(len(t), bool)
            back[0][order], back[1][order] = found.data, np.ma.getmaskarray(found)
            made.append(pa.array(back[0][own], pa.float64(), mask=back[1][own]))
        kept = group.select(carried).filter(pa.array(own))
        for name, values in zip(medians, made):
            kept = kept.append_column(name, values)
        return kept

    return parts.groupBy(*keys, "chunk").applyInArrow(run, schema)
