"""Alarm messages over samples, from a registry: state guard, start mask, on-delay, hysteresis, manual latch and restart.

Everything is windows over a part of a unit's time, which begins with what earlier parts carry into it; a message's
condition is a comparison of one signal, which may be derived. A sample either confirms the message (the plain
comparison has held for the delay), or denies it (the comparison widened by the reset band fails), or says nothing; the
last word stands. So no state runs through a task, and rows meet the registry by an equi-join on the signal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.conditions import COMPARE, GUARDS
from .chunks import in_parts

ALARM = "code string, bit int, guard string, signal string, op string, threshold double, hysteresis double, delay_s double, mask_s double, reset string"
#: How a message is reset.
RESETS = ("auto", "manual", "manual_service")


def alarm_registry(spark: SparkSession, entries: list[dict], settings: dict[str, float] | None = None) -> DataFrame:
    """Messages as a table of ``ALARM``; a threshold may name a setting, and what isn't given is 0, ``any`` or ``auto``.

    An unknown guard, comparison, reset or setting and a code or bit given twice are errors.
    """
    rows = []
    for entry in entries:
        e = {"guard": "any", "hysteresis": 0.0, "delay_s": 0.0, "mask_s": 0.0, "reset": "auto"} | entry
        if isinstance(e["threshold"], str):
            if e["threshold"] not in (settings or {}):
                raise ValueError(f"{e['code']}: there is no setting {e['threshold']}")
            e["threshold"] = settings[e["threshold"]]
        for field, known in (("guard", GUARDS), ("op", COMPARE), ("reset", RESETS)):
            if e[field] not in known:
                raise ValueError(f"{e['code']}: {e[field]} is no {field}")
        rows.append(tuple(float(e[n]) if kind == "double" else e[n] for n, kind in (c.split() for c in ALARM.split(", "))))
    for at, name in ((0, "code"), (1, "bit")):
        if len({r[at] for r in rows}) < len(rows):
            raise ValueError(f"a {name} stands for two messages")
    return spark.createDataFrame(rows, ALARM)


def _admitted(mode: Column) -> Column:
    """Whether a message's guard admits the machine state."""
    out = F
    for name, modes in GUARDS.items():
        out = out.when(F.col("guard") == name, F.lit(True) if modes is None else F.coalesce(mode.isin(*modes), F.lit(False)))
    return out.otherwise(False)


def _compared(band: Column) -> Column:
    """The comparison with the threshold moved by ``band`` towards the side of no alarm; a missing value holds nothing."""
    v, op, limit = F.col("v"), F.col("op"), F.col("threshold")
    return F.when(op == "gt", v > limit - band).when(op == "ge", v >= limit - band).when(op == "lt", v < limit + band).when(op == "le", v <= limit + band).when(op == "eq", v == limit).otherwise(v != limit)


_PART = ["unit_id", "chunk"]


def _last(value: Column) -> Column:
    """The last of the values that are there, as an aggregate."""
    return F.max_by(value, F.when(value.isNotNull(), F.struct("t_us", "seq")))


def _with_starts(samples: DataFrame) -> DataFrame:
    """``samples`` with _first (of its segment), _next_t and _start, the segment's last start so far."""
    own = Window.partitionBy(*_PART).orderBy("t_us", "seq")
    start = lambda p, segment, mode, t: F.when(p["segment"].eqNullSafe(segment) & (p["mode"] == "off") & (mode != "off"), F.struct(t.alias("t_us"), segment.alias("segment")))
    row = (F.col("segment"), F.col("mode"), F.col("t_us"))
    df = samples.withColumns({"_p": F.lag(F.struct("segment", "mode")).over(own), "_n": F.lead("t_us").over(own)}).withColumn("_s", start(F.col("_p"), *row))
    point = F.struct("t_us", "seq", "segment", "mode")
    ends = df.groupBy(*_PART).agg(F.min(point).alias("first"), F.max(point).alias("last"), _last(F.col("_s")).alias("_s"))
    unit = Window.partitionBy("unit_id").orderBy("chunk")
    ends = ends.withColumns({"_pin": F.lag(F.struct("last.segment", "last.mode")).over(unit), "_nin": F.lead("first.t_us").over(unit)})
    ends = ends.withColumn("_s", F.coalesce("_s", start(F.col("_pin"), F.col("first.segment"), F.col("first.mode"), F.col("first.t_us"))))
    ends = ends.select(*_PART, "_pin", "_nin", F.last("_s", ignorenulls=True).over(unit.rowsBetween(Window.unboundedPreceding, -1)).alias("_sin"))
    df = df.join(ends, _PART, "left").withColumns({"_p": F.coalesce("_p", "_pin"), "_next_t": F.coalesce("_n", "_nin")})
    df = df.withColumn("_s", start(F.col("_p"), *row))
    df = df.withColumn("_s", F.coalesce(F.last("_s", ignorenulls=True).over(own.rowsBetween(Window.unboundedPreceding, 0)), F.col("_sin")))
    df = df.withColumn("_first", F.col("_p").isNull() | ~F.col("_p.segment").eqNullSafe(F.col("segment")))
    df = df.withColumn("_start", F.when(F.col("_s.segment").eqNullSafe(F.col("segment")), F.col("_s.t_us")))
    return df.drop("_p", "_n", "_s", "_pin", "_nin", "_sin")


def alarm_states(samples: DataFrame, alarms: DataFrame, signals: list[str]) -> DataFrame:
    """(unit_id, segment, seq, t_us, code, bit, on, was) at every sample and message; ``was`` is ``on`` of the sample before.

    ``samples`` has unit_id, segment, seq, t_us, mode and the columns ``signals``, and ``chunk`` if the parts of time are known. A new
    segment forgets timers, the last start and latches; a message that was on stays on while its widened condition still holds. NaN is a
    missing value.
    """
    if "chunk" not in samples.columns:
        samples = in_parts(samples, "unit_id", F.col("t_us"))
    ids = ["unit_id", "chunk", "segment", "seq", "t_us", "mode", "_first", "_next_t", "_start"]
    long = _with_starts(samples).unpivot(ids, signals, "signal", "v").join(F.broadcast(alarms), "signal")
    long = long.withColumn("v", F.when(~F.isnan("v"), F.col("v")))
    group = [*_PART, "code"]
    own = Window.partitionBy(*group).orderBy("t_us", "seq")
    so_far = own.rowsBetween(Window.unboundedPreceding, 0)
    t, plain, wide, first = (F.col(c) for c in ("t_us", "_plain", "_wide", "_first"))
    seen = _admitted(F.col("mode")) & ~F.coalesce(t - F.col("_start") < F.col("mask_s") * 1_000_000, F.lit(False))
    yes = lambda c: F.coalesce(seen & c, F.lit(False))
    df = long.withColumns({"_plain": yes(_compared(F.lit(0.0))), "_wide": yes(_compared(F.col("hysteresis")))})
    # the comparison holds since the sample behind the last one at which it did not, or since the segment began
    df = df.withColumn("_from", F.when(~plain, F.col("_next_t")).when(first, t))
    df = df.withColumn("_since", F.last("_from", ignorenulls=True).over(so_far))
    word = F.when(plain & (t - F.col("_since") >= F.col("delay_s") * 1_000_000), True).when(~wide, False)
    carried = _carried(df, word, so_far)
    df = df.join(carried, group, "left").withColumn("_since", F.coalesce("_since", "_since_in"))
    df = df.withColumn("_word", word).withColumn("_active", F.coalesce(F.last("_word", ignorenulls=True).over(so_far), "_active_in", F.lit(False)))
    latch = F.last(F.when(F.col("_active"), True).when(first, False), ignorenulls=True).over(so_far)
    keeps = F.col("reset") != "auto"
    df = df.withColumn("on", F.col("_active") | (keeps & F.coalesce(latch, "_latch_in", F.lit(False))))
    was = F.coalesce(F.lag("on").over(own), F.col("_active_in") | (keeps & F.col("_latch_in")), F.lit(False))
    return df.select("unit_id", "segment", "seq", "t_us", "code", "bit", "on", was.alias("was"))


def _carried(df: DataFrame, word: Column, so_far: Window) -> DataFrame:
    """(unit_id, chunk, code, _since_in, _active_in, _latch_in): what each part of a unit's time begins with.

    Samples at a part's beginning whose comparison has held since before it speak only once it is known since when: the last of
    them has held longest. A segment may begin with what was on before the part; that is 2 until it is known.
    """
    open_ = F.col("_plain") & F.col("_since").isNull()
    df = df.withColumn("_open", open_).withColumn("_word", F.when(~F.col("_open"), word))
    df = df.withColumn("_active", F.last("_word", ignorenulls=True).over(so_far))
    begun = F.when(F.col("_active").isNull(), 2).when(F.col("_active"), 1).otherwise(0)
    latch = F.when(F.col("_word"), 1).when(F.col("_first"), begun)
    ends = df.groupBy(*_PART, "code").agg(
        _last(F.col("_from")).alias("_from"),
        F.max(F.when(F.col("_open"), F.col("t_us"))).alias("_open_t"),
        F.bool_or(F.col("_open") & ~F.col("_wide")).alias("_open_off"),
        _last(F.col("_word")).alias("_word"),
        _last(latch).alias("_latch"),
        F.max("delay_s").alias("delay_s"),
    )
    earlier = Window.partitionBy("unit_id", "code").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    so_far_of = lambda c: F.last(c, ignorenulls=True).over(earlier)
    ends = ends.withColumn("_since_in", so_far_of("_from"))
    held = F.col("_open_t") - F.col("_since_in") >= F.col("delay_s") * 1_000_000
    ends = ends.withColumn("_spoken", F.when(held, True).when(F.col("_open_off"), False))
    ends = ends.withColumn("_word", F.coalesce("_word", "_spoken")).withColumn("_active_in", F.coalesce(so_far_of("_word"), F.lit(False)))
    ends = ends.withColumn("_latch", F.when(F.col("_latch") == 2, F.coalesce("_spoken", "_active_in")).when(F.col("_latch").isNotNull(), F.col("_latch") == 1).when(held, True))
    return ends.select(*_PART, "code", "_since_in", "_active_in", F.coalesce(so_far_of("_latch"), F.lit(False)).alias("_latch_in"))


def alarm_changes(states: DataFrame) -> DataFrame:
    """The samples at which a message is raised or goes: (unit_id, code, seq, t_us, on)."""
    return states.where(F.col("on") != F.col("was")).select("unit_id", "code", "seq", "t_us", "on")


def alarm_codes(states: DataFrame) -> DataFrame:
    """(unit_id, seq, codes): the messages that are on at each sample, by ascending bit."""
    lit = F.array_sort(F.collect_list(F.when(F.col("on"), F.struct("bit", "code"))))
    return states.groupBy("unit_id", "seq").agg(F.transform(lit, lambda x: x["code"]).alias("codes"))


def hysteresis_events(samples: DataFrame, on: float, off: float, delay_s: float, gap_s: float) -> DataFrame:
    """(unit_id, seq, t_us, kind, since_us): the events of ``stateful.Hysteresis``, by windows.

    Raised once the value has been above ``on`` for the delay, cleared below ``off``; a gap or time going back resets. A
    missing value changes nothing.
    """
    unit = Window.partitionBy("unit_id").orderBy("t_us", "seq")
    t, v = F.col("t_us"), F.when(~F.isnan("v"), F.col("v"))
    before = F.lag("t_us").over(unit)
    df = samples.select("unit_id", "seq", "t_us", v.alias("v"), before.alias("_last"))
    df = df.withColumn("_new", F.coalesce(~(t - F.col("_last")).between(0, int(gap_s * 1_000_000)), F.lit(False)).cast("int"))
    df = df.withColumn("_seg", F.sum("_new").over(unit.rowsBetween(Window.unboundedPreceding, 0)))
    seg = Window.partitionBy("unit_id", "_seg").orderBy("t_us", "seq")
    so_far, past = seg.rowsBetween(Window.unboundedPreceding, 0), seg.rowsBetween(Window.unboundedPreceding, -1)
    above = F.col("v") > on
    df = df.withColumn("_since", F.when(above & ~F.coalesce(F.last(above, ignorenulls=True).over(past), F.lit(False)), t))
    df = df.withColumn("_since", F.last("_since", ignorenulls=True).over(so_far))
    df = df.withColumn("_word", F.when(above & (t - F.col("_since") >= delay_s * 1_000_000), True).when(F.col("v") < off, False))
    df = df.withColumn("_up", F.coalesce(F.last("_word", ignorenulls=True).over(so_far), F.lit(False)))
    df = df.withColumn("_was", F.lag("_up", 1, False).over(seg))
    df = df.withColumn("_raised", F.last(F.when(F.col("_up") & ~F.col("_was"), F.col("_since")), ignorenulls=True).over(so_far))
    df = df.withColumn("_lost", (F.col("_new") == 1) & F.lag("_up", 1, False).over(unit))
    event = lambda kind, since: F.struct(F.lit(kind).alias("kind"), since.alias("since_us"))
    found = F.array_compact(F.array(F.when(F.col("_lost"), event("reset", F.col("_last"))), F.when(F.col("_up") & ~F.col("_was"), event("raise", F.col("_since"))), F.when(~F.col("_up") & F.col("_was"), event("clear", F.col("_raised")))))
    return df.select("unit_id", "seq", "t_us", F.inline(found))
