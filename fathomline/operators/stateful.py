"""Sequential machines, written once as folds over a unit's ordered samples.

``run_batch`` mounts a fold on grouped batches, ``streaming.machines`` the same fold on a stream.
A machine has a state that is a plain tuple, so both keep and restore it alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame

SAMPLE = "unit_id long, seq long, t_us long, v double"
EVENT = "unit_id long, seq long, t_us long, kind string, since_us long"


@dataclass(frozen=True)
class Hysteresis:
    """An alarm with on-delay, hysteresis and reset on discontinuity.

    Raised once the value has been above ``on`` for ``delay_s``; cleared when it falls below
    ``off``; a gap of more than ``gap_s`` or time going back clears it without a trace of the past.
    State: (last time, time above since, raised).
    """

    on: float
    off: float
    delay_s: float
    gap_s: float
    empty: tuple = (None, None, False)
    state: str = "last long, above long, up boolean"

    def step(self, state: tuple, t_us: int, v: float | None) -> tuple[tuple, list[tuple[str, int]]]:
        last, above, up = state
        out = []
        if last is not None and not 0 <= t_us - last <= self.gap_s * 1e6:
            if up:
                out.append(("reset", last))
            above, up = None, False
        if v is not None and v == v:
            if up and v < self.off:
                out.append(("clear", above))
                above, up = None, False
            elif not up and v > self.on:
                above = t_us if above is None else above
                if t_us - above >= self.delay_s * 1e6:
                    out.append(("raise", above))
                    up = True
            elif not up:
                above = None
        return (t_us, above, up), out


@dataclass(frozen=True)
class Cadence:
    """Re-decision while a condition fires: at its start, then every ``every_s``; silence of ``silence_s`` ends it.

    State: (last firing, last decision).
    """

    above: float
    every_s: float
    silence_s: float
    empty: tuple = (None, None)
    state: str = "last long, decided long"

    def step(self, state: tuple, t_us: int, v: float | None) -> tuple[tuple, list[tuple[str, int]]]:
        last, decided = state
        if v is None or not v > self.above:
            return state, []
        if last is None or t_us - last > self.silence_s * 1e6:
            return (t_us, t_us), [("open", t_us)]
        if t_us - decided >= self.every_s * 1e6:
            return (t_us, t_us), [("decide", decided)]
        return (t_us, decided), []


def fold(machine, state: tuple, rows: Iterator[tuple]) -> tuple[tuple, list[tuple]]:
    """Run a machine over (unit_id, seq, t_us, v) rows in order."""
    out = []
    for unit, seq, t_us, v in rows:
        state, events = machine.step(state, int(t_us), None if v is None or v != v else float(v))
        out += [(unit, seq, t_us, kind, since) for kind, since in events]
    return state, out


def run_batch(samples: DataFrame, machine) -> DataFrame:
    """The machine's events over each unit's samples (``SAMPLE``).

    Sequential by nature: a unit's history is one group, sorted by Spark and read in Arrow batches,
    so memory holds a batch and the state.
    """

    def run(batches):
        key, state = None, machine.empty
        for pdf in batches:
            out: list[tuple] = []
            for unit, part in pdf.groupby("unit_id", sort=False):
                if unit != key:
                    key, state = unit, machine.empty
                state, events = fold(machine, state, part[["unit_id", "seq", "t_us", "v"]].itertuples(index=False, name=None))
                out += events
            yield pd.DataFrame(out, columns=["unit_id", "seq", "t_us", "kind", "since_us"])

    parts = int(samples.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = samples.select("unit_id", "seq", "t_us", "v").repartition(parts, "unit_id").sortWithinPartitions("unit_id", "t_us", "seq")
    return ordered.mapInPandas(run, EVENT)
