"""Episodes and their tickets: opening, promotion, update, merge, resolution and a technician's closing, as one fold.

The fold's state is a unit's episodes in order of opening; an event touches one of them, and a decision may
send an episode to another one's ticket. ``ticket_changes`` mounts it on a table, ``streaming.machines.ticket_stream`` on a
stream. A unit's events are one sorted run read in batches: memory holds a batch and the unit's episodes.

Events (unit_id, episode_id, t_us, seq, kind, choice, outcome): kind is ``decision``, ``end`` or ``close``; a decision's
choice is null where it was not answered; outcome is the gate's, ``ticket``, ``review`` or ``log``. Equal times go by seq.

* A decision that names a fault opens a ticket as ``open`` or ``review``, unless the gate only logs it. While the ticket lives,
  later ones update it and its fault, and the gate's ``ticket`` promotes it.
* An episode without ticket whose decision could open one is merged into the first open episode of the unit
  that isn't merged itself and has a ticket of that fault that no technician closed. From then on its decisions go
  there while that episode is open, and to itself afterwards.
* The end of an episode resolves its living ticket; nothing else happens to an ended episode but a technician's closing.
* With ``silence_s`` an episode without event for so long ends at that moment; ``until_us`` is how far time has come.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from .decisions import NONE_OF_THESE

CHANGE = "unit_id long, t_us long, seq long, episode_id long, ticket_id long, action string, status string, fault string, updates long, live long"
COLUMNS = [c.split()[0] for c in CHANGE.split(", ")]
LIVE = ("review", "open")


@dataclass
class Episode:
    """An episode and, under its id, its ticket."""

    id: int
    last_us: int
    open: bool = True
    merged: int | None = None
    status: str | None = None
    fault: str | None = None
    updates: int = 0


class Unit:
    """A unit's episodes; ``text`` and ``Unit(text)`` keep and restore them."""

    def __init__(self, text: str | None = None, silence_s: float | None = None) -> None:
        self.silence_us = None if silence_s is None else int(silence_s * 1_000_000)
        self.by_id = {e["id"]: Episode(**e) for e in json.loads(text)} if text else {}

    @property
    def text(self) -> str:
        return json.dumps([vars(e) for e in self.by_id.values()])

    def _row(self, unit: int, t_us: int, seq: int | None, episode: Episode, ticket: Episode, action: str) -> tuple:
        live = sum(e.status in LIVE for e in self.by_id.values())
        return unit, t_us, seq, episode.id, ticket.id, action, ticket.status, ticket.fault, ticket.updates, live

    def _end(self, unit: int, t_us: int, seq: int | None, episode: Episode) -> Iterator[tuple]:
        episode.open = False
        if episode.status in LIVE:
            episode.status = "resolved"
            yield self._row(unit, t_us, seq, episode, episode, "resolved")

    def advance(self, unit: int, now_us: int) -> Iterator[tuple]:
        """End what has been silent too long by ``now_us``, in order of time, then of opening."""
        if self.silence_us is None:
            return
        due = [(e.last_us + self.silence_us, e) for e in self.by_id.values() if e.open and e.last_us + self.silence_us <= now_us]
        for at, episode in sorted(due, key=lambda x: x[0]):
            yield from self._end(unit, at, None, episode)

    def next_end(self) -> int | None:
        """When the next episode ends if nothing more comes."""
        open_ = [e.last_us for e in self.by_id.values() if e.open]
        return min(open_) + self.silence_us if open_ and self.silence_us is not None else None

    def _target(self, episode: Episode, fault: str) -> int | None:
        for other in self.by_id.values():
            if other is not episode and other.open and other.merged is None and other.status not in (None, "closed") and other.fault == fault:
                return other.id
        return None

    def step(self, unit: int, episode_id: int, t_us: int, seq: int, kind: str, choice: str | None, outcome: str | None) -> Iterator[tuple]:
        """The changes that one event makes."""
        yield from self.advance(unit, t_us)
        episode = self.by_id.setdefault(episode_id, Episode(episode_id, t_us))
        if kind == "close":
            if episode.status not in (None, "closed"):
                episode.status = "closed"
                yield self._row(unit, t_us, seq, episode, episode, "closed")
            return
        if not episode.open:
            return
        episode.last_us = t_us
        if kind == "end":
            yield from self._end(unit, t_us, seq, episode)
            return
        if choice is None or choice == NONE_OF_THESE:
            return
        if outcome != "log" and episode.status is None and episode.merged is None:
            episode.merged = self._target(episode, choice)
            if episode.merged is not None:
                yield self._row(unit, t_us, seq, episode, self.by_id[episode.merged], "merged")
        ticket = self.by_id[episode.merged] if episode.merged is not None and self.by_id[episode.merged].open else episode
        if ticket.status is None:
            if outcome != "log":
                ticket.status, ticket.fault = ("open" if outcome == "ticket" else "review"), choice
                yield self._row(unit, t_us, seq, episode, ticket, "opened")
        elif ticket.status in LIVE:
            promoting = ticket.status == "review" and outcome == "ticket"
            ticket.status, ticket.fault, ticket.updates = ("open" if promoting else ticket.status), choice, ticket.updates + 1
            yield self._row(unit, t_us, seq, episode, ticket, "promoted" if promoting else "updated")


EVENTS = ("unit_id", "episode_id", "t_us", "seq", "kind", "choice", "outcome")


def changes_batch(rows: Iterable[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * len(COLUMNS)
    kinds = [pa.string() if c in ("action", "status", "fault") else pa.int64() for c in COLUMNS]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=COLUMNS)


def ticket_changes(events: DataFrame, silence_s: float | None = None, until_us: int | None = None) -> DataFrame:
    """Every change of a ticket (``CHANGE``), with the number of the unit's living tickets after it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, unit = None, Unit(None, silence_s)
        for batch in batches:
            out: list[tuple] = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[0] != key:
                    if key is not None and until_us is not None:
                        out += unit.advance(key, until_us)
                    key, unit = row[0], Unit(None, silence_s)
                out += unit.step(*row)
            yield changes_batch(out)
        if key is not None and until_us is not None:
            yield changes_batch(unit.advance(key, until_us))

    ordered = events.where("unit_id is not null and episode_id is not null").select(*EVENTS)
    parts = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return ordered.repartition(parts, "unit_id").sortWithinPartitions("unit_id", "t_us", "seq").mapInArrow(run, CHANGE)
