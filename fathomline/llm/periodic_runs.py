"""Periodic runs: stretches of words that repeat with some period at least LEAST_TURNS times.

A run is a maximal stretch with smallest period q, of MIN_WORDS and LEAST_TURNS * q words or more. In a run
every word stands LEAST_TURNS times, so words that are rarer in a stretch bound it: a text falls into
stretches, again and again, until each of its words is frequent there. Most texts end here.

In a stretch the equal pairs at each lag are counted, exactly: words that are frequent (heavy) by the
autocorrelation of their indicator through an FFT, whose sums are whole numbers and are rounded to
them; the others (light) by the differences of their positions. Only lags with as many equal pairs as a
run of that period has are scanned for islands. A scan looks at every 16th of a period first, where a run
shows as LEAST_TURNS - 1 turns of equal pairs, and word by word only around those. Islands that a run with a
period dividing the lag has given are that run. So n words take about n * sqrt(n) steps; only a text that agrees with
itself at most lags without repeating (one word throughout, but for rare others) is compared at each of them.

Rows are independent: an Arrow pass without a shuffle, whatever document or source is hot. Null and empty texts have
no words and no runs; a text of any length is worked on whole; repeated rows are rows of their own. Columns
other than the text are kept; those written here are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import ddl_plus, sliced, with_columns, without

#: Fixed values of the op13 contract.
MIN_WORDS, LEAST_TURNS = 6, 4
#: A word is heavy where its pairs would cost more than a transform of the stretch.
FFT_COST = 8
#: Differences counted at once.
PAIRS = 4_000_000


def lag_counts(codes: np.ndarray, most: int) -> np.ndarray:
    """How many equal pairs ``codes`` has at each lag from 0 to ``most``; those at lag 0 aren't counted."""
    n = len(codes)
    order = np.argsort(codes, kind="stable")
    bounds = np.flatnonzero(np.diff(codes[order], prepend=-1, append=-1))
    sizes = np.diff(bounds)
    total = np.zeros(most + 1, np.int64)
    heavy = sizes.astype(np.int64) ** 2 > FFT_COST * n * max(1, int(n).bit_length() // 4)
    if heavy.any():
        width = 1 << int(n + most).bit_length()
        power = np.zeros(width // 2 + 1)
        for k in np.flatnonzero(heavy):
            spot = np.zeros(width)
            spot[order[bounds[k] : bounds[k + 1]]] = 1.0
            wave = np.fft.rfft(spot)
            power += wave.real**2 + wave.imag**2
        total += np.rint(np.fft.irfft(power, width)[: most + 1]).astype(np.int64)
    light = order[np.repeat(~heavy, sizes)]  # positions by word, ascending within a word
    ends = np.repeat(np.cumsum(sizes[~heavy]), sizes[~heavy])
    # the d-th next place of the same word, for all places at once, while any is near enough
    left = np.arange(len(light))
    gathered: list[np.ndarray] = []
    held = 0
    step = 1
    while len(left):
        left = left[left + step < ends[left]]
        lags = light[left + step] - light[left]
        near = lags <= most
        left = left[near]  # places further on are further off
        gathered.append(lags[near])
        held += len(left)
        if held > PAIRS:
            total += np.bincount(np.concatenate(gathered), minlength=most + 1)
            gathered, held = [], 0
        step += 1
    if gathered:
        total += np.bincount(np.concatenate(gathered), minlength=most + 1)
    total[0] = 0
    return total


def islands(equal: np.ndarray, least: int) -> Iterator[tuple[int, int]]:
    """Start and end of each stretch of ``least`` or more that hold."""
    edges = np.flatnonzero(np.diff(equal.astype(np.int8), prepend=0, append=0))
    long_ = edges[1::2] - edges[::2] >= least
    yield from zip(edges[::2][long_].tolist(), edges[1::2][long_].tolist(), strict=True)


class Known:
    """Runs found so far that are long enough for a lag to meet them again, by start."""

    def __init__(self) -> None:
        self.rows = np.empty((0, 3), np.int64)  # start, end, period
        self.new: list[tuple[int, int, int]] = []

    def settle(self, q: int) -> None:
        """Keep what lag ``q`` or a later one may meet."""
        if self.new:
            self.rows = np.concatenate([self.rows, np.array(self.new, np.int64)])
            self.rows = self.rows[np.argsort(self.rows[:, 0], kind="stable")]
            self.new = []
        if len(self.rows):
            self.rows = self.rows[self.rows[:, 1] - self.rows[:, 0] >= LEAST_TURNS * q]
            self.reach = np.maximum.accumulate(self.rows[:, 1])

    def pairs(self, q: int) -> int:
        """Equal pairs at ``q`` in runs whose period divides it."""
        lengths = (self.rows[:, 1] - self.rows[:, 0])[q % self.rows[:, 2] == 0]
        return int(lengths.sum()) - q * len(lengths)

    def gaps(self, low: int, high: int, q: int) -> Iterator[tuple[int, int]]:
        """What of the pairs at ``q`` from ``low`` to ``high`` no run has whose period divides ``q``: such a run's pairs are an island by themselves."""
        if len(self.rows):
            near = self.rows[np.searchsorted(self.reach, low, "right") : np.searchsorted(self.rows[:, 0], high)]
            for start, end, period in near.tolist():
                if q % period == 0 and end - q > low:
                    yield low, start
                    low = max(low, end - q)
        yield low, high


def stretch_runs(codes: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs in a stretch."""
    n = len(codes)
    most = n // LEAST_TURNS
    lags = np.arange(most + 1)
    needed = np.maximum(MIN_WORDS - lags, (LEAST_TURNS - 1) * lags)
    counts = lag_counts(codes, most)
    enough = counts >= needed
    enough[0] = False
    found: list[tuple[int, int, int]] = []
    known = Known()
    for q in np.flatnonzero(enough).tolist():
        known.settle(q)
        pairs, step = int(needed[q]), max(1, q // 16)
        if counts[q] - known.pairs(q) < pairs:
            continue
        same = codes[: n - q : step] == codes[q::step]
        for first, last in islands(same, pairs // step):
            # next to a sampled island is a sampled pair that differs
            for low, high in known.gaps(max(0, (first - 1) * step + 1), min(n - q, last * step), q):
                if high - low < pairs:
                    continue
                for a, b in islands(codes[low:high] == codes[low + q : high + q], pairs):
                    found.append((low + a, b - a + q, q))
                    known.new.append((low + a, low + b + q, q))
    return found


def word_runs(codes: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a text's words, by start and period."""
    found = []
    left = [(0, codes)]
    while left:
        at, part = left.pop()
        if len(part) < MIN_WORDS:
            continue
        _, own, sizes = np.unique(part, return_inverse=True, return_counts=True)
        often = sizes[own] >= LEAST_TURNS
        if often.all():
            found += [(at + start, length, q) for start, length, q in stretch_runs(own)]
        else:
            left += [(at + a, part[a:b]) for a, b in islands(often, MIN_WORDS)]
    return sorted(found, key=lambda r: (r[0], r[2]))


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of ``n`` words stay: those that no run holds behind its first turn."""
    change = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return np.cumsum(change[:n]) == 0


RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def _pass(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[pa.RecordBatch]:
    for part, texts in sliced(batches, text):
        counts, runs, collapsed = [], [], []
        for t in texts:
            words = (t or "").encode().split()  # bytes split at space and 9 to 13 only
            index: dict[bytes, int] = {}
            own = word_runs(np.fromiter((index.setdefault(w, len(index)) for w in words), np.int64, len(words)))
            if own:
                words = [words[k] for k in np.flatnonzero(kept_words(len(words), own)).tolist()]
            counts.append(len(words))
            runs.append([dict(zip(("start", "length", "period"), r, strict=True)) for r in own])
            collapsed.append(b" ".join(words))
        yield with_columns(part, runs=pa.array(runs, RUNS), n_kept=pa.array(counts, pa.int64()), collapsed=pa.array(collapsed, pa.binary()).cast(pa.string()))


def find_runs(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows with ``runs`` by start and period, ``n_kept`` words and ``collapsed``, the words outside of repeats joined by a space."""
    docs = without(docs, ["runs", "n_kept", "collapsed"], [text])
    schema = ddl_plus(docs, "runs array<struct<start:long,length:long,period:long>>, n_kept long, collapsed string")
    return docs.mapInArrow(partial(_pass, text=text), schema)
