"""Benchmark decontamination by a prefix-filtered set join.

Benchmark items are cut into windows of ``WINDOW`` words. A window is contained in a document
only if every one of its word shingles is, so one shingle is a necessary prefix (at a
containment of 1 the prefix has length one). The shingle taken is the window's rarest over the
whole corpus, counted by Spark over all documents. Documents are then joined with the windows on
that shingle; the shingle's place in the window fixes where the window would start, the start and
the window's length must lie within the document, and what is left is compared word by word.

The benchmark side is small by nature but not assumed so: its size is measured, and a benchmark
over ``BLOCK_CHARS`` characters is split by item into blocks that are joined one after the other.
Documents are never shuffled and never leave their rows; a hot source or passage moves nothing.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ddl_plus, sliced, with_columns, without

WINDOW = 10
SHINGLE = 3
#: Characters of benchmark text whose index one task may hold.
BLOCK_CHARS = 32_000_000

_FOLD = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[bytes]:
    """Words of the contract: runs of digits, letters and everything beyond ASCII, A-Z lowered."""
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []


def _keys(ids: np.ndarray, q: int) -> np.ndarray:
    """A key for each run of ``q`` word ids; runs that hold an id of 0 (an unknown word) get key 0."""
    n = len(ids) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    key = ids[:n].astype(np.uint64)
    known = ids[:n] > 0
    for o in range(1, q):
        key = key * _MIX + ids[o : n + o].astype(np.uint64)
        key ^= key >> np.uint64(29)
        known &= ids[o : n + o] > 0
    return np.where(known, key | np.uint64(1 << 63), np.uint64(0))


class WindowIndex:
    """Distinct windows of a block of items, with their words numbered; bounded by ``BLOCK_CHARS``."""

    def __init__(self, items: list[tuple], window: int):
        self.vocabulary: dict[bytes, int] = {}
        of: dict[tuple, set] = defaultdict(set)
        for item, text in items:
            w = [self.vocabulary.setdefault(x, len(self.vocabulary) + 1) for x in words_of(text)]
            for i in range(max(1, len(w) - window + 1)) if w else ():
                of[tuple(w[i : i + window])].add(item)
        self.windows = sorted(of, key=lambda w: (len(w), w))
        self.items = [sorted(of[w], key=str) for w in self.windows]
        self.prefix: dict[int, tuple] = {}

    def shingles(self) -> dict[int, list[tuple[int, int, int]]]:
        """By shingle length: key, window, offset."""
        out = defaultdict(list)
        for i, w in enumerate(self.windows):
            q = min(SHINGLE, len(w))
            out[q] += [(int(k), i, o) for o, k in enumerate(_keys(np.array(w), q))]
        return out

    def counted(self) -> dict[int, np.ndarray]:
        return {q: np.unique(np.array([k for k, _, _ in rows], np.uint64)) for q, rows in self.shingles().items()}

    def choose(self, frequency: dict[tuple[int, int], int]) -> None:
        """Keep each window's rarest shingle: sorted keys, with the windows and offsets they stand for."""
        for q, rows in self.shingles().items():
            best: dict[int, tuple] = {}
            for key, window, offset in rows:
                rank = (frequency.get((q, key), 0), key, offset)
                if window not in best or rank < best[window]:
                    best[window] = rank
            picked = sorted((key, window, offset) for window, (_, key, offset) in best.items())
            self.prefix[q] = tuple(np.array(x, t) for x, t in zip(zip(*picked), (np.uint64, np.int64, np.int64)))
        self.length = np.array([len(w) for w in self.windows])
        self.words = np.zeros((len(self.windows), int(self.length.max(initial=1))), np.int32)
        for i, w in enumerate(self.windows):
            self.words[i, : len(w)] = w

    def numbered(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Word ids of a slice of texts, texts parted by zeros; where each starts and how long it is."""
        get, ids, starts, lengths = self.vocabulary.get, [], [], []
        gap = [0] * SHINGLE
        for t in texts:
            w = words_of(t)
            starts.append(len(ids))
            lengths.append(len(w))
            ids += [get(x, 0) for x in w]
            ids += gap
        return np.array(ids, np.int32), np.array(starts, np.int64), np.array(lengths, np.int64)

    def find(self, ids: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Verified occurrences: text, first word, window."""
        texts, firsts, wins = [], [], []
        for q, (keys, windows, offsets) in self.prefix.items():
            have = _keys(ids, q)
            low = np.searchsorted(keys, have, "left")
            at = np.flatnonzero((low < len(keys)) & (keys[np.minimum(low, len(keys) - 1)] == have))
            if not len(at):
                continue
            low = low[at]
            many = np.searchsorted(keys, have[at], "right") - low
            at = np.repeat(at, many)
            slot = np.repeat(low, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            win, first = windows[slot], at - offsets[slot]
            text = np.searchsorted(starts, at, "right") - 1
            fits = (first >= starts[text]) & (first + self.length[win] <= starts[text] + lengths[text])
            text, first, win = text[fits], first[fits], win[fits]
            same = np.ones(len(win), bool)
            for o in range(self.words.shape[1]):
                inside = o < self.length[win]
                same &= ~inside | (ids[np.minimum(first + o, len(ids) - 1)] == self.words[win, o])
            texts.append(text[same])
            firsts.append(first[same])
            wins.append(win[same])
        none = np.zeros(0, np.int64)
        return tuple(np.concatenate(x) if x else none for x in (texts, firsts, wins))


def _frequencies(docs: DataFrame, text_col: str, index: WindowIndex) -> dict[tuple[int, int], int]:
    """How often each shingle of the block occurs over all documents; at most a row per shingle returns."""
    wanted = index.counted()
    light = WindowIndex([], WINDOW)
    light.vocabulary = index.vocabulary

    def count(batches):
        total = {q: np.zeros(len(k), np.int64) for q, k in wanted.items()}
        for _, texts in sliced(batches, text_col):
            ids, _, _ = light.numbered(texts)
            for q, keys in wanted.items():
                have = _keys(ids, q)
                at = np.searchsorted(keys, have)
                good = keys[np.minimum(at, len(keys) - 1)] == have
                total[q] += np.bincount(at[good], minlength=len(keys))
        for q, keys in wanted.items():
            some = np.flatnonzero(total[q])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), q, np.int32)), pa.array(keys[some].view(np.int64)), pa.array(total[q][some])], names=["q", "key", "n"])

    counts = docs.select(text_col).mapInArrow(count, "q int, key long, n long").groupBy("q", "key").agg(F.sum("n").alias("n"))
    return {(r.q, r.key & (2**64 - 1)): r.n for r in counts.collect()}


def mark_contamination(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """``docs`` with n_words, n_hit and items (the ids, as sorted strings, of items with occurring windows).

    Null and empty texts have no words, no hits and no items; the same holds for items, which then
    match nothing; the words of an item without an id are hit, but it can't be named. Repeated rows and items are each treated on their own, items with equal windows
    are all named. An empty benchmark leaves every document without hits. Columns of these names
    that ``docs`` already has are replaced.
    """
    more = "n_words long, n_hit long, items array<string>"
    docs = without(docs, ["n_words", "n_hit", "items", "_hits", "_items"], [text_col])
    bench = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).alias("text")).where("text is not null")
    size = bench.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-size // BLOCK_CHARS))
    state = docs.withColumn("_hits", F.lit(None).cast("binary")).withColumn("_items", F.array().cast("array<string>"))
    for b in range(blocks):
        part = bench.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b)
        index = WindowIndex([(r.item, r.text) for r in part.collect()], window)
        index.choose(_frequencies(docs, text_col, index) if index.windows else {})
        join = _joiner(index, text_col)
        if b < blocks - 1:
            state = state.mapInArrow(join, state.schema)

    # one pass, as each more of a stage holds a worker of its own beside the others
    return state.mapInArrow(lambda batches: _finish(join(batches)), ddl_plus(docs, more))


def _finish(batches):
    """What the last block's pass leaves, with n_words, n_hit and items in place of its state."""
    for batch in batches:
        hits, items = batch.column(batch.schema.get_field_index("_hits")).to_pylist(), batch.column(batch.schema.get_field_index("_items")).to_pylist()
        n_words, n_hit = zip(*(_summary(h) for h in hits))
        kept = batch.select([n for n in batch.schema.names if n not in ("_hits", "_items")])
        yield with_columns(kept, n_words=pa.array(n_words, pa.int64()), n_hit=pa.array(n_hit, pa.int64()), items=pa.array([sorted(set(x)) for x in items], pa.list_(pa.string())))


def _summary(hits: bytes) -> tuple[int, int]:
    """Number of words and of hit words; ``hits`` holds the word count and a bit for each word."""
    n = int.from_bytes(hits[:8], "little")
    return n, int(np.unpackbits(np.frombuffer(hits[8:], np.uint8), count=n).sum()) if len(hits) > 8 else 0


def _joiner(index: WindowIndex, text_col: str):
    """A pass that adds one block's hits and items to those a row has."""

    def join(batches):
        for batch, texts in sliced(batches, text_col):
            old_hits = batch.column(batch.schema.get_field_index("_hits")).to_pylist()
            old_items = batch.column(batch.schema.get_field_index("_items")).to_pylist()
            ids, starts, lengths = index.numbered(texts)
            text, first, win = index.find(ids, starts, lengths) if index.windows else (np.zeros(0, np.int64),) * 3
            change = np.zeros(len(ids) + 1, np.int32)
            np.add.at(change, first, 1)
            np.add.at(change, first + index.length[win] if len(win) else first, -1)
            hit = np.cumsum(change[:-1]) > 0
            found: dict[int, set] = defaultdict(set)
            for t, w in set(zip(text.tolist(), win.tolist())):
                found[t].update(x for x in index.items[w] if x is not None)
            hits = []
            for i, old in enumerate(old_hits):
                n = int(lengths[i])
                head = n.to_bytes(8, "little")
                if i not in found and (old is None or len(old) == 8):
                    hits.append(head)  # no bit set so far
                    continue
                bits = hit[starts[i] : starts[i] + n]
                if old is not None and len(old) > 8:
                    bits = bits | np.unpackbits(np.frombuffer(old[8:], np.uint8), count=n).astype(bool)
                hits.append(head + np.packbits(bits).tobytes())
            items = [o + sorted(found[i]) if i in found else o for i, o in enumerate(old_items)]
            kept = batch.select([n for n in batch.schema.names if n not in ("_hits", "_items")])
            yield with_columns(kept, _hits=pa.array(hits, pa.binary()), _items=pa.array(items, pa.list_(pa.string())))

    return join
