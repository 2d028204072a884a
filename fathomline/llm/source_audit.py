"""Source divergence: how the use of words in each source of a language departs from its other sources and from the language.

Two passes over the texts. The first counts, a task, in how many documents each term of a language
stands, and adds the counts to a count-min sketch of fixed size; sketches are merged, salted first, by
blocks of cells, and cells stop at 255, which is above any least number of documents allowed here, so an
estimate that says "too few" is never wrong. The second pass counts every term by (lang, source), and terms
that the merged sketch rules out don't leave their task. Survivors are counted exactly and those in
too few documents of their language go.

Shares are whole numbers in billionths with two occurrences added to every kept term, so zero counts have a
share too. A pair's divergence sums over all kept terms; the part of terms that neither source has is a product, that of
terms of one source a sum over its histogram of counts, and only terms that both sources have are
joined, each pair once, with partial sums before the shuffle.

The sketch is broadcast: DEPTH times WIDTH bytes whatever the input. It only saves shuffling; a wider one pays where the
corpus has many more rare terms than cells.

Null lang, source and text are ''. A document repeated as a row counts as often as it stands there. No rows give no
rows; a language without kept terms has pairs of value 0 and no terms. Texts of any length are cut into pieces at
places where no term goes on. Columns other than the three aren't read.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stash

#: Fixed values of the op12 contract: shares are in parts of SCALE, every term gets ADDED occurrences.
SCALE, ADDED = 1_000_000_000, 2
#: The sketch: rows, cells a row (a power of two), cells in a block of the merge, and the greatest count.
DEPTH, WIDTH, BLOCK, FULL = 4, 1 << 22, 1 << 16, 255
#: Distinct terms that a task counts before it hands them on, and bytes of a text that are split into words at once.
HELD, PIECE = 400_000, 8_000_000

#: Bytes of a term: letters A-Z, lower-cased, and all that is not ASCII; anything else ends it.
_LETTERS = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))
_GAP = re.compile(rb"[^A-Za-z\x80-\xff]")


def terms(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in UTF-8, piece by piece; a piece ends where no term goes on."""
    start = 0
    while start < len(text):
        gap = _GAP.search(text, start + PIECE) if len(text) - start > PIECE else None
        end = gap.start() if gap else len(text)
        yield text[start:end].translate(_LETTERS).split()
        start = end


def cells(lang: bytes, words: list[bytes]) -> np.ndarray:
    """The cell of each word in each row of the sketch; two 32-bit halves of one hash give all rows."""
    seed = xxhash.xxh32_intdigest(lang)
    h = np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in words), np.uint64, len(words))
    low, high = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
    rows = np.arange(DEPTH, dtype=np.uint64)[:, None]
    return ((low + rows * high) % np.uint64(WIDTH)).astype(np.int64) + np.arange(DEPTH)[:, None] * WIDTH


def _text(column: pa.Array, k: int) -> bytes:
    return column[k].as_py() or b""


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's sketch by blocks that aren't empty."""
    sketch = np.zeros(DEPTH * WIDTH, np.uint8)
    seen: dict[bytes, Counter] = defaultdict(Counter)
    held = 0

    def add() -> None:
        for lang, counts in seen.items():
            number = np.minimum(np.fromiter(counts.values(), np.int64, len(counts)), FULL)
            for at in cells(lang, list(counts)):
                where, which = np.unique(at, return_inverse=True)
                sums = np.bincount(which, weights=number).astype(np.int64) + sketch[where]
                sketch[where] = np.minimum(sums, FULL)
        seen.clear()

    for batch in batches:
        for k in range(batch.num_rows):
            counts, own = seen[_text(batch.column(0), k)], set()
            for words in terms(_text(batch.column(1), k)):
                own.update(words)
            held -= len(counts)
            counts.update(own)
            held += len(counts)
            if held > HELD:
                add()
                held = 0
    add()
    blocks = sketch.reshape(-1, BLOCK)
    for k in np.flatnonzero(blocks.any(axis=1)):
        yield pa.RecordBatch.from_pylist([{"block": int(k), "cells": blocks[k].tobytes()}], pa.schema([("block", pa.int32()), ("cells", pa.binary())]))


def _merged(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sum of one block's counts, stopped at the greatest."""
    total = np.zeros(BLOCK, np.int64)
    for batch in batches:
        for part in batch.column(batch.schema.get_field_index("cells")):
            total = np.minimum(total + np.frombuffer(part.as_py(), np.uint8), FULL)
    row = {"block": key[0].as_py(), "cells": total.astype(np.uint8).tobytes()}
    yield pa.RecordBatch.from_pylist([row], pa.schema([("block", pa.int32()), ("cells", pa.binary())]))


def document_sketch(docs: DataFrame) -> np.ndarray:
    """The merged sketch of document frequencies by language, of DEPTH times WIDTH bytes."""
    parts = docs.select("lang", "text").mapInArrow(_sketches, "block int, cells binary").withColumn("salt", F.pmod(F.xxhash64(F.spark_partition_id()), F.lit(32)).cast("int"))
    salted = parts.groupBy("block", "salt").applyInArrow(_merged, "block int, cells binary")
    rows = salted.groupBy("block").applyInArrow(_merged, "block int, cells binary").collect()  # at most all blocks of one sketch
    sketch = np.zeros((DEPTH * WIDTH // BLOCK, BLOCK), np.uint8)
    for r in rows:
        sketch[r.block] = np.frombuffer(r.cells, np.uint8)
    return sketch.reshape(-1)


def _counts(batches: Iterator[pa.RecordBatch], sketch, least: int) -> Iterator[pa.RecordBatch]:
    """A task's occurrences and documents by (lang, source, term), without the terms that the sketch rules out."""
    known = sketch.value
    found: dict[tuple[bytes, bytes], tuple[Counter, Counter]] = defaultdict(lambda: (Counter(), Counter()))
    held = 0
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])

    def hand_on() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in found.items():
            words = list(docs)
            if not words:
                continue
            possible = np.flatnonzero(known[cells(lang, words)].min(axis=0) >= least)
            kept = [words[k] for k in possible]
            columns = [pa.array([x] * len(kept), pa.binary()).cast(pa.string()) for x in (lang, source)]
            columns += [pa.array(kept, pa.binary()).cast(pa.string()), pa.array([n[w] for w in kept], pa.int64()), pa.array([docs[w] for w in kept], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)
        found.clear()

    for batch in batches:
        for k in range(batch.num_rows):
            n, docs = found[_text(batch.column(0), k), _text(batch.column(1), k)]
            own: Counter = Counter()
            for words in terms(_text(batch.column(2), k)):
                own.update(words)
            held -= len(docs)
            n.update(own)
            docs.update(own.keys())
            held += len(docs)
            if held > HELD:
                yield from hand_on()
                held = 0
    yield from hand_on()


def _share(count: str, total: str, kept: str) -> Column:
    """1 + floor(SCALE * (count + ADDED) / (total + ADDED * kept)) of three columns, exact at any count."""
    return F.expr(f"1 + cast({count} + {ADDED} as decimal(20,0)) * {SCALE} div cast({total} + {ADDED} * {kept} as decimal(20,0))")


def _divergence(p: str, q: str) -> str:
    """floor((p - q)^2 / (p + q)) as an expression; shares are at most SCALE + 1, so the square fits a long."""
    return f"(({p} - {q}) * ({p} - {q}) div ({p} + {q}))"


def kept_counts(docs: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """Two tables: groups (lang, source, v, own_n, all_n, p0), and kept terms (lang, source, term, n, p, q) with n > 0.

    ``docs`` has lang, source and text without nulls.
    """
    if not 0 < least <= FULL:
        raise ValueError(f"the least number of documents must lie in 1 to {FULL}, where the sketch's counts stop")
    binary = [F.col(c).cast("binary").alias(c) for c in ("lang", "source", "text")]
    sketch = docs.sparkSession.sparkContext.broadcast(document_sketch(docs.select(*binary)))
    found = docs.select(*binary).mapInArrow(partial(_counts, sketch=sketch, least=least), "lang string, source string, term string, n long, docs long")
    counts = stash(found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "term-counts")
    terms_ = counts.groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("docs")).where(F.col("docs") >= least).drop("docs")
    terms_ = stash(terms_, "kept-terms")
    kept = stash(counts.drop("docs").join(terms_, ["lang", "term"]), "kept-counts")
    of_lang = terms_.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("total").alias("all_n"))
    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("own_n"))
    groups = docs.select("lang", "source").distinct().join(of_lang, "lang", "left").join(own, ["lang", "source"], "left").fillna(0, ["v", "all_n", "own_n"])
    groups = groups.withColumn("_none", F.lit(0)).withColumn("p0", F.when(F.col("v") > 0, _share("_none", "own_n", "v"))).drop("_none")
    groups = stash(groups, "groups")
    shares = kept.join(groups, ["lang", "source"]).select("lang", "source", "term", "n", _share("n", "own_n", "v").alias("p"), _share("total", "all_n", "v").alias("q"), "p0", "own_n", "v")
    return groups, stash(shares, "shares")


def pair_divergence(groups: DataFrame, kept: DataFrame) -> DataFrame:
    """(lang, source, item, value) for each two sources of a language, in both orders."""
    other = groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("o0"))
    none = _divergence("p0", "o0")
    pairs = groups.join(other, "lang").where("source < item")
    neither = pairs.select("lang", "source", "item", F.expr(f"coalesce(v * {none}, 0L)").alias("value"))
    # terms of one source: as many equal summands as terms share a count
    counts = kept.groupBy("lang", "source", "p", "p0").agg(F.count(F.lit(1)).alias("k"))
    one = counts.join(other, "lang").where("source <> item")
    one = one.groupBy("lang", "source", "item").agg(F.sum(F.expr(f"k * ({_divergence('p', 'o0')} - {none})")).alias("value"))
    one = one.select("lang", F.least("source", "item").alias("source"), F.greatest("source", "item").alias("item"), "value")
    right = kept.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("o"), F.col("p0").alias("o0"))
    both = kept.join(right, ["lang", "term"]).where("source < item")
    change = f"{_divergence('p', 'o')} - {_divergence('p', 'o0')} - {_divergence('p0', 'o')} + {none}"
    both = both.groupBy("lang", "source", "item").agg(F.sum(F.expr(change)).alias("value"))
    total = neither.union(one).union(both).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    ends = F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item")))
    return total.select("lang", "value", F.inline(ends)).select("lang", "source", "item", "value")


def divergences(docs: DataFrame, least: int = 10, ranks: int = 10) -> DataFrame:
    """(lang, source, part, item, value, rank): every pair of sources, and each source's ``ranks`` terms furthest above its language."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    groups, kept = kept_counts(docs.select(text("lang"), text("source"), text("text")), least)
    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    pairs = pair_divergence(groups, kept).withColumn("rank", place)
    high = kept.where("p > q").select("lang", "source", F.col("term").alias("item"), F.expr(_divergence("p", "q")).alias("value"))
    high = high.withColumn("rank", place).where(F.col("rank") <= ranks)
    part = lambda df, name: df.select("lang", "source", F.lit(name).alias("part"), "item", "value", "rank")
    return part(pairs, "pair").union(part(high, "term"))
