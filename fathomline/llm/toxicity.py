"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy.

A word's embedding is the sum of three rows of one hashed table: two hashes of the whole word, so
that a chance collision carries half the weight at most, and one of its first letters, which
inflected forms share. Filters of widths 1, 2 and 3 run over every word of the text, each keeps its
largest response, and a logistic unit turns those into a score.

All labelled rows teach. The table starts from the words' shrunken log odds, counted over every row; then
shards of some ``SHARD`` rows train table, filters and output from that common start, each in a task, and
their models are averaged: a table row over the shards that moved it, all else over all shards. A decision
threshold is calibrated for every language on all rows set aside from training; scores know neither
language nor source.

Scoring is one Arrow pass over whole texts without a shuffle; the model is a few MB whatever the
corpus holds.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ddl_plus, discard, give_back, sliced, stash, with_columns, without

#: Rows a shard trains on, give or take the hash's scatter; buckets that one slice of the averaged table holds.
SHARD, SLICE = 6000, 4096
#: Labels that are broadcast to the documents; beyond it both are shuffled.
BROADCAST_ROWS = 2_000_000
BUCKETS, DIM, FILTERS, WIDTHS = 1 << 18, 8, 8, (1, 2, 3)
PREFIX = 5
EPOCHS, RATE, BATCH = 4, 0.02, 64
DEFAULT_THRESHOLD = 0.3
GRID = np.round(np.arange(0.05, 0.96, 0.05), 2)

#: Words a worker remembers the responses of; beyond it the memory starts anew.
REMEMBERED = 150_000
_FOLD = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
_memory: dict = {}


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased runs of letters, digits and everything beyond ASCII."""
    return text.lower().encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []


def _buckets(words: list[bytes]) -> np.ndarray:
    """Three buckets a word; row 0 is the pad word's and always empty."""
    out = np.empty((len(words), 3), np.int64)
    for i, w in enumerate(words):
        out[i] = (zlib.crc32(w), zlib.crc32(w, 0x5BD1E995), zlib.crc32(w[:PREFIX], 0x1B873593))
    return out % (BUCKETS - 1) + 1


def _numbered(texts: list[str | None], index: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Word numbers of all texts, each followed by pads (0), where each text starts, and the words new to ``index``."""
    words: list[bytes] = []
    starts, pads = [], [b""] * max(WIDTHS)
    for t in texts:
        starts.append(len(words))
        words += words_of(t)
        words += pads
    get = index.get
    ids = [get(w, -1) for w in words]
    new: list[bytes] = []
    numbers = np.array(ids, np.int32)
    for i in np.flatnonzero(numbers < 0).tolist():
        w = words[i]
        n = index.get(w, -1)
        if n < 0:
            n = index[w] = len(index)
            new.append(w)
        numbers[i] = n
    return numbers, np.array(starts, np.int64), new


@dataclass
class Model:
    """Weights; ``prior`` is the score where there was nothing to learn from: without evidence nothing is toxic."""

    prior: float = 0.0
    table: np.ndarray | None = None
    filters: list[np.ndarray] = field(default_factory=list)  # (width * DIM, FILTERS)
    bias: np.ndarray | None = None
    out: np.ndarray | None = None
    out_bias: float = 0.0
    thresholds: dict[str, float] = field(default_factory=dict)
    mark: int = 0

    def parts(self, vectors: np.ndarray) -> list[np.ndarray]:
        """What a word adds to every filter from each place within it: one array a width and place."""
        return [vectors @ w[o * DIM : (o + 1) * DIM] for width, w in zip(WIDTHS, self.filters) for o in range(width)]

    def responses(self, ids: np.ndarray, parts: list[np.ndarray]) -> list[np.ndarray]:
        """The filters' responses at every word, one array a width, before the bias."""
        out, part = [], iter(parts)
        for width in WIDTHS:
            value = next(part).take(ids, axis=0)
            for o in range(1, width):
                value[: len(ids) - o] += next(part).take(ids[o:], axis=0)
            out.append(value)
        return out

    def score(self, texts: list[str | None]) -> np.ndarray:
        """A probability for every text; empty ones get what the pads alone say."""
        if self.table is None or not texts:
            return np.full(len(texts), self.prior)
        if _memory.get("model") != self.mark or len(_memory["index"]) > REMEMBERED:
            _memory.update(model=self.mark, index={b"": 0}, parts=[p.copy() for p in self.parts(np.zeros((1, DIM), np.float32))])
        ids, starts, new = _numbered(texts, _memory["index"])
        if new:
            fresh = self.parts(self.table[_buckets(new)].sum(1))
            _memory["parts"] = [np.concatenate(x) for x in zip(_memory["parts"], fresh)]
        values = self.responses(ids, _memory["parts"])
        top = np.concatenate([np.maximum.reduceat(v, starts, axis=0) for v in values], 1)
        z = np.maximum(top + self.bias, 0) @ self.out + self.out_bias
        return 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -30, 30)))


def train(texts: list[str], labels: np.ndarray, weights: np.ndarray, langs: list[str], seed: int = 7) -> Model:
    """Fit on rows whose place is not 4 mod 5 and calibrate thresholds on the others."""
    if not len(labels) or labels.min() == labels.max():
        return Model()
    index: dict[bytes, int] = {b"": 0}
    docs = [_numbered([t], index)[0] for t in texts]
    buckets = _all_buckets(index)
    place = np.arange(len(docs))
    fit = place[place % 5 != 4]
    seen = np.zeros((2, BUCKETS))
    for i in fit:
        seen[int(labels[i])][np.unique(buckets[np.unique(docs[i])])] += 1
    model = _start(seen, [int((labels[fit] == c).sum()) for c in (0, 1)], seed)
    _descend(model, [docs[i] for i in fit], labels[fit], weights[fit], buckets, seed)
    held = place[place % 5 == 4]
    scores = model.score([texts[i] for i in held])
    tally: dict = {}
    for i, k in zip(held, np.searchsorted(GRID, scores, "right")):
        key = langs[i], int(labels[i]), int(k)
        tally[key] = tally.get(key, 0) + weights[i]
    model.thresholds = _thresholds(tally)
    return model


def _all_buckets(index: dict[bytes, int]) -> np.ndarray:
    buckets = np.zeros((len(index), 3), np.int64)
    buckets[1:] = _buckets(list(index)[1:])
    return buckets


def _start(seen: np.ndarray, rows: list[int], seed: int = 7) -> Model:
    """The model before training, from the rows of each class that every bucket occurs in."""
    rng = np.random.default_rng(seed)
    support = seen[0] + seen[1]
    odds = np.log((seen[1] + 0.5) / max(1, rows[1])) - np.log((seen[0] + 0.5) / max(1, rows[0]))
    model = Model()
    model.table = rng.normal(0, 0.01, (BUCKETS, DIM)).astype(np.float32)
    model.table[:, 0] = odds * support / (support + 10)
    model.table[0] = 0
    model.filters = [rng.normal(0, 0.05, (w * DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
    for w in model.filters:
        w[0, 0] = 0.5
    size = FILTERS * len(WIDTHS)
    model.bias = np.full(size, -0.1, np.float32)
    model.out = rng.normal(0, 0.1, size).astype(np.float32)
    model.out[::FILTERS] = 0.6
    model.out_bias = -3.0
    return _marked(model)


def _marked(model: Model) -> Model:
    model.mark = zlib.crc32(model.out.tobytes(), zlib.crc32(model.table.tobytes())) + 1
    return model


def _descend(model: Model, docs: list[np.ndarray], labels: np.ndarray, weights: np.ndarray, buckets: np.ndarray, seed: int) -> None:
    """Train ``model`` in place on all of ``docs``; the rate falls to nothing over the epochs."""
    rng = np.random.default_rng(seed)
    dense = [model.bias, model.out, *model.filters]
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in dense] + [[np.zeros(1), np.zeros(1)]]
    steps, step = EPOCHS * -(-len(docs) // BATCH), 0
    for _ in range(EPOCHS):
        for at in np.array_split(rng.permutation(len(docs)), max(1, len(docs) // BATCH)):
            step += 1
            rate = RATE * (1 - step / (steps + 1))
            _step(model, [docs[i] for i in at], labels[at], weights[at], buckets, dense, moments, step, rate)
    _marked(model)


def _step(model: Model, docs: list[np.ndarray], y: np.ndarray, weight: np.ndarray, buckets: np.ndarray, dense: list, moments: list, step: int, rate: float) -> None:
    """One Adam step on a batch; the table gets plain gradients on the rows that were reached."""
    starts = np.cumsum([0, *map(len, docs)])[:-1]
    words, ids = np.unique(np.concatenate(docs), return_inverse=True)
    vectors = model.table[buckets[words]].sum(1)
    vectors[words == 0] = 0
    values = model.responses(ids, model.parts(vectors))
    top = np.concatenate([np.maximum.reduceat(v, starts, axis=0) for v in values], 1)
    active = np.maximum(top + model.bias, 0)
    z = active @ model.out + model.out_bias
    p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    d = ((p - y) * weight / weight.sum()).astype(np.float32)
    g_out, g_out_bias = active.T @ d, d.sum()
    d_top = np.outer(d, model.out) * (active > 0)
    g_filters = [np.zeros_like(w) for w in model.filters]
    g_words = np.zeros_like(vectors)
    ends = [*starts[1:], len(ids)]
    for k, (width, value) in enumerate(zip(WIDTHS, values)):
        for i, (s, e) in enumerate(zip(starts, ends)):
            best = s + value[s:e].argmax(0)
            part = d_top[i, k * FILTERS : (k + 1) * FILTERS]
            for o in range(width):
                reached = ids[np.minimum(best + o, len(ids) - 1)]
                rows = slice(o * DIM, (o + 1) * DIM)
                g_filters[k][rows] += vectors[reached].T * part
                np.add.at(g_words, reached, part[:, None] * model.filters[k][rows].T)
    grads = [d_top.sum(0), g_out, *g_filters, np.array([g_out_bias])]
    for j, (g, (m, v)) in enumerate(zip(grads, moments)):
        m += 0.1 * (g - m)
        v += 0.001 * (g * g - v)
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        if j < len(dense):
            dense[j] -= move.astype(dense[j].dtype)
        else:
            model.out_bias -= float(move[0])
    g_words[words == 0] = 0
    np.add.at(model.table, buckets[words].ravel(), np.repeat(-rate * 10 * g_words, 3, 0))
    model.table[0] = 0


def _thresholds(tally: dict) -> dict[str, float]:
    """For every language the threshold with the best F1, the one nearest the default among equals; from weights by language, label and place in ``GRID``."""
    out: dict[str, float] = {}
    for lang in sorted({x for x, y, _ in tally if x and y}):
        counts = np.zeros((2, len(GRID) + 1))
        for (x, y, k), n in tally.items():
            if x == lang:
                counts[y, k] += n
        said = counts[:, ::-1].cumsum(1)[:, ::-1]  # by class, rows that score so much or more
        f1 = 2 * said[1, 1:] / (said[:, 1:].sum(0) + counts[1].sum())
        out[lang] = max((f, -abs(t - DEFAULT_THRESHOLD), float(t)) for f, t in zip(f1, GRID))[2]
    return out


def fit_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", lang_col: str = "lang", shard: int = SHARD) -> Model:
    """Train on all the rows that ``labels`` marks.

    Rows without a label, text or id teach nothing; a document labelled twice counts as toxic if
    either label says so. Without labels of both kinds there is nothing to tell apart, and the model
    scores everything 0. ``labels`` should hold the rows to learn from only. The driver holds counts, weights and
    thresholds, whose size the input does not change.
    """
    marked = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(label_col).cast("int").alias("_y"))
    if marked.count() <= BROADCAST_ROWS:  # texts are shuffled only where the labels are too many
        marked = F.broadcast(marked)
    lang = F.col(lang_col) if lang_col in docs.columns else F.lit(None).cast("string")
    rows = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col), F.col(text_col).alias("_text"), lang.alias("_lang")).join(marked, id_col)
    rows = stash(rows.select(F.xxhash64(F.col(id_col)).alias("_h"), "_text", "_lang", "_y"), "labelled")
    try:
        return _fit(rows, shard)
    finally:
        discard(rows)


def _fit(rows: DataFrame, shard: int) -> Model:
    aside = F.pmod(F.xxhash64("_h", F.lit("aside")), F.lit(5)) == 4
    sizes = {(r[0], r[1]): r[2] for r in rows.groupBy("_y", aside.alias("_aside")).count().collect()}
    if len({y for y, _ in sizes}) < 2:
        return Model()
    fit = rows.where(~aside)
    n = [sizes.get((y, False), 0) for y in (0, 1)]
    seen = np.zeros((2, BUCKETS))
    for batch in fit.mapInArrow(_counted, "bucket int, clean long, toxic long").groupBy("bucket").agg(F.sum("clean"), F.sum("toxic")).toArrow().to_batches():
        at, *by_class = (c.to_numpy() for c in batch.columns)
        seen[:, at] = by_class
    start = _start(seen, n)
    shards = -(-sum(n) // shard)
    if shards:
        start = _averaged(start, fit, shards)

    def judge(batches):
        for batch, texts in sliced(batches, "_text", 500_000):
            place = np.searchsorted(GRID, start.score(texts), "right")
            yield pa.RecordBatch.from_arrays([batch.column("_lang"), batch.column("_y"), pa.array(place, pa.int32())], names=["lang", "y", "k"])
        _memory.clear()
        give_back()

    tally = rows.where(aside).mapInArrow(judge, "lang string, y int, k int").groupBy("lang", "y", "k").count().collect()
    start.thresholds = _thresholds({(r[0], r[1], r[2]): r[3] for r in tally})
    return start


def _counted(batches):
    """The rows of each class that every bucket occurs in."""
    seen = np.zeros((2, BUCKETS), np.int64)
    index: dict[bytes, int] = {b"": 0}
    buckets = np.zeros((1, 3), np.int64)
    for batch, texts in sliced(batches, "_text"):
        labels = batch.column("_y").to_pylist()
        if len(index) > REMEMBERED:
            index, buckets = {b"": 0}, np.zeros((1, 3), np.int64)
        found = [_numbered([t], index)[0] for t in texts]
        fresh = list(index)[len(buckets) :]
        if fresh:
            buckets = np.concatenate([buckets, _buckets(fresh)])
        for ids, y in zip(found, labels):
            seen[y][np.unique(buckets[np.unique(ids)])] += 1
    at = np.flatnonzero(seen.any(0))
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), *(pa.array(c[at]) for c in seen)], names=["bucket", "clean", "toxic"])
    index.clear()  # the worker may go on with another operator
    give_back()


def _averaged(start: Model, fit: DataFrame, shards: int) -> Model:
    """The average of the models that shards of ``fit`` train from ``start``."""
    shapes = [p.shape for p in (start.bias, start.out, *start.filters)]
    schema = "shard int, part int, payload binary"

    def learn(group: pa.Table) -> pa.Table:
        rows = sorted(zip(*(group.column(c).to_pylist() for c in ("_h", "_text", "_y"))))
        index: dict[bytes, int] = {b"": 0}
        docs = [_numbered([r[1]], index)[0] for r in rows]
        model = Model(table=start.table.copy(), filters=[w.copy() for w in start.filters], bias=start.bias.copy(), out=start.out.copy(), out_bias=start.out_bias)
        _descend(model, docs, np.array([r[2] for r in rows], np.float32), np.ones(len(rows), np.float32), _all_buckets(index), 7)
        moved = model.table - start.table
        touched = moved.any(1).astype(np.float32)[:, None]
        slices = np.concatenate([moved, touched], 1).reshape(-1, SLICE * (DIM + 1))
        dense = np.concatenate([p.ravel() for p in (model.bias, model.out, *model.filters)] + [[model.out_bias]]).astype(np.float32)
        parts = [dense, *slices]
        del rows, docs, index, model
        give_back()
        return pa.table({"shard": pa.array([group.column("_shard")[0].as_py()] * len(parts), pa.int32()), "part": pa.array(range(len(parts)), pa.int32()), "payload": pa.array([x.tobytes() for x in parts], pa.binary())})

    def add(group: pa.Table) -> pa.Table:
        group = group.sort_by("shard")  # sums in one order, so that runs agree
        total = sum(np.frombuffer(x.as_py(), np.float32).astype(np.float64) for x in group.column("payload"))
        return pa.table({"shard": pa.array([group.num_rows], pa.int32()), "part": group.column("part").slice(0, 1), "payload": pa.array([total.tobytes()], pa.binary())})

    dealt = fit.withColumn("_shard", F.pmod(F.xxhash64("_h", F.lit("shard")), F.lit(shards)).cast("int")).repartition(shards, "_shard")
    made = {r.part: (r.shard, np.frombuffer(bytes(r.payload))) for r in dealt.groupBy("_shard").applyInArrow(learn, schema).groupBy("part").applyInArrow(add, schema).collect()}
    used, dense = made.pop(0)
    whole = np.concatenate([made[k][1] for k in sorted(made)]).reshape(BUCKETS, DIM + 1)
    arrays = [x.reshape(shape).astype(np.float32) for x, shape in zip(np.split(dense[:-1] / used, np.cumsum([np.prod(s) for s in shapes])[:-1]), shapes)]
    table = start.table + (whole[:, :DIM] / np.maximum(whole[:, DIM:], 1)).astype(np.float32)
    return _marked(Model(table=table, bias=arrays[0], out=arrays[1], filters=arrays[2:], out_bias=float(dense[-1] / used)))


def score_toxicity(docs: DataFrame, model: Model, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``docs`` with score, threshold (its language's, else the default) and rejected.

    Null texts score as empty ones. Languages without calibration get ``DEFAULT_THRESHOLD``.
    Repeated rows get equal scores. Columns of these names that ``docs`` already has are replaced.
    """
    more = "score double, threshold double, rejected boolean"
    docs = without(docs, ["score", "threshold", "rejected"], [text_col])

    def run(batches):
        for batch, texts in sliced(batches, text_col, 500_000):
            score = model.score(texts)
            at = batch.schema.get_field_index(lang_col)
            langs = batch.column(at).to_pylist() if at >= 0 else [None] * len(texts)
            limit = np.array([model.thresholds.get(x, DEFAULT_THRESHOLD) for x in langs])
            yield with_columns(batch, score=pa.array(score, pa.float64()), threshold=pa.array(limit, pa.float64()), rejected=pa.array(score >= limit, pa.bool_()))
        _memory.clear()  # the worker may go on with another operator
        give_back()

    return docs.mapInArrow(run, ddl_plus(docs, more))


def is_held_out(id_col: str = "doc_id"):
    """Rows that no label may be learnt from: crc32 of the id as text leaves 2 on division by 4."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == 2
