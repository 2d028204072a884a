"""N-gram Jaccard join by T-occurrence search with DivideSkip, and the components of its links.

A document is the set of its word shingles, as 64-bit hashes. Documents with equal sets are one
class. Two classes link when 100 * intersection >= SIMILARITY * union, so the intersection must
reach T >= SIMILARITY % of either set. The inverted index is searched as DivideSkip does:

* short lists are merged: postings of tokens whose hash lies in the lowest ``SHARE`` of the hash
  space are sorted by token; a list of at most ``SHORT`` classes is passed on to its members, and
  each class merges its lists with a heap and counts how often every other class occurs;
* L lists aren't merged: tokens beyond the share, and lists longer than ``SHORT``. A class that
  occurs fewer than T - L times cannot reach T and is dropped, the others are candidates;
* candidates are probed: the tokens of the smaller set are looked up in the other's sorted array by
  binary search until T is reached.

The share is by hash value, the same for all documents, so a shared token below it is below it on
both sides. A pair is sure to be met if one of its classes is sure: T - L is 1 at least, and so large a part
of the set that a few shared tokens make no candidate. Classes for which that fails (most of
their tokens stand in long lists, or they are short) propose nothing and go to a second search among
themselves over all their tokens: there each class searches with its n - T + 1 rarest tokens, whose
lists of any length are linked to a head, round by round with other heads for as long as that joins
components; what is still in different components after that is paired in full. That pairing is
exact: of two sets that link, the smaller has a common token among its first n - 8/9 n + 1 and the
larger among its first n - T + 1. It is empty for groups of copies however large, and nearly so for
texts around a common passage, so no group is expanded into its pairs, and no link between
components is lost.
"""

from __future__ import annotations

import hashlib
import heapq
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, sliced, stash
from .components import components

WORDS = 5
SIMILARITY = 80
SHARE = 0.28
SHORT = 24
#: A class is sure if T - L reaches this part of its set.
MARGIN = 32
#: Share of the classes in which tokens are looked for that surely have long lists, and how many are kept of them.
LOOKED_AT, MOST_HOT = 0.02, 50_000
#: Rounds of heads go on while so many of 100 proposals link.
WORTHWHILE = 25
#: Ids that may be broadcast to pick documents; more are joined by a shuffle.
BROADCAST_IDS = 500_000
REMEMBERED = 100_000

_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
_LIMIT = np.int64(-(2**63) + int(SHARE * 2**64))
_known: dict[bytes, int] = {}


def shingle_sets(texts: list[str | None], words: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of every text; with fewer words, the whole sequence is the one shingle."""
    ids: list[int] = []
    lengths = []
    if len(_known) > REMEMBERED:
        _known.clear()
    get = _known.get
    for t in texts:
        w = t.encode("utf-8", "surrogatepass").translate(_FOLD).split() if t else []
        lengths.append(len(w))
        for x in w:
            h = get(x)
            if h is None:
                h = _known[x] = xxhash.xxh3_64_intdigest(x)
            ids.append(h)
    flat = np.array(ids, np.uint64)
    n = len(flat) - words + 1
    rolled = flat[: max(n, 0)].copy()
    for o in range(1, words):
        rolled = _mixed(rolled, flat[o : n + o]) if n > 0 else rolled
    out, at = [], 0
    for k in lengths:
        if k >= words:
            out.append(np.unique(rolled[at : at + k - words + 1].view(np.int64)))
        elif k:
            h = np.array([k * 0x9E3779B97F4A7C15 % 2**64], np.uint64)
            for x in flat[at : at + k]:
                h = _mixed(h, x)
            out.append(h.view(np.int64))
        else:
            out.append(np.zeros(0, np.int64))
        at += k
    return out


def _mixed(h: np.ndarray, x) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93) + x
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _digested(docs: DataFrame, text_col: str, id_col: str, words: int, full: bool) -> DataFrame:
    """(id, n, f1, f2, tokens): set size, 128 bits of the set's digest, and its tokens: all, or those of the share."""
    from pyspark.sql.pandas.types import to_arrow_type

    kind = docs.schema[id_col].dataType
    arrow = to_arrow_type(kind)

    def run(batches):
        for batch, texts in sliced(batches, text_col):
            sets = shingle_sets(texts, words)
            marks = [np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), np.int64) for s in sets]
            kept = sets if full else [s[: np.searchsorted(s, _LIMIT)] for s in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(batch.schema.get_field_index(id_col)).cast(arrow),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([m[0] for m in marks], pa.int64()),
                    pa.array([m[1] for m in marks], pa.int64()),
                    pa.array(kept, pa.list_(pa.int64())),
                ],
                names=["id", "n", "f1", "f2", "tokens"],
            )
        _known.clear()  # the worker may go on with another operator

    return docs.select(id_col, text_col).mapInArrow(run, f"id {kind.simpleString()}, n long, f1 long, f2 long, tokens array<long>")


def _least(n):
    """Columns: ceil(SIMILARITY % of n), which an intersection must reach at least."""
    return F.floor((F.lit(SIMILARITY) * n + 99) / 100)


def _joint(n1, n2):
    """Columns: the intersection that sets of these sizes need at least."""
    return F.ceil(F.lit(SIMILARITY) * (n1 + n2) / (100 + SIMILARITY))


def _reachable(n1: str, place1: str, n2: str, place2: str):
    """Whether two sets of these sizes can link if their first common token stands at these places of their orders.

    No earlier token is shared, so the intersection is the token itself and what may follow it on
    the shorter side. A pair that links passes at its first common token, which is one of its lists.
    """
    most = 1 + F.least(F.col(n1) - F.col(place1), F.col(n2) - F.col(place2))
    return (most * (100 + SIMILARITY) >= SIMILARITY * (F.col(n1) + F.col(n2))) & (100 * F.least(n1, n2) >= SIMILARITY * F.greatest(n1, n2))


def _runs(batches, keys: list[str]):
    """Arrow batches sorted by the first of ``keys`` as runs: (value, columns as lists), runs across batches joined."""
    held, key = None, None
    for batch in batches:
        cols = [batch.column(batch.schema.get_field_index(k)) for k in keys]
        if not len(cols[0]):
            continue
        k = cols[0].to_numpy(zero_copy_only=False)
        ends = [*(np.flatnonzero(k[1:] != k[:-1]) + 1).tolist(), len(k)]
        rest = [c.to_pylist() for c in cols[1:]]
        at = 0
        for e in ends:
            part = [c[at:e] for c in rest]
            if held is not None and key == k[at]:
                held = [h + p for h, p in zip(held, part)]
            else:
                if held is not None:
                    yield key, held
                key, held = k[at], part
            at = e
    if held is not None:
        yield key, held


def _passed_on(batches):
    """Inverted lists (token, c), sorted by both, to rows (c, others, long): short lists go to their members, long ones are only counted."""
    key, members, is_long = None, [], False
    a, others, long_ = [], [], []

    def close() -> None:
        if not is_long and len(members) > 1:
            for i, c in enumerate(members):
                a.append(c)
                others.append(members[:i] + members[i + 1 :])
                long_.append(0)

    def taken():
        out = pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(others, pa.list_(pa.int64())), pa.array(long_, pa.int64())], names=["c", "others", "long"])
        a.clear(), others.clear(), long_.clear()
        return out

    for batch in batches:
        tokens, classes = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        if not len(tokens):
            continue
        starts = np.concatenate([[0], np.flatnonzero(tokens[1:] != tokens[:-1]) + 1])
        ends = np.append(starts[1:], len(tokens))
        # runs of one token occurrence in the middle of a batch are most of all rows and say nothing
        keep = (ends - starts > 1) | (starts == 0) | (ends == len(tokens))
        for s, e in zip(starts[keep].tolist(), ends[keep].tolist()):
            t = tokens[s]
            if key is None or t != key:
                close()
                key, members, is_long = t, [], False
            part = classes[s:e].tolist()
            if not is_long and len(members) + len(part) > SHORT:
                is_long = True
                part, members = members + part, []
            if is_long:
                a.extend(part)
                others.extend([[]] * len(part))
                long_.extend([1] * len(part))
            else:
                members = members + part
        if len(a) > 20_000:
            yield taken()
    close()
    if a:
        yield taken()


def _merged(batches):
    """Rows (c, others, long, n, s) sorted by c to candidates (a, b) and a row (a, null, long) for each class with long lists.

    Each class that is sure heap-merges its lists; what occurs T - L times or more stays.
    """
    a, b, many = [], [], []
    for c, (others, long_, n, s) in _runs(batches, ["c", "others", "long", "n", "s"]):
        c, hot = int(c), sum(long_)
        if hot:
            a.append(c), b.append(None), many.append(hot)
        need = -(-SIMILARITY * n[0] // 100) - (n[0] - s[0]) - hot
        if need >= max(1, n[0] // MARGIN):
            for other, hits in groupby(heapq.merge(*[o for o in others if o])):
                if sum(1 for _ in hits) >= need:
                    a.append(min(c, other)), b.append(max(c, other)), many.append(0)
        if len(a) > 50_000:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (a, b, many)], names=["a", "b", "long"])
            a, b, many = [], [], []
    if a:
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (a, b, many)], names=["a", "b", "long"])


def _reaches(batches):
    """Pairs with their sorted token arrays (as bytes) to those that link, by binary probes of the smaller set in the larger."""
    for batch in batches:
        keep = []
        for one, two in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            x, y = np.frombuffer(one, np.int64), np.frombuffer(two, np.int64)
            if len(x) > len(y):
                x, y = y, x
            if 100 * len(x) < SIMILARITY * len(y):
                keep.append(False)
                continue
            at = np.searchsorted(y, x)
            shared = int((y[np.minimum(at, len(y) - 1)] == x).sum())
            keep.append(100 * shared >= SIMILARITY * (len(x) + len(y) - shared))
        yield batch.filter(pa.array(keep, pa.bool_())).select([0, 1])


class _Search:
    """One join: its classes, and what has been linked so far."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, words: int):
        self.docs, self.id_col, self.text_col, self.words = docs, id_col, text_col, words
        raw = stash(_digested(docs, text_col, id_col, words, False), "sets")
        self.rows = stash(raw.select("id", "n", "f1", "f2"), "rows")
        grouped = raw.where("n > 0").groupBy("f1", "f2").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("tokens").alias("tokens"))
        self.classes = stash(grouped.withColumn("s", F.size("tokens").cast("long")).withColumn("c", F.monotonically_increasing_id()), "classes")
        discard(raw)
        self.links: list[DataFrame] = []
        #: Stashed tables that nothing reads once the result is there.
        self.used: list[DataFrame] = []
        self.label: DataFrame | None = None

    def sets_of(self, needed: DataFrame) -> DataFrame:
        """(c, n, tokens) with all tokens of the classes in ``needed`` (c), read again from their documents."""
        wanted = stash(needed.join(self.classes.select("c", "rep", "f1", "f2"), "c"), "wanted")
        self.used.append(wanted)
        ids = wanted.select(F.col("rep").alias("_id")).distinct()
        few = wanted.count() <= BROADCAST_IDS
        picked = self.docs.select(self.id_col, self.text_col).join(F.broadcast(ids) if few else ids, F.col(self.id_col).eqNullSafe(F.col("_id")), "left_semi")
        full = _digested(picked, self.text_col, self.id_col, self.words, True).select("f1", "f2", "n", "tokens")
        # a document may be there twice: one row a class
        found = full.join(F.broadcast(wanted.select("f1", "f2", "c")) if few else wanted.select("f1", "f2", "c"), ["f1", "f2"])
        return found.groupBy("c").agg(F.first("n").alias("n"), F.first("tokens").alias("tokens"))

    def verify(self, pairs: DataFrame, sets: DataFrame | None = None) -> int:
        """Probe candidate pairs (a, b), a stashed table, and keep those that link; returns how many.

        ``sets`` are the token sets of the classes as bytes, where they are at hand already.
        """
        if sets is None:
            needed = pairs.select(F.col("a").alias("c")).union(pairs.select("b")).distinct()
            blobs = stash(_as_bytes(self.sets_of(needed)), "blobs")
        else:
            blobs = sets
        one = blobs.select(F.col("c").alias("a"), F.col("blob").alias("x"))
        two = blobs.select(F.col("c").alias("b"), F.col("blob").alias("y"))
        joined = pairs.select("a", "b").join(one, "a").join(two, "b").select("a", "b", "x", "y")
        linked = stash(joined.mapInArrow(_reaches, "a long, b long"), "links")
        if sets is None:
            discard(blobs)
        found = linked.count()
        if found:
            self.links.append(linked)
            every = self.links[0]
            for x in self.links[1:]:
                every = every.unionByName(x)
            self.label = components(every)
        return found

    def apart(self, pairs: DataFrame) -> DataFrame:
        """Those pairs whose classes are in different components so far."""
        if self.label is None:
            return pairs
        one = self.label.select(F.col("node").alias("a"), F.col("root").alias("_ra"))
        two = self.label.select(F.col("node").alias("b"), F.col("root").alias("_rb"))
        both = pairs.join(one, "a", "left").join(two, "b", "left")
        return both.where(F.coalesce("_ra", "a") != F.coalesce("_rb", "b")).select(*pairs.columns)

    def link(self, pairs: DataFrame) -> None:
        """Verify candidate pairs: each class's smallest partner first, then what is not yet connected."""
        if pairs.isEmpty():
            return
        first = stash(pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), "first")
        self.verify(first)
        rest = stash(self.apart(pairs.join(first, ["a", "b"], "left_anti")), "rest")
        if not rest.isEmpty():
            self.verify(rest)

    def fitting(self, pairs: DataFrame) -> DataFrame:
        """Those pairs whose set sizes allow a link."""
        size = self.classes.select("c", "n")
        both = pairs.join(size.select(F.col("c").alias("a"), F.col("n").alias("_na")), "a").join(size.select(F.col("c").alias("b"), F.col("n").alias("_nb")), "b")
        return both.where((100 * F.least("_na", "_nb") >= SIMILARITY * F.greatest("_na", "_nb"))).select(*pairs.columns)

    def hot_tokens(self) -> DataFrame:
        """Tokens that surely have long lists, as a share of the classes shows already: at most ``MOST_HOT``, the most frequent."""
        some = self.classes.where(F.pmod(F.xxhash64("c"), F.lit(10_000)) < int(LOOKED_AT * 10_000)).select(F.explode("tokens").alias("token"))
        return some.groupBy("token").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > SHORT).orderBy(F.desc("_n"), "token").limit(MOST_HOT).select("token")

    def first_search(self) -> DataFrame:
        """Short lists of the share; links what they propose and returns the classes that need the second search."""
        postings = self.classes.select(F.explode("tokens").alias("token"), "c")
        # the longest lists are only counted, so their tokens need not meet in one task
        hot = F.broadcast(stash(self.hot_tokens(), "hot"))
        parts = int(self.docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        lists = postings.join(hot, "token", "left_anti").repartition(parts, "token").sortWithinPartitions("token", "c").mapInArrow(_passed_on, "c long, others array<long>, long long")
        # counts of long lists are summed before they travel; others travel as they are
        passed = stash(lists, "passed")
        counted = passed.where("long > 0").select("c", "long").unionByName(postings.join(hot, "token", "left_semi").select("c", F.lit(1).cast("long").alias("long")))
        long_ = counted.groupBy("c").agg(F.sum("long").alias("long")).withColumn("others", F.array().cast("array<long>"))
        members = passed.where("long = 0").unionByName(long_)
        asked = members.join(self.classes.select("c", "n", "s"), "c").repartition(parts, "c").sortWithinPartitions("c")
        merged = stash(asked.mapInArrow(_merged, "a long, b long, long long"), "merged")
        discard(passed)
        pairs = stash(self.fitting(merged.where(F.col("b").isNotNull()).select("a", "b").distinct()), "pairs")
        self.link(pairs)
        long_lists = merged.where(F.col("b").isNull()).select(F.col("a").alias("c"), "long")
        need = _least(F.col("n")) - (F.col("n") - F.col("s")) - F.coalesce("long", F.lit(0))
        sure = need >= F.greatest(F.lit(1), F.floor(F.col("n") / MARGIN))
        unsure = stash(self.classes.select("c", "n", "s").join(long_lists, "c", "left").where(~sure).select("c"), "unsure")
        discard(merged, pairs)
        self.used.append(unsure)
        return unsure

    def mixed(self, prefix: DataFrame) -> DataFrame:
        """The rows of ``prefix`` whose lists hold several components, with each class's root."""
        root = self.label.select(F.col("node").alias("c"), "root") if self.label is not None else prefix.select("c", F.lit(None).cast("long").alias("root")).limit(0)
        placed = prefix.select("token", "c", "n", "place").join(root, "c", "left").withColumn("root", F.coalesce("root", "c"))
        several = placed.groupBy("token").agg(F.min("root").alias("_lo"), F.max("root").alias("_hi")).where("_lo != _hi").select("token")
        return stash(placed.join(several, "token"), "mixed")

    def second_search(self, unsure: DataFrame) -> None:
        """All tokens of the unsure classes: rarest n - T + 1 first, linked to list heads, then paired across components."""
        if unsure.isEmpty():
            return
        full = stash(self.sets_of(unsure), "full")
        sets = stash(_as_bytes(full), "blobs")
        postings = full.select("c", "n", F.explode("tokens").alias("token"))
        counts = postings.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
        # tokens of one class only come first in its order but propose nothing: they are counted, not carried
        shared = postings.join(counts, "token")
        order = Window.partitionBy("c").orderBy("df", "token")
        alone = F.col("n") - F.count(F.lit(1)).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        prefix = stash(shared.withColumn("place", alone + F.row_number().over(order)).where(F.col("place") <= F.col("n") - _least(F.col("n")) + 1).select("token", "c", "n", "place"), "prefix")
        left, turn = self.mixed(prefix), 0
        while not left.isEmpty():
            # another head each round: first the one with the fewest rarer tokens, which texts made from it have more of; then any
            by = F.struct("place", "n", "c", "root") if turn == 0 else F.struct(F.xxhash64("c", F.lit(turn)), "c", "n", "place", "root")
            heads = left.groupBy("token").agg(F.min(by).alias("h")).select("token", F.col("h.c").alias("head"), F.col("h.n").alias("_hn"), F.col("h.place").alias("_hp"), F.col("h.root").alias("_hr"))
            near = left.join(heads, "token").where((F.col("root") != F.col("_hr")) & _reachable("n", "place", "_hn", "_hp"))
            stars = stash(near.select(F.least("c", "head").alias("a"), F.greatest("c", "head").alias("b")).distinct(), "stars")
            proposed = stars.count()
            found = self.verify(stars, sets) if proposed else 0
            discard(stars)
            if found:
                before, left = left, self.mixed(left)
                discard(before)
            turn += 1
            if 100 * found < WORTHWHILE * max(1, proposed):
                break
        x = left.where(F.col("place") <= F.col("n") - _joint(F.col("n"), F.col("n")) + 1)
        x = x.select("token", F.col("c").alias("a"), F.col("n").alias("_na"), F.col("root").alias("_ra"), F.col("place").alias("_pa"))
        y = left.select("token", F.col("c").alias("b"), F.col("n").alias("_nb"), F.col("root").alias("_rb"), F.col("place").alias("_pb"))
        across = x.join(y, (x.token == y.token) & (F.col("_na") <= F.col("_nb")) & (F.col("_ra") != F.col("_rb")) & _reachable("_na", "_pa", "_nb", "_pb"))
        # orders agree, so what two prefixes share is all that the sets share up to the last shared place
        across = across.groupBy("a", "b").agg(F.count(F.lit(1)).alias("_k"), F.first("_na").alias("_na"), F.first("_nb").alias("_nb"), F.max("_pa").alias("_pa"), F.max("_pb").alias("_pb"))
        across = across.where(F.col("_k") + F.least(F.col("_na") - F.col("_pa"), F.col("_nb") - F.col("_pb")) >= _joint(F.col("_na"), F.col("_nb")))
        across = stash(across.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "across")
        if not across.isEmpty():
            self.verify(across, sets)
        discard(left, across, prefix, sets, full)

    def result(self) -> DataFrame:
        """(id, n_shingles, component_id) for every row."""
        named = self.classes.select("c", "f1", "f2", "rep")
        if self.label is not None:
            named = named.join(self.label.withColumnRenamed("node", "c"), "c", "left").withColumn("root", F.coalesce("root", "c"))
            least = named.groupBy("root").agg(F.min("rep").alias("component_id"))
            named = named.join(least, "root")
        else:
            named = named.withColumn("component_id", F.col("rep"))
        of = self.rows.join(named.select("f1", "f2", "component_id"), ["f1", "f2"], "left")
        own = F.when(F.col("n") > 0, F.coalesce("component_id", "id")).otherwise(F.col("id"))
        return of.select("id", F.col("n").alias("n_shingles"), own.alias("component_id"))


def _as_bytes(sets: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            lists = batch.column(1)
            values, ends = lists.values.to_numpy(), lists.offsets.to_numpy()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([values[s:e].tobytes() for s, e in zip(ends[:-1], ends[1:])], pa.binary())], names=["c", "blob"])

    return sets.select("c", "tokens").mapInArrow(run, "c long, blob binary")


def link_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """(``id_col``, n_shingles, component_id) for every row of ``docs``.

    component_id is the smallest id that links reach, the row's own included. Null, empty and
    wordless texts have no shingles and link with nothing. Rows that repeat an id are documents of
    their own with one name; a null id is no name and never the smallest. Other columns are left
    aside, so none can clash. An empty table gives an empty result.
    """
    search = _Search(docs, id_col, text_col, words)
    search.second_search(search.first_search())
    out = stash(search.result(), "components")
    discard(*search.used, *search.links, search.rows, search.classes)
    return out.withColumnRenamed("id", id_col)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """One row of ``docs`` of each component: that with the smallest (id, digest of its text), null ids last.

    Rows are told apart by id and text, so rows that repeat an id are judged one by one. Of equal
    rows in a component one stays; texts without shingles all stay.
    """
    digests = F.xxhash64(text_col), F.xxhash64(F.lit(7), F.col(text_col))
    key = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), digests[0].alias("t1"), digests[1].alias("t2"))
    found = link_documents(docs.select(key.alias("_key"), F.col(text_col).alias("_text")), "_key", "_text", words).where("n_shingles > 0")
    counted = found.groupBy("_key", "component_id").agg(F.count(F.lit(1)).alias("_n"))
    marks = stash(counted.withColumn("_gone", ~F.col("_key").eqNullSafe(F.col("component_id"))).where("_gone OR _n > 1").select("_key.*", "_gone"), "marks")
    marks = marks.select(F.col("id").alias("_id"), F.col("t1").alias("_m1"), F.col("t2").alias("_m2"), "_gone")
    same = F.col(id_col).eqNullSafe(F.col("_id")) & (F.col("_t1") == F.col("_m1")) & (F.col("_t2") == F.col("_m2"))
    keyed = docs.withColumn("_t1", digests[0]).withColumn("_t2", digests[1])
    single = keyed.join(marks, same, "left_anti")
    repeated = keyed.join(marks.where("not _gone"), same, "left_semi").dropDuplicates([id_col, "_t1", "_t2"])
    return single.unionByName(repeated).select(*docs.columns)
