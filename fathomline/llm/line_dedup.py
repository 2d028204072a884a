"""Fuzzy line deduplication by MinHash, in DataFrame operations only.

A line is the set of its character shingles: eight characters from every character on; a shorter
line is one shingle. Its signature comes from one hash of every shingle: the hash space is cut into
``BANDS`` ranges, and a band's key is made of the ROWS smallest hashes from the start of its range,
so two lines share a key with a probability near the ROWS-th power of their Jaccard similarity, and
at 0.8 share some key in about 98 of 100 cases. A line of many words makes its keys of those shingles
that begin a word: a sixth of them in most languages, and pairs at 0.8 meet no less often. Lines of few
words, or of few blanks for their length, use every shingle, and lines in between make both kinds of keys.
Only the keys are sampled: similarity is always that of all shingles.

Repeated lines are folded into one row with their first place before anything is shuffled by band.
Then, in this order:

1. in a band's bucket every line is proposed to the bucket's head, its most frequent line;
2. proposals are verified by exact Jaccard similarity of the shingle sets, and verified ones joined
   by distributed union-find;
3. buckets that still hold several components are compared across them, so that no pair of a bucket
   is left out: a bucket of up to ``SMALL`` lines pair by pair; the lines of larger ones by a prefix
   join on their rarest shingles, which meets every pair that reaches the similarity and hardly
   any other, so templates that differ in a number don't grow with the square of their count;
4. what that proposes is verified and joined to the components in the same way.

Of each component the line with the smallest (id, text hash, place) stays, in every document the
others go. Buckets are summed with partial aggregation and joined, never gathered in one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, once, stash, unused
from .components import components

SHINGLE = 8
SIMILARITY = 80
BANDS, ROWS = 8, 4
#: Hashes of a range that are sorted, about: more than ROWS by so much that they hardly ever run out.
ENOUGH = 12
#: Lines of fewer shingles make keys of two hashes, those of more than FEW - 4 keys of ROWS; in between both.
FEW, SHORT_ROWS = 20, 2
#: Distinct shingles at words' starts from which on they make a line's keys, if they are at least one in SPARSE.
STARTS, SPARSE = 16, 16
#: Buckets of up to so many lines are compared pair by pair.
SMALL = 8
#: Lines whose texts may be picked by a broadcast of their places; more are joined by a shuffle.
BROADCAST_LINES = 300_000


def _lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Every line that is not blank: id, th (a hash of the whole text), pos, line without outer blanks, h1, h2."""
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"), F.posexplode(F.split(text_col, "\n")).alias("pos", "line"))
    rows = rows.withColumn("line", F.trim("line"))
    # trimming a set of characters looks at all of a text, so only lines that end in others than blanks go through it
    others = reduce(Column.__or__, [end(F.lit(c)) for c in "\t\r" for end in (F.col("line").startswith, F.col("line").endswith)])
    rows = rows.withColumn("line", F.when(others, F.btrim("line", F.lit(" \t\r"))).otherwise(F.col("line"))).where("line != ''")
    return rows.withColumn("h1", F.xxhash64("line")).withColumn("h2", F.xxhash64(F.lit(7), F.col("line")))


def _hashes(line: Column) -> Column:
    """A hash of every shingle of a line, in their order, repeats included."""
    # four bytes a character: a shingle is a slice of bytes, found without counting characters
    def of(u: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.octet_length(u) - 4 * SHINGLE + 1), F.lit(4))
        return F.transform(starts, lambda i: F.xxhash64(F.substring(u, i, F.lit(4 * SHINGLE))))

    return once(F.encode(line, "UTF-32"), of)


#: The lower bounds of the hash ranges but the first.
_WIDTH = (1 << 64) // BANDS
_BOUNDS = [-(1 << 63) + b * _WIDTH for b in range(1, BANDS)]


def _low(h: Column) -> Column:
    """The low part of every hash range: a key reads a range's first hashes, so of many only these are sorted."""
    part = F.lit(_WIDTH - 1).cast("long")
    most = F.floor(F.lit(_WIDTH - 1) / F.size(h) * BANDS * ENOUGH).cast("long")
    return F.when(F.size(h) <= BANDS * ENOUGH, h).otherwise(once(most, lambda x: F.filter(h, lambda v: v.bitwiseAND(part) < x)))


def _band_keys(line: Column) -> Column:
    """The band keys of a line by all its shingles: one for each hash range that holds a shingle."""
    bounds = [F.lit(b).cast("long") for b in _BOUNDS]
    ends = F.array(*bounds, F.lit(None).cast("long"))
    none = F.array().cast("array<bigint>")

    def of(m: Column, n: Column) -> Column:
        # sorted together with the ranges' lower bounds, a range's hashes follow its bound
        begin = F.array(F.lit(1).cast("long"), *[F.array_position(m, b) + 1 for b in bounds])

        def keys(rows: int) -> Column:
            # a bound that ends the range is part of the key; single places, as a slice copies the whole array first
            key = lambda j, b: F.xxhash64(F.lit(rows), b, *[F.get(m, j.cast("int") - 1 + i) for i in range(rows)])
            return F.array_compact(F.transform(begin, lambda j, b: F.when(~F.get(m, j.cast("int") - 1).eqNullSafe(F.get(ends, b)), key(j, b))))

        return F.when(n >= FEW, keys(ROWS)).when(n > FEW - 4, F.concat(keys(ROWS), keys(SHORT_ROWS))).when(n > 0, keys(SHORT_ROWS)).otherwise(none)

    def kept(h: Column) -> Column:
        return once(F.sort_array(F.concat(F.array_distinct(_low(h)), F.array(*bounds))), lambda m: of(m, F.size(h)))

    return once(_hashes(line), kept)


def _start_hashes(line: Column) -> Column:
    """A hash of every shingle of a line that begins a word, each once."""
    found = F.regexp_extract_all(F.concat(F.lit(" "), line), F.lit(f"(?s) (?=(.{{{SHINGLE}}}))"), F.lit(1))
    return F.array_distinct(F.transform(found, lambda x: F.xxhash64(x)))


def _signed(lines: DataFrame) -> DataFrame:
    """Every line's h1, h2, place and bands: its keys, nulls between them.

    A step a select: what is named more than once is worked out once, and in generated code.
    """
    bounds = [F.lit(b).cast("long") for b in _BOUNDS]
    rows = lines.select("h1", "h2", F.struct("id", "th", "pos").alias("place"), "line", _start_hashes(F.col("line")).alias("h"))
    n, c = F.length("line"), F.size("h")
    # near lines have about as many words: whichever side of the limits they are on, some kind of key is common
    sampled = (c >= STARTS) & (SPARSE * c >= n)
    alone = (4 * c >= 5 * STARTS) & (3 * SPARSE * c >= 4 * n)
    none = F.array().cast("array<bigint>")
    rows = rows.select("h1", "h2", "place", F.when(alone, none).otherwise(_band_keys(F.col("line"))).alias("own"), F.when(sampled, _low(F.col("h"))).alias("h"))
    # sorted together with the ranges' lower bounds, a range's hashes follow its bound
    rows = rows.withColumn("h", F.sort_array(F.concat("h", F.array(*bounds))))
    rows = rows.withColumn("begin", F.array(F.lit(1), *[(F.array_position("h", b) + 1).cast("int") for b in bounds]))
    keys = []
    for b, end in enumerate([*bounds, F.lit(None).cast("long")]):
        # slices, as single places make a method that is too long to be compiled
        begin = F.get("begin", F.lit(b))
        keys.append(F.when(~F.get("h", begin - 1).eqNullSafe(end), F.xxhash64(F.lit(1), F.lit(b), F.slice("h", begin, ROWS))))
    bands = F.when(F.col("h").isNull(), F.col("own")).otherwise(F.concat("own", F.array(*keys)))
    return rows.select("h1", "h2", "place", bands.alias("bands"))


def _alike(x: Column, y: Column) -> Column:
    """Whether sets of these sizes can reach the similarity, however they overlap."""
    return 100 * F.least(x, y) >= SIMILARITY * F.greatest(x, y)


def _overlap(x: Column, y: Column) -> Column:
    """The intersection that sets of these sizes need at least."""
    return F.ceil(SIMILARITY * (x + y) / (100 + SIMILARITY))


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs (a, b) whose shingle sets reach the similarity; ``texts`` has (k, line, m), m being the set's size."""
    one = texts.select(F.col("k").alias("a"), F.col("line").alias("x"), F.col("m").alias("mx"))
    two = texts.select(F.col("k").alias("b"), F.col("line").alias("y"), F.col("m").alias("my"))
    both = pairs.join(one, "a").join(two, "b").where(_alike(F.col("mx"), F.col("my")))
    shared = F.size(F.array_intersect(_hashes(F.col("x")), _hashes(F.col("y"))))
    both = both.withColumn("shared", shared)
    return both.where(100 * F.col("shared") >= SIMILARITY * (F.col("mx") + F.col("my") - F.col("shared"))).select("a", "b")


def _texts_of(needed: DataFrame, distinct: DataFrame, lines: DataFrame) -> DataFrame:
    """(k, line, m) of the distinct lines in ``needed`` (k), read again from their first places."""
    places = stash(needed.join(distinct.select("k", "first"), "k").select("k", "first.*"), "needed")
    few = places.count() <= BROADCAST_LINES
    place = [F.col(f"l.{c}").eqNullSafe(F.col(f"p.{c}")) for c in ("id", "th", "pos")]
    found = lines.select("id", "th", "pos", "line").alias("l").join((F.broadcast(places) if few else places).alias("p"), place[0] & place[1] & place[2])
    # rows that repeat an id and text repeat its places
    out = stash(found.select("k", "line").dropDuplicates(["k"]).withColumn("m", F.size(F.array_distinct(_hashes(F.col("line"))))), "texts")
    discard(places)
    return out


def _rooted(members: DataFrame, near: DataFrame | None) -> DataFrame:
    """``members`` of buckets that hold several components, with each line's root."""
    if near is None:
        placed = members.withColumn("root", F.col("k"))
    else:
        placed = members.join(near.select(F.col("node").alias("k"), "root"), "k", "left").withColumn("root", F.coalesce("root", "k"))
    mixed = placed.groupBy("band").agg(F.min("root").alias("_lo"), F.max("root").alias("_hi")).where("_lo != _hi").select("band")
    return placed.join(mixed, "band")


def _pairwise(small: DataFrame, sizes: DataFrame) -> DataFrame:
    """Pairs of small buckets across components, of sizes that allow the similarity."""
    rows = small.join(sizes, "k")
    x = rows.select("band", F.col("k").alias("a"), F.col("m").alias("_ma"), F.col("root").alias("_ra"))
    y = rows.select("band", F.col("k").alias("b"), F.col("m").alias("_mb"), F.col("root").alias("_rb"))
    both = x.join(y, (x.band == y.band) & (F.col("a") < F.col("b")) & (F.col("_ra") != F.col("_rb")) & _alike(F.col("_ma"), F.col("_mb")))
    return both.select("a", "b")


def _by_prefix(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs of the lines in ``rows`` (k, root) across components that share a rare enough shingle.

    Shingles are ordered by how many of the lines hold them. Of two sets that reach the similarity,
    the smaller has a common shingle among its first m - 8/9 m + 1 and the larger among its first
    m - 4/5 m + 1, and what follows both places is long enough for the overlap.
    """
    shingles = texts.join(rows, "k").select("k", "m", "root", F.explode(F.array_distinct(_hashes(F.col("line")))).alias("t"))
    df = shingles.groupBy("t").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    # shingles of one line only come first in its order but propose nothing: they are counted, not carried
    shared = shingles.join(df, "t")
    order = Window.partitionBy("k").orderBy("df", "t")
    alone = F.col("m") - F.count(F.lit(1)).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    rank = F.row_number().over(order)
    m = F.col("m")
    placed = shared.withColumn("place", alone + rank).where(F.col("place") <= m - F.ceil(m * SIMILARITY / 100) + 1)
    placed = stash(placed.select("t", "k", "m", "root", "place"), "prefix")
    x = placed.where(F.col("place") <= m - _overlap(m, m) + 1).select("t", F.col("k").alias("_ka"), F.col("m").alias("_ma"), F.col("root").alias("_ra"), F.col("place").alias("_pa"))
    y = placed.select("t", F.col("k").alias("_kb"), F.col("m").alias("_mb"), F.col("root").alias("_rb"), F.col("place").alias("_pb"))
    smaller = (F.col("_ma") < F.col("_mb")) | ((F.col("_ma") == F.col("_mb")) & (F.col("_ka") != F.col("_kb")))
    room = 1 + F.least(F.col("_ma") - F.col("_pa"), F.col("_mb") - F.col("_pb")) >= _overlap(F.col("_ma"), F.col("_mb"))
    both = x.join(y, (x.t == y.t) & smaller & (F.col("_ra") != F.col("_rb")) & _alike(F.col("_ma"), F.col("_mb")) & room)
    return both.select(F.least("_ka", "_kb").alias("a"), F.greatest("_ka", "_kb").alias("b"))


def _near_lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Distinct lines that occur twice or have a near line: h1, h2 and the place (id, th, pos) that is kept."""
    lines = _lines(docs, id_col, text_col)
    distinct = _signed(lines).groupBy("h1", "h2").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n"), F.first("bands").alias("bands"))
    # the more often a line occurs, by powers of two, the smaller its number: a bucket's smallest is its most frequent
    often = F.shiftleft(31 - F.floor(F.log2("n")).cast("long"), 58)
    distinct = stash(distinct.withColumn("k", often + F.monotonically_increasing_id()), "lines")
    banded = distinct.select("k", F.explode("bands").alias("band")).where("band IS NOT NULL")
    heads = banded.groupBy("band").agg(F.min("k").alias("head"), F.count(F.lit(1)).alias("c")).where("c > 1")
    members = stash(banded.join(heads, "band"), "buckets")
    pairs = stash(members.where("k != head").select(F.col("head").alias("a"), F.col("k").alias("b")).distinct(), "proposed")
    used = [members, pairs]
    near = None
    if not pairs.isEmpty():
        texts = _texts_of(members.select("k").distinct(), distinct, lines)
        edges = stash(_verified(pairs, texts), "near")
        if not edges.isEmpty():
            near = components(edges)
        # two lines are the head and its pair already
        mixed = stash(_rooted(members.where("c > 2"), near), "mixed")
        crowd = mixed.where(F.col("c") > SMALL).select("k", "root").distinct()
        across = _pairwise(mixed.where(F.col("c") <= SMALL), texts.select("k", "m")).unionByName(_by_prefix(crowd, texts))
        across = stash(across.distinct().join(pairs, ["a", "b"], "left_anti"), "across")
        if not across.isEmpty():
            more = stash(_verified(across, texts), "near")
            if not more.isEmpty():
                near = components(edges.unionByName(more))
            used.append(more)
        used += [texts, edges, mixed, across]
    if near is None:
        out = distinct.where("n > 1").select("h1", "h2", F.col("first").alias("kept"))
    else:
        member = distinct.select("k", "first").join(near.withColumnRenamed("node", "k"), "k")
        kept = member.groupBy("root").agg(F.min("first").alias("kept"))
        named = near.join(kept, "root").select(F.col("node").alias("k"), "kept")
        out = distinct.join(named, "k", "left").where(F.col("kept").isNotNull() | (F.col("n") > 1))
        out = out.select("h1", "h2", F.coalesce("kept", "first").alias("kept"))
    out = stash(out, "kept")
    discard(distinct, *used)
    return out


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with lines removed from the text, and n_lines and n_dropped.

    Of near or equal lines only that with the smallest (id, hash of its text, place) stays. Blank
    lines are never compared and always stay, like every document, be it left with an empty text.
    Null texts stay null with 0 lines. Rows that repeat both id and text count as one document and
    are treated alike. Columns named n_lines or n_dropped that ``docs`` already has are replaced,
    all others stay as they are; an empty table gives an empty result.
    """
    docs = docs.drop(*[c for c in ("n_lines", "n_dropped") if c not in (id_col, text_col)])
    own, at, th, gone = unused(docs, "_own", "_at", "_th", "_gone")
    kept = _near_lines(docs, id_col, text_col)
    lines = _lines(docs, id_col, text_col).select("id", "th", "pos", "h1", "h2")
    stays = F.col("kept.id").eqNullSafe(F.col("id")) & (F.col("kept.th") == F.col("th")) & (F.col("kept.pos") == F.col("pos"))
    dropped = lines.join(kept, ["h1", "h2"]).where(~stays).groupBy("id", "th").agg(F.collect_set("pos").alias(gone))
    dropped = stash(dropped.withColumnRenamed("id", at).withColumnRenamed("th", th), "gone")
    discard(kept)
    joined = docs.withColumn(own, F.xxhash64(text_col)).join(dropped, F.col(id_col).eqNullSafe(F.col(at)) & (F.col(own) == F.col(th)), "left")
    split = F.split(text_col, "\n")
    left = F.array_join(F.filter(split, lambda x, i: ~F.array_contains(gone, i)), "\n")
    return (
        joined.withColumn("n_lines", F.when(F.col(text_col).isNull(), 0).otherwise(F.size(split)))
        .withColumn("n_dropped", F.when(F.col(gone).isNull(), 0).otherwise(F.size(gone)))
        .withColumn(text_col, F.when(F.col(gone).isNull(), F.col(text_col)).otherwise(left))
        .drop(own, at, th, gone)
    )
