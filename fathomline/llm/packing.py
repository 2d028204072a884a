"""Best-fit packing of token pieces into sequences by bulk-synchronous supersteps over size classes.

Documents are tokenised once; longer ones are cut into full pieces. Then

1. pieces are range-sorted by length; a piece's place is its length and its rank among pieces of that
   length, from its row in its range and the counts of the ranges before. A length that a third of
   all documents share is split over ranges like any other;
2. supersteps run down the lengths. Gaps (sequences with room) are kept in order of size, as intervals
   of sequences with equal room. A step's successor sweep gives all pieces of its length the smallest
   gaps that hold them, as many to a gap as go in; ranks decide which piece gets which place, so
   none is given twice. The gaps shrink by what they took, new sequences are opened for what found
   none, and the next step begins;
3. every piece looks its place up by length and rank: a pass without a shuffle.

A step is exact best fit for all pieces of one length at once, so it needs no more of the cluster than
counts: there are at most ``SIZE`` lengths, and an interval that takes pieces loses at least half of
its room, so that the runs ("ranks a to b of length l go to sequences from s on, k to each") are
bounded by the sequence size, not by the corpus. Only counts by range and length reach the driver,
and only runs go back.
"""

from __future__ import annotations

import heapq
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, sliced, stash

SIZE = 2048
END = (0).to_bytes(4, "little")
SPECIAL = "<|endoftext|>"
#: Chunks a worker remembers the ids of; beyond it the memory starts anew.
REMEMBERED = 80_000

_state: dict = {}


def _tokenizer(path: str):
    if _state.get("path") != path:
        _state.clear()
        _state.update(path=path, chunks={}, fast=_ranked(path))
    return _state


def _whole(state: dict):
    """The tokenizer itself, loaded where a text needs it: it takes as much memory as the ranks."""
    if "whole" not in state:
        from tokenizers import Tokenizer

        state["whole"] = Tokenizer.from_file(state["path"])
    return state["whole"]


def _ranked(path: str):
    """The same vocabulary as ranks, if its file lies beside: several times faster, equal ids."""
    import base64
    import os

    ranks = path.removesuffix(".json") + ".tiktoken"
    if ranks == path or not os.path.exists(ranks):
        return None
    import public_tokenizers
    import tiktoken

    with open(ranks, "rb") as lines:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("pieces", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})


def _packed(ids: list[int]) -> bytes:
    return b"".join(i.to_bytes(4, "little") for i in ids)


def encode(text: str, path: str) -> bytes:
    """Ids of a text as little-endian unsigned 32-bit words, without special tokens added.

    A word with the one space before it is always a token boundary of this vocabulary's
    pre-tokenizer, so texts are taken apart there and words seen before come from memory. Runs of
    spaces, where that does not hold, and texts that spell a special token are encoded whole.
    """
    state = _tokenizer(path)
    whole = lambda t: _packed(_whole(state).encode(t, add_special_tokens=False).ids)
    if SPECIAL in text:
        return whole(text)
    fast = state["fast"]
    one = (lambda t: _packed(fast.encode_ordinary(t))) if fast else whole
    if "  " in text:
        return one(text)
    chunks = state["chunks"]
    if len(chunks) > REMEMBERED:
        chunks.clear()
    parts = text.split(" ")
    out = [one(parts[0])]
    for p in parts[1:]:
        known = chunks.get(p)
        if known is None:
            known = one(" " + p)
            if len(p) < 64:
                chunks[p] = known
        out.append(known)
    return b"".join(out)


def cut(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE) -> DataFrame:
    """Pieces (id, piece, start, length, ids_crc32): every document's ids and a closing 0, cut if over ``size``.

    Null texts are empty and give one piece of one id. The first piece takes the remainder.
    """
    id_type = docs.schema[id_col].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    arrow_id = to_arrow_type(id_type)

    def run(batches):
        for batch, texts in sliced(batches, text_col):
            rows: list[tuple] = []
            for name, text in zip(batch.column(batch.schema.get_field_index(id_col)).to_pylist(), texts):
                ids = encode(text or "", tokenizer) + END
                n = len(ids) // 4
                start, piece = 0, 0
                while start < n:
                    length = n if n <= size else (n - start) % size or size
                    rows.append((name, piece, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)])))
                    start, piece = start + length, piece + 1
            cols = list(zip(*rows))
            kinds = (arrow_id, pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=[id_col, "piece", "start", "length", "ids_crc32"])
        _state.clear()  # the worker may go on with another operator; a task loads the tables in a fraction of a second
        give_back()

    kind = id_type.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long")


def sweep(lengths: dict[int, int], size: int = SIZE) -> list[tuple[int, int, int, int, int]]:
    """All supersteps of a best-fit packing of so many pieces of each length into sequences of ``size``.

    Returns runs (length, first rank, first sequence, offset, pieces a sequence): the pieces of that
    length from that rank on go to that sequence and those after it, so many to each, behind what
    is in them up to the offset. A length's next run starts where the pieces of this one end.
    """
    runs: list[tuple[int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = {}  # room: intervals (first sequence, sequences)
    order: list[int] = []  # rooms as a heap, each once
    opened = 0

    def free(room: int, first: int, n: int) -> None:
        if room and n:
            if room not in gaps:
                gaps[room] = []
                heapq.heappush(order, room)
            gaps[room].append((first, n))

    for length in sorted(lengths, reverse=True):
        rank, todo = 0, lengths[length]
        small: list[int] = []  # rooms that no piece of this length fits, for the steps to come
        while todo:
            while order and order[0] < length:
                small.append(heapq.heappop(order))
            if order:
                room = order[0]
                first, n = gaps[room].pop()
                if not gaps[room]:
                    del gaps[room]
                    heapq.heappop(order)
            else:
                room, first, n = size, opened, -(-todo // (size // length))
                opened += n
            each = room // length
            taken = min(todo, n * each)
            runs.append((length, rank, first, size - room, each))
            full, rest = divmod(taken, each)
            free(room - each * length, first, full)
            if rest:
                free(room - rest * length, first + full, 1)
            free(room, first + full + bool(rest), n - full - bool(rest))
            rank, todo = rank + taken, todo - taken
        for room in small:
            heapq.heappush(order, room)
    return runs


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE) -> DataFrame:
    """Every piece of every document with sequence_id and offset: (id, piece, start, length, ids_crc32, sequence_id, offset).

    Null and empty texts are pieces of one id; repeated rows are packed as often as they come; an
    empty table gives an empty result; other columns of ``docs`` are left aside, so none can clash.
    """
    pieces = stash(cut(docs, tokenizer, id_col, text_col, size).withColumn("_tie", F.xxhash64(id_col, "piece", "ids_crc32")), "pieces")
    # the tie splits a length that many pieces share over several ranges
    ranges = pieces.repartitionByRange("length", "_tie").sortWithinPartitions("length", "_tie")
    row = F.monotonically_increasing_id()
    ranges = stash(ranges.drop("_tie").withColumn("_range", F.shiftright(row, 33).cast("int")).withColumn("_row", row.bitwiseAND(F.lit((1 << 33) - 1))), "ranges")
    # a row for each range and length in it: ranges hold neighbouring lengths, so there are few more rows than ranges and lengths
    counted = sorted((r[0], r[1], r[2], r[3]) for r in ranges.groupBy("length", "_range").agg(F.min("_row"), F.count(F.lit(1))).collect())
    lengths: dict[int, int] = {}
    before: list[int] = []
    for length, _, first, n in counted:
        before.append(lengths.get(length, 0) - first)
        lengths[length] = lengths.get(length, 0) + n
    place = np.array([(r << 20) | length for length, r, _, _ in counted], np.int64)
    by_place = np.argsort(place)
    place, before_rank = place[by_place], np.array(before, np.int64)[by_place]
    runs = np.array(sorted(sweep(lengths, size)), np.int64).reshape(-1, 5)
    starts = runs[:, 0] << 42 | runs[:, 1]
    names = [id_col, "piece", "start", "length", "ids_crc32"]

    def run(batches):
        for batch in batches:
            of = lambda name: batch.column(batch.schema.get_field_index(name))  # noqa: E731, B023
            length, at = of("length").to_numpy(), of("_range").to_numpy().astype(np.int64)
            rank = of("_row").to_numpy() + before_rank[np.searchsorted(place, at << 20 | length)]
            mine = runs[np.searchsorted(starts, length << 42 | rank, "right") - 1]
            along = rank - mine[:, 1]
            sequence = mine[:, 2] + along // mine[:, 4]
            offset = mine[:, 3] + along % mine[:, 4] * length
            yield pa.RecordBatch.from_arrays([*(of(n) for n in names), pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    kind = ranges.schema[id_col].dataType.simpleString()
    return ranges.mapInArrow(run, f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
