"""Secret scans with a recursive decoding worklist.

A text is scanned by three patterns. Then encoded stretches in it (percent escapes, ``\\u``
escapes, base64, and zlib or gzip data inside base64) are decoded, every decoded layer is
scanned and searched for encoded stretches again, until no layer yields another. Digests along the
way to a layer are remembered, so a layer that decodes to one it came from ends the search; a layer
met at several places is read once and its spans are mapped to each of them. Spans found in a layer
are mapped back to code points of the original text.

Compressed data is unfolded as a stream over all members and levels. Its text is scanned in pieces
that end where no pattern or encoded stretch can reach over, so memory holds a piece of PIECE bytes,
or the longest run without such a place.

Rows are independent: one Arrow pass without a shuffle, whatever key or source is hot.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import ddl_plus, sliced, with_columns, without

#: Fixed values of the op7 contract: kinds in order, pattern, the group that is measured, its least length.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # maximal runs, as [0-9a-f]+ with a least length of 32
KINDS = ("assign", "access", "hex")

PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
UNICODE = re.compile(r"\\u[0-9A-Fa-f]{4}|\\x[0-9A-Fa-f]{2}")
#: Escapes of an escape's own sign, one in another: they are taken off together, or each would make a layer of the whole text.
NESTED = re.compile(r"%25(?:25)+(?=[0-9A-Fa-f]{2})|\\u005[cC](?:u005[cC])+(?=u[0-9A-Fa-f]{4})|\\x5[cC](?:x5[cC])+(?=x[0-9A-Fa-f]{2})")
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
KEYWORDS = re.compile(r"passw|secret|token|api_?key", re.I | re.A)
#: Base64 over several lines, and what is joined away there.
SEPARATED = r"[ \t]*+\r?\n[ \t]*+[A-Za-z0-9+/_-]"
WRAPPED = re.compile(rf"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{{16,}}+(?:{SEPARATED}{{16,}}+)*+(?:{SEPARATED}++)?+={{0,2}}")
BLANKS = re.compile(r"[ \t\r\n]+")
CONTROLS = re.compile(r"[\x00-\x08\x0e-\x1f]")
#: Stretches of text in bytes that were decoded with replacement.
READABLE = re.compile(r"[^\x00-\x08\x0e-\x1f\ufffd]{8,}")
MAGIC = re.compile(rb"\x1f\x8b\x08|\x78[\x01\x5e\x9c\xda]")
#: Characters of which no pattern and no encoded stretch has any: a text may be cut behind one.
BREAK = re.compile(r"[^A-Za-z0-9_\"' :=+/.%\\\t\r\n-]")
#: Bytes unfolded at once.
PIECE = 1 << 20

Span = tuple[int, int, int]  # start, end, kind


def scan(text: str) -> list[Span]:
    """Spans of the three patterns, each leftmost and non-overlapping within its kind."""
    found: list[Span] = []
    if KEYWORDS.search(text):
        found += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        found += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    return found


def _pieces(text: str) -> Iterator[tuple[int, int, str]]:
    """Stretches of one character or more that decode to other text: start, end, decoded."""
    for m in NESTED.finditer(text):
        yield m.start(), m.end(), m[0][0]
    for m in UNICODE.finditer(text):
        yield m.start(), m.end(), chr(int(m[0][2:], 16))
    if "%" in text:
        for m in PERCENT.finditer(text):
            raw = bytes.fromhex(m[0].replace("%", ""))
            yield m.start(), m.end(), raw.decode("utf-8", "replace")


def _unescaped(text: str) -> tuple[str, list[int], list[int]] | None:
    """The text with its escapes decoded in place; ``outs`` and ``ins`` pair up positions after and before."""
    parts, at, outs, ins, made = [], 0, [0], [0], 0
    for start, end, decoded in sorted(_pieces(text), key=lambda p: (p[0], -p[1])):
        if start < at:
            continue
        parts += [text[at:start], decoded]
        made += start - at
        outs += [made, made + len(decoded)]
        ins += [start, end]
        made += len(decoded)
        at = end
    if not parts:
        return None
    outs.append(made + len(text) - at + 1)
    ins.append(len(text) + 1)
    return "".join(parts) + text[at:], outs, ins


def _back(position: int, outs: list[int], ins: list[int], end: bool) -> int:
    """Map a boundary of the decoded text to the encoded one; inside an escape it moves outwards."""
    i = bisect_right(outs, position) - 1
    if position == outs[i]:
        return ins[i] if not end or i == 0 or outs[i - 1] != outs[i] else ins[i]
    if i % 2:  # between an escape's start and end
        return ins[i + 1] if end else ins[i]
    return ins[i] + position - outs[i]


def _packed(head: bytes) -> bool:
    return head[:2] == b"\x1f\x8b" or (len(head) > 2 and head[0] & 15 == 8 and (head[0] * 256 + head[1]) % 31 == 0)


class _Damaged(Exception):
    """A compressed stream that ends early or does not unfold."""


def _broken(damage: _Damaged) -> Iterator[bytes]:
    raise damage
    yield b""


def _inflated(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """All members of a zlib or gzip stream, one after another, and what follows them as it is."""
    unpacker, plain = zlib.decompressobj(47), False
    for chunk in chunks:
        while chunk:
            if plain:
                yield chunk
                break
            try:
                out = unpacker.decompress(chunk, PIECE)
            except zlib.error as e:
                raise _Damaged from e
            if out:
                yield out
            chunk = unpacker.unused_data if unpacker.eof else unpacker.unconsumed_tail
            if unpacker.eof and chunk:
                plain = not _packed(chunk[:3])
                unpacker = zlib.decompressobj(47)
            elif not chunk:  # what is held back beyond the bound
                try:
                    while more := unpacker.decompress(b"", PIECE):
                        yield more
                except zlib.error as e:
                    raise _Damaged from e
    if not plain and not unpacker.eof:
        raise _Damaged


def _unfolded(chunks: Iterator[bytes], above: frozenset[bytes] = frozenset()) -> Iterator[bytes]:
    """The stream with every level of compression taken off; one that unfolds to a level above it ends."""
    head = b""
    try:
        for chunk in chunks:
            head += chunk
            if len(head) >= PIECE:
                break
    except _Damaged as e:
        if not head:
            raise
        chunks = _broken(e)  # what came before the damage is read first
    if not _packed(head[:3]):
        yield head
        yield from chunks
        return
    mark = hashlib.sha256(head).digest()
    if mark in above:
        return
    made = False
    try:
        for out in _unfolded(_inflated(chain([head], chunks)), above | {mark}):
            made = made or bool(out)
            yield out
    except _Damaged:
        if made:
            raise
        yield head  # text may begin like a compressed stream
        yield from chunks


def _pieces_of(chunks: Iterator[bytes], damage: list[bool]) -> Iterator[str]:
    """The text of a stream in pieces that no pattern reaches over; damage is noted."""
    decoder, held = codecs.getincrementaldecoder("utf-8")("replace"), []
    try:
        for chunk in chunks:
            text = decoder.decode(chunk)
            at = next((k + 1 for k in range(len(text) - 1, -1, -1) if BREAK.match(text, k)), 0)
            if at:
                yield "".join([*held, text[:at]])
                held = []
            held.append(text[at:])
    except _Damaged:
        damage.append(True)
    held.append(decoder.decode(b"", True))
    if any(held):
        yield "".join(held)


def _raw(token: str) -> bytes:
    body = token.rstrip("=").replace("-", "+").replace("_", "/")
    body = body[: len(body) - (len(body) % 4 == 1)]
    return base64.b64decode(body + "=" * (-len(body) % 4))


def _binary(token: str, damage: list[bool]) -> Iterator[tuple[int, int, Iterator[str]]]:
    """Stretches of a base64 run that hold text or compressed text: start, end, the pieces of the text.

    The run as a whole, or else what can be read in it from each of the four alignments.
    """
    whole = len(token.rstrip("=")) % 4 != 1
    raw = _raw(token)
    if whole and _packed(raw[:3]):
        first = zlib.decompressobj(47)
        try:
            if first.decompress(raw, 64):
                yield 0, len(token), _pieces_of(_unfolded(iter([raw])), damage)
                return
        except zlib.error:
            pass
    if whole:
        try:
            text = raw.decode("utf-8")
        except UnicodeDecodeError:
            text = None
        if text and not CONTROLS.search(text):
            yield 0, len(token), iter([text])
            return
    for skip in range(4):
        raw = _raw(token[skip:])
        place = lambda b0, b1: (skip + b0 // 3 * 4, min(len(token), skip + -(-b1 // 3) * 4))  # noqa: E731, B023
        for m in MAGIC.finditer(raw):
            try:
                if zlib.decompressobj(47).decompress(raw[m.start() : m.start() + 4096], 64):
                    yield *place(m.start(), len(raw)), _pieces_of(_unfolded(iter([raw[m.start() :]])), damage)
            except zlib.error:
                continue
        text = raw.decode("utf-8", "surrogateescape")
        text = re.sub("[\ud800-\udfff]", "\ufffd", text)
        at = done = 0
        for m in READABLE.finditer(text):
            at += len(text[done : m.start()].replace("\ufffd", "?").encode())
            size = len(m[0].encode())
            yield *place(at, at + size), iter([m[0]])
            at, done = at + size, m.end()


def _layers(layer: str, damage: list[bool]) -> Iterator[tuple[str, tuple]]:
    """The layers in a layer, each with the step back: a pair of position lists, or the stretch it is decoded from."""
    for m in WRAPPED.finditer(layer):
        if "\n" not in m[0]:
            continue
        for _, _, pieces in _binary(BLANKS.sub("", m[0]), damage):
            yield from ((piece, (m.start(), m.end(), None)) for piece in pieces)
    for m in BASE64.finditer(layer):
        for start, end, pieces in _binary(m[0], damage):
            yield from ((piece, (m.start() + start, m.start() + end, None)) for piece in pieces)
    last = [_unescaped(layer)] if "%" in layer or "\\" in layer else [None]
    layer = ""  # a long row of escaped escapes keeps no text of the layers above
    if last[0]:
        yield last[0][0], last.pop()[1:]


def deep_scan(text: str) -> tuple[list[Span], list[Span], int, bool]:
    """Base spans, all spans, the number of distinct layers decoded, and whether compressed data was damaged.

    A frame for each layer on the way: its digest, spans, inner layers, the step back to the layer
    above, and whether an inner one was left out because it is on the way itself.
    """
    digest = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).digest()
    base = scan(text)
    damage: list[bool] = []
    top = digest(text)
    known: dict[bytes, set[Span]] = {}
    met = {top}
    way = {top}
    frames: list[list] = [[top, set(base), _layers(text, damage), None, False]]
    while True:
        mark, spans, inner, step, looped = frames[-1]
        found = next(inner, None)
        if found is None:
            frames.pop()
            way.discard(mark)
            if not looped:
                known[mark] = spans
            if not frames:
                break
            frames[-1][1] |= _mapped(spans, step)
            frames[-1][4] |= looped
            continue
        layer, back = found
        mark = digest(layer)
        if mark in way:
            frames[-1][4] = True
        elif mark in known:
            spans |= _mapped(known[mark], back)
        else:
            met.add(mark)
            way.add(mark)
            frames.append([mark, set(scan(layer)), _layers(layer, damage), back, False])
    return base, sorted(spans), len(met) - 1, bool(damage)


def _mapped(spans: set[Span], step: tuple) -> set[Span]:
    """Spans of a layer as spans of the layer above."""
    if len(step) == 3:  # a whole stretch of the layer above
        return {(step[0], step[1], k) for _, _, k in spans}
    return {(_back(s, *step, False), _back(e, *step, True), k) for s, e, k in spans}


def render(spans: list[Span]) -> str:
    """kind:start:end, by start, then kind as listed, then end; comma-joined."""
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, e, k in sorted(spans, key=lambda x: (x[0], x[2], x[1])))


def scan_secrets(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with base_spans, spans, n_assign, n_access, n_hex, n_layers and cut.

    Null texts count as empty and have no spans. Repeated rows give repeated results. Columns
    that ``docs`` already has under these names are replaced.
    """
    more = "n_assign long, n_access long, n_hex long, base_spans string, spans string, n_layers long, cut boolean"
    names = [x.split()[0] for x in more.split(", ")]
    docs = without(docs, names, [text_col])

    def run(batches):
        for batch, texts in sliced(batches, text_col):
            out: list[list] = [[] for _ in names]
            for text in texts:
                base, every, layers, cut = deep_scan(text or "")
                row = [*(sum(k == want for _, _, k in base) for want in range(3)), render(base), render(every), layers, cut]
                for column, value in zip(out, row):
                    column.append(value)
            kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64(), pa.bool_()]
            yield with_columns(batch, **{n: pa.array(c, t) for n, c, t in zip(names, out, kinds)})

    return docs.mapInArrow(run, ddl_plus(docs, more))
