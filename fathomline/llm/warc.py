"""Web archives: pages written as WARC records, and archives read back into one nested row a capture.

Writing: a capture is three records of one file, a request, a response (or revisit) and a metadata
record; request and metadata name the response in WARC-Concurrent-To. Of captures with equal payloads
of at least ``least_bytes`` the one with the largest key is the response; the others are revisits, which keep
the HTTP head and the payload's digest and name the response in WARC-Refers-To. Only digests are
shuffled to find copies; payloads move once, in a join that Spark splits where a digest is hot,
and not at all where the table of copies is small enough to be broadcast by its measured size.

Reading: the text reader cuts a file (plain, or gzip by file or by record) at lines that begin with ``WARC/``, so a task holds one
record at a time. A payload may hold such a line: stretches are glued until the block has the
length its head states. A file that isn't compressed may be cut between tasks, so its stretches are
put in order by file first.

Assembly: records are joined through their concurrent-to identifiers, in either direction and over
several steps, until no record without a capture can be placed. A capture keeps one request and one metadata
record (those with the smallest identifier) and the number of each.

Null payloads are empty; a null url leaves out the header, line ends in a url become percent escapes;
a null key ranks below all and leaves out the field. Repeated rows are captures of their own: the input must give equal
rows in equal order when read again, as a table of files does, where keys repeat. No rows give no
captures. Columns other than the three named aren't read. A record that ends before its stated length has
``complete`` false; one without capture is in ``read_records`` only.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import partial, reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stash

CRLF = "\r\n"
#: What the reader cuts at: a line that begins like a record. No end of it is a start of it; the text reader misses such a cut where its buffer ends in the overlap.
CUT = "\nWARC/"
CAPTURES = ("response", "revisit", "resource")
SAME_PAYLOAD = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
#: Payload bytes gathered before a batch of records leaves a task.
BATCH_BYTES = 16_000_000

RECORD = pa.schema(
    [
        ("record_id", pa.string()),
        ("record_type", pa.string()),
        ("concurrent_to", pa.list_(pa.string())),
        ("refers_to", pa.string()),
        ("target_uri", pa.string()),
        ("date", pa.string()),
        ("http_start", pa.string()),
        ("http_headers", pa.map_(pa.string(), pa.string())),
        ("fields", pa.map_(pa.string(), pa.string())),
        ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()),
        ("digest_agrees", pa.bool_()),
        ("complete", pa.bool_()),
        ("payload", pa.binary()),
    ]
)
DDL = (
    "record_id string, record_type string, concurrent_to array<string>, refers_to string, target_uri string, date string, http_start string, "
    "http_headers map<string,string>, fields map<string,string>, payload_bytes long, payload_digest string, digest_agrees boolean, complete boolean, payload binary"
)


def base32_sha1(text: Column) -> Column:
    """The bare upper-case base32 SHA-1 of a text's UTF-8 bytes: ten hexadecimal digits are eight of base 32."""
    digits = F.sha1(text)
    parts = [F.lpad(F.conv(F.substring(digits, 10 * k + 1, 10), 16, 32), 8, "0") for k in range(4)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _urn(*parts: Column) -> Column:
    """A name-based identifier."""
    return F.regexp_replace(F.md5(F.concat_ws("/", *parts)), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "<urn:uuid:$1-$2-$3-$4-$5>")


def _record(kind: Column, block: Column, **headers: Column) -> Column:
    """A record up to the end of its block; headers that are null are left out."""
    named = {"WARC-" + name.replace("_", "-"): value for name, value in headers.items()}
    named["Content-Length"] = F.octet_length(block).cast("string")
    lines = [F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(CRLF)), F.lit("")) for name, value in named.items()]
    return F.concat(F.lit(f"WARC/1.0{CRLF}WARC-Type: "), kind, F.lit(CRLF), *lines, F.lit(CRLF), block)


def write_archives(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", payload: str = "html", least_bytes: int = 0, captured: str = "2024-01-01T00:00:00Z") -> None:
    """Write the rows of ``pages`` as gzip archives under ``path``."""
    rows = pages.select(F.col(key).cast("long").alias("key"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(payload).cast("string"), F.lit("")).alias("body"))
    rows = rows.withColumns({"digest": base32_sha1(F.col("body")), "bytes": F.octet_length("body"), "row": F.monotonically_increasing_id()})
    # one row of a key is known by its key; the row number only decides between rows of one key
    heads = (
        rows.where(F.col("bytes") >= least_bytes)
        .groupBy("digest")
        .agg(F.max(F.struct("key", "row")).alias("top"), F.max(F.struct("key", (-F.col("row")).alias("row"))).alias("low"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .select("digest", F.col("top.key").alias("top_key"), F.col("top.row").alias("top_row"), (F.col("top.row") == -F.col("low.row")).alias("one_row"))
    )
    rows = rows.join(stash(heads, "warc-copies"), "digest", "left")
    first = F.col("one_row").isNull() | (F.col("key").eqNullSafe(F.col("top_key")) & (F.col("one_row") | (F.col("row") == F.col("top_row"))))
    address = F.trim(F.replace(F.replace("url", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A")))
    own = _urn(F.col("digest"), F.coalesce(F.col("key").cast("string"), F.lit("")), F.col("row").cast("string"))
    original = _urn(F.col("digest"))
    head = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("bytes").cast("string"), F.lit(CRLF + CRLF))
    rows = rows.withColumns({"first": first, "uri": address, "own": own, "head": head}).withColumn("id", F.when(F.col("first") & (F.col("bytes") >= least_bytes), original).otherwise(F.col("own")))
    place = lambda pattern: F.coalesce(F.regexp_extract("uri", pattern, 1), F.lit(""))
    route = F.concat(F.lit("GET /"), place(r"^[^:]*://[^/]*/([^#]*)"), F.lit(f" HTTP/1.1{CRLF}Host: "), place(r"^[^:]*://([^/?#]*)"), F.lit(CRLF + CRLF))
    about = {"Target_URI": F.col("uri"), "Date": F.lit(captured)}
    side = lambda kind, block: _record(F.lit(kind), block, Record_ID=_urn(F.col("own"), F.lit(kind)), Concurrent_To=F.col("id"), **about)
    main = _record(
        F.when(F.col("first"), "response").otherwise("revisit"),
        F.concat("head", F.when(F.col("first"), F.col("body")).otherwise("")),
        Record_ID=F.col("id"),
        **about,
        Payload_Digest=F.concat(F.lit("sha1:"), "digest"),
        Profile=F.when(~F.col("first"), SAME_PAYLOAD),
        Refers_To=F.when(~F.col("first"), original),
    )
    fields = F.coalesce(F.concat(F.lit("key: "), F.col("key").cast("string"), F.lit(CRLF)), F.lit(""))
    captures = F.concat_ws(CRLF + CRLF, side("request", route), main, side("metadata", fields))
    rows.select(captures.alias("value")).write.option("lineSep", CRLF + CRLF).option("compression", "gzip").text(path)


def _named(lines: bytes) -> list[tuple[str, str]]:
    """Header lines as pairs, names in lower case, folded lines joined."""
    out: list[tuple[str, str]] = []
    for line in lines.decode("utf-8", "replace").split(CRLF):
        if line[:1] in (" ", "\t") and out:
            out[-1] = (out[-1][0], f"{out[-1][1]} {line.strip()}")
        elif ":" in line:
            name, _, value = line.partition(":")
            out.append((name.strip().lower(), value.strip()))
    return out


def _merged(pairs: list[tuple[str, str]]) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, value in pairs:
        out[name] = f"{out[name]}, {value}" if name in out else value
    return out


def _length(value: str | None) -> int | None:
    return int(value) if value and value.isascii() and value.isdigit() else None


def parse_record(data: bytes, keep_payload: bool) -> dict:
    """A record's row from what follows ``WARC/``: version, head, block and what is behind the block."""
    head, _, rest = data.partition(b"\r\n\r\n")
    pairs = _named(head.partition(b"\r\n")[2])
    h = dict(reversed(pairs))
    size = _length(h.get("content-length"))
    block = rest if size is None else rest[:size]
    row = {"record_id": h.get("warc-record-id"), "record_type": h.get("warc-type"), "concurrent_to": [v for k, v in pairs if k == "warc-concurrent-to"], "refers_to": h.get("warc-refers-to"), "target_uri": h.get("warc-target-uri"), "date": h.get("warc-date")}
    row["complete"] = size is not None and len(block) == size
    stated = (h.get("warc-payload-digest") or "").removeprefix("sha1:") or None
    payload = block
    if row["record_type"] in ("request", "response", "revisit"):
        start, _, payload = block.partition(b"\r\n\r\n")
        row["http_start"] = start.partition(b"\r\n")[0].decode("utf-8", "replace")
        row["http_headers"] = list(_merged(_named(start.partition(b"\r\n")[2])).items())
    elif h.get("content-type", "application/warc-fields").startswith("application/warc-fields"):
        row["fields"] = list(_merged(_named(block)).items())
    if row["record_type"] == "revisit":  # the payload is with the record it refers to
        row["payload_bytes"], row["payload_digest"] = _length(dict(row["http_headers"]).get("content-length")), stated
    else:
        own = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        row |= {"payload_bytes": len(payload), "payload_digest": own, "digest_agrees": None if stated is None else stated == own}
        if keep_payload:
            row["payload"] = payload
    return row


def _stated_end(data: bytes) -> int:
    """Where the record that starts with ``data`` ends by its own length; what there is if it states none; behind ``data`` where its head goes on."""
    head, found, _ = data.partition(b"\r\n\r\n")
    if not found:  # a block that starts with WARC/ takes the head's end into the cut
        return len(data) + 1
    size = _length(dict(reversed(_named(head.partition(b"\r\n")[2]))).get("content-length"))
    return 0 if size is None else len(head) + 4 + size


def _records(batches: Iterator[pa.RecordBatch], keep_payload: bool) -> Iterator[pa.RecordBatch]:
    """Records from a file's stretches in order; a stretch within a block is glued to what is before it."""
    cut = CUT.encode()
    current, parts, held, needed = None, [], 0, 0
    rows: list[dict] = []
    gathered = 0

    def close() -> None:
        nonlocal gathered, parts
        if parts:
            rows.append(parse_record(cut.join(parts), keep_payload))
            gathered += held
        parts = []

    for batch in batches:
        files, values = batch.column(0), batch.column(1)
        for k in range(batch.num_rows):
            file, data = files[k].as_py(), values[k].as_py() or b""
            if file != current:
                close()
                current = file
                if not data.startswith(b"WARC/"):  # nothing, or no archive
                    if data.strip():
                        raise ValueError(f"{file} does not start with a WARC record")
                    continue
                data = data[5:]
            elif parts and held < needed:
                if len(parts) == 1 and held + 1 == needed:
                    data, parts = parts[0] + cut + data, []
                    held, needed = 0, _stated_end(data)
                held += len(data) + (len(cut) if parts else 0)
                parts.append(data)
                continue
            else:
                close()
            parts, held, needed = [data], len(data), _stated_end(data)
            if gathered > BATCH_BYTES:
                yield pa.RecordBatch.from_pylist(rows, RECORD)
                rows, gathered = [], 0
    close()
    yield pa.RecordBatch.from_pylist(rows, RECORD)


def read_records(spark: SparkSession, path: str | list[str], payload: bool = True) -> DataFrame:
    """The records of the archives under ``path``; without ``payload`` it is measured and digested only."""
    text = spark.read.option("lineSep", CUT).text(path)
    cuts = text.select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("value"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place"))
    if not all(f.endswith(".gz") for f in text.inputFiles()):
        cuts = cuts.repartition("file").sortWithinPartitions("file", "block", "place")
    return cuts.select("file", "value").mapInArrow(partial(_records, keep_payload=payload), DDL)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row a capture: its own record, its request and metadata record, and how many there were of each.

    ``records`` is read several times: give a table.
    """
    captures = records.where(F.col("record_type").isin(*CAPTURES))
    sides = records.where(F.col("record_type").isin("request", "metadata") & F.col("record_id").isNotNull())
    named = records.select("record_id", F.explode(F.array_distinct("concurrent_to")).alias("other")).where("record_id is not null")
    both = named.union(named.select("other", "record_id"))
    placed, new = [], captures.select(F.col("record_id").alias("at"), F.col("record_id").alias("capture"))
    left = sides.select("record_id").distinct()
    while True:
        near = both.join(new, F.col("other") == F.col("at")).join(left, "record_id", "left_semi")
        placed.append(stash(near.groupBy("record_id").agg(F.min("capture").alias("capture")), "warc-placed"))
        new = placed[-1].select(F.col("record_id").alias("at"), "capture")
        left = left.join(placed[-1], "record_id", "left_anti")
        if placed[-1].isEmpty() or left.isEmpty():
            break
    of = sides.join(reduce(DataFrame.union, placed), "record_id")
    request = F.struct("record_id", "http_start", "http_headers")
    about = F.struct("record_id", "fields")
    kind = lambda name, value: F.min_by(F.when(F.col("record_type") == name, value), F.when(F.col("record_type") == name, F.col("record_id")))
    number = lambda name: F.count_if(F.col("record_type") == name)
    joined = of.groupBy("capture").agg(kind("request", request).alias("request"), kind("metadata", about).alias("metadata"), number("request").alias("n_requests"), number("metadata").alias("n_metadata"))
    out = captures.join(joined, F.col("record_id") == F.col("capture"), "left").drop("capture", "concurrent_to", "fields")
    return out.withColumns({"n_requests": F.coalesce("n_requests", F.lit(0)), "n_metadata": F.coalesce("n_metadata", F.lit(0))})


def resolve(captures: DataFrame) -> DataFrame:
    """The captures with ``original``: identifier, url and metadata fields of the record that a revisit refers to.

    ``captures`` is read twice: give a table. A response that many revisits name is a hot key of the join,
    whose two sides are plain shuffles, so that Spark splits it.
    """
    known = captures.where((F.col("record_type") != "revisit") & F.col("record_id").isNotNull())
    known = known.groupBy("record_id").agg(F.min(F.struct("target_uri", "payload_bytes")).alias("m"), F.min_by("metadata.fields", F.col("metadata.record_id")).alias("f"))
    known = known.select(F.struct("record_id", "m.target_uri", "m.payload_bytes", F.col("f").alias("fields")).alias("original"), F.col("record_id").alias("named"))
    return captures.join(stash(known, "warc-originals"), F.col("refers_to") == F.col("named"), "left").drop("named")
