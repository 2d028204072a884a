"""Archives: round trips, copies, records of other writers."""

import base64
import gzip
import hashlib

import pytest

from fathomline.llm.common import scratch_path, stash
from fathomline.llm.warc import assemble, read_records, resolve, write_archives

PAGES = "page_id long, url string, html string, key string, body string"


def sha(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def round_trip(spark, pages, **options):
    path = scratch_path(spark, "archives")
    write_archives(pages, path, **options)
    return resolve(stash(assemble(stash(read_records(spark, path)))))


NESTED = "a\r\n\r\nWARC/1.0\r\nWARC-Type: response\r\nContent-Length: 99999\r\n\r\nb\r\n\r\nWARC/1.0\r\n\r\n\r\nWARC/\r\n\r\n"
ROWS = [
    (1, "http://a.org/x?q#f", "<p>one</p>", "k", "b"),
    (2, None, "<p>one</p>", None, None),
    (3, "no scheme", None, "k", "b"),
    (4, "http://b.org", "", "k", "b"),
    (5, "http://c.org/ü\r\nX-Evil: 1", NESTED, "k", "b"),
    (6, "http://c.org/", "ünï\U0001f600" * 50_000, "k", "b"),
    (None, "http://d.org/", "<p>one</p>", "k", "b"),
    (None, "http://d.org/", "lone", "k", "b"),
    (7, "http://e.org/", "twice", "k", "b"),
    (7, "http://e.org/", "twice", "k", "b"),
    (7, "http://f.org/", "twice", "k", "b"),
    (8, "http://f.org/", "\r\n\r\n", "k", "b"),
]


def brute(rows, least):
    out, groups = [], {}
    for k, r in enumerate(rows):
        groups.setdefault(r[2] or "", []).append(k)
    for text, members in groups.items():
        top = max(members, key=lambda k: (rows[k][0] is not None, rows[k][0] or 0, k))
        for k in members:
            first = k == top or len(text.encode()) < least
            out.append((rows[k][0], len(text.encode()), sha(text), "response" if first else "revisit", None if first else rows[top][0]))
    return sorted(out, key=repr)


@pytest.mark.parametrize("least", [0, 5, 10])
def test_round_trip_equals_brute_force(spark, least):
    got = round_trip(spark, spark.createDataFrame(ROWS, PAGES).repartition(3, "page_id"), least_bytes=least).collect()
    as_key = lambda fields: int(fields["key"]) if fields and "key" in fields else None
    assert sorted([(as_key(r.metadata.fields), r.payload_bytes, r.payload_digest, r.record_type, as_key(r.original and r.original.fields)) for r in got], key=repr) == brute(ROWS, least)
    assert all(r.complete and r.n_requests == r.n_metadata == 1 and r.digest_agrees is not False for r in got)
    payloads = {as_key(r.metadata.fields): bytes(r.payload).decode() for r in got if r.record_type == "response" and r.payload_bytes > 10}
    assert payloads[5] == NESTED and payloads[6] == ROWS[5][2]
    of = {as_key(r.metadata.fields): r for r in got}
    assert of[1].request.http_start == "GET /x?q HTTP/1.1" and of[1].request.http_headers["host"] == "a.org"
    assert of[2].target_uri is None and of[5].target_uri == "http://c.org/ü%0D%0AX-Evil: 1"


def test_no_pages_give_no_captures(spark):
    assert round_trip(spark, spark.createDataFrame([], PAGES)).count() == 0


def record(kind, block=b"", **headers):
    lines = [f"WARC-Type: {kind}", *(f"{k.replace('_', '-')}: {v}" for k, v in headers.items()), f"Content-Length: {len(block)}"]
    return ("WARC/1.1\r\n" + "\r\n".join(lines) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def foreign():
    """The request comes first and the response names it; metadata names the request; a header is folded; one record is cut short."""
    http = b"HTTP/1.1 200 OK\r\nX-A: 1\r\nX-A: 2\r\n\r\n"
    return [
        record("warcinfo", b"software: other\r\n", WARC_Record_ID="<i>"),
        record("request", b"GET / HTTP/1.1\r\nHost: h\r\n\r\n", WARC_Record_ID="<q>", WARC_Target_URI="http://h/"),
        record("response", http + b"\xff\x00body", WARC_Record_ID="<r>", WARC_Concurrent_To="<q>", WARC_Target_URI="http://h/\r\n ?folded", WARC_Payload_Digest="sha1:WRONG"),
        record("metadata", b"a: 1\r\nb: 2\r\n", WARC_Record_ID="<m>", WARC_Concurrent_To="<q>", Content_Type="application/warc-fields"),
        record("metadata", b"c: 1\r\n", WARC_Record_ID="<z>", WARC_Concurrent_To="<nowhere>"),
        record("response", http + b"x" * 50, WARC_Record_ID="<s>")[:-30],
    ]


@pytest.mark.parametrize("packed", ["member", "whole", "plain"])
def test_records_of_other_writers(spark, tmp_path, packed):
    parts = foreign()
    data = b"".join(map(gzip.compress, parts)) if packed == "member" else gzip.compress(b"".join(parts)) if packed == "whole" else b"".join(parts)
    name = tmp_path / ("a.warc" if packed == "plain" else "a.warc.gz")
    name.write_bytes(data)
    cut = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100")  # a plain file lies in many tasks
    try:
        records = stash(read_records(spark, str(name)))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", cut)
    assert records.count() == 6
    got = {r.record_id: r for r in assemble(records).collect()}
    assert set(got) == {"<r>", "<s>"}
    r = got["<r>"]
    assert bytes(r.payload) == b"\xff\x00body" and r.complete and r.digest_agrees is False and r.http_headers["x-a"] == "1, 2"
    assert r.target_uri == "http://h/ ?folded" and r.request.record_id == "<q>" and r.metadata.fields == {"a": "1", "b": "2"}
    assert not got["<s>"].complete and got["<s>"].request is None and got["<s>"].n_metadata == 0


def test_long_plain_file_keeps_its_order(spark, tmp_path):
    blocks = [(b"WARC/1.0\r\n\r\n\r\nWARC/" * (k % 7)) + bytes([65 + k % 26]) * (k * 37 % 5000) for k in range(300)]
    (tmp_path / "b.warc").write_bytes(b"".join(record("resource", b, WARC_Record_ID=f"<{k}>", Content_Type="text/plain") for k, b in enumerate(blocks)))
    cut = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        got = read_records(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", cut)
    assert {r.record_id: bytes(r.payload) for r in got} == {f"<{k}>": b for k, b in enumerate(blocks)}


@pytest.mark.parametrize("packed", [True, False])
def test_no_record_is_lost_where_a_buffer_ends(spark, tmp_path, packed):
    blocks = [b"\r\n" * (k % 60) for k in range(4000)]
    data = b"".join(record("resource", b, WARC_Record_ID=f"<{k}>", Content_Type="text/plain") for k, b in enumerate(blocks))
    (tmp_path / ("d.warc.gz" if packed else "d.warc")).write_bytes(gzip.compress(data) if packed else data)
    got = read_records(spark, str(tmp_path)).collect()
    assert {r.record_id: bytes(r.payload) for r in got} == {f"<{k}>": b for k, b in enumerate(blocks)}


def test_a_file_that_is_no_archive_is_an_error(spark, tmp_path):
    (tmp_path / "c.warc").write_bytes(b"hello")
    with pytest.raises(Exception, match="does not start with a WARC record"):
        read_records(spark, str(tmp_path)).count()
