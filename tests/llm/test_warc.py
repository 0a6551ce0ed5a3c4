"""Archives: round trips against plain rules, payloads that look like records, archives from elsewhere."""

import base64
import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from casewright.llm import warc

NESTED = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x>\r\nContent-Length: 9\r\n\r\nHTTP\r\n\r\nx\r\n\r\n"
PAYLOADS = ["<p>a</p>", "", None, "same " * 40, "same " * 40, "same " * 40, "a\r\n\r\nb\r\n\r\n", "WARC/1.1\r\n", "WARC/1.1\r\nWARC/1.1\r\n", f"x{NESTED}y", NESTED * 3, "é😀 " * 50, "long " * 60_000, "\x00\x01\r", "WARC/1.1", "Content-Length: 3\r\n\r\nabc"]
URLS = ["http://a.example/x?y#z", None, "no scheme", "http://h.example", "https://ü.example/ö: p", "http://line\r\nWARC-Type: warcinfo/x"]


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def plain(pages, least):
    """(page_id, bytes, digest, type, refers_to) by the plain rules."""
    payload = [(x or "").encode() for _, _, x in pages]
    first = {}
    for k in sorted(range(len(pages)), key=lambda k: (pages[k][0] is None, pages[k][0] or 0, k)):
        first.setdefault(payload[k], k)
    out = []
    for k, (page, _, _) in enumerate(pages):
        again = len(payload[k]) >= least and first[payload[k]] != k
        out.append((page, len(payload[k]), digest(payload[k]), "revisit" if again else "response", pages[first[payload[k]]][0] if again else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("least,compression", [(0, "gzip"), (10, "none"), (1 << 20, "none")])
def test_round_trip(spark, least, compression):
    pages = [(k, URLS[k % len(URLS)], x) for k, x in enumerate(PAYLOADS * 2)] + [(3, None, "same " * 40), (None, "http://n.example/", "same " * 40), (None, None, "alone")]
    table = spark.createDataFrame(pages, "page_id long, url string, html string").selectExpr("*", "1 AS row_id", "2 AS first", "3 AS payload", "4 AS same", "5 AS kind")
    rows = warc.round_trip(table.coalesce(1), least, compression).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows), key=str) == plain(pages, least)
    assert sorted(((r.page_id, r.url) for r in rows), key=str) == sorted(((p, u) for p, u, _ in pages), key=str)
    assert all(len(r.requests) == 1 and r.requests[0].startswith("GET /") for r in rows)


def test_files_are_archives(spark, tmp_path):
    table = spark.createDataFrame([(k, "http://a.example/", x) for k, x in enumerate(PAYLOADS)], "page_id long, url string, html string")
    warc.write(table, f"{tmp_path}/a", compression="none")
    kinds, seen = [], {}
    for path in (tmp_path / "a").glob("part-*"):
        data = path.read_bytes()
        while data:
            head, _, rest = data.partition(b"\r\n\r\n")
            fields = [x.split(b": ", 1) for x in head.split(b"\r\n")[1:]]
            named = dict(fields)
            size = int(named[b"Content-Length"])
            assert head.startswith(b"WARC/1.1\r\n") and rest[size : size + 4] == b"\r\n\r\n" and len(named) == len(fields)
            kinds.append(named[b"WARC-Type"].decode())
            assert seen.setdefault(named[b"WARC-Record-ID"], named) is named
            if named[b"WARC-Type"] == b"response":
                assert named[b"WARC-Payload-Digest"].decode() == "sha1:" + digest(rest[:size].partition(b"\r\n\r\n")[2])
            data = rest[size + 4 :]
    assert {k: kinds.count(k) for k in set(kinds)} == {"request": 16, "metadata": 16, "response": 13, "revisit": 3}
    assert all(x[b"WARC-Refers-To"] in seen for x in seen.values() if x[b"WARC-Type"] == b"revisit")
    assert all(x[b"WARC-Concurrent-To"] in seen for x in seen.values() if x[b"WARC-Type"] in (b"request", b"metadata"))


def record(kind, name, block, *more):
    head = [b"WARC/1.1", b"WARC-Type: " + kind, b"WARC-Record-ID: <urn:" + name + b">", *more, b"content-length:  %d" % len(block)]
    return b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n"


def test_archives_from_elsewhere(spark, tmp_path):
    body = bytes(range(256)) + b"WARC/1.1\r\nx\r\n\r\n" + bytes(range(255, -1, -1))
    made = [
        record(b"warcinfo", b"i", b"software: other\r\n"), record(b"response", b"1", b"HTTP/1.1 200 OK\r\nA: b\r\n\r\n" + body, b"WARC-Target-URI: http://x.example/a: b", b"WARC-Payload-Digest: sha1:Q"),
        record(b"request", b"r1", b"GET / HTTP/1.1\r\n\r\n", b"WARC-Concurrent-To: <urn:1>", b"WARC-Concurrent-To: <urn:2>"), record(b"metadata", b"m1", b"k: v\r\n", b"WARC-Concurrent-To: <urn:1>"),
        record(b"revisit", b"2", b"", b"WARC-Refers-To: <urn:gone>"), record(b"request", b"r2", b"lost", b"WARC-Concurrent-To: <urn:nobody>"), record(b"conversion", b"c", b"text"),
    ]
    (tmp_path / "one.warc.gz").write_bytes(b"".join(map(gzip.compress, made)))
    (tmp_path / "two.warc").write_bytes(record(b"response", b"3", b"no head"))
    found = {r.record_id: r for r in warc.captures(warc.records(spark, str(tmp_path))).collect()}
    assert found.keys() == {"<urn:1>", "<urn:2>", "<urn:3>"}
    one, two = found["<urn:1>"], found["<urn:2>"]
    assert bytes(one.payload) == body and one.url == "http://x.example/a: b" and one.payload_digest == "Q" and one.metadata == ["k: v\r\n"]
    assert one.requests == two.requests == ["GET / HTTP/1.1\r\n\r\n"] and two.payload is None and two.refers_to == "<urn:gone>" and two.metadata == []
    assert bytes(found["<urn:3>"].payload) == b""


def test_split_archives(spark, tmp_path):
    """Small splits cut records anywhere; pieces come back in order."""
    table = spark.createDataFrame([(k, None, x) for k, x in enumerate(PAYLOADS)], "page_id long, url string, html string")
    warc.write(table.coalesce(1), f"{tmp_path}/a", compression="none")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        got = warc.captures(warc.records(spark, f"{tmp_path}/a")).select(warc.said(F.col("metadata"), "page-id").cast("long").alias("page_id"), "payload").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(got) == len(PAYLOADS) and {bytes(r.payload).decode() for r in got if r.payload is not None} == {x or "" for x in PAYLOADS}


def test_empty_table(spark):
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_base32(spark):
    rows = spark.createDataFrame([(bytes([k]) * k,) for k in range(40)], "x binary").select("x", warc.base32_sha1(F.col("x")).alias("y")).collect()
    assert all(r.y == digest(bytes(r.x)) for r in rows)
