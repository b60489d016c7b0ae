"""Archives: exact round trip, revisits, and assembly of records from other writers."""

import base64
import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from curatrix.llm import warc
from curatrix.llm.common import scratch

SCHEMA = "page_id long, url string, html string, digest string, size long, payload string"
BIG, OTHER = "<p>\r\n\r\nWARC/1.1\r\n</p>é" * 60, "x" * 1000
ROWS = [
    (1, "http://a.b/c?d=e#f", BIG), (2, "http://a.b/", BIG), (3, None, BIG), (4, "no scheme", "small"), (5, "http://a.b/\r\nX: y", "small"),
    (6, "http://a.b/", None), (7, "http://a.b/", ""), (8, "http://a.b/", OTHER), (None, "http://a.b/", OTHER), (9, "http://x", "x" * 999),
    (10, "http://x", "x" * 999), (11, "http://l", "long " * 400_000), (12, "http://r", "repeated row" * 100), (12, "http://r", "repeated row" * 100),
]


def frame(spark, rows=ROWS):
    return spark.createDataFrame([(*r, "clash", 1, None) for r in rows], SCHEMA)


def expected(rows):
    stored = {}
    for page, _, html in rows:
        data = (html or "").encode()
        if len(data) >= 1000 and page is not None:
            stored[data] = max(page, stored.get(data, page))
    out = []
    for page, _, html in rows:
        data = (html or "").encode()
        to = stored.get(data)
        again = to is not None and to != page
        out.append((page, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", to if again else None))
    return sorted(out, key=str)


def assembled(spark, rows):
    path = scratch(spark, "warc-test")
    warc.write_archives(frame(spark, rows).repartition(3), path, records_per_file=7)
    return warc.assemble(warc.read_archives(spark, path))


def test_round_trip(spark):
    rows = assembled(spark, ROWS).collect()
    got = [(f.get("pageid"), r["capture"]["payload_bytes"], r["capture"]["payload_digest"], r["capture"]["type"], f.get("referstopage"))
           for r in rows for f in [r["metadata"]["fields"]]]
    number = lambda v: None if v is None else int(v)
    assert sorted(((number(a), b, c, d, number(e)) for a, b, c, d, e in got), key=str) == expected(ROWS)
    assert all(r["n_requests"] == r["n_metadata"] == 1 for r in rows)
    html = {page: (text or "").encode() for page, _, text in ROWS}
    for r in rows:
        page = number(r["metadata"]["fields"].get("pageid"))
        assert r["capture"]["payload"] == (None if r["capture"]["type"] == "revisit" else html[page])
    request = next(r["request"] for r in rows if r["metadata"]["fields"].get("pageid") == "1")
    assert request["head"].startswith("GET /c?d=e HTTP/1.1\r\nHost: a.b") and request["target_uri"] == ROWS[0][1]


def test_empty_table(spark):
    assert assembled(spark, []).count() == 0


def record(kind, rid, block, *more):
    head = [b"WARC/1.0", b"WARC-Type: " + kind, b"WARC-Record-ID: " + rid, *more, b"Content-Length: %d" % len(block)]
    return b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n"


HTTP = b"HTTP/1.1 200 OK\r\nContent-Length: 4\r\n\r\n"


def foreign():
    http = b"Content-Type: application/http; msgtype=response"
    digest = b"WARC-Payload-Digest: sha1:" + base64.b32encode(hashlib.sha1(b"body").digest())
    return [
        record(b"warcinfo", b"<w>", b"software: x\r\n", b"Content-Type: application/warc-fields"),
        record(b"response", b"<r1>", HTTP + b"body", http),
        record(b"request", b"<q1>", b"GET / HTTP/1.1\r\n\r\n", http, b"WARC-Concurrent-To: <r1>"),
        record(b"request", b"<q0>", b"GET /0 HTTP/1.1\r\n\r\n", http, b"WARC-Concurrent-To: <r1>"),
        record(b"metadata", b"<m1>", b"a: b\r\n", b"Content-Type: application/warc-fields", b"WARC-Concurrent-To: <q1>"),
        record(b"revisit", b"<r2>", HTTP, http, digest, b"WARC-Concurrent-To: <q2>"),
        record(b"request", b"<q2>", b"GET /2 HTTP/1.1\r\n\r\n", http),
        record(b"metadata", b"<m9>", b"lost: 1\r\n", b"Content-Type: application/warc-fields", b"WARC-Concurrent-To: <gone>"),
    ]


@pytest.mark.parametrize("members", ["each", "one", "plain"])
def test_parse_forms_of_compression(members):
    blocks = foreign()
    data = {"each": b"".join(map(gzip.compress, blocks)), "one": gzip.compress(b"".join(blocks)), "plain": b"".join(blocks)}[members]
    rows = list(warc.parse_archive(data, True))
    assert [r[0] for r in rows] == ["<w>", "<r1>", "<q1>", "<q0>", "<m1>", "<r2>", "<q2>", "<m9>"]
    assert rows[1][8:] == (4, hashlib.sha1(b"body").hexdigest(), b"body")
    assert rows[5][8:] == (4, hashlib.sha1(b"body").hexdigest(), None)


def test_assembly_follows_links_both_ways(spark):
    rows = [r for b in foreign() for r in warc.parse_archive(b, True)]
    got = {r["capture"]["record_id"]: r for r in warc.assemble(spark.createDataFrame(rows, warc.RECORD)).collect()}
    assert set(got) == {"<r1>", "<r2>"}
    assert (got["<r1>"]["request"]["record_id"], got["<r1>"]["n_requests"], got["<r1>"]["metadata"]["fields"]) == ("<q0>", 2, {"a": "b"})
    assert (got["<r2>"]["request"]["record_id"], got["<r2>"]["metadata"], got["<r2>"]["n_metadata"]) == ("<q2>", None, 0)


def test_broken_archives_are_errors():
    with pytest.raises(ValueError, match="no WARC record"):
        list(warc.parse_archive(b"HELLO\r\n", True))
    with pytest.raises(ValueError, match="cut off"):
        list(warc.parse_archive(foreign()[1][:-8], True))


def test_captures_keep_all_rows_of_a_hot_payload(spark):
    pages = spark.range(900).select(F.col("id").alias("page_id"), F.lit("http://h").alias("url"),
                                    F.when(F.col("id") % 3 == 0, "h" * 1200).otherwise(F.concat(F.lit("p" * 1000), F.col("id").cast("string"))).alias("html"))
    rows = warc.captures(pages)
    assert rows.count() == 900
    assert rows.where("refers_to = 897").count() == 299
