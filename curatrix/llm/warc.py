"""WARC archives: captures written as linked records, read back, and assembled by their concurrent-to links.

Writing. Each page becomes three records: the response (or a revisit of an equal payload), the request, and
metadata; the latter two name the first in WARC-Concurrent-To. Records are rows of Spark's text sink with the
record separator as line separator and gzip as codec, so any shared or remote store that Spark writes to will do.

Reading. Archives are read by Spark as binary files, of a size the writer bounds by records per file, and parsed
record by record from the stream; gzip may be of one member or one per record.

Assembly. Requests and metadata find their capture through concurrent-to in either direction, metadata also by
way of a request. One nested row per capture.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SEPARATOR = "\r\n\r\n"
REVISIT_BYTES = 1000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
EPOCH = "1970-01-01T00:00:00Z"
RECORDS_PER_FILE = 6000

RECORD = ("record_id string, type string, concurrent_to string, refers_to string, target_uri string, date string, "
          "head string, fields map<string,string>, payload_bytes long, payload_digest string, payload binary")


def _urn(kind: str) -> Column:
    text = F.md5(F.concat_ws("|", F.lit(kind), F.col("capture").cast("string"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), "digest"))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(text, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))


def _record(kind: Column | str, record_id: Column, headers: list[Column], content_type: Column | str, block: Column) -> Column:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    content_type = F.lit(content_type) if isinstance(content_type, str) else content_type
    head = F.concat_ws("\r\n", F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), kind),
                       F.concat(F.lit("WARC-Record-ID: "), record_id), F.lit(f"WARC-Date: {EPOCH}"), *headers,
                       F.concat(F.lit("Content-Type: "), content_type),
                       F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")))
    return F.concat(head, F.lit(SEPARATOR), block)


def captures(pages: DataFrame) -> DataFrame:
    """Pages with payload, size, digest and the page each revisits (null: stored in full).

    Of equal payloads of REVISIT_BYTES or more, the row with the largest page_id is stored, and every row of that
    id; rows with null ids revisit it as well, unless all ids of the group are null: then all are stored. Smaller
    payloads are stored in full. Null html is an empty payload.
    """
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("payload"))
    rows = rows.withColumns({"size": F.octet_length("payload").cast("long"), "digest": F.sha1("payload")})
    repeated = (rows.where(F.col("size") >= REVISIT_BYTES).groupBy("digest")
                .agg(F.max("page_id").alias("stored"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "stored"))
    joined = rows.join(repeated, "digest", "left")
    again = F.col("stored").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("stored"))
    return joined.select("page_id", "url", "payload", "size", "digest", F.when(again, F.col("stored")).alias("refers_to"))


def write_archives(pages: DataFrame, path: str, records_per_file: int = RECORDS_PER_FILE) -> None:
    """Write three records per page to gzip archives under path. Line breaks in urls are percent-encoded."""
    rows = captures(pages).withColumn("capture", F.monotonically_increasing_id())
    url = F.replace(F.replace("url", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    uri = F.concat(F.lit("WARC-Target-URI: "), url)
    digest = F.concat(F.lit("WARC-Payload-Digest: sha1:"), "digest")
    own, again = _urn("response"), F.col("refers_to").isNotNull()
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
                    F.col("size").cast("string"), F.lit("\r\n\r\n"))
    response = _record(F.when(again, "revisit").otherwise("response"), own,
                       [uri, F.when(again, F.lit(f"WARC-Profile: {PROFILE}")), digest],
                       "application/http;msgtype=response", F.when(again, http).otherwise(F.concat(http, "payload")))
    joined = F.concat(F.lit("WARC-Concurrent-To: "), own)
    host = F.regexp_extract(F.coalesce(url, F.lit("")), "://([^/?#]*)", 1)
    target = F.regexp_extract(F.coalesce(url, F.lit("")), "://[^/?#]*([^#]*)", 1)
    request = _record("request", _urn("request"), [uri, joined], "application/http;msgtype=request",
                      F.concat(F.lit("GET "), F.when(target == "", "/").otherwise(target), F.lit(" HTTP/1.1\r\nHost: "), host, F.lit("\r\n\r\n")))
    line = lambda name, c: F.concat(F.lit(f"{name}: "), F.col(c).cast("string"), F.lit("\r\n"))
    metadata = _record("metadata", _urn("metadata"), [uri, joined], "application/warc-fields",
                       F.concat_ws("", line("pageId", "page_id"), line("refersToPage", "refers_to")))
    records = rows.select(F.explode(F.array(response, request, metadata)).alias("value"))
    (records.write.option("lineSep", SEPARATOR).option("compression", "gzip")
     .option("maxRecordsPerFile", records_per_file).text(path))


def _hex_digest(value: str | None) -> str | None:
    """Bare lower-case hex of a sha1: label in hex or base32; other labels stay as they are."""
    import base64

    if value is None:
        return None
    name, _, digest = value.rpartition(":")
    if name.lower() == "sha1" and len(digest) == 32:
        return base64.b32decode(digest.upper()).hex()
    return digest.lower() if name.lower() == "sha1" else value


def _headers(lines: list[bytes]) -> dict[str, str]:
    """Header fields by lower-case name; of a repeated field the first counts; a folded line continues the last."""
    out: dict[str, str] = {}
    last = None
    for line in lines:
        text = line.decode("utf-8", "replace")
        if text[:1] in " \t" and last:
            out[last] += " " + text.strip()
            continue
        name, _, value = text.partition(":")
        last = name.strip().lower()
        out.setdefault(last, value.strip())
    return out


def parse_archive(content: bytes, with_payload: bool, source: str = "") -> Iterator[tuple]:
    """Records of one archive, as RECORD's columns. Raises ValueError for what is not a WARC record."""
    import gzip
    import hashlib
    import io

    raw: io.BufferedIOBase = io.BytesIO(content)
    stream = io.BufferedReader(gzip.GzipFile(fileobj=raw)) if content[:2] == b"\x1f\x8b" else raw  # type: ignore[arg-type]
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"{source}: no WARC record at {line[:40]!r}")
        lines = []
        while (line := stream.readline()).strip():
            lines.append(line.rstrip(b"\r\n"))
        head = _headers(lines)
        length = int(head["content-length"])
        block = stream.read(length)
        if len(block) != length:
            raise ValueError(f"{source}: record {head.get('warc-record-id')} is cut off")
        kind = head.get("warc-type")
        payload, http, fields = block, None, None
        if head.get("content-type", "").startswith("application/http"):
            top, _, payload = block.partition(b"\r\n\r\n")
            http = top.decode("utf-8", "replace")
        elif head.get("content-type") == "application/warc-fields":
            fields = _headers([x for x in block.split(b"\r\n") if x])
        size, digest = len(payload), hashlib.sha1(payload).hexdigest()
        if kind == "revisit":  # the payload is stored elsewhere: its size and digest are what the headers say
            said = _headers((http or "").encode().split(b"\r\n")[1:]).get("content-length")
            size, digest, payload = int(said) if said else None, _hex_digest(head.get("warc-payload-digest")), None
        yield (head.get("warc-record-id"), kind, head.get("warc-concurrent-to"), head.get("warc-refers-to"),
               head.get("warc-target-uri"), head.get("warc-date"), http, fields, size, digest, payload if with_payload else None)


def read_archives(spark: SparkSession, path: str, with_payload: bool = True, glob: str = "*.gz") -> DataFrame:
    """One row per record of the archives under path."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", "content")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kinds = [pa.string()] * 7 + [pa.map_(pa.string(), pa.string()), pa.int64(), pa.string(), pa.binary()]
        names = [f.split()[0] for f in RECORD.split(", ")]

        def batch_of(rows):
            columns = [list(c) for c in zip(*rows)]
            columns[7] = [None if f is None else list(f.items()) for f in columns[7]]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

        for batch in batches:
            for at in range(batch.num_rows):
                rows, size = [], 0
                for record in parse_archive(batch.column(1)[at].as_py(), with_payload, batch.column(0)[at].as_py()):
                    rows.append(record)
                    size += len(record[10] or b"")
                    if len(rows) >= 5000 or size >= 32 << 20:
                        yield batch_of(rows)
                        rows, size = [], 0
                if rows:
                    yield batch_of(rows)

    return files.mapInArrow(run, RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One row per capture: capture (response, revisit or resource record), request, metadata, and their numbers.

    A request or metadata record belongs to the capture that it names in concurrent-to, or that names it, or, for
    metadata, to the capture of the request it names. Of several, that with the smallest record id is shown and
    n_requests or n_metadata counts all. Requests and metadata that lead to no capture give no row; captures
    without them have null there. Record ids are unique in an archive; of repeated captures each gives a row.
    """
    keyed = records.where("record_id is not null")
    capture = keyed.where(F.col("type").isin("response", "revisit", "resource"))
    reverse = (capture.where("concurrent_to is not null").groupBy(F.col("concurrent_to").alias("record_id"))
               .agg(F.min("record_id").alias("named_by")))
    request = keyed.where("type = 'request'").select("record_id", "concurrent_to", "target_uri", "head", "date")
    request = request.join(reverse, "record_id", "left").withColumn("of", F.coalesce("concurrent_to", "named_by")).drop("named_by")
    via = request.where("of is not null").groupBy(F.col("record_id").alias("concurrent_to")).agg(F.min("of").alias("via"))
    metadata = keyed.where("type = 'metadata'").select("record_id", "concurrent_to", "fields", "date")
    metadata = metadata.join(reverse, "record_id", "left").join(via, "concurrent_to", "left").withColumn(
        "of", F.coalesce("via", "concurrent_to", "named_by"))
    one = lambda *cols: F.min_by(F.struct("record_id", *cols), F.col("record_id"))
    requests = request.where("of is not null").groupBy(F.col("of").alias("key")).agg(
        one("target_uri", "head", "date").alias("request"), F.count(F.lit(1)).alias("n_requests"))
    metadatas = metadata.where("of is not null").groupBy(F.col("of").alias("key")).agg(
        one("fields", "date").alias("metadata"), F.count(F.lit(1)).alias("n_metadata"))
    rows = capture.select(F.col("record_id").alias("key"), F.struct(*capture.columns).alias("capture"))
    return (rows.join(requests, "key", "left").join(metadatas, "key", "left")
            .withColumns({"n_requests": F.coalesce("n_requests", F.lit(0)), "n_metadata": F.coalesce("n_metadata", F.lit(0))})
            .drop("key"))
