"""Exact deduplication as a stream: disk-backed keyed state without expiry, full bytes compared on every hit.

1. `arrivals` reads each text once: digest of the text without ASCII white space, length, id and content
   locator (file and row). These narrow rows are the log the stream reads.
2. `absorb` streams new log files into RocksDB state keyed by digest. The state never expires; it holds the
   rows seen and the identifier and locator of the row that stays.
3. `collisions` compares whole bodies of all rows that hit a digest another row has: per digest the least and
   the greatest body must be the same. Both are partial aggregates, so a group of any size leaves one pair of
   bodies per task. Digests found unequal are grouped again by digest and body.
4. `decisions` gives every row its group.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curatrix.llm.common import FILE, LOCATOR, ROW, SPACES, drop_rows, located, lookup, save, scratch, text_bytes

STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # Many small stores on one disk: no space is set aside for logs that are not written.
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    # All stores of an executor share one bound on memory; small write buffers suffice for short rows.
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "64",
    "spark.sql.streaming.stateStore.rocksdb.writeBufferSizeMB": "4",
}
LOG = f"doc_id long, {FILE} string, {ROW} long, n_chars long, digest string"
FILTER_BITS = 26  # of the bitmap over digests with hits: 8 MB, whatever the input

Digest = Callable[[bytes], str]


def sha256_hex(body: bytes) -> str:
    return hashlib.sha256(body).hexdigest()


def arrivals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Digest = sha256_hex) -> DataFrame:
    """One narrow row per row of `located(docs)`. Null texts count as empty; null ids stay null."""
    def describe(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            text = batch.column(3)
            digests = [digest(b.translate(None, SPACES)) for b in text_bytes(text)]
            chars = pc.fill_null(pc.cast(pc.utf8_length(text), pa.int64()), 0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), chars, pa.array(digests, pa.string())],
                names=["doc_id", FILE, ROW, "n_chars", "digest"])

    columns = docs.select(F.col(id_col).cast("long").alias("doc_id"), *LOCATOR, F.col(text_col).alias("text"))
    return columns.mapInArrow(describe, LOG)


@contextmanager
def _rocksdb(spark: SparkSession):
    before = {name: spark.conf.get(name, None) for name in STATE_STORE}
    for name, value in STATE_STORE.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def absorb(spark: SparkSession, log: str, state: str, per_trigger: int = 32 << 30) -> DataFrame:
    """Stream the log files not yet seen into the state folder; returns the state (digest, size, keep).

    May be called again whenever files are added to the log; Spark's offset log makes a restart exact.
    The row that stays has the most code points, then the smallest id (null last), then the first locator.
    """
    rows = spark.readStream.schema(LOG).option("maxBytesPerTrigger", str(per_trigger)).parquet(log)
    order = F.struct((-F.col("n_chars")).alias("o"), F.col("doc_id").isNull().alias("n"), "doc_id", *LOCATOR)
    groups = rows.groupBy("digest").agg(F.count(F.lit(1)).alias("size"), F.min(order).alias("keep"))
    with _rocksdb(spark):
        stream = (groups.writeStream.outputMode("update").format("noop").option("checkpointLocation", state)
                  .trigger(availableNow=True).start())
        stream.awaitTermination()
        held = spark.read.format("statestore").load(state)
        value = [f"value.`{c}`" for c in held.schema["value"].dataType.names]
        return held.select("key.digest", F.col(value[0]).alias("size"), F.col(value[1]).alias("keep"))


def _hit_filter(spark: SparkSession, hits: DataFrame):
    """Bitmap of hashed digests, 2**FILTER_BITS bits at any input size."""
    import numpy as np

    bit = F.xxhash64("digest").bitwiseAND((1 << FILTER_BITS) - 1)
    words = (hits.select(bit.alias("bit")).groupBy(F.shiftright("bit", 6).alias("word"))
             .agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("bits")).toArrow())
    bitmap = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    bitmap[words["word"].to_numpy()] = words["bits"].to_numpy()
    return spark.sparkContext.broadcast(bitmap)


def bodies(docs: DataFrame, hits: DataFrame, text_col: str = "text", digest: Digest = sha256_hex) -> DataFrame:
    """(digest, locator, body) of the rows whose digest is among hits, and of few others the bitmap lets through."""
    bitmap = _hit_filter(docs.sparkSession, hits)

    def emit(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import xxhash

        mask = (1 << FILTER_BITS) - 1
        bits = bitmap.value
        for batch in batches:
            body = [b.translate(None, SPACES) for b in text_bytes(batch.column(2))]
            key = [digest(b) for b in body]
            at = np.fromiter((xxhash.xxh64_intdigest(k.encode(), 42) & mask for k in key), np.int64, len(key))
            take = np.flatnonzero((bits[at >> 6] >> (at & 63)) & 1)
            for part in np.array_split(take, max(1, len(take) // 1000)):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(part)), batch.column(1).take(pa.array(part)),
                     pa.array([key[i] for i in part], pa.string()), pa.array([body[i] for i in part], pa.binary())],
                    names=[FILE, ROW, "digest", "body"])

    return docs.select(*LOCATOR, F.col(text_col).alias("text")).mapInArrow(
        emit, f"{FILE} string, {ROW} long, digest string, body binary")


def collisions(members: DataFrame) -> DataFrame:
    """Digests whose rows do not all have the same bytes."""
    return (members.groupBy("digest").agg(F.min("body").alias("least"), F.max("body").alias("greatest"))
            .where("least != greatest").select("digest"))


def decisions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Digest = sha256_hex) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, digest and the row's locator.

    Equal means: the same bytes after deleting white space `[\\x20\\x09-\\x0D]`; null texts are empty texts and
    equal to texts of white space only. Exactly one row of a group is kept, also where ids repeat or are null.
    An empty table gives an empty result. Other columns of docs, of any name, are not touched.
    """
    spark = docs.sparkSession
    docs = located(docs)
    log, state = scratch(spark, "dedup-log"), scratch(spark, "dedup-state")
    arrivals(docs, id_col, text_col, digest).write.parquet(log)
    rows = spark.read.schema(LOG).parquet(log)
    groups = save(absorb(spark, log, state), "dedup-groups")
    members = bodies(docs, groups.where("size > 1"), text_col, digest)
    unequal = save(collisions(members), "dedup-collisions")
    result = _decide(rows, groups)
    if unequal.isEmpty():
        return result
    order = F.struct((-F.col("n_chars")).alias("o"), F.col("doc_id").isNull().alias("n"), "doc_id", *LOCATOR)
    exact = members.join(unequal, "digest").withColumn("part", F.sha2("body", 512)).join(rows.drop("digest"), LOCATOR)
    exact = save(exact, "dedup-exact")
    parts = exact.groupBy("digest", "body").agg(F.count(F.lit(1)).alias("size"), F.min(order).alias("keep"))
    redone = exact.join(parts, ["digest", "body"])
    return result.join(unequal, "digest", "left_anti").unionByName(_kept(redone).select(result.columns))


def _kept(df: DataFrame) -> DataFrame:
    same = F.col(FILE).eqNullSafe(F.col(f"keep.{FILE}")) & F.col(ROW).eqNullSafe(F.col(f"keep.{ROW}"))
    return df.select("doc_id", F.col("keep.doc_id").alias("keep_id"), F.col("size").alias("group_size"),
                     same.alias("kept"), "digest", *LOCATOR)


def _decide(rows: DataFrame, groups: DataFrame) -> DataFrame:
    return _kept(lookup(rows, groups, "digest", "size"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that repeat another row's text; columns unchanged."""
    docs = located(docs)
    return drop_rows(docs, decisions(docs, id_col, text_col).where("not kept"))
