"""Stream deduplication against grouping in Python."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from curatrix.llm import exact_dedup
from curatrix.llm.common import scratch

SCHEMA = "doc_id long, text string, digest string, size long, keep string"
LONG = "word " * 60_000
ROWS = [
    (1, "a b", "x", 1, "k"), (2, "ab", "x", 1, None), (3, "a  b", None, 1, "k"), (4, "a\tb\n", "x", 1, "k"),
    (5, None, "x", 1, "k"), (6, "", "x", None, "k"), (7, " \x0b\x0c\r", "x", 1, "k"), (8, "a b", "x", 1, "k"),
    (9, "same", "x", 1, "k"), (9, "same", "x", 1, "k"), (None, "same", "x", 1, "k"), (None, "only null", "x", 1, "k"),
    (None, "only null", "x", 1, "k"), (10, "É b", "x", 1, "k"), (11, "Éb", "x", 1, "k"), (12, LONG, "x", 1, "k"),
    (13, LONG + " ", "x", 1, "k"), (14, "A b", "x", 1, "k"),
]


def body(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


def expected(rows):
    groups = {}
    for row in rows:
        groups.setdefault(body(row[1]), []).append(row)
    out = {}
    for key, members in groups.items():
        best = min(members, key=lambda r: (-len(r[1] or ""), r[0] is None, r[0] or 0))
        out[key] = (best[0], len(members))
    return out


def check(rows, frame):
    want = expected(rows)
    text_of = {hashlib.sha256(k.encode()).hexdigest()[:n]: k for k in want for n in (64,)}
    seen = {}
    for r in frame.collect():
        key = text_of[r["digest"]]
        assert (r["keep_id"], r["group_size"]) == want[key]
        seen.setdefault(key, []).append((r["doc_id"], r["kept"]))
    assert set(seen) == set(want)
    for key, members in seen.items():
        assert len(members) == want[key][1]
        assert [i for i, kept in members if kept] == [want[key][0]]


def test_decisions(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA).repartition(5)
    check(ROWS, exact_dedup.decisions(docs))


def test_columns_stay(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    kept = exact_dedup.deduplicate(docs)
    assert kept.columns == docs.columns
    assert sorted(body(r["text"]) for r in kept.collect()) == sorted(expected(ROWS))


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert exact_dedup.decisions(docs).count() == 0
    assert exact_dedup.deduplicate(docs).count() == 0


def test_full_bytes_decide_when_digests_collide(spark):
    def weak(b):
        return str(len(b) % 3)

    rows = [(i, t, None, None, None) for i, t in enumerate(["abc", "a bc", "abd", "x", "", "xyzw", "xyzw ", None, "abc"])]
    got = exact_dedup.decisions(spark.createDataFrame(rows, SCHEMA), digest=weak)
    want = expected(rows)
    texts = {r[0]: body(r[1]) for r in rows}
    result = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in got.collect()}
    assert result == {i: (*want[t], want[t][0] == i) for i, t in texts.items()}


def test_state_lasts_over_waves_of_files(spark):
    log, state = scratch(spark, "log"), scratch(spark, "state")

    def wave(rows):
        frame = spark.createDataFrame([(i, "f", i, len(t), exact_dedup.sha256_hex(t.encode())) for i, t in rows], exact_dedup.LOG)
        frame.coalesce(1).write.mode("append").parquet(log)
        return {r["digest"]: (r["size"], r["keep"]["doc_id"]) for r in exact_dedup.absorb(spark, log, state, 1).collect()}

    one, two = (exact_dedup.sha256_hex(t.encode()) for t in ("one", "two"))
    assert wave([(5, "one"), (6, "two")]) == {one: (1, 5), two: (1, 6)}
    assert wave([(4, "one"), (7, "one")]) == {one: (3, 4), two: (1, 6)}
    assert wave([(8, "two")]) == {one: (3, 4), two: (2, 6)}


def test_hot_group_of_a_third(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("text"))
    rows = exact_dedup.decisions(docs)
    assert rows.where("kept").count() == 2001
    assert rows.where("group_size = 1000 and keep_id = 0").count() == 1000


@pytest.mark.parametrize("text", ["", " ", "a b"])
def test_digest_is_of_the_text_without_ascii_space(spark, text):
    row = exact_dedup.decisions(spark.createDataFrame([(1, text, None, None, None)], SCHEMA)).first()
    assert row["digest"] == hashlib.sha256(body(text).encode()).hexdigest()


def test_frames_that_multiply_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    bodies = {body(r["text"]) for r in docs.collect()}
    twice = docs.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    for frame in (twice, docs.join(twice.select("doc_id", "copy"), "doc_id"), docs.unionByName(docs)):
        kept = exact_dedup.deduplicate(frame).collect()
        assert len(kept) == len(bodies) and {body(r["text"]) for r in kept} == bodies
        assert exact_dedup.decisions(frame).count() == 2 * docs.count()
