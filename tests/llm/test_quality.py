"""Compression classifier: held-out accuracy, what it may learn from, and odd inputs."""

import zlib

import pytest
from pyspark.sql import functions as F

from curatrix.llm import quality


@pytest.fixture(scope="module")
def tables(spark):
    folder = "/root/testdata/sf0.01"
    return spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")


def test_held_out_rule(spark):
    rows = spark.createDataFrame([(i,) for i in [*range(50), None]], "doc_id long").select("doc_id", quality.held_out().alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(("" if r["doc_id"] is None else str(r["doc_id"])).encode()) % 5 == 0) for r in rows)


def test_held_out_accuracy_and_no_leak(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    model = quality.fit(docs, labels.where(~quality.held_out()))
    turned = labels.withColumn("quality", F.when(quality.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert quality.fit(docs, turned.where(~quality.held_out())) == model
    rows = quality.score(docs, model).join(labels.where(quality.held_out()), "doc_id").select("score", "quality").collect()
    good = [r["score"] for r in rows if r["quality"] == 1]
    bad = [r["score"] for r in rows if r["quality"] == 0]
    assert sum((g > b) + (g == b) / 2 for g in good for b in bad) / (len(good) * len(bad)) > 0.95
    assert sum(g >= 0.3 for g in good) / len(good) > 0.98
    assert sum(b < 0.3 for b in bad) / len(bad) > 0.85


def test_odd_texts(spark, tables):
    docs, labels = tables
    model = quality.fit(docs, labels)
    rows = [(1, None, "x"), (2, "", "y"), (3, "a", None), (4, "word " * 100_000, "z"), (4, "a", "z"), (None, "a", "z")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, difference string")
    got = quality.score(frame, model).collect()
    assert len(got) == 6 and all(0 <= r["score"] <= 1 for r in got)
    assert {r["score"] for r in got if not r["text"]} == {model.prior}
    assert len({r["score"] for r in got if r["text"] == "a"}) == 1
    assert got[3]["score"] < 0.3


def test_empty_tables_and_one_class(spark, tables):
    docs, labels = tables
    none = quality.fit(docs, labels.limit(0))
    assert none.prior == 0.5 and quality.score(docs.limit(0), none).count() == 0
    one = quality.fit(docs, labels.where("quality = 1"))
    assert {r["score"] for r in quality.score(docs.limit(5), one).collect()} == {1.0}
    assert quality.keep_good(docs, labels.limit(0)).count() == docs.count()


def test_keep_good_keeps_columns(spark, tables):
    docs, labels = tables
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns
    assert 0 < kept.count() < docs.count()


def test_few_texts_of_a_class(spark):
    folder = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    model = quality.fit(docs, labels.where(~quality.held_out()))
    rows = quality.score(docs, model).join(labels.where(quality.held_out()), "doc_id").select("score", "quality").collect()
    good, bad = ([r["score"] for r in rows if r["quality"] == y] for y in (1, 0))
    assert len({r["score"] for r in rows}) > 5 and sum(s >= 0.3 for s in good) >= 0.9 * len(good)
    assert sum(b < g for b in bad for g in good) > 0.7 * len(bad) * len(good)


def test_one_text_of_a_class_and_a_column_named_score(spark):
    rows = [(1, "zzz qqq " * 50, 0.5), (2, "a plain sentence of good words", 0.1), (3, "zzz qqq zzz", 0.0), (4, "good words of a plain kind", 0.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, 0), (2, 1)], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in quality.score(docs, quality.fit(docs, labels)).collect()}
    assert list(got[1].asDict()) == ["doc_id", "text", "score"] and len({r["score"] for r in got.values()}) > 1
    assert all(0 <= r["score"] <= 1 for r in got.values())
