"""Rows of counts as bytes, and the fit over them, against a dense solver."""

import numpy as np
from pyspark.sql import functions as F

from curatrix.operators import compact as C
from curatrix.operators import models as MO
from curatrix.operators import ngrams as N


def made(spark, n=60):
    rng = np.random.default_rng(3)
    words = ["abra", "cadab", "sim", "sala", "bim", "hokus", "pokus", "x" * 300]
    rows = [(i, " ".join(words[k] for k in rng.integers(0, 8 if i % 9 == 0 else 7, 1 + i % 5)) if i % 11 else "", int(i % 3 == 0 or i % 7 == 1)) for i in range(n)]
    return rows, spark.createDataFrame(rows, "id long, text string, label int").repartition(3)


def plain(rows, terms):
    x = np.zeros((len(rows), len(terms)))
    for i, text, _ in rows:
        for r in terms:
            x[i, r["ix"]] = r["idf"] * sum(text[a:a + len(r["term"])] == r["term"] for a in range(len(text)))
    length = np.sqrt((x * x).sum(1, keepdims=True))
    return x / np.where(length > 0, length, 1)


def newton(x, y, weight):
    full, w = np.column_stack([x, np.ones(len(x))]), np.zeros(x.shape[1] + 1)
    penalty = np.append(np.ones(x.shape[1]), 0.0)
    for _ in range(50):
        p = 1 / (1 + np.exp(-full @ w))
        w -= np.linalg.solve((full.T * (weight * p * (1 - p))) @ full + np.diag(penalty + 1e-12), full.T @ (weight * (p - y)) + penalty * w)
    return w


def test_bytes_hold_wide_gaps_and_counts(spark, monkeypatch):
    monkeypatch.setattr(C, "ENTRIES_AT_ONCE", 40)
    _, df = made(spark)
    terms = N.number_terms(N.text_vocab(df, "text"), df.count()).withColumn("ix", F.col("ix") * 97).persist()
    batches = C.compact_counts(df.withColumn("label", F.col("id")), "label", "text", terms).toArrow().to_batches()
    got = {}
    for batch in batches:
        for lo, hi, starts, ix, tf in C._opened(batch):
            for k in range(hi - lo):
                got[batch.column("label")[lo + k].as_py()] = (ix[starts[k]:starts[k + 1]].tolist(), tf[starts[k]:starts[k + 1]].tolist())
    want = {r["id"]: (r["ix"], r["tf"]) for r in MO.term_counts(df, ["id"], "text", terms).collect()}
    assert got == want and max(t for _, tf in got.values() for t in tf) > C.WIDE


def test_fit_is_the_penalised_optimum(spark, monkeypatch):
    rows, df = made(spark)
    y = np.array([r[2] for r in rows], float)
    weight = np.where(y == 1, len(y) / 2 / y.sum(), len(y) / 2 / (1 - y).sum())
    for summed, slice_ in ((C.SUMMED, C.SLICE), (0, 100)):
        monkeypatch.setattr(C, "SUMMED", summed)
        monkeypatch.setattr(C, "SLICE", slice_)
        model = MO.fit_kmer(df, "text")
        terms = model.terms.collect()
        want = newton(plain(rows, terms), y, weight)
        assert all(abs(r["weight"] - want[r["ix"]]) < 2e-3 for r in terms) and abs(model.intercept - want[-1]) < 2e-3


def test_rows_of_a_fit_are_a_few_bytes(spark, monkeypatch):
    """A sparse vector takes 12 bytes for each entry."""
    kept = []
    monkeypatch.setattr(MO, "compact_counts", lambda *a, plain=C.compact_counts: kept.append(plain(*a)) or kept[-1])
    _, df = made(spark)
    MO.fit_kmer(df, "text")
    held = kept[0].agg(F.sum(sum(F.octet_length(c) for c in C.BYTES)).alias("b"), F.sum(F.octet_length("gaps")).alias("n")).first()
    assert held["b"] < 3 * held["n"]


def test_one_class_and_odd_labels(spark):
    _, df = made(spark)
    one = MO.fit_kmer(df.withColumn("label", F.lit(1)), "text")
    assert MO.score(df, one).agg(F.min("score")).first()[0] > 0.9
    for odd in (df.limit(0), df.withColumn("label", F.lit(None).cast("int")), df.withColumn("label", F.col("label") + 1)):
        try:
            MO.fit_kmer(odd, "text")
            raise AssertionError("odd labels were fitted on")
        except ValueError:
            pass
