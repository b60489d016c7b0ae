"""Sharded logistic regressions against NumPy on dense matrices."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from curatrix.operators.sharded import ManyLogistic

TERMS, ROWS = 230, 90


def made(spark, seed=3):
    """Sparse counts with a third of all entries on a few common terms; one row without terms."""
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(ROWS):
        common = rng.choice(6, 3, replace=False)
        rare = rng.choice(np.arange(6, TERMS), 9, replace=False)
        ix = np.unique(np.concatenate([common, rare])) if i else np.zeros(0, int)
        label = int(rng.random() < 0.3 + 0.4 * (0 in ix))
        rows.append((i, label, f"g{i % 4}", [int(x) for x in ix], [int(x) for x in rng.integers(1, 5, len(ix))]))
    return rows, spark.createDataFrame(rows, "id long, label int, source string, ix array<int>, tf array<long>")


def dense(rows, train, min_df, max_terms=None):
    """Matrix of all rows under the document frequencies of the training rows; class weights."""
    tf = np.zeros((len(rows), TERMS))
    for i, r in enumerate(rows):
        tf[i, r[3]] = r[4]
    df, total = (tf[train] > 0).sum(0), tf[train].sum(0)
    keep = df >= min_df
    if max_terms:
        best = sorted(np.flatnonzero(keep), key=lambda j: (-total[j], j))[:max_terms]
        keep = np.isin(np.arange(TERMS), best)
    idf = np.where(keep, np.log((1 + len(train)) / (1 + df)) + 1, 0)
    x = tf * idf
    norms = np.sqrt((x * x).sum(1, keepdims=True))
    y = np.array([r[1] for r in rows])
    weights = np.array([len(train) / (2 * (y[train] == v).sum()) for v in y])
    return x / np.where(norms > 0, norms, 1), y, weights


def newton(x, y, weights, c=1.0):
    design = np.hstack([x, np.ones((len(x), 1))])
    ridge = np.diag([1 / c] * x.shape[1] + [1e-12])
    w = np.zeros(design.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-design @ w))
        step = np.linalg.solve(design.T @ (design * (weights * p * (1 - p))[:, None]) + ridge, design.T @ (weights * (p - y)) + ridge @ w)
        w -= step
    return w


@pytest.mark.parametrize("bounds", [{}, {"size": 16, "entries": 60, "fan_in": 6}])
def test_models_reach_the_optimum_of_a_dense_solver(spark, bounds):
    rows, df = made(spark)
    uses = [F.lit(True), F.col("source") != "g1", (F.col("source") != "g2") & (F.col("id") > 5)]
    many = ManyLogistic(df.repartition(3), "label", uses, TERMS, ["id"], 2, **bounds)
    fit = many.fit(tol=1e-6)
    got = {r["id"]: r["scores"] for r in many.scores(fit).collect()}
    table = [{r["ix"]: (r["idf"], r["weight"]) for r in fit.terms(m).collect()} for m in range(3)]
    free = fit.intercepts()
    many.release()
    assert sorted(got) == list(range(ROWS)) and fit.steps < 80 and max(fit.gradient) < 1e-6
    trains = [[i for i, r in enumerate(rows) if ok(r)] for ok in
              (lambda r: True, lambda r: r[2] != "g1", lambda r: r[2] != "g2" and r[0] > 5)]
    for m, train in enumerate(trains):
        x, y, weights = dense(rows, train, 2)
        want = newton(x[train], y[train], weights[train])
        p = 1 / (1 + np.exp(-(x @ want[:-1] + want[-1])))
        assert all(abs(got[i][m] - p[i]) < 1e-5 for i in got)
        assert abs(free[m] - want[-1]) < 1e-4
        assert all(abs(table[m][j][1] - want[j]) < 1e-4 for j in table[m])


def test_most_frequent_terms_of_each_model(spark):
    rows, df = made(spark, 4)
    many = ManyLogistic(df, "label", [F.lit(True), F.col("source") == "g0"], TERMS, ["id"], 2, 20, size=32)
    fit = many.fit(tol=1e-6)
    kept = [{r["ix"] for r in fit.terms(m).filter("idf > 0").collect()} for m in range(2)]
    got = {r["id"]: r["scores"] for r in many.scores(fit).collect()}
    many.release()
    for m, train in enumerate([list(range(ROWS)), [i for i in range(ROWS) if rows[i][2] == "g0"]]):
        x, y, weights = dense(rows, train, 2, 20)
        assert kept[m] == set(np.flatnonzero(np.abs(x).sum(0))) and len(kept[m]) <= 20
        want = newton(x[train], y[train], weights[train])
        p = 1 / (1 + np.exp(-(x @ want[:-1] + want[-1])))
        assert all(abs(got[i][m] - p[i]) < 1e-5 for i in got)


def test_one_class_null_labels_and_no_rows(spark):
    rows, df = made(spark)
    nulls = df.withColumn("label", F.when(F.col("id") % 7 != 0, F.col("label")))
    many = ManyLogistic(nulls, "label", [F.lit(True), F.col("label") == 1, F.lit(None).cast("boolean")], TERMS, ["id"], 1)
    got = {r["id"]: r["scores"] for r in many.scores(many.fit()).collect()}
    many.release()
    assert len(got) == ROWS and all(s[2] == 0.5 for s in got.values())
    train = [i for i in range(ROWS) if i % 7]
    x, y, weights = dense(rows, train, 1)
    want = newton(x[train], y[train], weights[train])
    assert all(abs(got[i][0] - 1 / (1 + np.exp(-(x[i] @ want[:-1] + want[-1])))) < 2e-3 for i in train)
    none = ManyLogistic(df.limit(0), "label", [F.lit(True)], TERMS, ["id"])
    assert none.scores(none.fit()).count() == 0
    none.release()
