import itertools

import numpy as np
from pyspark.sql import functions as F

from curatrix.operators import metrics as M


def rows(spark):
    rng = np.random.default_rng(3)
    y = rng.integers(0, 2, 300)
    s = np.round(rng.random(300) * 0.6 + y * 0.3, 1)
    return y, s, spark.createDataFrame([(int(a), float(b), i) for i, (a, b) in enumerate(zip(y, s))], "y int, s double, i int")


def test_ranking_metrics_with_ties(spark):
    y, s, df = rows(spark)
    wins = [1.0 if a > b else 0.5 if a == b else 0.0 for a, b in itertools.product(s[y == 1], s[y == 0])]
    ap, seen = 0.0, 0
    for t in sorted(set(s), reverse=True):
        at = (y[s == t] == 1).sum()
        seen += at
        ap += at / (y == 1).sum() * seen / (s >= t).sum()
    got = M.ranking_metrics(df, "y", "s").first()
    assert abs(got["roc_auc"] - np.mean(wins)) < 1e-12 and abs(got["average_precision"] - ap) < 1e-12
    assert M.roc_auc(df.filter("y = 1"), "y", "s").first()["roc_auc"] is None


def test_calibration_keeps_empty_bins(spark):
    df = spark.createDataFrame([(0, 0.0), (1, 0.1), (1, 1.0)], "y int, s double")
    bins = {r["bin"]: r for r in M.calibration(df, "y", "s").collect()}
    assert len(bins) == 10 and bins[9]["count"] == 1 and bins[5]["count"] == 0 and bins[5]["observed"] is None
    assert bins[0]["count"] == 1 and bins[1]["count"] == 1


def test_topk_and_threshold(spark):
    y, s, df = rows(spark)
    assert [r["k"] for r in M.topk_precision(df, "y", "s", "i", [10, 1000]).collect()] == [10]
    clipped = {r["k"]: r["selected_count"] for r in M.topk_enrichment(df, "y", "s", "i", [10, 1000], "clip").collect()}
    assert clipped == {10: 10, 1000: 300}
    best = M.best_threshold(M.threshold_sweep(df, "y", "s")).first()
    assert best["rule"] in (1, 2, 3)
    one = M.classification_metrics(df.withColumn("p", F.lit(0)), "y", "p").first()
    assert one["precision"] == 0.0 and one["f1"] == 0.0


def test_nested_metrics_down_to_the_deepest_object(spark):
    from curatrix.operators.metric_trees import flatten_metrics

    text = '{"roc_auc": 0.9, "a": [{"b": {"pr_auc": {"mean": "0.5"}}}, 3], "majority": {"roc_auc": 1}, "c": {"average_precision": null}, "d": {}}'
    rows = spark.createDataFrame([("x", text), ("y", None), ("z", "[]"), ("w", '{"q": 1}')], "name string, json string")
    got = sorted((r["name"], r["path"], r["roc_auc"], r["pr_auc"]) for r in flatten_metrics(rows, "name", "json").collect())
    assert got == [("x", "", 0.9, None), ("x", "a.0.b", None, 0.5)]
    assert flatten_metrics(rows.limit(0), "name", "json").count() == 0
