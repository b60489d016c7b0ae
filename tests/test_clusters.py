"""k-means of many starts and the Euclidean silhouette against NumPy."""

from functools import partial

import numpy as np
import pytest
from pyspark.sql import functions as F

from curatrix.operators import clusters as CL


def frame(spark, points, clusters=None):
    rows = [(i, p.tolist(), None if clusters is None else clusters[i]) for i, p in enumerate(points)]
    return CL.as_vector(spark.createDataFrame(rows, "id long, embedding array<double>, c int").repartition(4)).withColumnRenamed("_v", "features")


def blobs(seed=0, per=40, width=4, centers=(0, 5, 10, 15, 20)):
    rng = np.random.default_rng(seed)
    return np.concatenate([rng.normal(c, 0.6, size=(per, width)) for c in centers])


def test_means_rows_and_costs(spark):
    points = blobs()
    df = frame(spark, points)
    fit = CL.best_kmeans(df, 5, starts=6)
    assert len(fit.costs) == 6 and fit.cost == min(fit.costs) and fit.steps < 40
    placed = {r["id"]: r["cluster_id"] for r in CL.assign(df, fit.centers).collect()}
    far = ((points[:, None] - fit.centers[None]) ** 2).sum(-1)
    assert all(placed[i] == far[i].argmin() for i in placed)
    assert abs(far.min(axis=1).sum() - fit.cost) < 1e-6
    own = np.array([placed[i] for i in range(len(points))])
    assert sorted(np.bincount(own)) == [40] * 5
    for k in range(5):
        assert np.allclose(points[own == k].mean(0), fit.centers[k], atol=1e-6)
    again = CL.best_kmeans(df.repartition(2), 5, starts=6)
    assert np.allclose(sorted(again.costs), sorted(fit.costs))


def test_copies_and_more_clusters_than_rows(spark):
    points = np.array([[1.0, 2.0]] * 30 + [[4.0, 4.0]] * 3)
    fit = CL.best_kmeans(frame(spark, points), 4, starts=2)
    assert fit.cost < 1e-9 and CL.assign(frame(spark, points), fit.centers).select("cluster_id").distinct().count() == 2
    with pytest.raises(ValueError):
        CL.best_kmeans(frame(spark, points).limit(0), 2)


def brute(points, own):
    far = np.sqrt(((points[:, None] - points[None]) ** 2).sum(-1))
    out = []
    for i, c in enumerate(own):
        size = (own == c).sum()
        a = far[i, own == c].sum() / max(1, size - 1)
        b = min(far[i, own == k].mean() for k in set(own.tolist()) - {c})
        out.append(0.0 if size == 1 else (b - a) / max(a, b))
    return np.array(out)


def test_silhouette_of_all_rows_and_of_a_sample(spark):
    rng = np.random.default_rng(3)
    points = rng.normal(size=(130, 3))
    own = rng.integers(0, 4, 130)
    own[0] = 9  # alone in its cluster
    df = frame(spark, points, own.tolist())
    want = brute(points, own)
    got = CL.silhouette(df, "c", sample=None).first()
    assert abs(got["silhouette"] - want.mean()) < 1e-6 and got["rows"] == 130
    some = CL.silhouette(df, "c", sample=60).first()
    assert some["rows"] == 60 and abs(some["silhouette"] - want.mean()) < 0.1
    one = CL.silhouette(df.withColumn("c", F.lit(1)), "c").first()
    assert (one["silhouette"], one["rows"]) == (0.0, 130)
    nulls = df.withColumn("c", F.when(F.col("id") >= 10, F.col("c")))
    assert CL.silhouette(nulls, "c", sample=None).first()["rows"] == 120


def test_silhouette_meets_groups_of_blocks_and_hands_over_no_pairs(spark, monkeypatch):
    """Joined pairs of blocks were handed to Python; now a task gets each block of its two groups once."""
    rng = np.random.default_rng(8)
    points, own = rng.normal(size=(140, 3)), rng.integers(0, 3, 140)
    monkeypatch.setattr(CL, "pack_dense", partial(CL.pack_dense, rows=8))
    monkeypatch.setattr(CL, "GROUP_PIECES", 3, raising=False)
    found = CL.silhouette(frame(spark, points, own.tolist()), "c", sample=None)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "CoGroup" in plan
    got = found.first()
    assert abs(got["silhouette"] - brute(points, own).mean()) < 1e-6 and got["rows"] == 140
