import math
import random

from pyspark.sql import functions as F

from curatrix.llm import negatives

SCHEMA = "vec_id long, embedding array<double>, label int, id string, key string"


def brute(rows, step, n_positive=5, n_negative=3):
    fit = []
    for k, v, label, *_ in rows:
        if k is None or label is None or v is None or any(x is None or not math.isfinite(x * 256) for x in v):
            continue
        fit.append((k, [math.floor(256 * x) for x in v], label))
    out = []
    for k, v, label in fit:
        if k % step:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j, m) for j, w, m in fit if j != k)
        for s, j, m in [x for x in scored if x[2] == label][:n_positive]:
            found = [x for x in scored if x[2] != label and 50 * -s <= 100 * -x[0] <= 95 * -s][:n_negative]
            out += [(k, j, r + 1, x[1], -s, -x[0]) for r, x in enumerate(found)]
    return sorted(out)


def mined(spark, rows, step):
    df = negatives.mine(negatives.participants(spark.createDataFrame(rows, SCHEMA)), F.col("id") % step == 0)
    return sorted(tuple(r[c] for c in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))
                  for r in df.collect())


def row(k, v, label):
    return k, v, label, "x", "y"


def test_random_vectors(spark):
    draw = random.Random(5)
    for dims in (1, 3, 24):
        rows = [row(k, [draw.gauss(0, 1) for _ in range(dims)], draw.randrange(4)) for k in range(600)]
        assert mined(spark, rows, 40) == brute(rows, 40)


def test_ties_and_copies(spark):
    draw = random.Random(6)
    hot = [0.5, -0.25, 0.0, 1.0]
    rows = [row(k, hot if k % 3 else [draw.randrange(-2, 3) / 4 for _ in range(4)], k % 2) for k in range(300)]
    assert mined(spark, rows, 15) == brute(rows, 15)


def test_rows_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [row(0, [1.0, 2.0], 1), row(10, [nan, 1.0], 1), row(1, [1.0, inf], 1), row(2, [None, 1.0], 1), row(3, None, 1),
            row(4, [1.0, 1.5], None), row(None, [1.0, 2.0], 1), row(5, [1.0, 1.0], 1), row(6, [0.7, 0.7], 2), row(7, [1e306, 0.0], 2),
            row(8, [], 2), row(9, [1.0], 2), row(20, [0.0, 0.0], 1), row(30, [-1.0, -1.0], 3)]
    got = mined(spark, rows, 10)
    assert got == brute(rows, 10) and got


def test_scores_beyond_doubles(spark):
    draw = random.Random(7)
    rows = [row(k, [draw.uniform(-1, 1) * 2.0 ** draw.randrange(0, 20) for _ in range(5)], k % 3) for k in range(120)]
    assert mined(spark, rows, 6) == brute(rows, 6)


def test_no_rows_and_no_anchors(spark):
    assert mined(spark, [], 5) == []
    assert mined(spark, [row(1, [1.0], 1), row(2, [1.0], 2)], 5) == []


def test_stops_before_the_end():
    import numpy as np

    draw = np.random.default_rng(8)
    lists = negatives.Lists(np.arange(4000), np.floor(256 * draw.normal(size=(4000, 3))))
    read = []
    lists.order = type("Counted", (), {"__getitem__": lambda self, at, o=lists.order: (read.append(o[at].size), o[at])[1]})()
    anchor = np.array([200.0, -100.0, 50.0])
    [(places, scores)] = lists.search(anchor, [(None, None)], 5, np.ones(4000, bool))
    every = lists.vectors @ anchor
    assert sorted(-scores) == sorted(-every)[:5] and sum(read) < 3 * 4000
