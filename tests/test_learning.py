"""Models and splits."""

import numpy as np
from pyspark.sql import functions as F

from curatrix.operators import clusters as CL
from curatrix.operators import models as MO
from curatrix.operators import ngrams as N
from curatrix.operators import splits as SP
from curatrix.sources.sinks import load_or_fit

WORDS = ["qvqlves", "evqllesgg", "divmtqs", "eivltqs", "gggasd", "ywtfr"]


def texts(spark, n=120):
    rows = [(i, f"{WORDS[i % 6]} {WORDS[(i * 5 + 1) % 4]} {i % 9}", int(i % 6 < 2 or i % 13 == 0), f"g{i % 7}") for i in range(n)]
    return spark.createDataFrame(rows, "id long, text string, label int, source string")


def test_fit_reaches_the_penalised_optimum(spark):
    df = texts(spark)
    features = MO.kmer_vectors(df, "id", "text").join(df.select("id", "label"), "id").select("label", "features")
    fitted = MO.fit_logreg(features)
    assert MO.gradient_norm(fitted, features) < 1e-3
    assert fitted.summary.totalIterations < 100
    length = features.select(F.aggregate(MO.vector_to_array("features"), F.lit(0.0), lambda a, x: a + x * x).alias("n")).collect()
    assert all(abs(r["n"] - 1) < 1e-9 for r in length)


def test_scores_are_those_of_the_fitted_vectors(spark):
    df = texts(spark)
    vectors = MO.kmer_vectors(df, "id", "text").join(df.select("id", "label"), "id")
    want = {r["id"]: r["score"] for r in MO.score(vectors, MO.fit_logreg(vectors.select("label", "features"))).select("id", "score").collect()}
    for dense_terms in (0, MO.DENSE_TERMS):
        model = MO.fit_kmer(df, "text", dense_terms=dense_terms)
        got = {r["id"]: r["score"] for r in MO.score(df, model).collect()}
        assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 2e-3 for i in want)
    unseen = MO.score(spark.createDataFrame([(1, "zz"), (2, None)], "id long, text string"), model).collect()
    base = 1 / (1 + np.exp(-model.intercept))
    assert all(abs(r["score"] - base) < 1e-9 for r in unseen)


def test_saved_model_gives_the_same_scores(spark, tmp_path):
    df = texts(spark)
    model, loaded = load_or_fit(str(tmp_path / "m"), df, lambda rows: MO.fit_kmer(rows, "text"))
    again, found = load_or_fit(str(tmp_path / "m"), df, lambda rows: MO.fit_kmer(rows, "text"))
    assert (loaded, found) == (False, True)
    one, two = ({r["id"]: r["score"] for r in MO.score(df, m).collect()} for m in (model, again))
    assert one.keys() == two.keys() and all(abs(one[i] - two[i]) < 1e-12 for i in one)


def test_a_vocabulary_beyond_a_million_terms_is_kept_whole(spark):
    """Two rows each hold the same letters in random order: every window of both counts."""
    rng = np.random.default_rng(1)
    letters = "".join(chr(0x4E00 + c) for c in rng.integers(0, 8000, 400_000))
    df = spark.createDataFrame([(0, letters), (1, letters)], "id long, text string")
    terms = N.number_terms(N.text_vocab(df, "text"), 2)
    want = len({letters[i:i + n] for n in (3, 4, 5) for i in range(len(letters) - n + 1)})
    assert want > 1 << 20 and terms.count() == want
    rows = N.tfidf_rows(df, "id", "text", terms).select("id", F.size("ix").alias("n")).collect()
    assert {r["n"] for r in rows} == {want}


def test_fold_models_equal_fresh_fits(spark):
    df = texts(spark)
    shared = MO.leave_out(df, "id", "text", "label", "source", ["g1", "g4"])
    got = {r["id"]: r["score"] for r in shared.collect()}
    for group in ("g1", "g4"):
        model = MO.fit_kmer(df.filter(F.col("source") != group), "text")
        for r in MO.score(df.filter(F.col("source") == group), model).collect():
            assert abs(got[r["id"]] - r["score"]) < 2e-3


def test_group_split_and_folds(spark):
    df = texts(spark)
    split, seed = SP.group_split(df, "source", "label")
    report = {r["side"]: r for r in SP.split_report(split, "side", "label", "source").collect()}
    assert report["test"]["group_overlap"] == 0 and report["test"]["groups"] == 2 and seed >= 42
    folds = SP.assign_folds(df, "source", "label", 3)
    assert folds.groupBy("source").agg(F.count_distinct("fold").alias("n")).filter("n > 1").count() == 0
    assert folds.count() == 120 and folds.select("fold").distinct().count() == 3
    try:
        SP.group_split(df.withColumn("source", F.lit("one")), "source", "label", attempts=2)
        raise AssertionError("one group was split")
    except ValueError:
        pass
    inner, method = SP.inner_split(df.withColumn("source", F.lit("one")), "id", "source", "label")
    assert method == "random_stratified_fallback" and inner.filter("side = 'test'").count() in (18, 19)


def test_folds_keep_skipped_groups(spark):
    folds = SP.logo_folds(texts(spark), "source", "label", min_rows=18, min_class=5)
    reasons = {r["fold"]: r["reason"] for r in folds.collect()}
    assert len(reasons) == 7 and reasons["g6"] == "too_few_test_rows"


def test_cluster_rules(spark):
    assert [CL.cluster_count(n) for n in (10, 2700, 3300, 10**7)] == [4, 4, 6, 12]
    rng = np.random.default_rng(0)
    points = np.concatenate([rng.normal(c, 0.1, size=(30, 4)) for c in (0, 5, 10, 15)])
    df = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "id long, embedding array<double>")
    found = CL.cluster(CL.scaled_vectors(df), starts=3)
    assert found.groupBy("cluster_id").count().filter("count = 30").count() == 4
    width = CL.silhouette(found).first()
    assert width["silhouette"] > 0.9 and width["rows"] == 120
    matrix = np.array(points)
    scaled = (matrix - matrix.mean(0)) / matrix.std(0, ddof=1)
    own = {r["id"]: (r["sv1"], r["sv2"]) for r in CL.reduce_svd(CL.scaled_vectors(df), "id").collect()}
    _, _, right = np.linalg.svd(scaled, full_matrices=False)
    want = scaled @ right[:2].T
    assert all(abs(abs(own[i][0]) - abs(want[i][0])) < 1e-6 for i in own)
