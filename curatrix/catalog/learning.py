"""J, K, L and O: n-grams, models, splits and clusters."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curatrix.catalog.base import RECORDS, SEQUENCES, Tables, query, rounded
from curatrix.catalog.rows import BINS_SQL, binned
from curatrix.catalog.scans import scratch
from curatrix.lineage import cut_lineage, side_by_side
from curatrix.operators import clusters as CL
from curatrix.operators import features as FE
from curatrix.operators import models as MO
from curatrix.operators import network as NN
from curatrix.operators import ngrams as N
from curatrix.operators import splits as SP
from curatrix.operators.low_rank import Svd, truncated_svd
from curatrix.operators.metrics import full_metrics
from curatrix.operators.sharded import ManyLogistic
from curatrix.plans.shortlist import retrieval_scorer
from curatrix.sources.sinks import load_or_fit, save_model
from curatrix.sources.tables import union_parts

W = "WITH "


def grams_sql(name: str, source: str) -> str:
    """CTEs for counted 3- to 5-grams of (id, text) rows: {name} has id, term, tf."""
    parts = [f"list_transform(range(1, len(c) - {n - 2}), lambda i: {' || '.join(f'c[i+{j}]' for j in range(n))})" for n in (3, 4, 5)]
    return rf"""{name}_c AS (SELECT id, string_split(regexp_replace(lower(text), '\s\s+', ' ', 'g'), '') AS c FROM ({source})),
{name}_g AS (SELECT id, unnest(list_concat({', '.join(parts)})) AS term FROM {name}_c),
{name} AS (SELECT id, term, count(*) AS tf FROM {name}_g GROUP BY 1, 2)"""


DOCS = grams_sql("g", "SELECT doc_id AS id, text FROM documents")
VOCAB = "v AS (SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS total FROM g GROUP BY 1 HAVING count(*) >= 2)"


@query("j1_char_ngrams", f"{W}{DOCS} SELECT id AS doc_id, count(*) AS terms, CAST(sum(tf) AS BIGINT) AS windows, CAST(max(tf) AS BIGINT) AS most, min(term) AS first_term FROM g GROUP BY 1")
def j1(t: Tables) -> DataFrame:
    return N.summarise_ngrams(N.char_ngrams(t.documents, "doc_id", "text"), "doc_id")


@query("j2_vocabulary", f"{W}{DOCS}, {VOCAB} SELECT length(term) AS n, df, count(*) AS terms, CAST(sum(total) AS BIGINT) AS total FROM v GROUP BY 1, 2")
def j2(t: Tables) -> DataFrame:
    vocab = N.text_vocab(t.documents, "text")
    return vocab.groupBy(F.length("term").alias("n"), "df").agg(F.count("*").alias("terms"), F.sum("total").alias("total"))


@query("j2_vocabulary_capped", f"{W}{DOCS}, {VOCAB} SELECT term, df, total FROM v ORDER BY total DESC, term LIMIT 5000")
def j2_capped(t: Tables) -> DataFrame:
    return N.fit_vocab(N.char_ngrams(t.documents, "doc_id", "text"), 2, 5000)


@query("j3_tfidf_weights", f"""{W}{DOCS}, {VOCAB}, w AS (SELECT id, g.term, tf * (ln((1.0 + n) / (1.0 + df)) + 1) AS w FROM g JOIN v ON g.term = v.term, (SELECT CAST(count(*) AS DOUBLE) AS n FROM documents)),
  u AS (SELECT id, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS weight FROM w)
  SELECT id AS doc_id, count(*) AS terms, round(sum(weight), 5) AS total, round(max(weight), 6) AS top FROM u GROUP BY 1""")
def j3(t: Tables) -> DataFrame:
    docs = t.documents
    weights = N.tfidf(docs, "doc_id", "text", N.text_vocab(docs, "text"), docs.count())
    return weights.groupBy("doc_id").agg(F.count("*").alias("terms"), F.round(F.sum("weight"), 5).alias("total"), F.round(F.max("weight"), 6).alias("top"))


@query("j4_tfidf_vectors", f"""{W}{DOCS}, {VOCAB}, w AS (SELECT id, tf * (ln((1.0 + n) / (1.0 + df)) + 1) AS w FROM g JOIN v ON g.term = v.term, (SELECT CAST(count(*) AS DOUBLE) AS n FROM documents))
  SELECT d.doc_id, count(w.w) AS terms, round(coalesce(max(w) / sqrt(sum(w * w)), 0), 6) AS top FROM documents d LEFT JOIN w ON d.doc_id = w.id GROUP BY 1""")
def j4(t: Tables) -> DataFrame:
    vectors, _ = N.fit_tfidf_rows(t.documents, "doc_id", "text")
    return rounded(vectors.select("doc_id", F.size("ix").cast("long").alias("terms"), F.coalesce(F.array_max("w"), F.lit(0.0)).alias("top")))


@query("j5_standard_scaler", """WITH s AS (SELECT avg(n_chars) AS m, stddev_pop(n_chars) AS s FROM documents WHERE doc_id % 5 <> 0)
  SELECT doc_id, round((n_chars - m) / s, 6) AS n_chars, CAST(0 AS DOUBLE) AS constant FROM documents, s""")
def j5(t: Tables) -> DataFrame:
    df = t.documents.select("doc_id", F.col("n_chars").cast("double").alias("n_chars"), F.lit(3.0).alias("constant"))
    scaler = FE.fit_scaler(df.filter("doc_id % 5 <> 0"), ["n_chars", "constant"])
    return rounded(FE.apply_scaler(df, scaler))


def pair_rows(t: Tables) -> DataFrame:
    """Labelled records: the whole text as the pair, its first line as the heavy-only variant."""
    rows = t.records.filter("label IS NOT NULL")
    return rows.select("row_id", "label", "source", "lang", F.col("text").alias("pair"), "heavy_raw", "light_raw")


VARIANTS_SQL = f"""{RECORDS}, lab AS (SELECT *, text AS pair FROM rec WHERE label IS NOT NULL),
long AS (SELECT 'whole' AS variant, source, pair AS x FROM lab UNION ALL SELECT 'heavy', source, heavy_raw FROM lab UNION ALL SELECT 'paired', source, pair FROM lab WHERE light_raw <> ''
  UNION ALL SELECT 'english', source, pair FROM lab WHERE lang = 'en' AND source = 'src1')"""


def variants() -> dict:
    return {"whole": (F.col("pair"), None), "heavy": (F.col("heavy_raw"), None), "paired": (F.col("pair"), F.col("light_raw") != ""),
            "english": (F.col("pair"), (F.col("lang") == "en") & (F.col("source") == "src1"))}


@query("j9_input_variants", f"""{W}{VARIANTS_SQL}, s AS (SELECT variant, count(*) AS row_count, count(DISTINCT source) AS group_count, CAST(sum(length(x)) AS BIGINT) AS chars FROM long WHERE length(x) > 0 GROUP BY 1)
  SELECT variant, row_count, group_count, CASE WHEN row_count >= 100 AND group_count >= 4 THEN 'available' ELSE 'skipped_too_few_rows_or_groups' END AS status,
  CASE WHEN row_count >= 100 AND group_count >= 4 THEN chars END AS chars FROM s""")
def j9(t: Tables) -> DataFrame:
    long, status = FE.build_variants(pair_rows(t), "row_id", "source", variants(), min_rows=100)
    return status.join(long.groupBy("variant").agg(F.sum(F.length("model_text")).alias("chars")), "variant", "left")


@query("j8_feature_sets")
def j8(t: Tables) -> DataFrame:
    """Six feature sets, fitted on the training side and measured on the other, for a random and a grouped split."""
    rows = t.documents.join(t.labels, "doc_id").select("doc_id", "source", F.col("quality").alias("label"), F.col("n_chars").cast("double").alias("length"),
                                                       F.length(F.split_part("text", F.lit("\n"), F.lit(1))).cast("double").alias("heavy_length"), "text")
    vectors = MO.as_vector(t.embeddings.select(F.col("vec_id").alias("doc_id"), "embedding")).select("doc_id", F.col("_v").alias("embedding_vector"))
    rows = rows.join(vectors, "doc_id")
    blocks = {"kmer": ["kmer_vector"], "embedding": ["embedding_vector"], "simple": ["length", "heavy_length"]}
    jobs = []
    for split, sides in {"random": SP.stratified_split(rows, "doc_id", "label"), "grouped": SP.group_split(rows, "source", "label")[0]}.items():
        sides = cut_lineage(sides.select("doc_id", "label", "side", "length", "heavy_length", "embedding_vector"))
        texts = rows.select("doc_id", "text").join(sides.select("doc_id", "side"), "doc_id")
        kmer = MO.kmer_vectors(texts.select("doc_id", "text"), "doc_id", "text", train=texts.filter("side = 'train'").select("doc_id", "text"))
        joined = cut_lineage(sides.join(kmer.withColumnRenamed("features", "kmer_vector"), "doc_id"))
        jobs += [(split, joined, name) for name in FE.FEATURE_SETS]

    def fit_and_score(job: tuple[str, DataFrame, str]) -> DataFrame:
        split, joined, name = job
        features = FE.feature_set(joined, blocks, name).select("label", "side", "features")
        fitted = MO.fit_logreg(features.filter("side = 'train'").select("label", "features"), penalise_intercept=True)
        scored = MO.score(features.filter("side = 'test'"), fitted)
        return cut_lineage(scored.select(F.lit(split).alias("split"), F.lit(name).alias("feature_set"), "label", "score"))

    table = full_metrics(union_parts(side_by_side(fit_and_score, jobs)), "label", "score", ["split", "feature_set"], min_class=1)
    return rounded(table.select("split", "feature_set", "rows", "roc_auc", "average_precision"), 3)


@query("k1_balanced_logreg")
def k1(t: Tables) -> DataFrame:
    rows = pair_rows(t)
    return rounded(MO.score(rows.select("row_id", "label", "pair"), MO.fit_kmer(rows, "pair"), ["row_id", "label"]), 3)


@query("k1_sliced_optimum", f"""{W}{RECORDS}, {grams_sql('g', 'SELECT row_id AS id, text FROM rec WHERE label IS NOT NULL')}, v AS (SELECT term FROM g GROUP BY 1 HAVING count(*) >= 2)
  SELECT (SELECT count(*) FROM rec WHERE label IS NOT NULL) AS rows, (SELECT count(*) FROM v) AS terms, CAST(0 AS DOUBLE) AS gradient""")
def k1_sliced(t: Tables) -> DataFrame:
    """The fit whose weights stay cut into slices: rows, terms and the length of the gradient where it stops."""
    rows = pair_rows(t)
    terms = cut_lineage(N.number_terms(N.text_vocab(rows, "pair"), rows.count()))
    size = terms.count()
    many = ManyLogistic(MO.term_counts(rows, ["label"], "pair", terms), "label", [F.lit(True)], size)
    try:
        fit = many.fit()
        scored = many.scores(fit).count()
    finally:
        many.release()
    return t.spark.createDataFrame([(scored, size, round(fit.gradient[0], 2) + 0.0)], "rows long, terms long, gradient double")


@query("k2_positive_score")
def k2(t: Tables) -> DataFrame:
    rows = pair_rows(t)
    everyone = t.records.select("row_id", F.col("text").alias("pair"))
    return rounded(MO.score(everyone, MO.fit_kmer(rows, "pair"), ["row_id"]), 3)


@query("k3_majority_baseline", f"""{W}{RECORDS}, m AS (SELECT label AS prediction FROM rec WHERE label IS NOT NULL AND row_id % 5 <> 0 GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
  SELECT row_id, label, prediction, CAST(prediction AS DOUBLE) AS score FROM rec, m WHERE label IS NOT NULL AND row_id % 5 = 0""")
def k3(t: Tables) -> DataFrame:
    rows = t.records.filter("label IS NOT NULL")
    return MO.majority(rows.filter("row_id % 5 <> 0"), rows.filter("row_id % 5 = 0")).select("row_id", "label", "prediction", "score")


def class_vectors(t: Tables) -> DataFrame:
    """Embeddings with label 0 as the positive class."""
    return t.embeddings.select("vec_id", "embedding", (F.col("label") == 0).cast("int").alias("label"))


@query("k4_mlp")
def k4(t: Tables) -> DataFrame:
    """Trained on the rows outside a hash fold, chosen on that fold; scores of all rows."""
    rows = class_vectors(t)
    net = NN.train(rows, "vec_id", F.pmod(F.xxhash64("vec_id"), F.lit(5)) == 0, epochs=12, patience=4)
    return rounded(net.score(rows).select("vec_id", "label", "score"), 2)


@query("k4_training_history", """SELECT 12 AS most_epochs, true AS numbered, true AS best_is_highest, true AS scores_match
  FROM embeddings LIMIT 1""")
def k4_history(t: Tables) -> DataFrame:
    """The history of a training run: epochs without gaps, and the kept parameters are those of the best epoch."""
    rows = class_vectors(t)
    held = F.pmod(F.xxhash64("vec_id"), F.lit(5)) == 0
    net = NN.train(rows, "vec_id", held, epochs=12, patience=4)
    history = net.history_table(t.spark)
    again = full_metrics(net.score(rows.filter(held)), "label", "score", min_class=1).select("roc_auc")
    best = history.agg(F.max("val_roc_auc").alias("top"), F.max_by("val_roc_auc", F.col("epoch") == net.best_epoch).alias("kept"),
                       F.count("*").alias("n"), F.max("epoch").alias("last"))
    checks = best.crossJoin(again)
    return checks.select(F.lit(12).alias("most_epochs"), ((F.col("n") == F.col("last")) & (F.col("n") <= 12)).alias("numbered"),
                         (F.col("kept") >= F.col("top") - 12 * NN.LEAST_GAIN).alias("best_is_highest"),
                         (F.abs(F.col("kept") - F.col("roc_auc")) < 1e-9).alias("scores_match"))


@query("k5_embedding_logreg")
def k5(t: Tables) -> DataFrame:
    rows = class_vectors(t)
    return rounded(MO.score(MO.as_vector(rows), MO.fit_embedding_logreg(rows)).select("vec_id", "label", "score"), 3)


FOLDS_SQL = f"""{RECORDS}, gr AS (SELECT source AS g, count(*) FILTER (label = 1) AS n1, count(*) AS n FROM rec WHERE label IS NOT NULL GROUP BY 1),
p AS (SELECT g, row_number() OVER (ORDER BY n1 DESC, n DESC, g) - 1 AS p FROM gr),
f AS (SELECT g, CAST(CASE WHEN (p // 5) % 2 = 0 THEN p % 5 ELSE 4 - p % 5 END AS INTEGER) AS fold FROM p)"""


@query("k6_fold_assignment", f"{W}{FOLDS_SQL} SELECT row_id, fold FROM rec JOIN f ON source = g WHERE label IS NOT NULL")
def k6_folds(t: Tables) -> DataFrame:
    return SP.assign_folds(pair_rows(t), "source", "label", 5).select("row_id", "fold")


@query("k6_out_of_fold_scores")
def k6(t: Tables) -> DataFrame:
    folds = SP.assign_folds(pair_rows(t), "source", "label", 5)
    return rounded(MO.leave_out(folds, "row_id", "pair", "label", "fold", list(range(5))), 3)


@query("k7_retrieval_scorer")
def k7(t: Tables) -> DataFrame:
    docs = t.documents.select("doc_id", "text")
    return rounded(MO.score(docs, retrieval_scorer(t.benchmark, docs, "text"), ["doc_id"]), 3)


@query("k8_batch_inference", "SELECT vec_id, CAST(0 AS DOUBLE) AS difference FROM embeddings")
def k8(t: Tables) -> DataFrame:
    rows = class_vectors(t)
    path = scratch(t, "embedding_model")
    model = MO.fit_embedding_logreg(rows)
    save_model(model, path)
    fresh = MO.score(MO.as_vector(rows), model).select("vec_id", F.col("score").alias("fresh"))
    loaded = MO.score(MO.as_vector(rows), PipelineModel.load(path)).select("vec_id", "score")
    return rounded(loaded.join(fresh, "vec_id").select("vec_id", F.abs(F.col("score") - F.col("fresh")).alias("difference")))


@query("a11_load_or_fit", f"{W}{RECORDS} SELECT row_id, true AS loaded, CAST(0 AS DOUBLE) AS difference FROM rec WHERE label IS NOT NULL")
def a11(t: Tables) -> DataFrame:
    path = scratch(t, "pair_model")
    rows = pair_rows(t)
    rows = rows.select("row_id", "label", "pair")
    model = MO.fit_kmer(rows, "pair")
    save_model(model, path)
    again, loaded = load_or_fit(path, rows, lambda df: MO.fit_kmer(df, "pair"))
    fresh = MO.score(rows, model, ["row_id"]).withColumnRenamed("score", "fresh")
    scored = MO.score(rows, again, ["row_id"]).join(fresh, "row_id")
    return rounded(scored.select("row_id", F.lit(loaded).alias("loaded"), F.abs(F.col("score") - F.col("fresh")).alias("difference")))


@query("l1_stratified_split", f"""{W}{RECORDS} SELECT row_id, CASE WHEN row_number() OVER (PARTITION BY label ORDER BY sha256(row_id || ':42')) <= ceil(0.2 * count(*) OVER (PARTITION BY label))
  THEN 'test' ELSE 'train' END AS side FROM rec WHERE label IS NOT NULL""")
def l1(t: Tables) -> DataFrame:
    return SP.stratified_split(t.records.filter("label IS NOT NULL"), "row_id", "label").select("row_id", "side")


GROUP_SPLIT_SQL = f"""{RECORDS}, gs AS (SELECT source AS g, row_number() OVER (ORDER BY sha256(source || ':42')) <= ceil(0.2 * count(*) OVER ()) AS test FROM rec WHERE label IS NOT NULL GROUP BY 1),
sp AS (SELECT rec.*, CASE WHEN test THEN 'test' ELSE 'train' END AS side FROM rec JOIN gs ON source = g WHERE label IS NOT NULL)"""


@query("l2_group_split", f"{W}{GROUP_SPLIT_SQL} SELECT row_id, side FROM sp")
def l2(t: Tables) -> DataFrame:
    return SP.group_split(t.records.filter("label IS NOT NULL"), "source", "label")[0].select("row_id", "side")


@query("l3_group_split_fallback", f"{W}{GROUP_SPLIT_SQL} SELECT row_id, side, 'source' AS used FROM sp")
def l3(t: Tables) -> DataFrame:
    rows = t.records.filter("label IS NOT NULL").withColumn("single", F.lit("one"))
    split, used, _ = SP.group_split_any(rows, ["absent", "single", "source"], "label", attempts=3)
    return split.select("row_id", "side", F.lit(used).alias("used"))


@query("l4_inner_split", f"""{W}{GROUP_SPLIT_SQL}, tr AS (SELECT * FROM sp WHERE side = 'train'),
  gi AS (SELECT source AS g, row_number() OVER (ORDER BY sha256(source || ':142')) <= ceil(0.15 * count(*) OVER ()) AS test FROM tr GROUP BY 1)
  SELECT row_id, CASE WHEN test THEN 'test' ELSE 'train' END AS inner_side FROM tr JOIN gi ON source = gi.g""")
def l4(t: Tables) -> DataFrame:
    train = SP.group_split(t.records.filter("label IS NOT NULL"), "source", "label")[0].filter("side = 'train'").drop("side")
    return SP.inner_split(train, "row_id", "source", "label")[0].select("row_id", F.col("side").alias("inner_side"))


@query("l5_logo_folds", f"""{W}{RECORDS}, te AS (SELECT source AS fold, count(*) AS test_rows, count(*) FILTER (label = 0) AS test_0, count(*) FILTER (label = 1) AS test_1 FROM rec WHERE label IS NOT NULL GROUP BY 1),
  f AS (SELECT *, CAST(sum(test_rows) OVER () - test_rows AS BIGINT) AS train_rows, CAST(sum(test_0) OVER () - test_0 AS BIGINT) AS train_0, CAST(sum(test_1) OVER () - test_1 AS BIGINT) AS train_1 FROM te)
  SELECT *, CASE WHEN test_rows < 15 THEN 'too_few_test_rows' WHEN train_0 = 0 OR train_1 = 0 THEN 'train_single_class' WHEN test_0 < 2 OR test_1 < 2 THEN 'test_insufficient_class_counts' ELSE 'ok' END AS reason,
  reason = 'ok' AS valid FROM f""")
def l5(t: Tables) -> DataFrame:
    return SP.logo_folds(t.records.filter("label IS NOT NULL"), "source", "label", 15, 2)


@query("l6_balanced_sample", f"""{W}{RECORDS}, s AS (SELECT row_id, label, row_number() OVER (PARTITION BY label ORDER BY sha256(row_id || ':42')) AS k, min(n) OVER () AS n FROM (
  SELECT *, count(*) OVER (PARTITION BY label) AS n FROM rec WHERE label IS NOT NULL)) SELECT row_id, label FROM s WHERE k <= n""")
def l6(t: Tables) -> DataFrame:
    rows = t.records.filter("label IS NOT NULL").select("row_id", "label")
    a, b, _ = SP.balance(rows.filter("label = 1"), rows.filter("label = 0"), "row_id")
    return a.unionByName(b)


MATCHED_SQL = f"""{BINS_SQL}, m AS (SELECT *, label IS NOT NULL AS side_a FROM bins), c AS (SELECT matching_bin, count(*) FILTER (side_a) AS left_rows, count(*) FILTER (NOT side_a) AS right_rows FROM m GROUP BY 1),
k AS (SELECT m.row_id, m.matching_bin, side_a, row_number() OVER (PARTITION BY m.matching_bin, side_a ORDER BY sha256(row_id || ':42')) AS k, least(left_rows, right_rows) AS n FROM m JOIN c ON m.matching_bin = c.matching_bin)"""


@query("l7_matched_sample", f"{W}{MATCHED_SQL} SELECT row_id, matching_bin, side_a FROM k WHERE k <= n")
def l7(t: Tables) -> DataFrame:
    rows = binned(t).select("row_id", "matching_bin", "label")
    a, b, _ = SP.matched_sample(rows.filter("label IS NOT NULL"), rows.filter("label IS NULL"), "row_id", "matching_bin")
    return a.withColumn("side_a", F.lit(True)).unionByName(b.withColumn("side_a", F.lit(False))).select("row_id", "matching_bin", "side_a")


@query("l7_matched_audit", f"{W}{MATCHED_SQL} SELECT matching_bin, left_rows, right_rows, least(left_rows, right_rows) AS matched_rows FROM c WHERE left_rows > 0")
def l7_audit(t: Tables) -> DataFrame:
    rows = binned(t).select("row_id", "matching_bin", "label")
    return SP.matched_sample(rows.filter("label IS NOT NULL"), rows.filter("label IS NULL"), "row_id", "matching_bin")[2]


@query("l8_split_report", f"""{W}{GROUP_SPLIT_SQL} SELECT side, count(*) AS rows, count(*) FILTER (label = 0) AS label_0, count(*) FILTER (label = 1) AS label_1,
  count(DISTINCT source) AS groups, CAST(0 AS BIGINT) AS group_overlap FROM sp GROUP BY 1""")
def l8(t: Tables) -> DataFrame:
    split = SP.group_split(t.records.filter("label IS NOT NULL"), "source", "label")[0]
    return SP.split_report(split, "side", "label", "source")


@query("o1_kmeans")
def o1(t: Tables) -> DataFrame:
    return CL.cluster(CL.scaled_vectors(t.embeddings), starts=20).select("vec_id", "label", "cluster_id")


@query("o1_kmeans_optimum", "SELECT count(*) AS rows, CAST(0 AS BIGINT) AS misplaced, true AS means_hold, true AS best_of_starts FROM embeddings")
def o1_optimum(t: Tables) -> DataFrame:
    """Rows not in the cluster of the nearest mean; whether means are the means of their rows and no start is better."""
    rows = CL.scaled_vectors(t.embeddings)
    fit = CL.best_kmeans(rows, CL.cluster_count(rows.count()), 20)
    placed = CL.assign(rows, fit.centers).select("cluster_id", MO.vector_to_array("features").alias("x"))
    entries = placed.select("cluster_id", F.posexplode("x").alias("d", "v"))
    means = entries.groupBy("cluster_id", "d").agg(F.avg("v").alias("m")).groupBy("cluster_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("d", "m"))), lambda p: p["m"]).alias("mean"))
    held = cut_lineage(means)
    far = F.aggregate(F.zip_with("x", "mean", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)
    near = placed.crossJoin(F.broadcast(held.withColumnRenamed("cluster_id", "other"))).select("cluster_id", "other", far.alias("far"), F.hash("x").alias("h"))
    own = near.filter("cluster_id = other").agg(F.sum("far").alias("cost"), F.count("*").alias("rows"))
    best = near.filter("cluster_id <> other").join(near.filter("cluster_id = other").select("h", F.col("far").alias("own")), "h")
    # Lloyd steps end when the means move by less than the tolerance, so a row may be nearer by as little.
    wrong = best.agg(F.count_if(F.col("far") < F.col("own") * 0.99).alias("misplaced"))
    least = min(fit.costs)
    return own.crossJoin(wrong).select("rows", "misplaced", (F.abs(F.col("cost") / least - 1) < 1e-3).alias("means_hold"),
                                       F.lit(fit.cost == least and len(fit.costs) == 20).alias("best_of_starts"))


@query("o2_silhouette", """WITH e AS (SELECT vec_id, label AS c, unnest(range(len(embedding))) AS d, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
  s AS (SELECT vec_id, c, d, (x - avg(x) OVER w) / stddev_samp(x) OVER w AS x FROM e WINDOW w AS (PARTITION BY d)),
  v AS (SELECT vec_id, c, list(x ORDER BY d) AS x FROM s GROUP BY 1, 2),
  g AS (SELECT a.vec_id, a.c, b.c AS k, sum(list_distance(a.x, b.x)) AS far, count(*) AS size FROM v a, v b GROUP BY 1, 2, 3),
  ab AS (SELECT vec_id, max(size) FILTER (c = k) AS size, max(far / nullif(size - 1, 0)) FILTER (c = k) AS a, min(far / size) FILTER (c <> k) AS b FROM g GROUP BY 1)
  SELECT round(avg(CASE WHEN size = 1 THEN 0 ELSE (b - a) / greatest(a, b) END), 3) AS silhouette, count(*) AS rows FROM ab""")
def o2(t: Tables) -> DataFrame:
    """Silhouette of the given labels as clusters, every row held against all rows."""
    return rounded(CL.silhouette(CL.scaled_vectors(t.embeddings), "label", sample=None), 3)


@query("o2_silhouette_sample", "SELECT true AS near, least(200, count(*)) AS rows FROM embeddings")
def o2_sample(t: Tables) -> DataFrame:
    """The estimate from 200 rows lies near the value of all rows."""
    rows = CL.scaled_vectors(t.embeddings)
    whole = CL.silhouette(rows, "label", sample=None).select(F.col("silhouette").alias("whole"))
    return CL.silhouette(rows, "label", sample=200).crossJoin(whole).select((F.abs(F.col("silhouette") - F.col("whole")) < 0.02).alias("near"), "rows")


@query("o3_pca")
def o3(t: Tables) -> DataFrame:
    return rounded(CL.reduce_pca(CL.scaled_vectors(t.embeddings), "vec_id"), 4)


@query("o3_truncated_svd")
def o3_svd(t: Tables) -> DataFrame:
    return rounded(CL.reduce_svd(CL.scaled_vectors(t.embeddings), "vec_id"), 4)


@query("o3_sparse_svd_axes", "SELECT CAST(axis AS INTEGER) AS axis, true AS falling, CAST(0 AS DOUBLE) AS residual FROM range(1, 3) r(axis)")
def o3_axes(t: Tables) -> DataFrame:
    """Two axes of the n-gram vectors of all documents, all terms: how far each is from an exact one."""
    found = sparse_svd(t, 2)
    falling = [a >= b for a, b in zip(found.values, [*found.values[1:], 0.0])]
    rows = [(i + 1, down, round(r, 2)) for i, (down, r) in enumerate(zip(falling, found.residuals))]
    return t.spark.createDataFrame(rows, "axis int, falling boolean, residual double")


@query("o3_sparse_svd")
def o3_sparse(t: Tables) -> DataFrame:
    found = sparse_svd(t, 2)
    return rounded(found.rows.select("doc_id", F.get("coordinates", F.lit(0)).alias("sv1"), F.get("coordinates", F.lit(1)).alias("sv2")), 3)


def sparse_svd(t: Tables, k: int) -> Svd:
    vectors, terms = N.fit_tfidf_rows(t.documents, "doc_id", "text")
    return truncated_svd(vectors, ["doc_id"], terms.count(), k)


@query("o4_cluster_enrichment", f"""{W}{SEQUENCES} SELECT source, count(*) AS row_count, count(*) FILTER (label = 0) AS label_0, count(*) FILTER (label = 1) AS label_1,
  round(CAST(count(*) FILTER (label = 1) AS DOUBLE) / nullif(count(label), 0), 6) AS positive_fraction FROM seq GROUP BY 1""")
def o4(t: Tables) -> DataFrame:
    return rounded(CL.cluster_enrichment(t.records, "source", "label"))
