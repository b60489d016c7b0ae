"""Classifiers: balanced logistic regression on n-grams or embeddings, baselines."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import SQLTransformer, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curatrix.lineage import cut_lineage, saved, shared_path, source_bytes
from curatrix.operators.compact import compact_counts, fit_counts
from curatrix.operators.ngrams import number_terms, text_vocab, tfidf_rows, weigh
from curatrix.operators.sharded import ManyLogistic

ROWS_PER_TASK = 1_000
BYTES_PER_TASK = 256 << 20
DENSE_TERMS = 1 << 21  # 16 MB of weights


def with_weights(df: DataFrame, label: str = "label", name: str = "weight") -> tuple[DataFrame, float]:
    """Class weights n / (classes x class rows); also their sum, which is n."""
    counts = {r[label]: r["count"] for r in df.groupBy(label).count().collect()}  # one row per class
    total = sum(counts.values())
    weight = F.lit(None).cast("double")
    for value, n in counts.items():
        weight = F.when(F.col(label) == value, total / (len(counts) * n)).otherwise(weight)
    return df.withColumn(name, weight), float(total)


def logistic(total_weight: float, features: str = "features", label: str = "label", c: float = 1.0) -> LogisticRegression:
    """L2 penalty as in C = 1: the loss is a sum there and a mean here."""
    return LogisticRegression(
        featuresCol=features, labelCol=label, weightCol="weight", regParam=1.0 / (c * total_weight),
        elasticNetParam=0.0, standardization=False, maxIter=500, tol=1e-5,
    )


def even_scale(df: DataFrame, features: str, label: str, total_weight: float, size: int | None = None) -> DataFrame:
    """Add two rows of vanishing weight that give every feature the same spread.

    Spark always optimises over features divided by their deviation. For rare n-grams that
    turns an even penalty into a very uneven one, and the fit needs hundreds of passes. Two
    opposite rows with value v in every feature and weight n / v**2 raise each variance by
    about 2, while their share of the loss is of order 1 / v: the optimum stays, and about
    twenty passes reach it.
    """
    value = 1e7
    size = size or df.select(F.size(vector_to_array(features)).alias("n")).first()["n"]
    pads = df.sparkSession.range(0, 2, 1, 1).select(
        F.col("id").cast("int").alias(label), F.lit(total_weight / value**2).alias("weight"),
        array_to_vector(F.array_repeat(F.lit(value), size)).alias(features),
    )
    return df.select(label, "weight", features).unionByName(pads)


def pass_tasks(rows: int, size: int, cores: int) -> int:
    """Tasks of a pass over so many rows of so many bytes."""
    return max(1, min(rows // ROWS_PER_TASK, max(cores, size // BYTES_PER_TASK)))


def fit_logreg(
    df: DataFrame, features: str = "features", label: str = "label", penalise_intercept: bool = False, size: int | None = None
):
    """Balanced logistic regression; optionally the intercept is penalised like a weight.

    Every pass runs one task per partition and adds up one gradient of each, so rows are drawn together: as many
    partitions as cores, more only where one would hold over BYTES_PER_TASK. ``size`` is the length of the
    vectors, where the caller knows it.
    """
    weighted, total = with_weights(df, label)
    weighted = weighted.coalesce(pass_tasks(int(total), source_bytes(df), df.sparkSession.sparkContext.defaultParallelism))
    if not penalise_intercept:
        return logistic(total, features, label).fit(even_scale(weighted, features, label, total, size))
    one = SQLTransformer(statement="SELECT *, 1.0D AS _one FROM __THIS__")
    wide = VectorAssembler(inputCols=[features, "_one"], outputCol="_with_one")
    padded = even_scale(wide.transform(one.transform(weighted)), "_with_one", label, total)
    model = logistic(total, "_with_one", label).setFitIntercept(False).fit(padded)
    return PipelineModel(stages=[one, wide, model])


def positive_score(scored: DataFrame, name: str = "score") -> DataFrame:
    return scored.withColumn(name, vector_to_array("probability")[1])


def score(df: DataFrame, model, keep: list[str] | None = None) -> DataFrame:
    """Probability of label 1 by a fitted or loaded model; batches are Spark's partitions.

    With ``keep`` only these columns of df go on beside the score.
    """
    if isinstance(model, KmerModel):
        return model.score(df, keep=keep)
    helpers = ["features", "_one", "_with_one", "rawPrediction", "probability", "prediction"]
    scored = positive_score(model.transform(df))
    scored = scored.drop(*[c for c in helpers if c not in df.columns])
    return scored if keep is None else scored.select(*keep, "score")


@dataclass
class KmerModel:
    """N-gram TF-IDF and logistic weights: ``terms`` has (term, ix, idf, weight), one row per term."""

    terms: DataFrame
    intercept: float
    text: str

    def score(self, df: DataFrame, name: str = "score", keep: list[str] | None = None) -> DataFrame:
        """df (or its columns ``keep``) with the probability of label 1; the vocabulary is met through a join."""
        intercept = self.intercept

        def probability(n, rows, ix, counts, known):
            total = np.full(n, intercept)
            if len(rows):
                weights = counts * known("idf").to_numpy(zero_copy_only=False)
                norms = np.sqrt(np.bincount(rows, weights * weights, n))
                total += np.bincount(rows, weights * known("weight").to_numpy(zero_copy_only=False) / norms[rows], n)
            return [pa.array(1 / (1 + np.exp(-total)))]

        return weigh(df.drop(name), self.text, self.terms, probability, [(name, T.DoubleType())], keep=keep)

    def save(self, path: str) -> None:
        self.terms.write.mode("overwrite").parquet(f"{path}/terms")
        spark = self.terms.sparkSession
        spark.createDataFrame([(self.intercept, self.text)], "intercept double, text string").write.mode("overwrite").json(f"{path}/head")

    @staticmethod
    def load(spark: SparkSession, path: str) -> KmerModel:
        head = spark.read.schema("intercept double, text string").json(f"{path}/head").first()
        return KmerModel(spark.read.parquet(f"{path}/terms"), head["intercept"], head["text"])


def as_vectors(df: DataFrame, keys: list[str], ix: str, w: str, size: int) -> DataFrame:
    """keys and ``features``, sparse vectors made of two arrays, written once for the passes of a fit.

    The columns are written in the layout in which Spark stores vectors, and read as vectors.
    """
    packed = F.struct(F.lit(0).cast("tinyint").alias("type"), F.lit(size).alias("size"), F.col(ix).alias("indices"), F.col(w).alias("values"))
    path = shared_path(df.sparkSession, "vectors")
    df.select(*keys, packed.alias("features")).write.parquet(path)
    schema = T.StructType([*[df.schema[k] for k in keys], T.StructField("features", VectorUDT())])
    return df.sparkSession.read.schema(schema).parquet(path)


def kmer_vectors(df: DataFrame, key: str, text: str, min_df: int = 2, max_terms: int | None = None, train: DataFrame | None = None) -> DataFrame:
    """(key, features): n-gram TF-IDF of every row of df; the vocabulary is that of ``train``."""
    train = df if train is None else train
    terms = cut_lineage(number_terms(text_vocab(train, text, min_df, max_terms), train.count()))
    return as_vectors(tfidf_rows(df, key, text, terms), [key], "ix", "w", terms.count())


def term_counts(df: DataFrame, keep: list[str], text: str, terms: DataFrame) -> DataFrame:
    """``keep`` and the vocabulary terms of each row as two arrays, ix and tf, written once for the passes of a fit."""
    def counts_of(n, rows, ix, counts, known):
        offsets = pa.array(np.searchsorted(rows, np.arange(n + 1)), pa.int32())
        return [pa.ListArray.from_arrays(offsets, pa.array(ix, pa.int32())),
                pa.ListArray.from_arrays(offsets, pa.array(counts, pa.int64()))]

    fields = [("ix", T.ArrayType(T.IntegerType())), ("tf", T.ArrayType(T.LongType()))]
    return saved(weigh(df, text, terms.select("term", "ix"), counts_of, fields, keep=keep), "counts")


def fit_kmer(
    df: DataFrame, text: str = "text", label: str = "label", min_df: int = 2, max_terms: int | None = None,
    dense_terms: int = DENSE_TERMS,
) -> KmerModel:
    """N-gram TF-IDF and balanced logistic regression, fitted on these rows only; all terms unless capped.

    Up to ``dense_terms`` terms the weights travel as one vector of bounded size, which takes the fewest stages a
    step; beyond, they stay cut into slices. Both find the same optimum.
    """
    terms = cut_lineage(number_terms(text_vocab(df, text, min_df, max_terms), df.count()))
    size = terms.count()
    if size <= dense_terms:
        counted, (importance, total) = compact_counts(df, label, text, terms), class_weights(df, label)
        counted = counted.coalesce(pass_tasks(int(total), source_bytes(counted), df.sparkSession.sparkContext.defaultParallelism))
        weights, intercept = fit_counts(counted, label, importance, total, in_order(terms, "idf", size))
        return KmerModel(cut_lineage(with_coefficients(terms, weights)), intercept, text)
    many = ManyLogistic(term_counts(df, [label], text, terms), label, [F.lit(True)], size, min_df=min_df)
    try:
        fit = many.fit()
    finally:
        many.release()
    weighted = terms.select("term", "ix", "idf").join(fit.terms().select("ix", "weight"), "ix").select("term", "ix", "idf", "weight")
    return KmerModel(cut_lineage(weighted), float(fit.intercepts()[0]), text)


def class_weights(df: DataFrame, label: str = "label") -> tuple[dict[int, float], float]:
    """n / (classes x class rows) of each class, and n; labels are 0 and 1."""
    counts = {r[label]: r["count"] for r in df.groupBy(label).count().collect()}  # one row per class
    if not counts or set(counts) - {0, 1}:
        raise ValueError("labels to fit on have to be 0 or 1, in one row at least")
    total = float(sum(counts.values()))
    return {int(value): total / (len(counts) * n) for value, n in counts.items()}, total


def in_order(terms: DataFrame, column: str, size: int) -> np.ndarray:
    """A column of numbered terms as one vector; ``size`` is bounded by the caller."""
    held, found = np.zeros(size), terms.select("ix", column).toArrow()
    held[found["ix"].to_numpy()] = found[column].to_numpy()
    return held


def with_coefficients(terms: DataFrame, weights: np.ndarray) -> DataFrame:
    """terms with the fitted weight of each; the weights are one vector of bounded size."""
    found = terms.sparkSession.createDataFrame(pd.DataFrame({"ix": np.arange(len(weights), dtype=np.int32), "weight": weights}))
    return terms.join(found.withColumn("ix", F.col("ix").cast("int")), "ix").select("term", "ix", "idf", "weight")


def fit_embedding_logreg(df: DataFrame, vector: str = "embedding", label: str = "label") -> PipelineModel:
    """Scaled dense vectors and balanced logistic regression."""
    rows, total = with_weights(df.withColumn("_v", array_to_vector(F.transform(vector, lambda x: x.cast("double")))), label)
    scaler = StandardScaler(inputCol="_v", outputCol="features", withMean=True, withStd=True).fit(rows)
    scaled = even_scale(scaler.transform(rows), "features", label, total)
    return PipelineModel(stages=[scaler, logistic(total, label=label).fit(scaled)])


def as_vector(df: DataFrame, vector: str = "embedding") -> DataFrame:
    return df.withColumn("_v", array_to_vector(F.transform(vector, lambda x: x.cast("double"))))


def majority(train: DataFrame, test: DataFrame, label: str = "label") -> DataFrame:
    """Constant prediction of the most frequent training label; ties go to the smaller label."""
    top = train.groupBy(label).count().orderBy(F.col("count").desc(), label).first()
    value = int(top[label])
    return test.withColumns({"prediction": F.lit(value), "score": F.lit(float(value))})


def leave_out(
    df: DataFrame, key: str, text: str, label: str, group: str, groups: list, min_df: int = 2, max_terms: int | None = None
) -> DataFrame:
    """(key, label, group, score): scores of every listed group from a model of all other groups.

    The terms of a row are counted once; all models are fitted in the same steps. A model has the vocabulary,
    document frequencies and class weights of its own training rows.
    """
    names = [key, label, group]
    terms = cut_lineage(number_terms(text_vocab(df, text, min_df), df.count()))
    counted = term_counts(df, names, text, terms)
    own = [F.col(group).eqNullSafe(F.lit(value)) for value in groups]
    many = ManyLogistic(counted, label, [~o for o in own], terms.count(), names, min_df, max_terms)
    try:
        place = F.coalesce(*[F.when(o, F.lit(k)) for k, o in enumerate(own)])
        scored = many.scores(many.fit()).withColumn("_place", place).filter(F.col("_place").isNotNull())
        return saved(scored.select(*names, F.get("scores", "_place").alias("score")), "held-out")
    finally:
        many.release()


def gradient_norm(model: LogisticRegressionModel, df: DataFrame, label: str = "label") -> float:
    """Length of the gradient of the penalised loss at the fitted weights (test aid)."""
    rows, total = with_weights(df, label)
    w, b = model.coefficients.toArray(), model.intercept
    parts = rows.select(label, "weight", vector_to_array("features").alias("x")).toPandas()
    x = np.array(parts["x"].tolist())
    p = 1 / (1 + np.exp(-(x @ w + b)))
    residual = (p - parts[label]) * parts["weight"] / total
    return math.sqrt(float(((x.T @ residual + w / total) ** 2).sum() + residual.sum() ** 2))
