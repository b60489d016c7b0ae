"""Registry of results from metric files, and the check of a set of outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curatrix.constants import FORBIDDEN_PUBLIC_COLUMNS
from curatrix.operators.metric_trees import flatten_metrics
from curatrix.operators.metrics import compare_models
from curatrix.operators.ordered import top_n_per_group


def registry(metrics: DataFrame, subset: str, baseline: str, name: str = "name", payload: str = "json") -> DataFrame:
    """Best metric pair per source, best PR AUC first, against the baseline of the same subset."""
    flat = flatten_metrics(metrics, name, payload)
    order = [F.col("pr_auc").desc_nulls_last(), F.col("roc_auc").desc_nulls_last(), F.col("path")]
    best = top_n_per_group(flat, [name], order, 1, "_rank").drop("_rank")
    entries = metrics.select(name, subset).join(best, name, "left")
    return compare_models(entries, name, baseline, ["roc_auc", "pr_auc"], [subset])


def contract_check(spark: SparkSession, expected: list[str], forbidden: list[str] = FORBIDDEN_PUBLIC_COLUMNS) -> DataFrame:
    """Per expected CSV output: does it exist, which forbidden columns does its header show."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    found = []
    for path in expected:
        exists = hadoop(path).getFileSystem(conf).exists(hadoop(path))
        columns = spark.read.option("header", True).csv(path).columns if exists else []
        bad = sorted({c.strip().lower() for c in columns} & set(forbidden))
        found.append((path, exists, bad, exists and not bad))
    return spark.createDataFrame(found, "path string, exists boolean, forbidden array<string>, passed boolean")
