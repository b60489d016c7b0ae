"""Nested metric JSON: pairs of metrics and a flat list of everything inside."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curatrix.lineage import cut_lineage

SKIPPED_PATHS = ("baseline", "kmer", "majority")


def scalar_metric(payload: Column, name: str) -> Column:
    """A number, or the mean, value or max of a nested object."""
    places = [f"$.{name}", f"$.{name}.mean", f"$.{name}.value", f"$.{name}.max"]
    return F.coalesce(*[F.get_json_object(payload, p).try_cast("double") for p in places])


def metric_pair(payload: Column) -> tuple[Column, Column]:
    """(ROC AUC, PR AUC); average precision stands in for a missing PR AUC."""
    pr = F.coalesce(scalar_metric(payload, "pr_auc"), scalar_metric(payload, "average_precision"))
    return scalar_metric(payload, "roc_auc"), pr


def nested_objects(df: DataFrame, name: str, payload: str) -> DataFrame:
    """(name, path, object): every object of each JSON text with its path, level by level down to the deepest."""
    level = cut_lineage(df.select(F.col(name).alias("name"), F.lit("").alias("path"), F.parse_json(F.col(payload)).alias("node"))
                        .filter("node IS NOT NULL"))
    levels = None
    while not level.isEmpty():
        levels = level if levels is None else levels.unionByName(level)
        members = df.sparkSession.sql(
            "SELECT name, path, m.pos, m.key, m.value AS node FROM {level}, LATERAL variant_explode(node) AS m", level=level)
        step = F.coalesce("key", F.col("pos").cast("string"))
        inner = members.select("name", F.when(F.col("path") == "", step).otherwise(F.concat_ws(".", "path", step)).alias("path"), "node")
        level = cut_lineage(inner.filter(F.schema_of_variant("node").rlike("^(OBJECT|ARRAY)")))
    levels = level if levels is None else levels
    return levels.filter(F.schema_of_variant("node").startswith("OBJECT")).select(F.col("name").alias(name), "path", "node")


def flatten_metrics(df: DataFrame, name: str, payload: str) -> DataFrame:
    """(name, path, roc_auc, pr_auc) of every nested object with a metric, baselines left out."""
    rows = nested_objects(df, name, payload)
    lowered = F.lower("path")
    clean = ~lowered.rlike("|".join(SKIPPED_PATHS))
    roc = variant_metric("roc_auc")
    pr = F.coalesce(variant_metric("pr_auc"), variant_metric("average_precision"))
    return (
        rows.filter(clean).select(name, "path", roc.alias("roc_auc"), pr.alias("pr_auc"))
        .filter(F.col("roc_auc").isNotNull() | F.col("pr_auc").isNotNull())
    )


def variant_metric(name: str) -> Column:
    """As ``scalar_metric``, of a parsed object."""
    return F.coalesce(*[F.try_variant_get("node", f"$.{name}{inner}", "double") for inner in ("", ".mean", ".value", ".max")])
