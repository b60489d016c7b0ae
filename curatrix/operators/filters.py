"""Row filters, with the counts the reports need taken in the same pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curatrix.constants import HEAVY_LENGTHS, LIGHT_LENGTHS
from curatrix.functions.text import all_of, any_mention, any_of, clean_sequence, is_missing
from curatrix.functions.values import binary_label
from curatrix.operators.ordered import top_n_per_group

ACCEPTABLE_RISK = ["low", "medium"]
PRIMARY_CATEGORIES = ["known_neutralising", "missing_label", "conflict_label"]
REVIEW_CATEGORY = "known_non_neutralising"


def filter_mentions(df: DataFrame, columns: list[str], pattern: str) -> DataFrame:
    return df.filter(any_mention(columns, pattern))


def filter_lengths(
    df: DataFrame, heavy: str, light: str,
    heavy_bounds: tuple[int, int] = HEAVY_LENGTHS, light_bounds: tuple[int, int] = LIGHT_LENGTHS,
) -> DataFrame:
    return df.filter(F.length(heavy).between(*heavy_bounds) & F.length(light).between(*light_bounds))


def funnel(df: DataFrame, steps: dict[str, Column], name: str = "drop_reason") -> DataFrame:
    """First failing step of an ordered list of drop conditions, null for rows that stay."""
    reason = F.lit(None).cast("string")
    for step, condition in reversed(steps.items()):
        reason = F.when(condition, F.lit(step)).otherwise(reason)
    return df.withColumn(name, reason)


def funnel_counts(tagged: DataFrame, name: str = "drop_reason") -> DataFrame:
    return tagged.groupBy(F.coalesce(name, F.lit("kept")).alias("step")).agg(F.count("*").alias("rows"))


def strict_label_steps(
    label: str, conflict: str, has_heavy: str, valid_heavy: str, has_light: str, valid_light: str
) -> dict[str, Column]:
    """Drop steps of the strict labelled table, in order."""
    return {
        "label_missing": ~F.coalesce(F.col(label).isin(0, 1), F.lit(False)),
        "conflict": F.col(conflict),
        "invalid_heavy": ~(F.col(has_heavy) & F.col(valid_heavy)),
        "invalid_light": F.col(has_light) & ~F.col(valid_light),
    }


def count_any_value(df: DataFrame, columns: list[str], markers: list[str] | None = None) -> DataFrame:
    """Rows in which at least one of the columns holds a value."""
    present = any_of([~is_missing(c, markers) for c in columns])
    return df.agg(F.count_if(present).alias("rows_with_value"), F.count("*").alias("rows"))


def filter_scorable(df: DataFrame, heavy: str, valid: str | None = None) -> DataFrame:
    """Rows with heavy text, and with the valid flag where such a column exists."""
    usable = df.filter(clean_sequence(heavy, "token") != "")
    return usable.filter(F.col(valid)) if valid and valid in df.columns else usable


def candidate_pool(df: DataFrame, score: str = "score") -> DataFrame:
    """High score, high confidence, acceptable risk; known negatives only from 0.90."""
    category = F.col("record_category")
    chosen = all_of([
        F.col(score) >= 0.75,
        F.col("confidence_bin") == "high",
        F.col("risk_bin").isin(ACCEPTABLE_RISK),
        category.isin(PRIMARY_CATEGORIES) | ((category == REVIEW_CATEGORY) & (F.col(score) >= 0.90)),
    ])
    return df.filter(chosen).withColumn("model_disagreement", category == REVIEW_CATEGORY)


def relaxed_pool(df: DataFrame, score: str = "score") -> DataFrame:
    chosen = all_of([
        F.col(score) >= 0.65,
        F.col("confidence_bin").isin("medium", "high"),
        F.col("risk_bin").isin(ACCEPTABLE_RISK),
        F.col("record_category").isin(PRIMARY_CATEGORIES),
    ])
    return df.filter(chosen).withColumn("model_disagreement", F.lit(False))


def top_pool(df: DataFrame, score: str, tie: str, n: int = 25) -> DataFrame:
    """Best rows per category, whatever their score."""
    order = [F.col(score).desc(), F.col("confidence_score").desc(), F.col(tie)]
    best = top_n_per_group(df, ["record_category"], order, n, "_rank").drop("_rank")
    return best.withColumn("model_disagreement", F.col("record_category") == REVIEW_CATEGORY)


def choose_pool(df: DataFrame, score: str, tie: str) -> tuple[DataFrame, str | None]:
    """The strict pool, the relaxed one if it is empty, the best per category if both are."""
    for pool, name in ((candidate_pool(df, score), None), (relaxed_pool(df, score), "relaxed_score_threshold_once")):
        if not pool.isEmpty():
            return pool, name
    return top_pool(df, score, tie), "top_k_per_category"


def binary_labels(df: DataFrame, column: str, name: str = "label") -> DataFrame:
    """Rows whose label reads as 0 or 1, as integer."""
    return df.withColumn(name, binary_label(column)).filter(F.col(name).isNotNull())


def primary_subset(df: DataFrame, flags: list[str], label: str = "label") -> DataFrame:
    """Rows on which every flag holds and the label is binary."""
    return df.filter(all_of([F.col(f) for f in flags] + [F.col(label).isin(0, 1)]))
