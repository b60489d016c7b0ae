"""Joins. Sides are broadcast only by Spark's own size rule, never by a fixed hint on data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curatrix.functions.text import is_blank
from curatrix.operators.ordered import join_on


def first_nonblank(df: DataFrame, key: str, columns: list[str], order: str) -> DataFrame:
    """Per key and column the first value in order that is not blank."""
    return df.filter(~is_blank(key)).groupBy(key).agg(*[
        F.coalesce(
            F.min_by(F.when(~is_blank(c), F.col(c)), F.when(~is_blank(c), F.col(order))), F.lit("")
        ).alias(c)
        for c in columns
    ])


def enrich_by_key(left: DataFrame, right: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Left join on a unique right side: present values win, blank ones are filled."""
    incoming = right.select(key, *[F.col(c).alias(f"_in_{c}") for c in columns])
    joined = left.join(incoming, key, "left")
    for c in columns:
        filled = F.col(f"_in_{c}")
        if c in left.columns:
            filled = F.when(is_blank(c) & filled.isNotNull(), filled).otherwise(F.col(c))
        joined = joined.withColumn(c, F.coalesce(filled, F.lit("")))
    return joined.drop(*[f"_in_{c}" for c in columns])


def blank_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns that hold no value at all, one pass."""
    filled = df.agg(*[F.count_if(~is_blank(c)).alias(c) for c in columns])
    return filled.unpivot([], columns, "column", "filled_rows").filter(F.col("filled_rows") == 0)


def remove_overlap(df: DataFrame, reference: DataFrame, key: str) -> DataFrame:
    return df.join(reference.select(key), key, "left_anti")


def count_overlap(df: DataFrame, reference: DataFrame, key: str) -> DataFrame:
    return df.join(reference.select(key), key, "left_semi").agg(F.count("*").alias("overlap_rows"))


def mean_scores(scores: DataFrame, key: str, score: str, file: str) -> DataFrame:
    """Mean score per (key, file): one row per key and file."""
    return scores.filter(F.col(score).isNotNull()).groupBy(key, file).agg(F.avg(score).alias(score))


def merge_scores(rows: DataFrame, scores: DataFrame, id_: str, keys: list[str]) -> DataFrame:
    """Saved scores found by any of several hashes, averaged per record.

    ``scores`` has (score_hash, saved_score, score_file), at most one row per hash and file.
    """
    lookup = rows.select(id_, *keys).distinct()
    hits = None
    for key in keys:
        part = lookup.select(id_, F.col(key).alias("score_hash")).join(scores, "score_hash")
        part = part.select(id_, "saved_score", "score_file")
        hits = part if hits is None else hits.unionByName(part)
    merged = hits.distinct().groupBy(id_).agg(
        F.avg("saved_score").alias("saved_score"),
        F.count_distinct("score_file").alias("score_files"),
    )
    return rows.join(merged, id_, "left")


def attach_first(df: DataFrame, other: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """Left join on the first value per key."""
    unique = other.groupBy(key).agg(F.min_by(value, order).alias(value))
    return df.join(unique, key, "left")


def attach_rows(predictions: DataFrame, rows: DataFrame, key: str, how: str = "left") -> DataFrame:
    return predictions.join(rows, key, how)


def cogroup_bins(a: DataFrame, b: DataFrame, bin_: str) -> DataFrame:
    """Row counts of both sides per bin, bins of one side alone included."""
    left = a.groupBy(bin_).agg(F.count("*").alias("left_rows"))
    right = b.groupBy(bin_).agg(F.count("*").alias("right_rows"))
    both = left.join(right, bin_, "full").na.fill(0, ["left_rows", "right_rows"])
    return both.withColumn("matched_rows", F.least("left_rows", "right_rows"))


def assemble(df: DataFrame, blocks: list[DataFrame], key: str) -> DataFrame:
    """Feature blocks side by side, matched by id and not by place."""
    for block in blocks:
        df = df.join(block, key)
    return df


def cross_params(df: DataFrame, values: list, name: str) -> DataFrame:
    """Every row once per parameter value, from a literal list inside the row."""
    return df.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))


def with_param(name: str, values: list) -> Column:
    return F.explode(F.array(*[F.lit(v) for v in values])).alias(name)


__all__ = [
    "assemble", "attach_first", "attach_rows", "blank_columns", "cogroup_bins", "count_overlap",
    "cross_params", "enrich_by_key", "first_nonblank", "join_on", "mean_scores", "merge_scores",
    "remove_overlap", "with_param",
]
