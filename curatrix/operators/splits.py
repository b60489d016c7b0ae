"""Splits and draws. Choices follow SHA-256 order of (key, seed), so they repeat anywhere."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curatrix.constants import INNER_FRACTION, MIN_CLASS_ROWS, MIN_SOURCE_ROWS, SPLIT_SEED, TEST_FRACTION
from curatrix.functions.text import norm_text
from curatrix.lineage import cut_lineage, side_by_side
from curatrix.operators.ordered import draw, global_position, join_groups, join_on
from curatrix.operators.sets import group_overlap


def share(fraction: float) -> Column:
    """Rows of a stratum to draw; the tiny step down keeps 0.2 x 5 at 1."""
    return F.ceil(F.col("n") * F.lit(fraction) - 1e-9)


def stratified_split(
    df: DataFrame, key: str, label: str, fraction: float = TEST_FRACTION, seed: int = SPLIT_SEED
) -> DataFrame:
    """Column ``side`` (train, test) with the same test share in every label."""
    drawn = draw(df, key, [label], share(fraction), seed, "_test")
    return drawn.withColumn("side", F.when(F.col("_test"), "test").otherwise("train")).drop("_test")


def with_group(df: DataFrame, group: str, name: str = "_group") -> DataFrame:
    text = norm_text(group)
    return df.withColumn(name, F.when(text == "", "__missing_group__").otherwise(text))


def group_split(
    df: DataFrame, group: str, label: str, fraction: float = TEST_FRACTION, seed: int = SPLIT_SEED, attempts: int = 50
) -> tuple[DataFrame, int]:
    """Whole groups to one side; the first seed that leaves both labels on both sides.

    Seeds are tried on the table of groups with their label counts, not on the rows.
    """
    rows = with_group(df, group)
    groups = cut_lineage(rows.groupBy("_group").agg(
        F.count_if(F.col(label) == 0).alias("n0"), F.count_if(F.col(label) == 1).alias("n1"), F.count("*").alias("n")))
    for attempt in range(seed, seed + attempts):
        sides = draw(groups, "_group", [], share(fraction), attempt, "_test")
        checks = sides.groupBy("_test").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
        if checks.filter((F.col("n0") > 0) & (F.col("n1") > 0)).count() == 2:
            side = F.when(F.col("_test"), "test").otherwise("train").alias("side")
            return join_groups(rows, sides.select("_group", side, "n"), ["_group"], "n").drop("_group"), attempt
    raise ValueError(f"no seed gives both labels on both sides of groups of {group}")


def group_split_any(df: DataFrame, groups: list[str], label: str, **options) -> tuple[DataFrame, str, int]:
    """The first group column that can be split; (rows, column, seed)."""
    failure: ValueError | None = None
    for group in groups:
        if group not in df.columns:
            continue
        try:
            rows, seed = group_split(df, group, label, **options)
            return rows, group, seed
        except ValueError as exc:
            failure = exc
    raise failure or ValueError("no group column is available")


def inner_split(
    train: DataFrame, key: str, group: str, label: str, fraction: float = INNER_FRACTION, seed: int = SPLIT_SEED
) -> tuple[DataFrame, str]:
    """Validation share inside the training rows: by group, else stratified; (rows, method)."""
    try:
        return group_split(train, group, label, fraction, seed + 100)[0], "grouped"
    except ValueError:
        return stratified_split(train, key, label, fraction, seed), "random_stratified_fallback"


def logo_folds(
    df: DataFrame, group: str, label: str, min_rows: int = MIN_SOURCE_ROWS, min_class: int = MIN_CLASS_ROWS
) -> DataFrame:
    """One row per held-out group with sizes, label counts and the reason it is skipped.

    Training counts are the totals minus the group: one aggregation for all folds.
    """
    test = df.groupBy(F.col(group).alias("fold")).agg(
        F.count("*").alias("test_rows"),
        F.count_if(F.col(label) == 0).alias("test_0"), F.count_if(F.col(label) == 1).alias("test_1"),
    )
    total = test.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("test_rows", "test_0", "test_1")]).first()
    folds = test.withColumns({
        "train_rows": F.lit(total["test_rows"]) - F.col("test_rows"),
        "train_0": F.lit(total["test_0"]) - F.col("test_0"),
        "train_1": F.lit(total["test_1"]) - F.col("test_1"),
    })
    reason = (
        F.when(F.col("test_rows") < min_rows, "too_few_test_rows")
        .when((F.col("train_0") == 0) | (F.col("train_1") == 0), "train_single_class")
        .when((F.col("test_0") < min_class) | (F.col("test_1") < min_class), "test_insufficient_class_counts")
        .otherwise("ok")
    )
    return folds.withColumn("reason", reason).withColumn("valid", F.col("reason") == "ok")


def assign_folds(df: DataFrame, group: str, label: str, k: int = 5) -> DataFrame:
    """Fold per group: groups by positives and size, dealt forth and back over the folds."""
    rows = with_group(df, group)
    groups = rows.groupBy("_group").agg(F.count_if(F.col(label) == 1).alias("n1"), F.count("*").alias("n"))
    order = [F.col("n1").desc(), F.col("n").desc(), F.col("_group")]
    placed = global_position(groups, order, "_p")
    lap, seat = F.floor((F.col("_p") - 1) / k), F.pmod(F.col("_p") - 1, F.lit(k))
    fold = F.when(lap % 2 == 0, seat).otherwise(k - 1 - seat).cast("int")
    return join_groups(rows, placed.select("_group", fold.alias("fold"), "n"), ["_group"], "n").drop("_group")


def balance(a: DataFrame, b: DataFrame, key: str, cap: int | None = None, seed: int = SPLIT_SEED) -> tuple[DataFrame, DataFrame, int]:
    """The same number of rows of both classes, on request at most the cap; (a, b, rows per class)."""
    n = min(x for x in (a.count(), b.count(), cap) if x is not None)
    parts = [draw(df, key, [], F.lit(n), seed).filter("drawn").drop("drawn") for df in (a, b)]
    return parts[0], parts[1], n


def matched_sample(
    a: DataFrame, b: DataFrame, key: str, bin_: str, seed: int = SPLIT_SEED
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Per bin the smaller count from both sides; (a, b, audit of the bins of a)."""
    narrow = [cut_lineage(df.select(key, bin_)) for df in (a, b)]
    left = narrow[0].groupBy(bin_).agg(F.count("*").alias("left_rows"))
    right = narrow[1].groupBy(bin_).agg(F.count("*").alias("right_rows"))
    audit = left.join(right, bin_, "left").na.fill(0, ["right_rows"])
    audit = cut_lineage(audit.withColumn("wanted", F.least("left_rows", "right_rows")))
    goal = audit.select(bin_, "wanted")
    sides = []
    for df, keys in zip((a, b), narrow):
        keys = join_on(keys, goal.filter("wanted > 0").select(bin_), [bin_], "left_semi")
        drawn = draw(keys, key, [bin_], goal, seed).filter("drawn").select(key)
        sides.append(df.join(drawn, key, "left_semi"))
    return sides[0], sides[1], audit.withColumnRenamed("wanted", "matched_rows")


def split_report(df: DataFrame, side: str, label: str, group: str) -> DataFrame:
    """Sizes, label counts and group counts per side, and the groups on both sides."""
    report = df.groupBy(side).agg(
        F.count("*").alias("rows"), F.count_if(F.col(label) == 0).alias("label_0"),
        F.count_if(F.col(label) == 1).alias("label_1"), F.count_distinct(group).alias("groups"),
    )
    train, test = df.filter(F.col(side) == "train"), df.filter(F.col(side) == "test")
    shared = group_overlap(train, test, group).count()
    return report.withColumn("group_overlap", F.lit(shared).cast("long"))


def out_of_fold(
    df: DataFrame, folds: list[int], fit_and_score: Callable[[DataFrame, DataFrame], DataFrame]
) -> DataFrame:
    """Scores of every row from a model that saw none of its fold; some fits run side by side."""
    parts = side_by_side(
        lambda fold: cut_lineage(fit_and_score(df.filter(F.col("fold") != fold), df.filter(F.col("fold") == fold))), folds)
    first, *others = parts
    for other in others:
        first = first.unionByName(other)
    return first
