"""Profiles and summaries. Counts combine before the shuffle; no group is collected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curatrix.functions.text import all_of, hash_id, is_missing, is_missing_text, norm_text
from curatrix.operators.ordered import exact_quantiles, join_on, top_n_per_group

QUARTILES = {"p25": 0.25, "p50": 0.5, "p75": 0.75}


def value_counts(df: DataFrame, column: str, n: int | None = None, missing: str = "missing") -> DataFrame:
    """Rows per value, most frequent first, ties by value."""
    value = F.coalesce(F.col(column).cast("string"), F.lit(missing)).alias("value")
    ordered = df.groupBy(value).agg(F.count("*").alias("count")).orderBy(F.col("count").desc(), "value")
    return ordered.limit(n) if n else ordered


def long_counts(df: DataFrame, columns: list[str], missing: str = "missing") -> DataFrame:
    """Value counts of several columns as (metric, value, count): one shuffle of counts."""
    cells = F.explode(F.array(*[
        F.struct(F.lit(c).alias("metric"), F.coalesce(F.col(c).cast("string"), F.lit(missing)).alias("value"))
        for c in columns
    ])).alias("cell")
    return df.select(cells).groupBy("cell.metric", "cell.value").agg(F.count("*").alias("count"))


def label_counts(df: DataFrame, label: str = "label", by: list[str] | None = None) -> DataFrame:
    return df.groupBy(*(by or [])).agg(
        F.count_if(F.col(label) == 0).alias("label_0"), F.count_if(F.col(label) == 1).alias("label_1")
    )


def missing_profile(df: DataFrame, markers: list[str] | None = None, tokens: bool = False) -> DataFrame:
    """Missing and present cells per column: one pass, then turned to rows."""
    test = is_missing_text if tokens else (lambda c: is_missing(c, markers))
    counts = df.agg(*[F.count_if(test(F.col(c))).alias(c) for c in df.columns], F.count("*").alias("_rows"))
    rows = counts.unpivot(["_rows"], df.columns, "column", "missing")
    share = F.when(F.col("_rows") > 0, F.round(F.col("missing") / F.col("_rows") * 100, 2)).otherwise(0.0)
    return rows.select(
        "column", "missing", (F.col("_rows") - F.col("missing")).alias("non_missing"), share.alias("missing_percent")
    )


def melt(df: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """(by, column, value) rows of numeric columns."""
    cells = F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns
    ])).alias("cell")
    return df.select(*by, cells).select(*by, "cell.column", "cell.value")


def describe_numeric(df: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """Count, mean, sample deviation, range and exact quartiles per column and group."""
    keys = [*(by or []), "column"]
    cells = melt(df, by or [], columns).filter(F.col("value").isNotNull())
    moments = cells.groupBy(*keys).agg(
        F.count("value").alias("count"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"),
    )
    return join_on(moments, exact_quantiles(cells, keys, "value", QUARTILES), keys)


def value_preview(df: DataFrame, columns: list[str], order: str, n: int = 8) -> DataFrame:
    """First n distinct present values per column, in row order."""
    cells = F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).alias("value"), (~is_missing(c)).alias("present"))
        for c in columns
    ])).alias("cell")
    firsts = (
        df.select(order, cells).filter("cell.present")
        .groupBy("cell.column", "cell.value").agg(F.min(order).alias("first_row"))
    )
    return top_n_per_group(firsts, ["column"], ["first_row", "value"], n, "place")


def column_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value, rows) of trimmed text columns, blanks included."""
    cells = F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), norm_text(c).alias("value")) for c in columns
    ])).alias("cell")
    return df.select(cells).groupBy("cell.column", "cell.value").agg(F.count("*").alias("rows"))


def group_column_status(df: DataFrame, columns: list[str]) -> DataFrame:
    """Whether a column can group rows, with the reason where it cannot."""
    counts = column_counts(df, columns)
    filled = F.col("value") != ""
    stats = counts.groupBy("column").agg(
        F.sum("rows").alias("row_count"),
        F.coalesce(F.sum(F.when(~filled, F.col("rows"))), F.lit(0)).alias("missing_count"),
        F.coalesce(F.sum(F.when(filled, F.col("rows"))), F.lit(0)).alias("non_missing_count"),
        F.count_if(filled).alias("unique_count"),
    )
    unique, present = F.col("unique_count"), F.col("non_missing_count")
    reason = (
        F.when(present == 0, "empty")
        .when(F.col("missing_count") / F.col("row_count") >= 0.50, "mostly_empty")
        .when(unique >= present, "no_repeated_values")
        .when((unique / F.col("row_count") >= 0.80) | (unique / present >= 0.90), "near_row_unique")
        .otherwise("ok")
    )
    return stats.withColumn("reason", reason).withColumn("useful_for_grouping", F.col("reason") == "ok")


def top_hashed_values(df: DataFrame, columns: list[str], n: int = 20) -> DataFrame:
    """Most frequent values per column under neutral ids."""
    filled = column_counts(df, columns).filter(F.col("value") != "")
    hashed = filled.select("column", hash_id("value", 12, "value_").alias("value_id"), F.col("rows").alias("count"))
    return top_n_per_group(hashed, ["column"], [F.col("count").desc(), F.col("value_id")], n)


def group_balance(df: DataFrame, group: str, label: str = "label", min_rows: int = 30, min_class: int = 5) -> DataFrame:
    """Rows and labels per group, and whether the group can be held out."""
    counts = df.groupBy(group).agg(
        F.count("*").alias("row_count"),
        F.count_if(F.col(label) == 0).alias("label_0"), F.count_if(F.col(label) == 1).alias("label_1"),
    )
    return counts.withColumn("usable", all_of([
        F.col("row_count") >= min_rows, F.col("label_0") >= min_class, F.col("label_1") >= min_class,
    ]))


def count_flags(df: DataFrame, flags: dict[str, Column]) -> DataFrame:
    """Many conditional counts in one row."""
    return df.agg(*[F.count_if(condition).alias(name) for name, condition in flags.items()])


def subgroup_summary(df: DataFrame, columns: list[str], score: str, label: str = "label") -> DataFrame:
    """Rows, labels and scores per value of several subgroup columns."""
    cells = F.explode(F.array(*[
        F.struct(F.lit(c).alias("subgroup_type"),
                 F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")), F.lit("missing")).alias("subgroup_value"))
        for c in columns
    ])).alias("cell")
    keys = ["subgroup_type", "subgroup_value"]
    rows = df.select(F.col(label).alias("label"), F.col(score).alias("score"), cells).select("cell.*", "label", "score")
    stats = rows.groupBy(*keys).agg(
        F.count("*").alias("row_count"),
        F.count_if(F.col("label") == 0).alias("label_0"), F.count_if(F.col("label") == 1).alias("label_1"),
        F.min("score").alias("score_min"), F.avg("score").alias("score_mean"), F.max("score").alias("score_max"),
        F.count_if(F.col("score") >= 0.75).alias("high_score_count"),
    )
    return join_on(stats, exact_quantiles(rows, keys, "score", {"score_median": 0.5}), keys)


def crosstab(df: DataFrame, rows: str, columns: str, values: list[str]) -> DataFrame:
    """Counts of one column by the fixed values of another, zero filled."""
    return df.groupBy(rows).pivot(columns, values).count().na.fill(0)


def coverage(df: DataFrame, columns: list[str]) -> DataFrame:
    """True cells, share and rest per flag column."""
    counts = df.agg(
        *[F.count_if(F.lower(norm_text(c)).isin("true", "1", "yes")).alias(c) for c in columns],
        F.count("*").alias("_rows"),
    )
    rows = counts.unpivot(["_rows"], columns, "column", "true_count")
    return rows.select(
        "column", "true_count", (F.col("_rows") - F.col("true_count")).alias("false_or_missing"),
        (F.col("true_count") / F.col("_rows")).alias("fraction"),
    )


def compare_columns(df: DataFrame, existing: str, annotated: str) -> DataFrame:
    a, b = F.coalesce(F.col(existing), F.lit("")), F.coalesce(F.col(annotated), F.lit(""))
    both = (a != "") & (b != "")
    return count_flags(df, {
        "exact_match_count": both & (a == b), "mismatch_count": both & (a != b), "missing_count": ~both,
        "existing_nonempty_count": a != "", "annotated_nonempty_count": b != "",
    })


def metric_correlations(df: DataFrame, metrics: list[str], signals: list[str]) -> DataFrame:
    """Pearson correlation of metric and signal; null below three rows or on a constant."""
    cells = F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.lit(s).alias("signal"),
                 F.col(m).cast("double").alias("y"), F.col(s).cast("double").alias("x"))
        for m in metrics for s in signals
    ])).alias("cell")
    pairs = df.select(cells).select("cell.*").filter(F.col("x").isNotNull() & F.col("y").isNotNull())
    usable = (F.count("*") >= 3) & (F.min("x") < F.max("x")) & (F.min("y") < F.max("y"))
    spread = F.nullif(F.stddev_pop("x") * F.stddev_pop("y"), F.lit(0.0))  # corr() fails on constants
    return pairs.groupBy("metric", "signal").agg(
        F.count("*").alias("rows"), F.when(usable, F.covar_pop("x", "y") / spread).alias("correlation")
    )


def aggregate_folds(df: DataFrame, metrics: list[str], size: str, by: list[str] | None = None) -> DataFrame:
    """Macro mean and size-weighted mean per metric over the valid folds."""
    aggs = [F.count("*").alias("valid_folds")]
    for m in metrics:
        aggs.append(F.avg(m).alias(f"macro_{m}"))
        aggs.append((F.sum(F.col(m) * F.col(size)) / F.sum(size)).alias(f"weighted_{m}"))
    return df.groupBy(*(by or [])).agg(*aggs)


def aggregate_runs(df: DataFrame, by: list[str], metric: str, baseline: float | None = None) -> DataFrame:
    """Mean, sample deviation (0 for one run), range, and whether every run beats a baseline."""
    aggs = [
        F.count(metric).alias("runs"), F.avg(metric).alias("mean"),
        F.coalesce(F.stddev_samp(metric), F.lit(0.0)).alias("std"),
        F.min(metric).alias("min"), F.max(metric).alias("max"),
    ]
    if baseline is not None:
        aggs.append(F.coalesce(F.bool_and(F.col(metric) > baseline), F.lit(False)).alias("all_beat_baseline"))
    return df.groupBy(*by).agg(*aggs).withColumn("stable", F.col("std") <= 0.02)


def history_summary(df: DataFrame, run: str, epoch: str, train: str, loss: str, auc: str) -> DataFrame:
    """Best epochs, drop from the best and overfit flag per run: one aggregation."""
    first_best = F.struct(F.col(auc), -F.col(epoch))
    stats = df.groupBy(run).agg(
        F.max(auc).alias("best_auc"),
        F.max_by(epoch, F.when(F.col(auc).isNotNull(), first_best)).alias("best_auc_epoch"),
        F.min(loss).alias("best_loss"),
        F.min_by(epoch, F.when(F.col(loss).isNotNull(), F.struct(loss, epoch))).alias("best_loss_epoch"),
        F.max_by(auc, epoch).alias("last_auc"), F.max_by(loss, epoch).alias("last_loss"),
        F.min_by(train, epoch).alias("_first_train"), F.max_by(train, epoch).alias("_last_train"),
    )
    stats = (
        stats.withColumn("auc_drop", F.col("best_auc") - F.coalesce("last_auc", "best_auc"))
        .withColumn("loss_increase", F.coalesce("last_loss", "best_loss") - F.col("best_loss"))
        .withColumn("train_loss_drop", F.col("_first_train") - F.col("_last_train"))
    )
    overfit = (F.col("train_loss_drop") > 0) & ((F.col("auc_drop") > 0.02) | (F.col("loss_increase") > 0.05))
    return stats.withColumn("overfit", overfit).drop("_first_train", "_last_train")


def error_counts(df: DataFrame, group: str, truth: str, predictions: dict[str, str], n: int = 15) -> DataFrame:
    """Wrong predictions per group and model, groups with most errors first."""
    errors = [F.count_if(F.col(truth) != F.col(p)).alias(f"{name}_errors") for name, p in predictions.items()]
    counts = df.groupBy(group).agg(F.count("*").alias("rows"), *errors)
    total = sum((F.col(f"{name}_errors") for name in predictions), F.lit(0))
    return counts.withColumn("total_errors", total).orderBy(F.col("total_errors").desc(), group).limit(n)


def histogram(df: DataFrame, column: str, bins: int, by: list[str] | None = None) -> DataFrame:
    """Equal-width bins between the overall minimum and maximum, the last one closed."""
    low, high = df.agg(F.min(column), F.max(column)).first()
    if low is None:
        return df.limit(0).select(*(by or []), F.lit(0).alias("bin"), F.lit(0).alias("count"))
    width = (high - low) / bins or 1.0
    place = F.least(F.floor((F.col(column) - float(low)) / float(width)), F.lit(bins - 1)).cast("int")
    return df.filter(F.col(column).isNotNull()).groupBy(*(by or []), place.alias("bin")).agg(F.count("*").alias("count"))


def count_json(df: DataFrame, by: list[str], column: str, name: str) -> DataFrame:
    """Value counts per group as a JSON object with sorted keys.

    Values are categories; they are counted first, so an array holds one entry per category.
    """
    counted = df.groupBy(*by, F.col(column).cast("string").alias("_value")).agg(F.count("*").alias("_count"))
    entries = F.array_sort(F.collect_list(F.struct("_value", "_count")))
    return counted.groupBy(*by).agg(F.to_json(F.map_from_entries(entries)).alias(name))


def group_descriptor(df: DataFrame, group: str, categories: dict[str, str], means: dict[str, str]) -> DataFrame:
    """Category counts as JSON and mean values per group."""
    described = df.groupBy(group).agg(*[F.avg(c).alias(name) for name, c in means.items()])
    for name, column in categories.items():
        described = join_on(described, count_json(df, [group], column, name), [group])
    return described

