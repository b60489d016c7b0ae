"""Evaluation metrics over (label, score) rows, overall or per group.

Threshold-free metrics use running counts over distinct scores (``prefix_sums``), so equal
scores count once and a group of any size is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curatrix.constants import MIN_CLASS_ROWS, THRESHOLDS, TOP_K
from curatrix.operators.joins import with_param
from curatrix.operators.ordered import join_on, prefix_sums, top_k

CONFUSION = ["tn", "fp", "fn", "tp"]


def ratio(part: Column, whole: Column) -> Column:
    """Quotient, 0 where the divisor is 0."""
    return F.coalesce(part / F.nullif(whole, F.lit(0)), F.lit(0.0))


def confusion(df: DataFrame, y: str, prediction: str, by: list[str] | None = None) -> DataFrame:
    truth, guess = F.col(y) == 1, F.col(prediction) == 1
    return df.groupBy(*(by or [])).agg(
        F.count("*").alias("rows"),
        F.count_if(~truth & ~guess).alias("tn"), F.count_if(~truth & guess).alias("fp"),
        F.count_if(truth & ~guess).alias("fn"), F.count_if(truth & guess).alias("tp"),
    )


def classification_metrics(df: DataFrame, y: str, prediction: str, by: list[str] | None = None) -> DataFrame:
    """Confusion counts and the metrics from them; balanced accuracy is accuracy on one class."""
    tn, fp, fn, tp = (F.col(c) for c in CONFUSION)
    precision, recall = ratio(tp, tp + fp), ratio(tp, tp + fn)
    accuracy = (tp + tn) / F.col("rows")
    both = (tp + fn > 0) & (tn + fp > 0)
    return confusion(df, y, prediction, by).withColumns({
        "accuracy": accuracy,
        "balanced_accuracy": F.when(both, (ratio(tp, tp + fn) + ratio(tn, tn + fp)) / 2).otherwise(accuracy),
        "precision": precision, "recall": recall, "f1": ratio(2 * tp, 2 * tp + fp + fn),
    })


def score_curve(df: DataFrame, y: str, score: str, by: list[str] | None = None) -> DataFrame:
    """Per distinct score: positives and negatives at it (pos, neg) and at or above it (tp, fp)."""
    by = by or []
    ties = df.groupBy(*by, score).agg(
        F.count_if(F.col(y) == 1).alias("pos"), F.count_if(F.col(y) != 1).alias("neg")
    )
    return prefix_sums(ties, by, [F.col(score).desc()], {"tp": "pos", "fp": "neg"})


def ranking_metrics(
    df: DataFrame, y: str, score: str, by: list[str] | None = None, min_class: int = 1
) -> DataFrame:
    """ROC AUC with half credit for ties and step-sum average precision, from one curve.

    Null unless both classes reach ``min_class`` rows.
    """
    by = by or []
    curve = score_curve(df, y, score, by)
    above = F.col("tp") - F.col("pos")
    sums = curve.groupBy(*by).agg(
        F.sum("pos").alias("positives"), F.sum("neg").alias("negatives"),
        F.sum(F.col("neg") * (above + F.col("pos") / 2)).alias("_area"),
        F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))).alias("_steps"),
    )
    p, n = F.col("positives"), F.col("negatives")
    valid = (p >= min_class) & (n >= min_class)
    return sums.select(
        *by, "positives", "negatives",
        F.when(valid, F.col("_area") / (p * n)).alias("roc_auc"),
        F.when(valid, F.col("_steps") / p).alias("average_precision"),
    )


def roc_auc(df: DataFrame, y: str, score: str, by: list[str] | None = None, min_class: int = 1) -> DataFrame:
    return ranking_metrics(df, y, score, by, min_class).drop("average_precision")


def average_precision(df: DataFrame, y: str, score: str, by: list[str] | None = None, min_class: int = 1) -> DataFrame:
    return ranking_metrics(df, y, score, by, min_class).drop("roc_auc")


def full_metrics(
    df: DataFrame, y: str, score: str, by: list[str] | None = None, min_class: int = MIN_CLASS_ROWS,
    threshold: float = 0.5, prediction: str | None = None,
) -> DataFrame:
    """Classification and ranking metrics side by side."""
    by = by or []
    if prediction is None:
        prediction = "_prediction"
        df = df.withColumn(prediction, (F.col(score) >= threshold).cast("int"))
    left = classification_metrics(df, y, prediction, by)
    right = ranking_metrics(df, y, score, by, min_class)
    if by:
        return join_on(left, right, by)
    return join_on(left.withColumn("_one", F.lit(1)), right.withColumn("_one", F.lit(1)), ["_one"]).drop("_one")


def curves(df: DataFrame, y: str, score: str, by: list[str] | None = None) -> DataFrame:
    """Points of the ROC and of the precision-recall curve, one per distinct score."""
    by = by or []
    curve = score_curve(df, y, score, by)
    totals = df.groupBy(*by).agg(F.count_if(F.col(y) == 1).alias("_p"), F.count_if(F.col(y) != 1).alias("_n"))
    if by:
        joined = join_on(curve, totals, by)
    else:
        row = totals.first()
        joined = curve.withColumns({"_p": F.lit(row["_p"]), "_n": F.lit(row["_n"])})
    tp, fp = F.col("tp"), F.col("fp")
    return joined.select(
        *by, score, ratio(fp, F.col("_n")).alias("false_positive_rate"),
        ratio(tp, F.col("_p")).alias("recall"), ratio(tp, tp + fp).alias("precision"),
    )


def brier(df: DataFrame, y: str, score: str, by: list[str] | None = None) -> DataFrame:
    return df.groupBy(*(by or [])).agg(F.avg(F.pow(F.col(score) - F.col(y), F.lit(2))).alias("brier_score"))


def calibration(df: DataFrame, y: str, score: str, bins: int = 10) -> DataFrame:
    """Equal bins over [0, 1], the last one closed, empty ones kept."""
    place = F.least(F.floor(F.col(score) * bins), F.lit(bins - 1)).cast("int")
    filled = df.groupBy(place.alias("bin")).agg(
        F.count("*").alias("n"), F.avg(score).alias("mean_predicted"), F.avg(F.col(y).cast("double")).alias("observed"),
    )
    spark = df.sparkSession
    frame = spark.range(bins).select(F.col("id").cast("int").alias("bin"))
    low = F.col("bin") / bins
    return frame.join(filled, "bin", "left").select(
        "bin", low.alias("low"), ((F.col("bin") + 1) / bins).alias("high"),
        F.coalesce("n", F.lit(0)).alias("count"), "mean_predicted", "observed",
    )


def calibration_error(curve: DataFrame) -> DataFrame:
    """Expected calibration error from calibration bins."""
    gap = F.abs(F.col("mean_predicted") - F.col("observed"))
    return curve.agg((F.sum(F.col("count") * gap) / F.sum("count")).alias("ece"))


def threshold_sweep(df: DataFrame, y: str, score: str, thresholds: list[float] = THRESHOLDS) -> DataFrame:
    """Rows selected, coverage, precision, recall and F1 at each threshold, one pass."""
    picked = F.col(score) >= F.col("threshold")
    counts = df.select(y, score, with_param("threshold", thresholds)).groupBy("threshold").agg(
        F.count("*").alias("_rows"), F.count_if(picked).alias("selected"),
        F.count_if(picked & (F.col(y) == 1)).alias("_tp"), F.count_if(F.col(y) == 1).alias("_p"),
    )
    chosen, tp, p = F.col("selected"), F.col("_tp"), F.col("_p")
    return counts.select(
        "threshold", "selected", ratio(chosen, F.col("_rows")).alias("coverage"),
        ratio(tp, chosen).alias("precision"), ratio(tp, p).alias("recall"), ratio(2 * tp, chosen + p).alias("f1"),
    )


def best_threshold(sweep: DataFrame, target: float = 0.80, enough: int = 25) -> DataFrame:
    """Highest threshold at the target precision; else best precision on enough rows; else best."""
    rule = (
        F.when((F.col("precision") >= target) & (F.col("selected") > 0), 1)
        .when(F.col("selected") >= enough, 2).otherwise(3)
    )
    ranked = sweep.withColumn("rule", rule)
    first = F.when(F.col("rule") == 1, F.col("threshold")).otherwise(F.col("precision"))
    second = (
        F.when(F.col("rule") == 1, F.col("recall")).when(F.col("rule") == 2, F.col("threshold"))
        .otherwise(F.col("selected").cast("double"))
    )
    return ranked.orderBy("rule", first.desc(), second.desc(), "threshold").limit(1)


def topk_precision(df: DataFrame, y: str, score: str, tie: str, ks: list[int] = TOP_K) -> DataFrame:
    """Precision of the first k rows; k above the row count is left out."""
    first = top_k(df.select(y, score, tie), [F.col(score).desc(), F.col(tie)], max(ks))
    return (
        first.select(y, "rank", with_param("k", ks)).filter(F.col("rank") <= F.col("k"))
        .groupBy("k").agg(F.count("*").alias("selected_count"), F.count_if(F.col(y) == 1).alias("positive_count"))
        .filter(F.col("selected_count") == F.col("k"))
        .withColumn("precision", F.col("positive_count") / F.col("k"))
    )


def topk_enrichment(
    df: DataFrame, y: str, score: str, tie: str, ks: list[int], on_short: str = "skip"
) -> DataFrame:
    """Share of positives in the first k rows over the overall share.

    ``on_short``: ``skip`` drops k above the row count, ``clip`` uses all rows for it.
    """
    base = df.agg(F.avg(F.col(y).cast("double")).alias("b")).first()["b"]
    first = top_k(df.select(y, score, tie), [F.col(score).desc(), F.col(tie)], max(ks))
    counts = (
        first.select(y, "rank", with_param("k", ks)).filter(F.col("rank") <= F.col("k"))
        .groupBy("k").agg(F.count("*").alias("selected_count"), F.count_if(F.col(y) == 1).alias("positive_count"))
    )
    if on_short == "skip":
        counts = counts.filter(F.col("selected_count") == F.col("k"))
    share = F.col("positive_count") / F.col("selected_count")
    lift = share / F.lit(base) if base else F.lit(None).cast("double")
    return counts.withColumn("fraction", share).withColumn("enrichment", lift)


def subgroup_rows(df: DataFrame, columns: list[str], keep: list[str]) -> DataFrame:
    """One row per (row, subgroup column)."""
    cells = F.explode(F.array(*[
        F.struct(F.lit(c).alias("subgroup_type"),
                 F.coalesce(F.nullif(F.trim(F.col(c).cast("string")), F.lit("")), F.lit("missing")).alias("subgroup_value"))
        for c in columns
    ])).alias("cell")
    return df.select(*keep, cells).select("cell.*", *keep)


def subgroup_metrics(
    df: DataFrame, y: str, models: dict[str, str], columns: list[str], min_rows: int = 1, threshold: float = 0.5
) -> DataFrame:
    """All metrics per subgroup and model; models are score columns."""
    scores = F.explode(F.array(*[
        F.struct(F.lit(name).alias("model"), F.col(column).alias("model_score")) for name, column in models.items()
    ])).alias("m")
    rows = subgroup_rows(df, columns, [y, *models.values()]).select("subgroup_type", "subgroup_value", y, scores)
    rows = rows.select("subgroup_type", "subgroup_value", y, "m.*")
    by = ["subgroup_type", "subgroup_value", "model"]
    metrics = full_metrics(rows, y, "model_score", by, min_class=1, threshold=threshold)
    return metrics.filter(F.col("rows") >= min_rows).withColumn("positive_fraction", F.col("positives") / F.col("rows"))


def subgroup_deltas(metrics: DataFrame, first: str, second: str, names: list[str]) -> DataFrame:
    """Metrics of two models side by side and second minus first."""
    keys = ["subgroup_type", "subgroup_value", "rows", "positive_fraction"]
    wide = metrics.groupBy(*keys).pivot("model", [first, second]).agg(*[F.first(n).alias(n) for n in names])
    for n in names:
        wide = wide.withColumn(f"delta_{n}", F.col(f"{second}_{n}") - F.col(f"{first}_{n}"))
    return wide


def compare_models(metrics: DataFrame, model: str, baseline: str, names: list[str], by: list[str]) -> DataFrame:
    """Every model against the baseline of the same subset: deltas and beats flags."""
    base = metrics.filter(F.col(model) == baseline).select(*by, *[F.col(n).alias(f"_base_{n}") for n in names])
    joined = join_on(metrics, base, by, "left")
    for n in names:
        joined = joined.withColumn(f"delta_{n}", F.col(n) - F.col(f"_base_{n}"))
        joined = joined.withColumn(f"beats_{n}", F.col(n) > F.col(f"_base_{n}"))
    beats_all = None
    for n in names:
        beats_all = F.col(f"beats_{n}") if beats_all is None else beats_all & F.col(f"beats_{n}")
    return joined.withColumn("beats_all", beats_all).drop(*[f"_base_{n}" for n in names])


def prediction_table(rows: DataFrame, scores: dict[str, DataFrame], key: str, threshold: float = 0.5) -> DataFrame:
    """Rows with the scores and labels of several models, matched by id."""
    for name, frame in scores.items():
        rows = rows.join(frame.select(key, F.col("score").alias(f"{name}_score")), key)
        rows = rows.withColumn(f"{name}_label", (F.col(f"{name}_score") >= threshold).cast("int"))
    return rows
