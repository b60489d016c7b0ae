"""Ranking strategies over scored rows and their yield at fixed review budgets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from curatrix.constants import BUDGETS
from curatrix.lineage import cut_lineage
from curatrix.operators.joins import with_param
from curatrix.operators.ordered import global_position, round_robin, top_k, top_n_per_group


def _orders(score: str, tie: str) -> dict[str, list]:
    best_first = [F.col(score).desc(), F.col(tie)]
    return {"highest_score": best_first, "uncertainty": [F.abs(F.col(score) - 0.5), *best_first]}


def all_strategies(df: DataFrame, score: str, tie: str, groups: dict[str, str]) -> DataFrame:
    """Every row with its position under every strategy."""
    ranked = [
        global_position(df, order).withColumn("strategy", F.lit(name)) for name, order in _orders(score, tie).items()
    ]
    for name, group in groups.items():
        ranked.append(round_robin(df, group, score, tie).drop("rank_in_group").withColumn("strategy", F.lit(name)))
    return reduce(DataFrame.unionByName, ranked)


def strategy_top(df: DataFrame, score: str, tie: str, groups: dict[str, str], k: int) -> DataFrame:
    """First k rows of every strategy.

    A row among the first k of a round robin is among the first k of its group, so groups are
    cut to k rows before anything is sorted as a whole.
    """
    parts = [top_k(df, order, k, "position").withColumn("strategy", F.lit(name)) for name, order in _orders(score, tie).items()]
    for name, group in groups.items():
        filled = df.withColumn(group, F.coalesce(F.col(group), F.lit("missing")))
        near = top_n_per_group(filled, [group], [F.col(score).desc(), F.col(tie)], k, "_in_group")
        order = [F.col("_in_group"), F.col(score).desc(), F.col(group), F.col(tie)]
        parts.append(top_k(near, order, k, "position").drop("_in_group").withColumn("strategy", F.lit(name)))
    return reduce(DataFrame.unionByName, parts)


def budget_evaluation(
    df: DataFrame, label: str, score: str, tie: str, groups: dict[str, str], budgets: list[int] = BUDGETS
) -> DataFrame:
    """Hits per strategy among the first rows, for every budget."""
    first = strategy_top(df, score, tie, groups, max(budgets))
    return (
        first.select("strategy", "position", label, with_param("budget", budgets))
        .filter(F.col("position") <= F.col("budget"))
        .groupBy("strategy", "budget")
        .agg(F.count("*").alias("selected_count"), F.count_if(F.col(label) == 1).alias("positive_count"))
        .withColumn("precision", F.col("positive_count") / F.col("selected_count"))
    )


def random_reference(
    df: DataFrame, label: str, key: str, budgets: list[int], repeats: int = 100, seed: int = 42
) -> DataFrame:
    """Mean and deviation of hits over repeated random draws of each budget size.

    A draw is the first rows by SHA-256 of (key, repeat, seed). A row goes on only for the repeats in which
    its hash is below a bound a little above the budget's share; the bound doubles until every repeat has
    enough rows.
    """
    rows = df.count()
    most = min(max(budgets), rows)
    hashes = F.transform(F.sequence(F.lit(0), F.lit(repeats - 1)), lambda r: F.struct(
        r.alias("repeat"), F.sha2(F.concat_ws(":", F.col(key).cast("string"), r.cast("string"), F.lit(str(seed))), 256).alias("_h")))
    share = (1.5 * most + 50) / max(rows, 1)
    while True:
        bound = f"{int(min(share, 1.0) * (16**8 - 1)):08x}" + "g"  # above every hash with these eight digits
        near = cut_lineage(df.select(key, label, F.explode(F.filter(hashes, lambda h: h["_h"] < bound)).alias("_d")).select(key, label, "_d.*"))
        full = near.groupBy("repeat").count().filter(F.col("count") >= most).count()
        if share >= 1.0 or full == repeats:
            break
        share *= 2
    order = W.partitionBy("repeat").orderBy("_h", key)
    drawn = near.withColumn("_place", F.row_number().over(order)).filter(F.col("_place") <= most)
    hits = (
        drawn.select("repeat", "_place", label, with_param("budget", budgets))
        .filter(F.col("_place") <= F.col("budget"))
        .groupBy("budget", "repeat")
        .agg(F.count("*").alias("n"), F.count_if(F.col(label) == 1).alias("hits"))
    )
    return hits.groupBy("budget").agg(
        F.max("n").alias("selected_count"), F.avg("hits").alias("positive_count_mean"),
        F.stddev_samp("hits").alias("positive_count_std"),
        F.avg(F.col("hits") / F.col("n")).alias("precision_mean"),
        F.stddev_samp(F.col("hits") / F.col("n")).alias("precision_std"),
    )
