"""Order-dependent operators, with one key that holds a third of all rows."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from curatrix.operators import ordered as O
from curatrix.operators import strategies as S


def skewed(spark, n=6000):
    group = F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 40))
    return spark.range(n).select("id", group.alias("g"), (F.col("id") * 7919 % 97).cast("double").alias("v"))


def test_positions_and_groups(spark):
    pdf = skewed(spark).toPandas().sort_values(["v", "id"], ascending=[False, True])
    pdf["want"] = pdf.groupby("g").cumcount() + 1
    got = O.position_in_group(skewed(spark), ["g"], [F.col("v").desc(), F.col("id")], "p").toPandas()
    both = got.merge(pdf[["id", "want"]], on="id")
    assert len(both) == 6000 and (both["p"] == both["want"]).all()
    ids = O.with_row_id(skewed(spark), ["v", "id"], "r").toPandas().sort_values(["v", "id"])
    assert ids["r"].tolist() == list(range(6000))


def test_prefix_sums(spark):
    df = skewed(spark).groupBy("g", "v").agg(F.count("*").alias("n"))
    got = O.prefix_sums(df, ["g"], [F.col("v").desc()], {"upto": "n"}).toPandas().sort_values(["g", "v"], ascending=[True, False])
    assert (got.groupby("g")["n"].cumsum() == got["upto"]).all()


def test_exact_quantiles(spark):
    got = O.exact_quantiles(skewed(spark), ["g"], "v", {"a": 0.25, "b": 0.9}).toPandas().set_index("g")
    want = skewed(spark).toPandas().groupby("g")["v"].quantile([0.25, 0.9]).unstack()
    assert np.allclose(got.loc[want.index, "a"], want[0.25]) and np.allclose(got.loc[want.index, "b"], want[0.9])


def test_draw_takes_exact_numbers(spark):
    drawn = O.draw(skewed(spark), "id", ["g"], F.ceil(F.col("n") * 0.2), 42).toPandas()
    want = drawn.groupby("g").size().mul(0.2).apply(np.ceil)
    assert (drawn.groupby("g")["drawn"].sum() == want).all() and len(drawn) == 6000
    assert O.draw(skewed(spark), "id", [], F.lit(17), 1).filter("drawn").count() == 17
    assert O.draw(skewed(spark), "id", [], F.lit(10**9), 1).filter("drawn").count() == 6000
    again = O.draw(skewed(spark).repartition(5), "id", ["g"], F.ceil(F.col("n") * 0.2), 42).filter("drawn")
    assert set(r["id"] for r in again.collect()) == set(drawn.loc[drawn["drawn"], "id"])


def test_dedup_ignores_partitioning(spark):
    want = {(r["g"], r["id"]) for r in O.dedup_first(skewed(spark), ["g"], "id").collect()}
    got = {(r["g"], r["id"]) for r in O.dedup_first(skewed(spark).repartition(7, "v"), ["g"], "id").collect()}
    assert got == want and ("hot", 0) in want


def test_short_ids_keep_all_digits(spark):
    df = spark.range(1200).select(F.lpad(F.col("id").cast("string"), 6, "0").alias("h"))
    ids = [r["s"] for r in O.short_ids(df, "h", "s").orderBy("h").collect()]
    assert ids[0] == "source_001" and ids[1199] == "source_1200" and len(set(ids)) == 1200


def test_strategy_top_agrees_with_full_order(spark):
    df = skewed(spark).select("id", "g", (F.col("v") / 97).alias("score"), (F.col("id") % 2).alias("label"))
    full = S.all_strategies(df, "score", "id", {"by_g": "g"}).filter("position <= 30").select("strategy", "id", "position")
    top = S.strategy_top(df, "score", "id", {"by_g": "g"}, 30).select("strategy", "id", "position")
    assert full.exceptAll(top).count() == 0 and top.count() == 90


def test_random_reference_is_whole(spark):
    df = spark.range(3000).select("id", (F.col("id") % 4 == 0).cast("int").alias("label"))
    got = S.random_reference(df, "label", "id", [50, 5000], repeats=30).toPandas().set_index("budget")
    assert got.loc[5000, "selected_count"] == 3000 and abs(got.loc[50, "precision_mean"] - 0.25) < 0.05
    assert isinstance(got, pd.DataFrame) and got.loc[5000, "positive_count_std"] == 0.0
