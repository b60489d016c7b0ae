"""Rows that meet one value per group stay spread where the groups are few."""

from pyspark.sql import functions as F

from curatrix.operators import features as FE
from curatrix.operators import ordered as O
from curatrix.operators import splits as SP


def shuffled_rows(df):
    """Shuffles of the plan as text, without those of the counts of pieces."""
    return [line for line in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning" in line and "(_piece#" not in line]


def table(spark, n=1000):
    return spark.range(n).select("id", F.when(F.col("id") % 10 > 0, F.lit("a")).when(F.col("id") % 20 > 0, F.lit("b")).alias("g"), (F.floor(F.col("id") / 100) % 2).cast("int").alias("label"))


def unbroadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    return before


def test_few_groups_move_no_rows(spark):
    before = unbroadcast(spark)
    try:
        df = table(spark)
        made = [O.draw(df, "id", ["g"], SP.share(0.2), 1), O.position_in_group(df, ["g"], [F.col("id")]), SP.group_split(df, "g", "label")[0],
                SP.assign_folds(df, "g", "label", 2)]
        variants = {"all": (F.col("g"), None), "some": (F.col("g"), F.col("label") == 1)}
        long, _ = FE.build_variants(df, "id", "label", variants, 10, 1)
        assert [shuffled_rows(m) for m in made] == [[]] * 4
        assert not any("variant" in line and "id#" in line for line in shuffled_rows(long)) and "SortMergeJoin" not in long._jdf.queryExecution().executedPlan().toString()
        places = {r["id"]: r["position"] for r in made[1].collect()}
        assert [places[i] for i in (0, 20, 1, 2, 11, 10, 30)] == [1, 2, 1, 2, 10, 1, 2]
        assert long.filter("variant = 'some'").count() == 475  # null texts take no part
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_many_groups_and_a_hot_one(spark):
    df = spark.range(3000).select("id", F.when(F.col("id") % 3 > 0, F.col("id") % 997).alias("g"))
    groups = df.groupBy("g").agg(F.count("*").alias("n"), F.max("id").alias("top")).filter("g is null or g <> 5")
    got = {r["id"]: (r["g"], r["top"]) for r in O.join_groups(df, groups, ["g"], "n").collect()}
    tops = {}
    for i in range(3000):
        tops[i % 997 if i % 3 else None] = i
    assert got == {i: ((g := i % 997 if i % 3 else None), None if g == 5 else tops[g]) for i in range(3000)}
