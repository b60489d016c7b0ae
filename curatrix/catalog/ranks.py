"""F and G: order, ranks, top rows and ranking strategies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curatrix.catalog.base import RECORDS, Tables, query, rounded
from curatrix.catalog.rows import SCORED_SQL, scored
from curatrix.functions.text import hash_id
from curatrix.operators import ordered as O
from curatrix.operators import strategies as S
from curatrix.operators.metrics import score_curve

W = "WITH "


@query("f2_rank_in_group", "SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_quantity DESC, l_orderkey, l_linenumber) AS rank FROM lineitem")
def f2(t: Tables) -> DataFrame:
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity")
    order = [F.col("l_quantity").desc(), F.col("l_orderkey"), F.col("l_linenumber")]
    return O.position_in_group(rows, ["l_returnflag"], order, "rank").select("l_orderkey", "l_linenumber", "rank")


@query("f3_group_size", "SELECT doc_id, count(*) OVER (PARTITION BY lang, source) AS group_size FROM documents")
def f3(t: Tables) -> DataFrame:
    return O.group_size(t.documents, ["lang", "source"]).select("doc_id", "group_size")


@query("f4_best_per_group", f"""{W}{SCORED_SQL} SELECT row_id, lang, source, group_size FROM (SELECT *, count(*) OVER (PARTITION BY lang, source) AS group_size,
  row_number() OVER (PARTITION BY lang, source ORDER BY score DESC, confidence_score DESC, risk_score, row_id) AS rn FROM scored) WHERE rn = 1""")
def f4(t: Tables) -> DataFrame:
    order = [F.col("score").desc(), F.col("confidence_score").desc(), F.col("risk_score"), F.col("row_id")]
    return O.best_per_group(scored(t), ["lang", "source"], order).select("row_id", "lang", "source", "group_size")


@query("f5_top_n_per_group", "SELECT o_orderkey, o_custkey, rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 3")
def f5(t: Tables) -> DataFrame:
    return O.top_n_per_group(t.orders, ["o_custkey"], [F.col("o_totalprice").desc(), F.col("o_orderkey")], 3).select("o_orderkey", "o_custkey", "rank")


@query("f6_round_robin", f"""{W}{RECORDS}, r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, row_id) AS k FROM rec)
  SELECT row_id, row_number() OVER (ORDER BY k, score DESC, lang, row_id) AS position FROM r""")
def f6(t: Tables) -> DataFrame:
    return O.round_robin(t.records.select("row_id", "lang", "score"), "lang", "score", "row_id").select("row_id", "position")


@query("f7_global_rank", "SELECT l_orderkey, l_linenumber, row_number() OVER (ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS rank FROM lineitem")
def f7(t: Tables) -> DataFrame:
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_extendedprice")
    return O.global_position(rows, [F.col("l_extendedprice").desc(), "l_orderkey", "l_linenumber"], "rank").select("l_orderkey", "l_linenumber", "rank")


@query("f8_short_ids", "SELECT doc_id, 'source_' || lpad(CAST(dense_rank() OVER (ORDER BY sha256(source)) AS VARCHAR), 3, '0') AS short_id FROM documents")
def f8(t: Tables) -> DataFrame:
    return O.short_ids(t.documents.select("doc_id", hash_id("source").alias("h")), "h", "short_id").select("doc_id", "short_id")


@query("f9_score_curve", """WITH c AS (SELECT l_returnflag, l_quantity AS score, count(*) FILTER (l_tax > 0.04) AS pos, count(*) FILTER (NOT l_tax > 0.04) AS neg FROM lineitem GROUP BY 1, 2)
  SELECT l_returnflag, score, CAST(sum(pos) OVER w AS BIGINT) AS tp, CAST(sum(neg) OVER w AS BIGINT) AS fp FROM c WINDOW w AS (PARTITION BY l_returnflag ORDER BY score DESC)""")
def f9(t: Tables) -> DataFrame:
    df = t.lineitem.select("l_returnflag", F.col("l_quantity").alias("score"), (F.col("l_tax") > 0.04).cast("int").alias("y"))
    return score_curve(df, "y", "score", ["l_returnflag"]).select("l_returnflag", "score", "tp", "fp")


@query("g1_sort_stable", "SELECT c_custkey, c_mktsegment, c_acctbal FROM customer ORDER BY c_mktsegment, c_acctbal DESC, c_custkey")
def g1(t: Tables) -> DataFrame:
    return O.sort_stable(t.customer, ["c_mktsegment", F.col("c_acctbal").desc()], "c_custkey").select("c_custkey", "c_mktsegment", "c_acctbal")


@query("g2_cap_rows", "SELECT l_orderkey, l_linenumber FROM lineitem ORDER BY l_shipdate, l_orderkey, l_linenumber LIMIT 50000")
def g2(t: Tables) -> DataFrame:
    return O.cap_rows(t.lineitem, ["l_shipdate", "l_orderkey", "l_linenumber"], 50_000).select("l_orderkey", "l_linenumber")


@query("g3_top_k", f"{W}{RECORDS} SELECT row_id, row_number() OVER (ORDER BY score DESC, row_id) AS rank FROM rec ORDER BY rank LIMIT 100")
def g3(t: Tables) -> DataFrame:
    return O.top_k(t.records, [F.col("score").desc(), F.col("row_id")], 100).select("row_id", "rank")


STRATEGY_SQL = f"""{SCORED_SQL}, rr AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, row_id) AS k1,
  row_number() OVER (PARTITION BY source ORDER BY score DESC, row_id) AS k2 FROM scored WHERE label IS NOT NULL),
strat AS (SELECT 'highest_score' AS strategy, row_id, label, row_number() OVER (ORDER BY score DESC, row_id) AS position FROM rr
  UNION ALL SELECT 'uncertainty', row_id, label, row_number() OVER (ORDER BY abs(score - 0.5), score DESC, row_id) FROM rr
  UNION ALL SELECT 'by_lang', row_id, label, row_number() OVER (ORDER BY k1, score DESC, lang, row_id) FROM rr
  UNION ALL SELECT 'by_source', row_id, label, row_number() OVER (ORDER BY k2, score DESC, source, row_id) FROM rr)"""


def labelled(t: Tables) -> DataFrame:
    return scored(t).filter("label IS NOT NULL").select("row_id", "label", "score", "lang", "source")


@query("g4_ranking_strategies", f"{W}{STRATEGY_SQL} SELECT strategy, row_id, position FROM strat")
def g4(t: Tables) -> DataFrame:
    return S.all_strategies(labelled(t), "score", "row_id", {"by_lang": "lang", "by_source": "source"}).select("strategy", "row_id", "position")


@query("m11_budget_evaluation", f"""{W}{STRATEGY_SQL} SELECT strategy, budget, count(*) AS selected_count, count(*) FILTER (label = 1) AS positive_count,
  round(CAST(positive_count AS DOUBLE) / selected_count, 6) AS "precision" FROM strat, (SELECT unnest([25, 50, 100, 200]) AS budget) WHERE position <= budget GROUP BY 1, 2""")
def m11(t: Tables) -> DataFrame:
    return rounded(S.budget_evaluation(labelled(t), "label", "score", "row_id", {"by_lang": "lang", "by_source": "source"}, [25, 50, 100, 200]))


@query("m11_random_reference", f"""{W}{RECORDS}, r AS (SELECT *, row_number() OVER (PARTITION BY rep ORDER BY sha256(row_id || ':' || rep || ':42'), row_id) AS place
    FROM rec, range(100) t(rep) WHERE label IS NOT NULL),
  h AS (SELECT budget, rep, count(*) AS n, count(*) FILTER (label = 1) AS hits FROM r, (VALUES (25), (50), (100), (200)) b(budget) WHERE place <= budget GROUP BY 1, 2)
  SELECT budget, max(n) AS selected_count, round(avg(hits), 6) AS positive_count_mean, round(stddev_samp(hits), 6) AS positive_count_std,
  round(avg(hits / n), 6) AS precision_mean, round(stddev_samp(hits / n), 6) AS precision_std FROM h GROUP BY 1""")
def m11_random(t: Tables) -> DataFrame:
    return rounded(S.random_reference(labelled(t), "label", "row_id", [25, 50, 100, 200], repeats=100))


@query("g5_select_best", """WITH g AS (SELECT l_suppkey, CASE WHEN l_suppkey % 4 = 0 THEN NULL ELSE avg(l_discount) END AS pr_auc, avg(l_tax) AS roc_auc FROM lineitem GROUP BY 1)
  SELECT l_suppkey, round(pr_auc, 6) AS pr_auc, round(roc_auc, 6) AS roc_auc FROM g ORDER BY pr_auc DESC NULLS LAST, roc_auc DESC NULLS LAST, l_suppkey LIMIT 1""")
def g5(t: Tables) -> DataFrame:
    g = t.lineitem.groupBy("l_suppkey").agg(F.avg("l_discount").alias("d"), F.avg("l_tax").alias("roc_auc"))
    g = g.withColumn("pr_auc", F.when(F.col("l_suppkey") % 4 != 0, F.col("d")))
    best = O.select_best(g, [F.col("pr_auc").desc_nulls_last(), F.col("roc_auc").desc_nulls_last(), F.col("l_suppkey")])
    return rounded(best.select("l_suppkey", "pr_auc", "roc_auc"))
