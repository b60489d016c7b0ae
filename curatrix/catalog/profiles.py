"""E: profiles, counts and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curatrix.catalog.base import RECORDS, SEQUENCES, Tables, query, rounded
from curatrix.catalog.rows import MARKERS, SCORED_SQL, scored
from curatrix.constants import AUDIT_EMPTY_MARKERS
from curatrix.functions.values import region_group
from curatrix.operators import profile as P
from curatrix.operators.joins import first_nonblank
from curatrix.operators.ordered import duplicate_count, position_in_group

W = "WITH "


@query("e1_value_counts", "SELECT coalesce(CAST(quality AS VARCHAR), 'missing') AS value, count(*) AS count FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1")
def e1(t: Tables) -> DataFrame:
    return P.value_counts(t.records, "label")


@query("e1_value_counts_top", "SELECT source AS value, count(*) AS count FROM conversations JOIN documents ON conv_id = doc_id GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5")
def e1_top(t: Tables) -> DataFrame:
    joined = t.conversations.join(t.documents.select("doc_id", "source"), F.col("conv_id") == F.col("doc_id"))
    return P.value_counts(joined, "source", 5)


@query("e2_label_counts", f"{W}{RECORDS} SELECT source, count(*) FILTER (label = 0) AS label_0, count(*) FILTER (label = 1) AS label_1 FROM rec GROUP BY 1")
def e2(t: Tables) -> DataFrame:
    return P.label_counts(t.records, "label", ["source"])


PROFILE_COLUMNS = ("text", "lang", "source")


@query("e3_missing_profile", " UNION ALL ".join(f"""SELECT '{c}' AS "column", count(*) FILTER (trim(regexp_replace(lower({c}), '[^a-z0-9]+', ' ', 'g')) IN {MARKERS}) AS missing,
  count(*) FILTER (trim(regexp_replace(lower({c}), '[^a-z0-9]+', ' ', 'g')) NOT IN {MARKERS}) AS non_missing,
  round(100.0 * missing / count(*), 2) AS missing_percent FROM documents""" for c in PROFILE_COLUMNS))
def e3(t: Tables) -> DataFrame:
    return P.missing_profile(t.documents.select(*PROFILE_COLUMNS))


AUDIT_MARKERS = "(" + ", ".join(f"'{m}'" for m in AUDIT_EMPTY_MARKERS) + ")"


@query("e3_missing_profile_audit", " UNION ALL ".join(f"""SELECT '{c}' AS "column", count(*) FILTER (trim(regexp_replace(lower(x), '[^a-z0-9]+', ' ', 'g')) IN {AUDIT_MARKERS}) AS missing,
  count(*) FILTER (trim(regexp_replace(lower(x), '[^a-z0-9]+', ' ', 'g')) NOT IN {AUDIT_MARKERS}) AS non_missing, round(100.0 * missing / count(*), 2) AS missing_percent
  FROM (SELECT CASE WHEN o_orderkey % 7 = 0 THEN 'Not  Done' WHEN o_orderkey % 11 = 0 THEN 'N/A' ELSE {c} END AS x FROM orders)""" for c in ("o_orderstatus", "o_orderpriority")))
def e3_audit(t: Tables) -> DataFrame:
    """The wide list of markers, over columns that hold some of them."""
    key = F.col("o_orderkey")
    cell = lambda c: F.when(key % 7 == 0, "Not  Done").when(key % 11 == 0, "N/A").otherwise(F.col(c)).alias(c)
    return P.missing_profile(t.orders.select(cell("o_orderstatus"), cell("o_orderpriority")), AUDIT_EMPTY_MARKERS)


def describe_sql(table: str, column: str, by: str = "") -> str:
    group = f"{by}, " if by else ""
    return f"""SELECT {group}'{column}' AS "column", count(x) AS count, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS std,
  min(x) AS min, max(x) AS max, round(quantile_cont(x, 0.25), 6) AS p25, round(quantile_cont(x, 0.5), 6) AS p50, round(quantile_cont(x, 0.75), 6) AS p75
  FROM (SELECT {group}CAST({column} AS DOUBLE) AS x FROM {table}) {f'GROUP BY {by}' if by else ''}"""


@query("e4_describe_numeric", " UNION ALL ".join(describe_sql("lineitem", c) for c in ("l_quantity", "l_extendedprice", "l_discount")))
def e4(t: Tables) -> DataFrame:
    return rounded(P.describe_numeric(t.lineitem, ["l_quantity", "l_extendedprice", "l_discount"]))


@query("e4_describe_by_group", describe_sql("lineitem", "l_extendedprice", "l_returnflag"))
def e4_by(t: Tables) -> DataFrame:
    return rounded(P.describe_numeric(t.lineitem, ["l_extendedprice"], ["l_returnflag"]))


@query("e5_value_preview", " UNION ALL ".join(f"""SELECT '{c}' AS "column", value, first_row, place FROM (
  SELECT {c} AS value, min(o_orderkey) AS first_row, row_number() OVER (ORDER BY min(o_orderkey), {c}) AS place FROM orders
  WHERE trim(regexp_replace(lower({c}), '[^a-z0-9]+', ' ', 'g')) NOT IN {MARKERS} GROUP BY 1) WHERE place <= 8""" for c in ("o_orderstatus", "o_orderpriority")))
def e5(t: Tables) -> DataFrame:
    return P.value_preview(t.orders, ["o_orderstatus", "o_orderpriority"], "o_orderkey")


STATUS_COLUMNS = ["lang", "source", "doc_key", "blank", "rare"]
STATUS_SQL = """cols AS (SELECT lang, source, CAST(doc_id AS VARCHAR) AS doc_key, '' AS blank, CASE WHEN doc_id % 3 = 0 THEN lang ELSE ' ' END AS rare FROM documents),
cells AS (UNPIVOT cols ON lang, source, doc_key, blank, rare INTO NAME col VALUE v)"""


def status_rows(t: Tables) -> DataFrame:
    return t.documents.select("lang", "source", F.col("doc_id").cast("string").alias("doc_key"), F.lit("").alias("blank"),
                              F.when(F.col("doc_id") % 3 == 0, F.col("lang")).otherwise(" ").alias("rare"))


@query("e6_group_column_status", f"""{W}{STATUS_SQL}, s AS (SELECT col, count(*) AS row_count, count(*) FILTER (trim(v) = '') AS missing_count,
  count(*) FILTER (trim(v) <> '') AS non_missing_count, count(DISTINCT nullif(trim(v), '')) AS unique_count FROM cells GROUP BY 1)
  SELECT col AS "column", row_count, missing_count, non_missing_count, unique_count, CASE WHEN non_missing_count = 0 THEN 'empty'
  WHEN missing_count / row_count >= 0.5 THEN 'mostly_empty' WHEN unique_count >= non_missing_count THEN 'no_repeated_values'
  WHEN unique_count / row_count >= 0.8 OR unique_count / non_missing_count >= 0.9 THEN 'near_row_unique' ELSE 'ok' END AS reason,
  reason = 'ok' AS useful_for_grouping FROM s""")
def e6(t: Tables) -> DataFrame:
    return P.group_column_status(status_rows(t), STATUS_COLUMNS)


@query("e6_top_hashed_values", f"""{W}{STATUS_SQL}, c AS (SELECT col AS "column", 'value_' || left(sha256(trim(v)), 12) AS value_id, count(*) AS count
  FROM cells WHERE trim(v) <> '' GROUP BY ALL) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY count DESC, value_id) AS rank FROM c) WHERE rank <= 20""")
def e6_top(t: Tables) -> DataFrame:
    return P.top_hashed_values(status_rows(t), STATUS_COLUMNS)


@query("e7_first_nonblank", f"""{W}{RECORDS} SELECT source, coalesce(arg_min(light_raw, row_id) FILTER (trim(light_raw) <> ''), '') AS light_raw,
  coalesce(arg_min(lang, row_id) FILTER (trim(lang) <> ''), '') AS lang FROM rec GROUP BY 1""")
def e7(t: Tables) -> DataFrame:
    return first_nonblank(t.records, "source", ["light_raw", "lang"], "row_id")


@query("e8_duplicate_count", "SELECT doc_id, count(*) OVER (PARTITION BY text) AS duplicate_count FROM documents")
def e8(t: Tables) -> DataFrame:
    return duplicate_count(t.documents, ["text"]).select("doc_id", "duplicate_count")


@query("e9_group_balance", f"""{W}{RECORDS} SELECT source, count(*) AS row_count, count(*) FILTER (label = 0) AS label_0, count(*) FILTER (label = 1) AS label_1,
  count(*) >= 10 AND label_0 >= 2 AND label_1 >= 2 AS usable FROM rec WHERE label IS NOT NULL GROUP BY 1""")
def e9(t: Tables) -> DataFrame:
    return P.group_balance(t.records.filter("label IS NOT NULL"), "source", min_rows=10, min_class=2)


@query("e10_curation_metrics", f"""{W}{SEQUENCES} SELECT count(*) AS rows, count(*) FILTER (heavy <> '') AS with_heavy, count(*) FILTER (light <> '') AS with_light,
  count(*) FILTER (heavy <> '' AND light <> '') AS paired, count(*) FILTER (label = 1) AS label_1, count(*) FILTER (label = 0) AS label_0,
  count(*) FILTER (label IS NULL) AS label_missing, count(*) FILTER (conflict) AS conflicts FROM seq""")
def e10(t: Tables) -> DataFrame:
    heavy, light = F.col("heavy") != "", F.col("light") != ""
    return P.count_flags(t.sequences, {
        "rows": F.lit(True), "with_heavy": heavy, "with_light": light, "paired": heavy & light, "label_1": F.col("label") == 1,
        "label_0": F.col("label") == 0, "label_missing": F.col("label").isNull(), "conflicts": F.col("conflict")})


REGION_SQL = """CASE WHEN x IN ('', 'na', 'nan', 'none', 'null', 'nd', 'n/a', 'unknown') THEN 'unknown'
  WHEN contains(x, 'rbd') OR contains(x, 'receptor binding') THEN 'RBD' WHEN contains(x, 'ntd') OR contains(x, 'n-terminal') OR contains(x, 'n terminal') THEN 'NTD'
  WHEN x = 's' OR contains(x, 'spike') OR contains(x, 's protein') THEN 'Spike/S' ELSE 'other' END"""


@query("e11_dataset_audit", f"""{W}{SEQUENCES}, a AS (SELECT CASE WHEN light = '' THEN 'light_missing_or_single_chain' ELSE 'paired' END AS paired_status,
  {REGION_SQL.replace('x IN', "trim(lower(light_raw)) IN").replace('(x,', '(lower(light_raw),').replace('x =', 'trim(lower(light_raw)) =')} AS region,
  coalesce(CAST(label AS VARCHAR), 'missing') AS label FROM seq), u AS (UNPIVOT a ON paired_status, region, label INTO NAME metric VALUE value)
  SELECT metric, value, count(*) AS count FROM u GROUP BY ALL""")
def e11(t: Tables) -> DataFrame:
    df = t.sequences.select(
        F.when(F.col("light") == "", "light_missing_or_single_chain").otherwise("paired").alias("paired_status"),
        region_group("light_raw").alias("region"), "label")
    return P.long_counts(df, ["paired_status", "region", "label"])


def subgroup_sql(column: str) -> str:
    return f"""SELECT '{column}' AS subgroup_type, coalesce(nullif(CAST({column} AS VARCHAR), ''), 'missing') AS subgroup_value, count(*) AS row_count,
  count(*) FILTER (label = 0) AS label_0, count(*) FILTER (label = 1) AS label_1, round(min(score), 6) AS score_min, round(avg(score), 6) AS score_mean,
  round(max(score), 6) AS score_max, count(*) FILTER (score >= 0.75) AS high_score_count, round(median(score), 6) AS score_median FROM scored GROUP BY 2"""


SUBGROUPS = ["lang", "record_category", "risk_bin", "confidence_bin"]


@query("e12_subgroup_summary", f"{W}{SCORED_SQL} " + " UNION ALL ".join(subgroup_sql(c) for c in SUBGROUPS))
def e12(t: Tables) -> DataFrame:
    return rounded(P.subgroup_summary(scored(t), SUBGROUPS, "score"))


@query("e13_crosstab", """SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS "F", count(*) FILTER (o_orderstatus = 'O') AS "O",
  count(*) FILTER (o_orderstatus = 'P') AS "P" FROM orders GROUP BY 1""")
def e13(t: Tables) -> DataFrame:
    return P.crosstab(t.orders, "o_orderpriority", "o_orderstatus", ["F", "O", "P"])


@query("e14_annotation_summary", f"""{W}{SEQUENCES} SELECT count(*) AS rows, count(*) FILTER (heavy <> '' AND light <> '') AS candidates,
  count(*) FILTER (heavy <> '' AND light <> '' AND cdrh3 <> '') AS region_found, count(*) FILTER (NOT (heavy <> '' AND light <> '')) AS excluded,
  count(*) FILTER (length(heavy) >= 10) AS prefix_found FROM seq""")
def e14(t: Tables) -> DataFrame:
    pair = (F.col("heavy") != "") & (F.col("light") != "")
    return P.count_flags(t.sequences, {"rows": F.lit(True), "candidates": pair, "region_found": pair & (F.col("cdrh3") != ""),
                                       "excluded": ~pair, "prefix_found": F.length("heavy") >= 10})


COVERAGE = ["heavy_found", "light_found", "region_found"]


@query("e15_coverage", f"""{W}{SEQUENCES}, f AS (SELECT CAST(heavy <> '' AS VARCHAR) AS heavy_found, CASE WHEN light <> '' THEN ' Yes ' ELSE 'no' END AS light_found,
  CASE WHEN cdrh3 <> '' THEN '1' ELSE '' END AS region_found FROM seq) """ + " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count(*) FILTER (trim(lower({c})) IN ('true', '1', 'yes')) AS true_count, count(*) - true_count AS false_or_missing,
  round(CAST(true_count AS DOUBLE) / count(*), 6) AS fraction FROM f""" for c in COVERAGE))
def e15(t: Tables) -> DataFrame:
    df = t.sequences.select((F.col("heavy") != "").cast("string").alias("heavy_found"),
                            F.when(F.col("light") != "", " Yes ").otherwise("no").alias("light_found"),
                            F.when(F.col("cdrh3") != "", "1").otherwise("").alias("region_found"))
    return rounded(P.coverage(df, COVERAGE))


@query("e15_compare_columns", f"""{W}{SEQUENCES}, p AS (SELECT left(heavy, 3) AS a, left(light, 3) AS b FROM seq)
  SELECT count(*) FILTER (a <> '' AND b <> '' AND a = b) AS exact_match_count, count(*) FILTER (a <> '' AND b <> '' AND a <> b) AS mismatch_count,
  count(*) FILTER (a = '' OR b = '') AS missing_count, count(*) FILTER (a <> '') AS existing_nonempty_count, count(*) FILTER (b <> '') AS annotated_nonempty_count FROM p""")
def e15_compare(t: Tables) -> DataFrame:
    return P.compare_columns(t.sequences.select(F.left("heavy", F.lit(3)).alias("a"), F.left("light", F.lit(3)).alias("b")), "a", "b")


PRIORITY_COLUMNS = ["predicted_label", "confidence_bin", "record_category", "priority_category", "risk_bin", "risk_score"]


@query("e16_priority_summary", f"{W}{SCORED_SQL} " + " UNION ALL ".join(
    f"SELECT '{c}' AS metric, CAST({'CAST(score >= 0.5 AS INTEGER)' if c == 'predicted_label' else c} AS VARCHAR) AS value, count(*) AS count FROM scored GROUP BY 2" for c in PRIORITY_COLUMNS))
def e16(t: Tables) -> DataFrame:
    return P.long_counts(scored(t), PRIORITY_COLUMNS)


@query("e18_metric_correlations", """WITH g AS (SELECT l_suppkey, avg(l_discount) AS m1, avg(l_tax) AS m2, count(*) AS s1, avg(l_quantity) AS s2, 1 AS s3 FROM lineitem GROUP BY 1)
  SELECT 'm1' AS metric, 's1' AS signal, count(*) AS rows, round(corr(m1, s1), 6) AS correlation FROM g UNION ALL SELECT 'm1', 's2', count(*), round(corr(m1, s2), 6) FROM g
  UNION ALL SELECT 'm1', 's3', count(*), NULL FROM g UNION ALL SELECT 'm2', 's1', count(*), round(corr(m2, s1), 6) FROM g
  UNION ALL SELECT 'm2', 's2', count(*), round(corr(m2, s2), 6) FROM g UNION ALL SELECT 'm2', 's3', count(*), NULL FROM g""")
def e18(t: Tables) -> DataFrame:
    g = t.lineitem.groupBy("l_suppkey").agg(F.avg("l_discount").alias("m1"), F.avg("l_tax").alias("m2"), F.count("*").alias("s1"),
                                            F.avg("l_quantity").alias("s2"), F.lit(1).alias("s3"))
    return rounded(P.metric_correlations(g, ["m1", "m2"], ["s1", "s2", "s3"]))


@query("e19_aggregate_folds", """WITH g AS (SELECT l_returnflag, l_suppkey, avg(l_discount) AS roc_auc, avg(l_tax) AS pr_auc, count(*) AS n FROM lineitem GROUP BY 1, 2)
  SELECT l_returnflag, count(*) AS valid_folds, round(avg(roc_auc), 6) AS macro_roc_auc, round(sum(roc_auc * n) / sum(n), 6) AS weighted_roc_auc,
  round(avg(pr_auc), 6) AS macro_pr_auc, round(sum(pr_auc * n) / sum(n), 6) AS weighted_pr_auc FROM g GROUP BY 1""")
def e19(t: Tables) -> DataFrame:
    g = t.lineitem.groupBy("l_returnflag", "l_suppkey").agg(F.avg("l_discount").alias("roc_auc"), F.avg("l_tax").alias("pr_auc"), F.count("*").alias("n"))
    return rounded(P.aggregate_folds(g, ["roc_auc", "pr_auc"], "n", ["l_returnflag"]))


@query("e20_aggregate_runs", """SELECT o_orderpriority, count(o_totalprice) AS runs, round(avg(o_totalprice), 4) AS mean, round(coalesce(stddev_samp(o_totalprice), 0), 4) AS std,
  min(o_totalprice) AS min, max(o_totalprice) AS max, bool_and(o_totalprice > 1000) AS all_beat_baseline, coalesce(stddev_samp(o_totalprice), 0) <= 0.02 AS stable FROM orders GROUP BY 1""")
def e20(t: Tables) -> DataFrame:
    return rounded(P.aggregate_runs(t.orders, ["o_orderpriority"], "o_totalprice", 1000.0), 4)


@query("e21_history_summary", """WITH h AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS epoch, value AS train, value / 2 AS loss, 1 / (1 + value) AS auc FROM events),
  s AS (SELECT user_id, max(auc) AS best_auc, arg_min(epoch, (-auc, epoch)) AS best_auc_epoch, min(loss) AS best_loss, arg_min(epoch, (loss, epoch)) AS best_loss_epoch,
  arg_max(auc, epoch) AS last_auc, arg_max(loss, epoch) AS last_loss, arg_min(train, epoch) - arg_max(train, epoch) AS train_loss_drop FROM h GROUP BY 1)
  SELECT user_id, round(best_auc, 6) AS best_auc, best_auc_epoch, round(best_loss, 6) AS best_loss, best_loss_epoch, round(last_auc, 6) AS last_auc, round(last_loss, 6) AS last_loss,
  round(best_auc - last_auc, 6) AS auc_drop, round(last_loss - best_loss, 6) AS loss_increase, round(train_loss_drop, 6) AS train_loss_drop,
  train_loss_drop > 0 AND (best_auc - last_auc > 0.02 OR last_loss - best_loss > 0.05) AS overfit FROM s""")
def e21(t: Tables) -> DataFrame:
    h = position_in_group(t.events.select("user_id", "event_id", "value"), ["user_id"], ["event_id"], "epoch").select(
        "user_id", "epoch", F.col("value").alias("train"), (F.col("value") / 2).alias("loss"), (1 / (1 + F.col("value"))).alias("auc"))
    return rounded(P.history_summary(h, "user_id", "epoch", "train", "loss", "auc"))


@query("e22_error_counts", f"""{W}{RECORDS}, e AS (SELECT source, count(*) AS rows, count(*) FILTER (label <> CAST(score >= 0.5 AS INTEGER)) AS a_errors,
  count(*) FILTER (label <> CAST(length(text) > 1000 AS INTEGER)) AS b_errors FROM rec WHERE label IS NOT NULL GROUP BY 1)
  SELECT *, a_errors + b_errors AS total_errors FROM e ORDER BY total_errors DESC, source LIMIT 15""")
def e22(t: Tables) -> DataFrame:
    df = t.records.filter("label IS NOT NULL").withColumns({"a": (F.col("score") >= 0.5).cast("int"), "b": (F.length("text") > 1000).cast("int")})
    return P.error_counts(df, "source", "label", {"a": "a", "b": "b"})


@query("e23_histogram", """WITH s AS (SELECT min(l_extendedprice) AS lo, (max(l_extendedprice) - min(l_extendedprice)) / 30 AS w FROM lineitem)
  SELECT l_returnflag, CAST(least(floor((l_extendedprice - lo) / w), 29) AS INTEGER) AS bin, count(*) AS count FROM lineitem, s GROUP BY 1, 2""")
def e23(t: Tables) -> DataFrame:
    return P.histogram(t.lineitem, "l_extendedprice", 30, ["l_returnflag"])


@query("e24_group_descriptor", f"""{W}{SEQUENCES}, l AS (SELECT source, lang, count(*) AS n FROM seq GROUP BY 1, 2),
  j AS (SELECT source, '{{' || string_agg('"' || lang || '":' || n, ',' ORDER BY lang) || '}}' AS lang_counts FROM l GROUP BY 1)
  SELECT s.source, j.lang_counts, round(avg(length(heavy)), 6) AS mean_heavy_length, round(avg(length(light)), 6) AS mean_light_length FROM seq s JOIN j ON s.source = j.source GROUP BY 1, 2""")
def e24(t: Tables) -> DataFrame:
    df = t.sequences.withColumns({"hl": F.length("heavy"), "ll": F.length("light")})
    return rounded(P.group_descriptor(df, "source", {"lang_counts": "lang"}, {"mean_heavy_length": "hl", "mean_light_length": "ll"}))

