"""M: evaluation metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curatrix.catalog.base import RECORDS, Tables, query, rounded
from curatrix.catalog.learning import GROUP_SPLIT_SQL, pair_rows
from curatrix.operators import metrics as M
from curatrix.operators import models as MO
from curatrix.plans.validation import validation_matrix

W = "WITH "
LAB = f"""{RECORDS}, lab AS (SELECT *, CAST(score >= 0.5 AS INTEGER) AS pred, round(score, 1) AS tied FROM rec WHERE label IS NOT NULL)"""


def labelled(t: Tables) -> DataFrame:
    """Labelled records with a fixed score, and the same score rounded so that it ties."""
    return t.records.filter("label IS NOT NULL").select("row_id", "label", "score", "lang", "source", F.round("score", 1).alias("tied"),
                                                        (F.col("score") >= 0.5).cast("int").alias("pred"))


def confusion_sql(source: str, by: str = "") -> str:
    g = f"{by}, " if by else ""
    return f"""SELECT {g}count(*) AS rows, count(*) FILTER (label = 0 AND pred = 0) AS tn, count(*) FILTER (label = 0 AND pred = 1) AS fp,
  count(*) FILTER (label = 1 AND pred = 0) AS fn, count(*) FILTER (label = 1 AND pred = 1) AS tp FROM {source} {f'GROUP BY {by}' if by else ''}"""


DERIVED = """CAST(tp + tn AS DOUBLE) / rows AS accuracy, CASE WHEN tp + fn > 0 AND tn + fp > 0 THEN (CAST(tp AS DOUBLE) / (tp + fn) + CAST(tn AS DOUBLE) / (tn + fp)) / 2 ELSE CAST(tp + tn AS DOUBLE) / rows END AS balanced_accuracy,
  coalesce(CAST(tp AS DOUBLE) / nullif(tp + fp, 0), 0) AS "precision", coalesce(CAST(tp AS DOUBLE) / nullif(tp + fn, 0), 0) AS recall, coalesce(2.0 * CAST(tp AS DOUBLE) / nullif(2 * tp + fp + fn, 0), 0) AS f1"""


@query("m1_classification_metrics", f"""{W}{LAB}, c AS ({confusion_sql('lab', 'source')}), d AS (SELECT *, {DERIVED} FROM c)
  SELECT source, rows, tn, fp, fn, tp, round(accuracy, 6) AS accuracy, round(balanced_accuracy, 6) AS balanced_accuracy, round("precision", 6) AS "precision", round(recall, 6) AS recall, round(f1, 6) AS f1 FROM d""")
def m1(t: Tables) -> DataFrame:
    return rounded(M.classification_metrics(labelled(t), "label", "pred", ["source"]))


def ranking_sql(source: str, score: str, by: str) -> str:
    """ROC AUC by average ranks and step-sum average precision, per group."""
    return f"""r AS (SELECT {by}, label, {score} AS s, rank() OVER (PARTITION BY {by} ORDER BY {score}) + (count(*) OVER (PARTITION BY {by}, {score}) - 1) / 2.0 AS rk FROM {source}),
auc AS (SELECT {by}, count(*) FILTER (label = 1) AS positives, count(*) FILTER (label = 0) AS negatives,
  (sum(CASE WHEN label = 1 THEN CAST(rk AS DOUBLE) END) - positives * (positives + 1) / 2.0) / nullif(positives * negatives, 0) AS roc_auc FROM r GROUP BY {by}),
tie AS (SELECT {by}, s, count(*) FILTER (label = 1) AS pos, count(*) AS n FROM r GROUP BY {by}, s),
cum AS (SELECT {by}, s, pos, sum(pos) OVER w AS tp, sum(n) OVER w AS seen, sum(pos) OVER (PARTITION BY {by}) AS p FROM tie WINDOW w AS (PARTITION BY {by} ORDER BY s DESC)),
ap AS (SELECT {by}, sum(CAST(pos AS DOUBLE) / nullif(p, 0) * tp / seen) AS average_precision FROM cum GROUP BY {by})"""


@query("m2_roc_auc", f"""{W}{LAB}, {ranking_sql('lab', 'tied', 'lang')} SELECT lang, positives, negatives, round(CASE WHEN least(positives, negatives) >= 5 THEN roc_auc END, 6) AS roc_auc FROM auc""")
def m2(t: Tables) -> DataFrame:
    return rounded(M.roc_auc(labelled(t), "label", "tied", ["lang"], 5))


@query("m2_roc_auc_large", f"""WITH lab AS (SELECT l_returnflag AS g, l_extendedprice AS score, CAST(l_tax > 0.04 AS INTEGER) AS label FROM lineitem), {ranking_sql('lab', 'score', 'g')}
  SELECT g, positives, negatives, round(roc_auc, 6) AS roc_auc, round(average_precision, 6) AS average_precision FROM auc JOIN ap USING (g)""")
def m2_large(t: Tables) -> DataFrame:
    df = t.lineitem.select(F.col("l_returnflag").alias("g"), F.col("l_extendedprice").alias("score"), (F.col("l_tax") > 0.04).cast("int").alias("label"))
    return rounded(M.ranking_metrics(df, "label", "score", ["g"]))


@query("m3_average_precision", f"""{W}{LAB}, {ranking_sql('lab', 'tied', 'lang')} SELECT lang, positives, negatives,
  round(CASE WHEN least(positives, negatives) >= 5 THEN average_precision END, 6) AS average_precision FROM auc JOIN ap USING (lang)""")
def m3(t: Tables) -> DataFrame:
    return rounded(M.average_precision(labelled(t), "label", "tied", ["lang"], 5))


@query("m4_curves", f"""{W}{LAB}, c AS (SELECT score, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label = 0) AS neg FROM lab GROUP BY 1),
  k AS (SELECT score, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER () AS p, sum(neg) OVER () AS n FROM c WINDOW w AS (ORDER BY score DESC))
  SELECT round(score, 6) AS score, round(CAST(fp AS DOUBLE) / n, 6) AS false_positive_rate, round(CAST(tp AS DOUBLE) / p, 6) AS recall, round(CAST(tp AS DOUBLE) / (tp + fp), 6) AS "precision" FROM k""")
def m4(t: Tables) -> DataFrame:
    return rounded(M.curves(labelled(t), "label", "score"))


@query("m5_brier", f"{W}{LAB} SELECT lang, round(avg((score - label) * (score - label)), 6) AS brier_score FROM lab GROUP BY 1")
def m5(t: Tables) -> DataFrame:
    return rounded(M.brier(labelled(t), "label", "score", ["lang"]))


CALIBRATION_SQL = f"""{LAB}, half AS (SELECT *, score / 2 AS s FROM lab), b AS (SELECT CAST(least(floor(s * 10), 9) AS INTEGER) AS bin, count(*) AS n, avg(s) AS mp, avg(label) AS ob FROM half GROUP BY 1)"""


@query("m6_calibration_curve", f"""{W}{CALIBRATION_SQL} SELECT CAST(i AS INTEGER) AS bin, round(CAST(i AS DOUBLE) / 10, 6) AS low, round(CAST(i + 1 AS DOUBLE) / 10, 6) AS high, coalesce(n, 0) AS count,
  round(mp, 6) AS mean_predicted, round(ob, 6) AS observed FROM (SELECT unnest(range(10)) AS i) LEFT JOIN b ON b.bin = i""")
def m6(t: Tables) -> DataFrame:
    return rounded(M.calibration(labelled(t).withColumn("s", F.col("score") / 2), "label", "s"))


@query("m6_expected_calibration_error", f"{W}{CALIBRATION_SQL} SELECT round(sum(n * abs(mp - ob)) / sum(n), 6) AS ece FROM b")
def m6_ece(t: Tables) -> DataFrame:
    return rounded(M.calibration_error(M.calibration(labelled(t).withColumn("s", F.col("score") / 2), "label", "s")))


SWEEP_SQL = f"""{LAB}, sw AS (SELECT CAST(unnest([0.5, 0.6, 0.7, 0.8, 0.9]) AS DOUBLE) AS threshold), ct AS (SELECT threshold, count(*) AS n, count(*) FILTER (score >= threshold) AS selected,
  count(*) FILTER (score >= threshold AND label = 1) AS tp, count(*) FILTER (label = 1) AS p FROM lab, sw GROUP BY 1),
sweep AS (SELECT threshold, selected, CAST(selected AS DOUBLE) / n AS coverage, coalesce(CAST(tp AS DOUBLE) / nullif(selected, 0), 0) AS prec, CAST(tp AS DOUBLE) / p AS recall, 2.0 * CAST(tp AS DOUBLE) / (selected + p) AS f1 FROM ct)"""


@query("m7_threshold_sweep", f"""{W}{SWEEP_SQL} SELECT threshold, selected, round(coverage, 6) AS coverage, round(prec, 6) AS "precision", round(recall, 6) AS recall, round(f1, 6) AS f1 FROM sweep""")
def m7(t: Tables) -> DataFrame:
    return rounded(M.threshold_sweep(labelled(t), "label", "score"))


@query("m8_best_threshold", f"""{W}{SWEEP_SQL}, rk AS (SELECT *, CASE WHEN prec >= 0.8 AND selected > 0 THEN 1 WHEN selected >= 25 THEN 2 ELSE 3 END AS rule FROM sweep)
  SELECT threshold, selected, round(coverage, 6) AS coverage, round(prec, 6) AS "precision", round(recall, 6) AS recall, round(f1, 6) AS f1, rule FROM rk
  ORDER BY rule, CASE WHEN rule = 1 THEN threshold ELSE prec END DESC, CASE rule WHEN 1 THEN recall WHEN 2 THEN threshold ELSE selected END DESC LIMIT 1""")
def m8(t: Tables) -> DataFrame:
    return rounded(M.best_threshold(M.threshold_sweep(labelled(t), "label", "score")))


TOPK_SQL = f"{LAB}, rk AS (SELECT label, row_number() OVER (ORDER BY score DESC, row_id) AS rank, count(*) OVER () AS n, avg(label) OVER () AS base FROM lab)"


@query("m9_topk_precision", f"""{W}{TOPK_SQL} SELECT k, count(*) AS selected_count, count(*) FILTER (label = 1) AS positive_count, round(CAST(count(*) FILTER (label = 1) AS DOUBLE) / k, 6) AS "precision"
  FROM rk, (SELECT unnest([25, 50, 100, 250, 1000000]) AS k) WHERE rank <= k AND k <= n GROUP BY k""")
def m9(t: Tables) -> DataFrame:
    return rounded(M.topk_precision(labelled(t), "label", "score", "row_id", [25, 50, 100, 250, 1_000_000]))


@query("m10_topk_enrichment", f"""{W}{TOPK_SQL} SELECT k, count(*) AS selected_count, count(*) FILTER (label = 1) AS positive_count, round(avg(label), 6) AS fraction, round(avg(label) / max(base), 6) AS enrichment
  FROM rk, (SELECT unnest([50, 100, 500, 1000000]) AS k) WHERE rank <= k GROUP BY k""")
def m10(t: Tables) -> DataFrame:
    return rounded(M.topk_enrichment(labelled(t), "label", "score", "row_id", [50, 100, 500, 1_000_000], "clip"))


SUB = f"""{LAB}, u AS (SELECT 'lang' AS subgroup_type, lang AS subgroup_value, label, score, tied FROM lab UNION ALL SELECT 'source', source, label, score, tied FROM lab),
lm AS (SELECT subgroup_type || '/' || subgroup_value || '/a' AS g, subgroup_type, subgroup_value, 'a' AS model, label, score AS s, CAST(score >= 0.5 AS INTEGER) AS pred FROM u
  UNION ALL SELECT subgroup_type || '/' || subgroup_value || '/b', subgroup_type, subgroup_value, 'b', label, tied, CAST(tied >= 0.5 AS INTEGER) FROM u), {ranking_sql('lm', 's', 'g')},
cf AS ({confusion_sql('lm', 'g, subgroup_type, subgroup_value, model')}),
sub AS (SELECT cf.*, {DERIVED}, CASE WHEN least(positives, negatives) > 0 THEN roc_auc END AS roc_auc, CASE WHEN least(positives, negatives) > 0 THEN average_precision END AS average_precision,
  CAST(positives AS DOUBLE) / rows AS positive_fraction FROM cf JOIN auc USING (g) JOIN ap USING (g) WHERE rows >= 20)"""


def subgroups(t: Tables) -> DataFrame:
    return M.subgroup_metrics(labelled(t), "label", {"a": "score", "b": "tied"}, ["lang", "source"], min_rows=20)


@query("m12_subgroup_metrics", f"""{W}{SUB} SELECT subgroup_type, subgroup_value, model, rows, round(accuracy, 6) AS accuracy, round(f1, 6) AS f1, round(roc_auc, 6) AS roc_auc,
  round(average_precision, 6) AS average_precision, round(positive_fraction, 6) AS positive_fraction FROM sub""")
def m12(t: Tables) -> DataFrame:
    return rounded(subgroups(t).select("subgroup_type", "subgroup_value", "model", "rows", "accuracy", "f1", "roc_auc", "average_precision", "positive_fraction"))


@query("m13_subgroup_deltas", f"""{W}{SUB} SELECT a.subgroup_type, a.subgroup_value, a.rows, round(b.f1 - a.f1, 6) AS delta_f1, round(b.roc_auc - a.roc_auc, 6) AS delta_roc_auc
  FROM sub a JOIN sub b ON a.subgroup_type = b.subgroup_type AND a.subgroup_value = b.subgroup_value AND a.model = 'a' AND b.model = 'b'""")
def m13(t: Tables) -> DataFrame:
    return rounded(M.subgroup_deltas(subgroups(t), "a", "b", ["f1", "roc_auc"]).select("subgroup_type", "subgroup_value", "rows", "delta_f1", "delta_roc_auc"))


@query("m14_prediction_table")
def m14(t: Tables) -> DataFrame:
    rows = pair_rows(t)
    train, test = rows.filter("row_id % 5 <> 0"), rows.filter("row_id % 5 = 0")
    scores = {name: MO.score(test.select("row_id", text), MO.fit_kmer(train, text)) for name, text in (("pair", "pair"), ("heavy", "heavy_raw"))}
    return rounded(M.prediction_table(test.select("row_id", "label", "lang", "source"), scores, "row_id"), 3)


@query("m15_validation_matrix")
def m15(t: Tables) -> DataFrame:
    table = validation_matrix(pair_rows(t), "row_id", "label", "source", {"pair": "pair", "heavy": "heavy_raw"})
    return rounded(table.select("split", "model", "rows", "accuracy", "roc_auc", "average_precision"), 3)


def fixed_scorer(train: DataFrame, test: DataFrame, text: str, label: str) -> DataFrame:
    """A score that SQL can give too, to check splits, variants and metrics around a classifier."""
    return test.withColumn("score", (F.length(text) % 97).cast("double") / 97)


def fixed_score_sql(text: str) -> str:
    return f"CAST(length({text}) % 97 AS DOUBLE) / 97"


MATRIX_SQL = f"""{GROUP_SPLIT_SQL}, rs AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY label ORDER BY sha256(row_id || ':42')) <= ceil(0.2 * count(*) OVER (PARTITION BY label)) THEN 'test' ELSE 'train' END AS side
  FROM rec WHERE label IS NOT NULL),
bo AS (SELECT 'random' AS split, row_id, label, text, heavy_raw, side FROM rs UNION ALL SELECT 'grouped', row_id, label, text, heavy_raw, side FROM sp),
mj AS (SELECT split, arg_max(label, n * 10 - label) AS m FROM (SELECT split, label, count(*) AS n FROM bo WHERE side = 'train' GROUP BY 1, 2) GROUP BY 1),
ms AS (SELECT split, 'pair' AS model, label, {fixed_score_sql('text')} AS s FROM bo WHERE side = 'test' UNION ALL SELECT split, 'heavy', label, {fixed_score_sql('heavy_raw')} FROM bo WHERE side = 'test'
  UNION ALL SELECT split, 'majority', label, CAST(m AS DOUBLE) FROM bo JOIN mj USING (split) WHERE side = 'test'),
lm AS (SELECT split || '/' || model AS g, split, model, label, s, CAST(s >= 0.5 AS INTEGER) AS pred FROM ms), {ranking_sql('lm', 's', 'g')},
cf AS ({confusion_sql('lm', 'g, split, model')}), fm AS (SELECT *, {DERIVED} FROM cf)"""


@query("m15_matrix_fixed_scorer", f"""{W}{MATRIX_SQL} SELECT split, model, rows, round(accuracy, 6) AS accuracy, round(f1, 6) AS f1, round(roc_auc, 6) AS roc_auc,
  round(average_precision, 6) AS average_precision FROM fm JOIN auc USING (g) JOIN ap USING (g)""")
def m15_fixed(t: Tables) -> DataFrame:
    table = validation_matrix(pair_rows(t), "row_id", "label", "source", {"pair": "pair", "heavy": "heavy_raw"}, scorer=fixed_scorer)
    return rounded(table.select("split", "model", "rows", "accuracy", "f1", "roc_auc", "average_precision"))


@query("m16_compare_models", f"""WITH m AS (SELECT l_returnflag AS subset, l_linenumber AS model, avg(l_discount) AS roc_auc, avg(l_tax) AS pr_auc FROM lineitem GROUP BY 1, 2)
  SELECT m.subset, m.model, round(m.roc_auc - b.roc_auc, 6) AS delta_roc_auc, round(m.pr_auc - b.pr_auc, 6) AS delta_pr_auc, m.roc_auc > b.roc_auc AND m.pr_auc > b.pr_auc AS beats_all
  FROM m LEFT JOIN m b ON m.subset = b.subset AND b.model = 1""")
def m16(t: Tables) -> DataFrame:
    m = t.lineitem.groupBy(F.col("l_returnflag").alias("subset"), F.col("l_linenumber").alias("model")).agg(F.avg("l_discount").alias("roc_auc"), F.avg("l_tax").alias("pr_auc"))
    return rounded(M.compare_models(m, "model", 1, ["roc_auc", "pr_auc"], ["subset"]).select("subset", "model", "delta_roc_auc", "delta_pr_auc", "beats_all"))

