"""P and Q: end-to-end jobs and the metric flattener."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curatrix.catalog.base import RECORDS, SEQUENCES, Tables, canonical_sql, query, rounded
from curatrix.catalog.learning import pair_rows, variants
from curatrix.catalog.rows import SCORED_SQL, binned, saved_scores, scored
from curatrix.catalog.scans import scratch
from curatrix.catalog.evaluation import DERIVED, confusion_sql, fixed_score_sql, fixed_scorer, ranking_sql
from curatrix.constants import ENRICHMENT_K, MAX_TERMS
from curatrix.operators import rules as R
from curatrix.operators.metric_trees import flatten_metrics
from curatrix.operators.ordered import dedup_first, position_in_group, top_k
from curatrix.plans import curation, prioritise, registry, shortlist, validation
from curatrix.sources.sinks import write_csv

W = "WITH "


@query("p0_flagship_shortlist", f"""{W}{RECORDS}, u AS (SELECT *, row_number() OVER (PARTITION BY text ORDER BY row_id) AS rn FROM rec),
  k AS (SELECT row_id, source, score, CASE WHEN conflict THEN 'conflict_label' WHEN label = 1 THEN 'known_neutralising' WHEN label = 0 THEN 'known_non_neutralising' ELSE 'missing_label' END AS record_category,
    row_number() OVER (PARTITION BY source ORDER BY score DESC, row_id) AS rank_in_source FROM u WHERE rn = 1)
  SELECT row_id, source, round(score, 6) AS score, record_category, rank_in_source, row_number() OVER (ORDER BY k.score DESC, row_id) AS rank FROM k ORDER BY rank LIMIT 25""")
def p0(t: Tables) -> DataFrame:
    """Unique documents, categorised, ranked inside their source, best 25."""
    unique = dedup_first(t.records.drop("heavy_raw", "light_raw"), ["text"], "row_id").drop("text")
    ranked = position_in_group(unique, ["source"], [F.col("score").desc(), F.col("row_id")], "rank_in_source")
    ranked = ranked.withColumn("record_category", R.record_category())
    best = top_k(ranked, [F.col("score").desc(), F.col("row_id")], 25)
    return rounded(best.select("row_id", "source", "score", "record_category", "rank_in_source", "rank"))


def raw_records(t: Tables) -> DataFrame:
    """Documents as raw records: placeholders, two label texts and a target text."""
    i = F.col("row_id")
    return t.sequences.select(
        "row_id", F.concat(F.lit("ab"), i).alias("Name"), F.when(i % 7 == 0, "Nb").otherwise("Ab").alias("Ab or Nb"),
        F.when(i % 11 == 0, "ND").otherwise(F.col("heavy")).alias("VHorVHH"), F.when(i % 5 == 0, "-").otherwise(F.col("light")).alias("VL"),
        F.col("cdrh3").alias("CDRH3"), F.right("light", F.lit(8)).alias("CDRL3"), F.when(F.col("lang") == "en", "S; RBD").otherwise("N").alias("Protein + Epitope"),
        F.col("source").alias("Origin"), F.when(i % 9 == 0, "1abc").otherwise("ND").alias("Structures"), F.col("source").alias("Sources"),
        F.lit("").alias("Date Added"), F.lit("").alias("Last Updated"), F.when(i % 10 < 8, "SARS-CoV2_WT").otherwise("MERS").alias("Binds to"),
        F.when((F.col("label") == 1) | F.col("conflict"), "sars cov 2").otherwise("").alias("Neutralising Vs"),
        F.when((F.col("label") == 0) | F.col("conflict"), "SARS_CoV_2").otherwise("").alias("Not Neutralising Vs"))


CURATE_SQL = SEQUENCES + """,
cl AS (SELECT row_id, nullif(CASE WHEN row_id % 11 = 0 OR lower(heavy) IN ('na', 'nd', 'nan') THEN '' ELSE heavy END, '') AS h, nullif(CASE WHEN row_id % 5 = 0 OR lower(light) IN ('na', 'nd', 'nan') THEN '' ELSE light END, '') AS l,
  CASE WHEN label = 1 OR conflict THEN 1 WHEN label = 0 THEN 0 END AS y, conflict, row_id % 7 = 0 AS nb, row_id % 9 = 0 AS st, cdrh3 FROM seq WHERE row_id % 10 < 8),
ky AS (SELECT *, CASE WHEN l IS NOT NULL THEN h || '__' || l ELSE h END AS k FROM cl WHERE h IS NOT NULL),
fin AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY row_id) AS rn, count(*) OVER (PARTITION BY k) AS duplicate_count FROM ky) WHERE rn = 1)"""


@query("p1_curate", f"{W}{CURATE_SQL} SELECT row_id, md5(k) AS key_digest, y AS neutralising_label, conflict AS neutralising_conflict, duplicate_count, nb AS is_nanobody_like, st AS has_structure FROM fin")
def p1(t: Tables) -> DataFrame:
    final, _ = curation.curate(raw_records(t), "row_id")
    return final.select("row_id", F.md5("sequence_key").alias("key_digest"), "neutralising_label", "neutralising_conflict", "duplicate_count", "is_nanobody_like", "has_structure")


@query("p1_curation_counts", f"""{W}{CURATE_SQL}, a AS (SELECT (SELECT count(*) FROM documents) AS raw_rows, count(*) AS filtered_rows, count(h) AS rows_with_heavy, count(l) AS rows_with_light,
  count(*) FILTER (h IS NOT NULL AND l IS NOT NULL) AS paired_rows, count(*) FILTER (nb) AS nanobody_like_rows, count(*) FILTER (y = 1) AS label_1, count(*) FILTER (y = 0) AS label_0,
  count(*) FILTER (y IS NULL) AS label_missing, count(*) FILTER (conflict) AS conflicts, CAST(0 AS BIGINT) AS invalid_heavy, CAST(0 AS BIGINT) AS invalid_light, count(*) FILTER (h IS NULL) AS removed_without_key,
  (SELECT count(*) FROM fin) AS final_rows, (SELECT count(*) FROM fin WHERE duplicate_count > 1) AS duplicate_keys, (SELECT CAST(sum(duplicate_count - 1) AS BIGINT) FROM fin) AS removed_copies FROM cl)
  UNPIVOT a ON COLUMNS(*) INTO NAME metric VALUE count""")
def p1_counts(t: Tables) -> DataFrame:
    return curation.curate(raw_records(t), "row_id")[1]


@query("p2_strict_table", f"""{W}{CURATE_SQL} SELECT row_id, y AS label, md5(CASE WHEN l IS NOT NULL THEN h || '[SEP]' || l ELSE h END) AS pair_digest, length(h) AS heavy_length, length(l) AS light_length,
  nullif(length(CASE WHEN lower(cdrh3) IN ('na', 'nd', 'nan') THEN '' ELSE cdrh3 END), 0) AS cdrh3_length FROM fin WHERE y IS NOT NULL AND NOT conflict""")
def p2(t: Tables) -> DataFrame:
    table, _ = curation.strict_table(curation.curate(raw_records(t), "row_id")[0])
    return table.select("row_id", "label", F.md5("sequence_pair_text").alias("pair_digest"), "heavy_length", "light_length", "cdrh3_length")


@query("p2_funnel_counts", f"{W}{CURATE_SQL} SELECT CASE WHEN y IS NULL THEN 'label_missing' WHEN conflict THEN 'conflict' ELSE 'kept' END AS step, count(*) AS rows FROM fin GROUP BY 1")
def p2_counts(t: Tables) -> DataFrame:
    return curation.strict_table(curation.curate(raw_records(t), "row_id")[0])[1]


STANDARD_SQL = f"""{RECORDS}, sc AS (SELECT row_id, source, {canonical_sql('heavy_raw')} AS h, {canonical_sql('light_raw')} AS l FROM rec)"""


def scan(t: Tables) -> DataFrame:
    return t.records.select("row_id", F.col("source").alias("source_file"), "heavy_raw", "light_raw")


@query("p3_standardise", f"""{W}{STANDARD_SQL}, ok AS (SELECT * FROM sc WHERE length(h) BETWEEN 80 AND 180 AND length(l) BETWEEN 60 AND 140)
  SELECT row_id, source AS source_file, md5(h || '[SEP]' || l) AS pair_digest FROM (SELECT *, row_number() OVER (PARTITION BY h, l ORDER BY source, row_id) AS rn FROM ok) WHERE rn = 1""")
def p3(t: Tables) -> DataFrame:
    table, _ = curation.standardise(scan(t), ["source_file", "row_id"])
    return table.select("row_id", "source_file", F.md5("sequence_pair_text").alias("pair_digest"))


@query("p3_rows_per_file", f"""{W}{STANDARD_SQL} SELECT source AS source_file, count(*) AS rows_scanned, count(*) FILTER (h <> '' AND l <> '') AS rows_cleaned,
  count(*) FILTER (length(h) BETWEEN 80 AND 180 AND length(l) BETWEEN 60 AND 140) AS rows_in_length FROM sc GROUP BY 1""")
def p3_files(t: Tables) -> DataFrame:
    return curation.standardise(scan(t), ["source_file", "row_id"])[1]


@query("p4_neutral_tables", f"""{W}{SEQUENCES}, src AS (SELECT heavy || '||' || light AS k, arg_min(source, row_id) FILTER (trim(source) <> '') AS v, arg_min(lang, row_id) FILTER (trim(lang) <> '') AS r FROM seq GROUP BY 1)
  SELECT row_id AS extra_col_03, md5(heavy || '||' || light) AS key_digest, coalesce(v, '') AS group_feature_v, CASE WHEN row_id % 2 = 0 THEN coalesce(r, '') ELSE 'kept' END AS metadata_target_region
  FROM seq LEFT JOIN src ON k = heavy || '||' || light""")
def p4(t: Tables) -> DataFrame:
    s = t.sequences
    blank = F.lit("")
    source = s.select(
        F.col("row_id").cast("string").alias("name"), blank.alias("type"), blank.alias("p"), blank.alias("n"), blank.alias("lp"), blank.alias("ln"),
        F.col("lang").alias("region"), blank.alias("origin"), F.col("heavy").alias("a"), F.col("light").alias("b"), F.col("source").alias("v"), "row_id")
    prepared = s.select(F.col("heavy").alias("heavy_or_vhh_sequence"), F.col("light").alias("light_sequence"), F.col("cdrh3"))
    table = s.select(F.col("heavy").alias("sequence_heavy_only"), F.col("light").alias("light_sequence"),
                     F.when(F.col("row_id") % 2 == 0, "").otherwise("kept").alias("protein_epitope"), "row_id")
    _, _, merged = curation.neutralise(source, prepared, table, "row_id")
    return merged.select("extra_col_03", F.md5("sequence_key").alias("key_digest"), "group_feature_v", "metadata_target_region")


PRIORITY_SQL = f"""{SCORED_SQL}, pg AS (SELECT *, source || ' | ' || lang || ' | ' || CASE WHEN length(cdrh3) <= 10 THEN 'short' WHEN length(cdrh3) <= 20 THEN 'medium' ELSE 'long' END AS diversity_group FROM scored)"""


@query("p5_prioritise", f"""{W}{PRIORITY_SQL} SELECT row_id, priority_category, risk_score, diversity_group, count(*) OVER (PARTITION BY diversity_group) AS diversity_group_size,
  row_number() OVER (PARTITION BY diversity_group ORDER BY score DESC, row_id) AS rank_in_diversity_group, row_number() OVER (PARTITION BY lang ORDER BY score DESC, row_id) AS rank_in_region FROM pg""")
def p5(t: Tables) -> DataFrame:
    table = prioritise.prioritise(t.sequences, "row_id", "source", "lang")
    return table.select("row_id", "priority_category", "risk_score", "diversity_group", "diversity_group_size", "rank_in_diversity_group", "rank_in_region")


@query("p5_score_and_prioritise")
def p5_scored(t: Tables) -> DataFrame:
    rows = t.sequences.drop("score").withColumnRenamed("text", "pair")
    table = prioritise.score_and_prioritise(rows, "row_id", "pair", "source", "lang")
    return rounded(table.select("row_id", "score", "record_category", "priority_category", "risk_bin"), 3)


@query("p6_diverse_groups", f"""{W}{SCORED_SQL}, cp AS (SELECT *, record_category = 'known_non_neutralising' AS md FROM scored WHERE score >= 0.75 AND confidence_bin = 'high' AND risk_bin IN ('low', 'medium')
    AND (record_category <> 'known_non_neutralising' OR score >= 0.90)),
  dk AS (SELECT *, lang || ' | ' || source || ' | unknown | missing_cdrh3' AS dg FROM cp),
  bs AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY dg) AS group_candidates, row_number() OVER (PARTITION BY dg ORDER BY score DESC, confidence_score DESC, risk_score, row_id) AS rn FROM dk) WHERE rn = 1)
  SELECT row_id, row_number() OVER (ORDER BY score DESC, confidence_score DESC, risk_score, lang, row_id) AS shortlist_rank, group_candidates,
  CASE WHEN record_category = 'conflict_label' OR md THEN 'review' WHEN score >= 0.85 AND risk_bin = 'low' THEN 'tier_1' ELSE 'tier_2' END AS shortlist_tier FROM bs""")
def p6(t: Tables) -> DataFrame:
    return prioritise.diverse_groups(scored(t), "row_id", "lang", "source").select("row_id", "shortlist_rank", "group_candidates", "shortlist_tier")


@query("p7_source_holdout")
def p7(t: Tables) -> DataFrame:
    folds, _ = validation.holdout(pair_rows(t), "row_id", "pair", "label", "source", min_rows=15, min_class=3)
    return rounded(folds.select("fold", "test_rows", "reason", "roc_auc", "average_precision", "accuracy"), 3)


HOLDOUT_SQL = f"""{RECORDS}, lab AS (SELECT * FROM rec WHERE label IS NOT NULL),
te AS (SELECT source AS fold, count(*) AS test_rows, count(*) FILTER (label = 0) AS t0, count(*) FILTER (label = 1) AS t1 FROM lab GROUP BY 1),
fo AS (SELECT fold, test_rows, CASE WHEN test_rows < 15 THEN 'too_few_test_rows' WHEN sum(t0) OVER () = t0 OR sum(t1) OVER () = t1 THEN 'train_single_class'
  WHEN t0 < 3 OR t1 < 3 THEN 'test_insufficient_class_counts' ELSE 'ok' END AS reason FROM te),
lm AS (SELECT source AS g, label, {fixed_score_sql('text')} AS s, CAST({fixed_score_sql('text')} >= 0.5 AS INTEGER) AS pred FROM lab JOIN fo ON fold = source AND reason = 'ok'), {ranking_sql('lm', 's', 'g')},
cf AS ({confusion_sql('lm', 'g')}), fm AS (SELECT *, {DERIVED} FROM cf)"""


@query("p7_holdout_fixed_scorer", f"""{W}{HOLDOUT_SQL} SELECT fold, test_rows, reason, round(roc_auc, 6) AS roc_auc, round(average_precision, 6) AS average_precision, round(accuracy, 6) AS accuracy
  FROM fo LEFT JOIN fm ON fm.g = fold LEFT JOIN auc ON auc.g = fold LEFT JOIN ap ON ap.g = fold""")
def p7_fixed(t: Tables) -> DataFrame:
    folds, _ = validation.holdout(pair_rows(t), "row_id", "pair", "label", "source", min_rows=15, min_class=3, scorer=fixed_scorer)
    return rounded(folds.select("fold", "test_rows", "reason", "roc_auc", "average_precision", "accuracy"))


@query("p7_calibration")
def p7_calibration(t: Tables) -> DataFrame:
    return rounded(validation.calibrate(pair_rows(t), "row_id", "pair", "label", ["source", "lang"])["calibration"], 2)


@query("p8_source_robust_selection")
def p8(t: Tables) -> DataFrame:
    comparison, chosen = validation.robust_select(
        pair_rows(t), "row_id", "label", "source", variants(), ["whole", "heavy"], 20, 4, 100, 4, max_terms=MAX_TERMS)
    picked = chosen.select("variant", F.lit(True).alias("selected"))
    table = comparison.join(picked, "variant", "left").withColumn("selected", F.coalesce("selected", F.lit(False)))
    return rounded(table.select("variant", "row_count", "valid_folds", "weighted_roc_auc", "weighted_average_precision", "brier", "selected"), 3)


@query("p9_background_retrieval")
def p9(t: Tables) -> DataFrame:
    rows = t.records.select("row_id", "label", F.col("text").alias("pair"))
    found = validation.retrieval(rows.filter("label IS NOT NULL"), rows.filter("label IS NULL"), "row_id", "pair")
    return rounded(found["enrichment"], 3)


RETRIEVAL_SQL = f"""{RECORDS}, de AS (SELECT *, row_number() OVER (PARTITION BY label IS NULL, text ORDER BY row_id) AS rn FROM rec),
pj AS (SELECT * FROM de WHERE label IS NOT NULL AND rn = 1), bg AS (SELECT * FROM de WHERE label IS NULL AND rn = 1 AND text NOT IN (SELECT text FROM pj)),
n AS (SELECT least((SELECT count(*) FROM pj), (SELECT count(*) FROM bg)) AS n),
pk AS (SELECT 1 AS y, row_id, text, row_number() OVER (ORDER BY sha256(row_id || ':42')) AS k FROM pj UNION ALL SELECT 0, row_id, text, row_number() OVER (ORDER BY sha256(row_id || ':42')) FROM bg),
un AS (SELECT y, y || ':' || row_id AS k, text FROM pk, n WHERE k <= n),
si AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY sha256(k || ':42')) <= ceil(0.2 * count(*) OVER (PARTITION BY y)) AS test FROM un),
rk AS (SELECT y, row_number() OVER (ORDER BY {fixed_score_sql('text')} DESC, k) AS rank, avg(y) OVER () AS base FROM si WHERE test)"""


@query("p9_retrieval_fixed_scorer", f"""{W}{RETRIEVAL_SQL} SELECT k, count(*) AS selected_count, count(*) FILTER (y = 1) AS positive_count, round(avg(y), 6) AS fraction, round(avg(y) / max(base), 6) AS enrichment
  FROM rk, (SELECT unnest({list(ENRICHMENT_K)}) AS k) WHERE rank <= k GROUP BY k""")
def p9_fixed(t: Tables) -> DataFrame:
    rows = t.records.select("row_id", "label", F.col("text").alias("pair"))
    found = validation.retrieval(rows.filter("label IS NOT NULL"), rows.filter("label IS NULL"), "row_id", "pair", scorer=fixed_scorer)
    return rounded(found["enrichment"])


@query("p9_matched_retrieval")
def p9_matched(t: Tables) -> DataFrame:
    rows = binned(t).select("row_id", "label", "matching_bin", F.col("text").alias("pair")).filter("pair <> ''")
    found = validation.retrieval(rows.filter("label IS NOT NULL"), rows.filter("label IS NULL"), "row_id", "pair", "matching_bin")
    return rounded(found["metrics"].select("rows", "accuracy", "roc_auc", "average_precision"), 3)


@query("p10_background_shortlist")
def p10(t: Tables) -> DataFrame:
    docs = t.sequences.select("row_id", "text", "heavy", "light")
    refs = t.benchmark.select(F.col("item_id").alias("row_id"), "text")
    table = shortlist.shortlist(docs, refs, "row_id", "text", "heavy", "light", saved_scores(t))
    return rounded(table.select("rank", "row_id", "max_similarity", "centroid_similarity", "diversity_cluster", "selected", "risk_flag_count", "review_notes"), 3)


@query("p11_registry", """WITH m AS (SELECT user_id, event_type, CAST(avg(CAST(json_extract_string(props, '$.k') AS DOUBLE)) AS DOUBLE) AS roc, avg(value) AS pr FROM events GROUP BY 1, 2),
  b AS (SELECT event_type, roc, pr FROM m WHERE user_id = 0)
  SELECT user_id || '/' || m.event_type AS name, round(m.roc, 3) AS roc_auc, round(m.pr, 3) AS pr_auc, round(m.roc - b.roc, 3) AS delta_roc_auc, round(m.pr - b.pr, 3) AS delta_pr_auc,
    m.roc > b.roc AND m.pr > b.pr AS beats_all FROM m LEFT JOIN b ON m.event_type = b.event_type AND b.event_type = 'click'""")
def p11(t: Tables) -> DataFrame:
    m = t.events.groupBy("user_id", "event_type").agg(F.avg(F.get_json_object("props", "$.k").cast("double")).alias("roc"), F.avg("value").alias("pr"))
    deep = F.struct(F.struct(F.col("roc").alias("roc_auc"), F.struct(F.col("pr").alias("mean")).alias("pr_auc")).alias("result"),
                    F.struct((F.col("roc") + 1000).alias("roc_auc"), (F.col("pr") + 1000).alias("pr_auc")).alias("kmer_reference"))
    rows = m.select(F.concat_ws("/", "user_id", "event_type").alias("name"), F.col("event_type").alias("subset"), F.to_json(deep).alias("json"))
    return rounded(registry.registry(rows, "subset", "0/click").select("name", "roc_auc", "pr_auc", "delta_roc_auc", "delta_pr_auc", "beats_all"), 3)


@query("p12_contract_check")
def p12(t: Tables) -> DataFrame:
    good, bad = scratch(t, "public_scores"), scratch(t, "leaky_scores")
    write_csv(t.records.select("row_id", "score"), good)
    write_csv(t.sequences.select("row_id", F.col("heavy").alias("heavy_sequence")), bad)
    checked = registry.contract_check(t.spark, [good, bad, good + "-absent"])
    return checked.select(F.element_at(F.split("path", "/"), -1).alias("output"), "exists", F.concat_ws(",", "forbidden").alias("forbidden"), "passed")


@query("q1_flatten_metrics", """SELECT event_id, 'a.0' AS path, CAST(k AS DOUBLE) AS roc_auc, CAST(NULL AS DOUBLE) AS pr_auc FROM (SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)
  UNION ALL SELECT event_id, 'b', CAST(NULL AS DOUBLE), CAST(k + 1 AS DOUBLE) FROM (SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)""")
def q1(t: Tables) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    payload = F.concat(F.lit('{"a": [{"roc_auc": '), k.cast("string"), F.lit('}], "b": {"average_precision": {"max": '), (k + 1).cast("string"), F.lit('}}, "majority": {"roc_auc": 0.5}}'))
    return flatten_metrics(t.events.select("event_id", payload.alias("json")), "event_id", "json")

