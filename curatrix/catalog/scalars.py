"""I: scalar functions and rule columns; J6 and J7: fixed feature columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curatrix.catalog.base import RECORDS, SEQUENCES, Tables, query, rounded
from curatrix.catalog.profiles import REGION_SQL
from curatrix.catalog.rows import SCORED_SQL, scored
from curatrix.functions import text as X
from curatrix.functions import values as V
from curatrix.functions.spans import mark_spans
from curatrix.operators import features as FE
from curatrix.operators import rules as R
from curatrix.operators.metric_trees import metric_pair
from curatrix.operators.similarity import blend, composite, minmax

W = "WITH "
TOKENS = "('', 'na', 'nan', 'none', 'null', 'nd', 'n/a', 'unknown')"


@query("i1_clean_sequence", rf"""{W}{SEQUENCES}, c AS (SELECT row_id, heavy, light, regexp_replace(replace(heavy_raw, 'ß', ''), '[^A-Za-z ]', '', 'g') AS raw FROM seq)
  SELECT row_id, md5(upper(replace(raw, ' ', ''))) AS compact, md5(CASE WHEN lower(replace(raw, ' ', '')) IN {TOKENS} THEN '' ELSE upper(replace(raw, ' ', '')) END) AS token,
  heavy AS canonical, CASE WHEN trim(lower(raw)) IN {TOKENS} THEN NULL ELSE upper(replace(raw, ' ', '')) END AS placeholder FROM c""")
def i1(t: Tables) -> DataFrame:
    raw = F.regexp_replace(F.replace("heavy_raw", F.lit("ß"), F.lit("")), "[^A-Za-z ]", "")
    return t.records.select(
        "row_id", F.md5(X.clean_sequence(raw, "compact")).alias("compact"), F.md5(X.clean_sequence(raw, "token")).alias("token"),
        X.clean_sequence("heavy_raw", "canonical").alias("canonical"), X.clean_sequence(raw, "placeholder").alias("placeholder"))


@query("i3_pair_text", f"""{W}{SEQUENCES} SELECT row_id, md5(CASE WHEN light <> '' THEN heavy || '[SEP]' || light ELSE heavy END) AS sep_text,
  md5(heavy || '||' || light) AS key_text, md5(CASE WHEN light <> '' THEN heavy || '|' || light ELSE heavy END) AS model_text FROM seq""")
def i3(t: Tables) -> DataFrame:
    return t.sequences.select("row_id", F.md5(X.pair_text("heavy", "light")).alias("sep_text"),
                              F.md5(X.pair_text("heavy", "light", "||", always=True)).alias("key_text"),
                              F.md5(X.model_text(X.pair_text("heavy", "light"))).alias("model_text"))


@query("i4_split_pair", f"{W}{SEQUENCES} SELECT row_id, heavy AS first, light AS second FROM seq")
def i4(t: Tables) -> DataFrame:
    first, second = X.split_pair(X.pair_text("heavy", "light"))
    return t.sequences.select("row_id", first.alias("first"), second.alias("second"))


@query("i5_region_text", f"{W}{SEQUENCES} SELECT row_id, left(heavy, 4) || '|' || cdrh3 || '|' || left(light, 4) AS regions FROM seq")
def i5(t: Tables) -> DataFrame:
    return t.sequences.select("row_id", X.region_text([F.left("heavy", F.lit(4)), "cdrh3", F.left("light", F.lit(4))]).alias("regions"))


@query("i6_parse_bool", """SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN true WHEN doc_id % 4 = 1 THEN n_chars % 2 = 1 WHEN doc_id % 4 = 2 THEN false ELSE n_chars % 3 <> 0 END AS flag FROM documents""")
def i6(t: Tables) -> DataFrame:
    case = F.col("doc_id") % 4
    a = F.when(case == 0, " Yes").when(case == 2, "FALSE").otherwise("maybe")
    b = F.when(case == 1, (F.col("n_chars") % 2).cast("string")).when(case == 3, F.concat((F.col("n_chars") % 3).cast("string"), F.lit(".0"))).otherwise("")
    return t.documents.select("doc_id", V.parse_bool([a, b]).alias("flag"))


@query("i7_parse_label", """SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 1.0 WHEN 1 THEN 0.0 WHEN 2 THEN CAST(n_chars % 2 AS DOUBLE) WHEN 3 THEN 0.0 END AS label FROM documents""")
def i7(t: Tables) -> DataFrame:
    case = F.col("doc_id") % 5
    raw = (F.when(case == 0, "Positive ").when(case == 1, "neg").when(case == 2, (F.col("n_chars") % 2).cast("string"))
           .when(case == 3, "non-neutralising").otherwise("unclear"))
    return t.documents.select("doc_id", V.parse_label(raw).alias("label"))


@query("i8_numeric_or_flag", """SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN CAST(n_chars AS DOUBLE) WHEN 1 THEN 1.0 ELSE 0.0 END AS value FROM documents""")
def i8(t: Tables) -> DataFrame:
    case = F.col("doc_id") % 3
    raw = F.when(case == 0, F.col("n_chars").cast("string")).when(case == 1, "TRUE").otherwise("n/a")
    return t.documents.select("doc_id", V.numeric_or_flag(raw).alias("value"))


@query("i9_derive_label", """SELECT doc_id, CASE WHEN p THEN 1 WHEN n THEN 0 END AS label, p AND n AS conflict FROM (SELECT doc_id,
  regexp_matches(split_part(text, chr(10), 1), '(?i)the') AS p, regexp_matches(split_part(text, chr(10), 2), '(?i)the') AS n FROM documents)""")
def i9(t: Tables) -> DataFrame:
    label, conflict = V.derive_label("heavy_raw", "light_raw", "the")
    return t.records.select(F.col("row_id").alias("doc_id"), label.alias("label"), conflict.alias("conflict"))


@query("i10_word_flags", r"""SELECT doc_id, regexp_matches(text, '(?i)\bof\b') AS has_of, regexp_matches(text, '(?i)\bwas\b') AS has_was FROM documents WHERE lang = 'en'""")
def i10(t: Tables) -> DataFrame:
    return t.documents.filter("lang = 'en'").select("doc_id", X.mentions("text", r"\bof\b").alias("has_of"), X.mentions("text", r"\bwas\b").alias("has_was"))


REGION_INPUT = "CASE doc_id % 7 WHEN 0 THEN 'S; RBD' WHEN 1 THEN 'N-terminal part' WHEN 2 THEN ' S ' WHEN 3 THEN 'Spike S2' WHEN 4 THEN 'n/a' WHEN 5 THEN 'S protein' ELSE lang END"


@query("i11_region_group", f"""SELECT doc_id, {REGION_SQL} AS region, CASE WHEN x IN {TOKENS} THEN 'other_unknown' WHEN contains(x, 'rbd') THEN 'RBD'
  WHEN contains(x, 'spike') OR x IN ('s', 's protein') THEN 'Spike non-RBD' ELSE 'other_unknown' END AS coarse FROM (SELECT doc_id, trim(lower({REGION_INPUT})) AS x FROM documents)""")
def i11(t: Tables) -> DataFrame:
    raw = F.expr(REGION_INPUT)
    return t.documents.select("doc_id", V.region_group(raw).alias("region"), V.region_group_coarse(raw).alias("coarse"))


@query("i12_status_columns", f"""{W}{SEQUENCES} SELECT row_id, CASE WHEN light = '' THEN 'light_missing_or_single_chain' ELSE 'paired' END AS light_status,
  row_id % 4 = 0 OR trim(lower(light_raw)) NOT IN {TOKENS} AS has_structure FROM seq""")
def i12(t: Tables) -> DataFrame:
    flag = F.when(F.col("row_id") % 4 == 0, "true").otherwise("")
    return t.sequences.select("row_id", V.light_status(F.col("light") == "").alias("light_status"), V.has_structure([flag], "light_raw").alias("has_structure"))


@query("i13_residue_statistics", f"""{W}{SEQUENCES} SELECT row_id, length(heavy) AS heavy_length, length(heavy) - length(replace(heavy, 'C', '')) AS cysteines,
  round(CASE WHEN heavy <> '' THEN CAST(length(heavy) - length(translate(heavy, 'AVILMFWY', '')) AS DOUBLE) / length(heavy) END, 6) AS hydrophobic,
  round(CASE WHEN heavy <> '' THEN CAST(length(heavy) - length(translate(heavy, 'FWY', '')) AS DOUBLE) / length(heavy) ELSE 0 END, 6) AS aromatic,
  length(heavy) - length(translate(heavy, 'DE', '')) AS acidic, length(heavy) - length(translate(heavy, 'KRH', '')) AS basic FROM seq""")
def i13(t: Tables) -> DataFrame:
    return rounded(t.sequences.select(
        "row_id", F.length("heavy").alias("heavy_length"), V.char_count("heavy", "C").alias("cysteines"),
        V.char_fraction("heavy", "AVILMFWY").alias("hydrophobic"), V.char_fraction("heavy", "FWY", 0.0).alias("aromatic"),
        V.char_count("heavy", "DE").alias("acidic"), V.char_count("heavy", "KRH").alias("basic")))


@query("i14_motif_count", f"""{W}{SEQUENCES} SELECT row_id, len(list_filter(range(1, length(heavy) - 1), lambda i: heavy[i] = 'N' AND heavy[i+1] <> 'P' AND heavy[i+2] IN ('S', 'T'))) AS overlapping,
  len(regexp_extract_all(heavy, 'N[^P][ST]')) AS separate FROM seq""")
def i14(t: Tables) -> DataFrame:
    return t.sequences.select("row_id", V.motif_count("heavy").alias("overlapping"), V.motif_count("heavy", overlapping=False).alias("separate"))


@query("i15_bins", f"""{W}{SEQUENCES} SELECT row_id, CASE WHEN length(cdrh3) <= 10 THEN 'short' WHEN length(cdrh3) <= 20 THEN 'medium' ELSE 'long' END AS region_bin,
  CASE WHEN length(heavy) <= 115 THEN 'short' WHEN length(heavy) <= 135 THEN 'normal' ELSE 'long' END AS heavy_bin, length(heavy) // 5 * 5 AS width_bin FROM seq""")
def i15(t: Tables) -> DataFrame:
    return t.sequences.select("row_id", V.region_length_bin(F.length("cdrh3")).alias("region_bin"), V.heavy_length_bin(F.length("heavy")).alias("heavy_bin"),
                              V.width_bin(F.length("heavy"), 5).alias("width_bin"))


@query("i16_affixes", f"{W}{SEQUENCES} SELECT row_id, left(heavy, 3) AS heavy_prefix, right(heavy, 3) AS heavy_suffix FROM seq")
def i16(t: Tables) -> DataFrame:
    return t.sequences.select("row_id", X.prefix("heavy", 3).alias("heavy_prefix"), X.suffix("heavy", 3).alias("heavy_suffix"))


@query("i17_hash_ids", f"""{W}{RECORDS} SELECT row_id, sha256(text) AS text_hash, 'value_' || left(sha256(source), 12) AS value_id,
  CASE WHEN light_raw = '' THEN 'missing' ELSE left(sha256(light_raw), 12) END AS short_hash FROM rec""")
def i17(t: Tables) -> DataFrame:
    return t.records.select("row_id", X.hash_id("text").alias("text_hash"), X.hash_id("source", 12, "value_").alias("value_id"),
                            X.hash_id("light_raw", 12, "", "missing").alias("short_hash"))


@query("i18_primary_token", r"""SELECT doc_id, CASE WHEN x = '' THEN 'missing_source' ELSE coalesce(list_filter(list_transform(string_split_regex(x, '[;,|]'),
  lambda p: regexp_replace(p, '^\s+|\s+$', '', 'g')), lambda p: p <> '')[1], x) END AS token FROM (
  SELECT doc_id, regexp_replace(split_part(text, chr(10), 1), '^\s+|\s+$', '', 'g') AS x FROM documents)""")
def i18(t: Tables) -> DataFrame:
    return t.records.select(F.col("row_id").alias("doc_id"), X.primary_token("heavy_raw").alias("token"))


@query("i19_minmax", """WITH s AS (SELECT min(n_chars) AS lo, max(n_chars) AS hi FROM documents) SELECT doc_id, round(CAST(n_chars - lo AS DOUBLE) / (hi - lo), 6) AS n_chars_scaled,
  CAST(0.5 AS DOUBLE) AS same_scaled, CAST(NULL AS DOUBLE) AS none_scaled FROM documents, s""")
def i19(t: Tables) -> DataFrame:
    df = t.documents.select("doc_id", "n_chars", F.lit(7.0).alias("same"), F.lit(None).cast("double").alias("none"))
    return rounded(minmax(df, ["n_chars", "same", "none"]).select("doc_id", "n_chars_scaled", "same_scaled", "none_scaled"))


@query("i20_metric_pair", """SELECT event_id, CAST(k AS DOUBLE) AS roc_auc, CAST(CASE WHEN event_id % 2 = 0 THEN k + 1 ELSE k + 2 END AS DOUBLE) AS pr_auc FROM (
  SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)""")
def i20(t: Tables) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long").cast("string")
    plus = lambda n: (k.cast("long") + n).cast("string")
    even = F.concat(F.lit('{"roc_auc": {"mean": '), k, F.lit('}, "pr_auc": '), plus(1), F.lit("}"))
    odd = F.concat(F.lit('{"roc_auc": '), k, F.lit(', "average_precision": {"value": '), plus(2), F.lit("}}"))
    payload = F.when(F.col("event_id") % 2 == 0, even).otherwise(odd)
    roc, pr = metric_pair(payload)
    return t.events.select("event_id", roc.alias("roc_auc"), pr.alias("pr_auc"))


@query("i21_mark_spans", f"""{W}{SEQUENCES}, r AS (SELECT row_id, heavy, substr(heavy, 3, 4) AS r1, substr(heavy, 12, 5) AS r2, CASE WHEN row_id % 3 = 0 THEN 'WWWWWW' ELSE substr(heavy, 20, 3) END AS r3 FROM seq),
  a AS (SELECT *, CASE WHEN r1 = '' THEN 0 ELSE instr(heavy, r1) END AS o1 FROM r), b AS (SELECT *, CASE WHEN o1 > 0 THEN o1 + length(r1) ELSE 1 END AS p1 FROM a),
  c AS (SELECT *, CASE WHEN r2 = '' THEN 0 ELSE instr(substr(heavy, p1), r2) END AS o2 FROM b), d AS (SELECT *, CASE WHEN o2 > 0 THEN p1 + o2 - 1 + length(r2) ELSE p1 END AS p2 FROM c),
  e AS (SELECT *, CASE WHEN r3 = '' THEN 0 ELSE instr(substr(heavy, p2), r3) END AS o3 FROM d)
  SELECT row_id, concat_ws(',', CASE WHEN o1 = 0 THEN 'cdrh1' END, CASE WHEN o2 = 0 THEN 'cdrh2' END, CASE WHEN o3 = 0 THEN 'cdrh3' END) AS failed_regions, o1 > 0 AND o2 > 0 AND o3 > 0 AS ok,
  concat_ws(',', CASE WHEN o1 > 0 AND length(heavy) - length(replace(heavy, r1, '')) > length(r1) THEN 'cdrh1' END,
    CASE WHEN o2 > 0 AND length(substr(heavy, p1)) - length(replace(substr(heavy, p1), r2, '')) > length(r2) THEN 'cdrh2' END,
    CASE WHEN o3 > 0 AND length(substr(heavy, p2)) - length(replace(substr(heavy, p2), r3, '')) > length(r3) THEN 'cdrh3' END) AS ambiguous_regions FROM e""")
def i21(t: Tables) -> DataFrame:
    third = F.when(F.col("row_id") % 3 == 0, "WWWWWW").otherwise(F.substr("heavy", F.lit(20), F.lit(3)))
    regions = [("cdrh1", F.substr("heavy", F.lit(3), F.lit(4))), ("cdrh2", F.substr("heavy", F.lit(12), F.lit(5))), ("cdrh3", third)]
    marked = t.sequences.select("row_id", mark_spans(F.col("heavy"), regions).alias("m"))
    return marked.select("row_id", "m.failed_regions", "m.ok", "m.ambiguous_regions")


@query("i22_rule_columns", f"{W}{SCORED_SQL} SELECT row_id, confidence_bin, risk_score, risk_bin, record_category, priority_category FROM scored")
def i22(t: Tables) -> DataFrame:
    return scored(t).select("row_id", "confidence_bin", "risk_score", "risk_bin", "record_category", "priority_category")


@query("i22_tiers_and_flags", f"""{W}{SCORED_SQL} SELECT row_id, CASE WHEN record_category = 'conflict_label' OR record_category = 'known_non_neutralising' THEN 'review'
  WHEN score >= 0.85 AND confidence_bin = 'high' AND risk_bin = 'low' THEN 'tier_1' ELSE 'tier_2' END AS tier,
  length(heavy) < 105 OR length(heavy) > 140 OR length(light) < 85 OR length(light) > 130 AS unusual_length_flag FROM scored""")
def i22_tiers(t: Tables) -> DataFrame:
    df = scored(t).withColumn("model_disagreement", F.col("record_category") == "known_non_neutralising")
    flags = R.with_review_flags(df.drop("heavy_length", "light_length"), "heavy", "light")
    return flags.select("row_id", R.shortlist_tier().alias("tier"), "unusual_length_flag")


@query("i23_verdicts", """WITH m AS (SELECT l_suppkey, avg(l_discount) * 14 AS mr, avg(l_tax) * 18 AS mp, avg(l_discount) * 3.6 AS br, avg(l_tax) * 2 AS ec, count(*) AS vg,
    avg(l_quantity) / 28 AS xr, avg(l_quantity) / 27 AS xp FROM lineitem GROUP BY 1)
  SELECT l_suppkey, CASE WHEN mr >= 0.7 AND mp >= 0.7 THEN 'supported' ELSE 'weaker_than_grouped' END AS generalisation,
  CASE WHEN br <= 0.18 AND ec <= 0.08 THEN 'reasonably_calibrated' ELSE 'ranking_only' END AS calibration,
  CASE WHEN xr >= 0.9 AND xp >= 0.9 THEN 'domain_difference' WHEN mr - xr >= 0.1 OR mp - xp >= 0.1 THEN 'partly_source_driven' ELSE 'conservative_control' END AS background FROM m""")
def i23(t: Tables) -> DataFrame:
    m = t.lineitem.groupBy("l_suppkey").agg(
        (F.avg("l_discount") * 14).alias("macro_roc_auc"), (F.avg("l_tax") * 18).alias("macro_pr_auc"), (F.avg("l_discount") * 3.6).alias("brier"),
        (F.avg("l_tax") * 2).alias("ece"), F.count("*").alias("valid_groups"), (F.avg("l_quantity") / 28).alias("matched_roc_auc"), (F.avg("l_quantity") / 27).alias("matched_pr_auc"))
    m = m.withColumns({"broad_roc_auc": F.col("macro_roc_auc"), "broad_pr_auc": F.col("macro_pr_auc")})
    return R.verdicts(m).select("l_suppkey", "generalisation", "calibration", "background")


@query("i24_diversity_key", f"""{W}{SEQUENCES} SELECT row_id, lang || ' | ' || source || ' | ' || CASE WHEN cdrh3 = '' THEN 'unknown' WHEN length(cdrh3) <= 10 THEN 'short'
  WHEN length(cdrh3) <= 20 THEN 'medium' ELSE 'long' END || ' | ' || CASE WHEN cdrh3 = '' THEN 'missing_cdrh3' ELSE left(sha256(cdrh3), 12) END AS diversity_group,
  source || ' | ' || lang || ' | ' || CASE WHEN length(cdrh3) <= 10 THEN 'short' WHEN length(cdrh3) <= 20 THEN 'medium' ELSE 'long' END AS old_group,
  lang || ' | ' || source || ' | unknown | missing_cdrh3' AS group_from_old_key FROM seq""")
def i24(t: Tables) -> DataFrame:
    df = R.with_priority_group(t.sequences.withColumn("n", F.length("cdrh3")), "source", "lang", "n").withColumnRenamed("diversity_group", "old_group")
    old = R.diversity_key(df, "lang", None, "old_group", None).select("*", F.col("diversity_group").alias("group_from_old_key")).drop(
        "diversity_group", "target_region_group", "v_gene_group", "cdrh3_length_bin", "cdrh3_pattern_hash")
    return R.diversity_key(old, "lang", "source", None, "cdrh3").select("row_id", "diversity_group", "old_group", "group_from_old_key")


@query("n8_clonotype_key", f"""{W}{SEQUENCES} SELECT row_id, source || '|' || CASE WHEN length(cdrh3) <= 10 THEN 'short' WHEN length(cdrh3) <= 20 THEN 'medium' ELSE 'long' END
  || '|' || left(cdrh3, 5) || '|' || right(cdrh3, 5) AS clonotype FROM seq""")
def n8(t: Tables) -> DataFrame:
    return t.sequences.select("row_id", R.clonotype_key("source", "cdrh3").alias("clonotype"))


@query("j6_simple_features", f"""{W}{SEQUENCES} SELECT row_id, CAST(length(heavy) AS DOUBLE) AS heavy_length, CAST(length(light) AS DOUBLE) AS light_length, CAST(length(cdrh3) AS DOUBLE) AS cdrh3_length,
  CAST(0 AS DOUBLE) AS cdrl3_length, CAST(light <> '' AS DOUBLE) AS has_light, CAST(light = '' AS DOUBLE) AS is_nanobody_like, CAST(1 AS DOUBLE) AS has_structure,
  CAST(row_id % 2 AS DOUBLE) AS targets_rbd, CAST(0 AS DOUBLE) AS targets_spike, CAST(0 AS DOUBLE) AS targets_ntd FROM seq WHERE lower(heavy) NOT IN {TOKENS} AND lower(light) NOT IN ('na', 'nd') AND lower(cdrh3) NOT IN ('na', 'nd')""")
def j6(t: Tables) -> DataFrame:
    df = t.sequences.filter(~F.lower("heavy").isin("", "na", "nan", "none", "null", "nd", "n/a", "unknown") & ~F.lower("light").isin("na", "nd") & ~F.lower("cdrh3").isin("na", "nd"))
    df = df.withColumn("targets_rbd", F.when(F.col("row_id") % 2 == 1, "yes").otherwise("no"))
    return FE.simple_features(df, {"heavy": "heavy", "light": "light", "cdrh3": "cdrh3", "structure": "source", "region": "lang"}).select("row_id", *FE.SIMPLE_FEATURES)


@query("j7_model_columns", f"""{W}{SEQUENCES} SELECT row_id, md5(CASE WHEN light <> '' THEN heavy || '[SEP]' || light ELSE heavy END) AS pair_digest, nullif(length(heavy), 0) AS heavy_length,
  nullif(length(light), 0) AS light_length, nullif(length(cdrh3), 0) AS cdrh3_length, lang = 'en' AS targets_rbd, false AS targets_ntd FROM seq""")
def j7(t: Tables) -> DataFrame:
    df = t.sequences.withColumn("epitope", F.when(F.col("lang") == "en", "S; RBD").otherwise("rbdx"))
    out = FE.model_columns(df, "heavy", "light", "cdrh3", "cdrh3", "epitope")
    return out.select("row_id", F.md5("sequence_pair_text").alias("pair_digest"), "heavy_length", "light_length", "cdrh3_length", "targets_rbd", "targets_ntd")


@query("n3_composite_score", f"""{W}{RECORDS}, p AS (SELECT row_id, score AS a, CAST(length(text) AS DOUBLE) AS b, CAST(row_id % 17 AS DOUBLE) AS c FROM rec),
  s AS (SELECT min(a) la, max(a) ha, min(b) lb, max(b) hb, min(c) lc, max(c) hc FROM p)
  SELECT row_id, round(((a - la) / (ha - la) * 0.4 + (b - lb) / (hb - lb) * 0.3 + (c - lc) / (hc - lc) * 0.2) / 0.9, 6) AS composite_score FROM p, s""")
def n3(t: Tables) -> DataFrame:
    df = t.records.select("row_id", F.col("score").alias("retrieval_score"), F.length("text").cast("double").alias("max_similarity"),
                          (F.col("row_id") % 17).cast("double").alias("top10_similarity"), F.lit(None).cast("double").alias("centroid_similarity"))
    return rounded(composite(df).select("row_id", "composite_score"))


@query("n4_blend", f"""{W}{RECORDS} SELECT row_id, round(CASE WHEN row_id % 3 = 0 THEN score WHEN row_id % 3 = 1 THEN (score + 0.5) / 2 END, 6) AS blended FROM rec""")
def n4(t: Tables) -> DataFrame:
    df = t.records.withColumns({"a": F.when(F.col("row_id") % 3 != 2, F.col("score")), "b": F.when(F.col("row_id") % 3 == 1, 0.5)})
    return rounded(df.select("row_id", blend(["a", "b"]).alias("blended")))
