"""C, D and H: filters, joins and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curatrix.catalog.base import RECORDS, SEQUENCES, Tables, query, rounded
from curatrix.functions.text import hash_id, is_missing, is_missing_text, is_valid_alphabet
from curatrix.functions.values import matching_bin
from curatrix.lineage import cut_lineage
from curatrix.operators import filters as X
from curatrix.operators import joins as J
from curatrix.operators import rules as R
from curatrix.operators import sets as H
from curatrix.operators.ordered import dedup_first

W = "WITH "
MISSING9 = "('', 'na', 'nan', 'none', 'null', 'nd', 'n/a', 'unknown')"
MARKERS = "('', '-', '--', 'na', 'n/a', 'nan', 'nd', 'n d', 'none', 'null', 'not available', 'not determined', 'not reported', 'not sequenced', 'unknown', 'unavailable')"
SCORED_SQL = SEQUENCES + """,
flags AS (SELECT *, abs(score - 0.5) AS confidence_score,
    CASE WHEN abs(score - 0.5) >= 0.30 THEN 'high' WHEN abs(score - 0.5) >= 0.15 THEN 'medium' ELSE 'low' END AS confidence_bin,
    length(heavy) AS hl, length(cdrh3) AS cl,
    length(heavy) - length(replace(heavy, 'C', '')) AS cys_h, length(cdrh3) - length(replace(cdrh3, 'C', '')) AS cys_c,
    CASE WHEN heavy <> '' THEN CAST(length(heavy) - length(translate(heavy, 'AVILMFWY', '')) AS DOUBLE) / length(heavy) ELSE 0 END AS hyd_h,
    CASE WHEN cdrh3 <> '' THEN CAST(length(cdrh3) - length(translate(cdrh3, 'AVILMFWY', '')) AS DOUBLE) / length(cdrh3) ELSE 0 END AS hyd_c,
    (length(heavy) - length(translate(heavy, 'KRH', ''))) - (length(heavy) - length(translate(heavy, 'DE', ''))) AS charge,
    len(list_filter(range(1, length(heavy) - 1), lambda i: heavy[i] = 'N' AND heavy[i+1] <> 'P' AND heavy[i+2] IN ('S', 'T'))) AS motifs
  FROM seq),
risk AS (SELECT *, CAST(cl > 20 AS INTEGER) + CAST(cl > 30 AS INTEGER) + CAST(hyd_c > 0.45 AS INTEGER)
    + CAST(hyd_h > 0.42 AS INTEGER) + CAST(cys_c > 1 AS INTEGER) + CAST(cys_h > 4 AS INTEGER) + CAST(motifs > 0 AS INTEGER)
    + CAST(abs(charge) > 12 AS INTEGER) + CAST(hl < 105 OR hl > 140 AS INTEGER) AS risk_score FROM flags),
cat AS (SELECT *, CASE WHEN risk_score <= 1 THEN 'low' WHEN risk_score <= 3 THEN 'medium' ELSE 'high' END AS risk_bin,
    CASE WHEN conflict THEN 'conflict_label' WHEN label = 1 THEN 'known_neutralising' WHEN label = 0 THEN 'known_non_neutralising'
         WHEN label IS NULL THEN 'missing_label' ELSE 'other' END AS record_category FROM risk),
scored AS (SELECT *, CASE
    WHEN score >= 0.75 AND confidence_bin = 'high' AND risk_bin IN ('low', 'medium') AND record_category = 'known_neutralising' THEN 'high_confidence_known_positive'
    WHEN score >= 0.75 AND confidence_bin = 'high' AND risk_bin IN ('low', 'medium') AND record_category = 'conflict_label' THEN 'high_score_conflict_label'
    WHEN score >= 0.75 AND confidence_bin = 'high' AND risk_bin IN ('low', 'medium') AND record_category = 'missing_label' THEN 'high_score_missing_label'
    WHEN score >= 0.75 AND confidence_bin = 'high' AND risk_bin = 'high' THEN 'high_score_but_sequence_risk'
    WHEN confidence_bin = 'low' THEN 'uncertain_prediction' ELSE 'lower_priority' END AS priority_category FROM cat)"""


def scored(t: Tables) -> DataFrame:
    """Sequences with prediction, flags, risk and categories.

    Cleaned sequences are written once: a later filter on a category would otherwise be pushed
    below the cleaning and repeat its expressions in every condition.
    """
    df = R.with_prediction(cut_lineage(t.sequences))
    df = cut_lineage(R.with_risk(R.with_sequence_flags(df, "heavy", "light", "cdrh3")))
    return df.withColumn("record_category", R.record_category()).withColumn("priority_category", R.priority_category())


@query("c1_filter_mentions", "SELECT doc_id FROM documents WHERE regexp_matches(coalesce(text, ''), '(?i)licen[cs]e')")
def c1(t: Tables) -> DataFrame:
    return X.filter_mentions(t.documents, ["text"], "licen[cs]e").select("doc_id")


@query("c2_is_missing", f"""SELECT doc_id, line IS NULL OR trim(regexp_replace(lower(line), '[^a-z0-9]+', ' ', 'g')) IN {MARKERS} AS missing
  FROM (SELECT doc_id, split_part(text, chr(10), 3) AS line FROM documents)""")
def c2(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", is_missing(F.split_part("text", F.lit("\n"), F.lit(3))).alias("missing"))


@query("c3_is_missing_text", f"""{W}{RECORDS} SELECT row_id, lower(trim(coalesce(light_raw, ''))) IN {MISSING9} AS missing FROM rec""")
def c3(t: Tables) -> DataFrame:
    return t.records.select("row_id", is_missing_text("light_raw").alias("missing"))


@query("c4_valid_alphabet", f"""{W}{SEQUENCES} SELECT row_id, regexp_matches(heavy, '^[ACDEFGHIKLMNPQRSTVWY]+$') AS heavy_ok,
  regexp_matches(heavy_raw, '^[A-Za-z .,]+$') AS raw_ok FROM seq""")
def c4(t: Tables) -> DataFrame:
    return t.sequences.select("row_id", is_valid_alphabet("heavy").alias("heavy_ok"),
                              is_valid_alphabet("heavy_raw", "A-Za-z .,").alias("raw_ok"))


@query("c5_filter_lengths", f"{W}{SEQUENCES} SELECT row_id FROM seq WHERE length(heavy) BETWEEN 80 AND 180 AND length(light) BETWEEN 60 AND 140")
def c5(t: Tables) -> DataFrame:
    return X.filter_lengths(t.sequences, "heavy", "light").select("row_id")


@query("c6_strict_label_funnel", f"""{W}{SEQUENCES} SELECT CASE WHEN label IS NULL THEN 'label_missing' WHEN conflict THEN 'conflict'
  WHEN heavy = '' THEN 'invalid_heavy' WHEN light <> '' AND length(light) < 20 THEN 'invalid_light' ELSE 'kept' END AS step,
  count(*) AS rows FROM seq GROUP BY 1""")
def c6(t: Tables) -> DataFrame:
    df = t.sequences.withColumns({
        "has_heavy": F.col("heavy") != "", "valid_heavy": F.col("heavy") != "",
        "has_light": F.col("light") != "", "valid_light": F.length("light") >= 20})
    steps = X.strict_label_steps("label", "conflict", "has_heavy", "valid_heavy", "has_light", "valid_light")
    return X.funnel_counts(X.funnel(df, steps))


@query("c7_any_value_count", f"""SELECT count(*) FILTER (NOT ({' AND '.join(f"trim(regexp_replace(lower({c}), '[^a-z0-9]+', ' ', 'g')) IN {MARKERS}" for c in ('text', 'source'))})) AS rows_with_value,
  count(*) AS rows FROM documents""")
def c7(t: Tables) -> DataFrame:
    return X.count_any_value(t.documents, ["text", "source"])


@query("c8_filter_scorable", f"{W}{SEQUENCES} SELECT row_id FROM seq WHERE heavy <> '' AND lower(heavy) NOT IN {MISSING9} AND length(heavy) >= 20")
def c8(t: Tables) -> DataFrame:
    df = t.sequences.withColumn("valid", F.length("heavy") >= 20)
    return X.filter_scorable(df, "heavy", "valid").select("row_id")


@query("c9_candidate_pool", f"""{W}{SCORED_SQL} SELECT row_id, record_category = 'known_non_neutralising' AS model_disagreement FROM scored
  WHERE score >= 0.75 AND confidence_bin = 'high' AND risk_bin IN ('low', 'medium')
    AND (record_category IN ('known_neutralising', 'missing_label', 'conflict_label') OR (record_category = 'known_non_neutralising' AND score >= 0.90))""")
def c9(t: Tables) -> DataFrame:
    return X.candidate_pool(scored(t)).select("row_id", "model_disagreement")


@query("c10_relaxed_pool", f"""{W}{SCORED_SQL} SELECT row_id, false AS model_disagreement FROM scored WHERE score >= 0.65
    AND confidence_bin IN ('medium', 'high') AND risk_bin IN ('low', 'medium') AND record_category IN ('known_neutralising', 'missing_label', 'conflict_label')""")
def c10(t: Tables) -> DataFrame:
    return X.relaxed_pool(scored(t)).select("row_id", "model_disagreement")


@query("c11_binary_labels", """SELECT doc_id, CAST(x AS INTEGER) AS label FROM (
  SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN '2' WHEN doc_id % 7 = 0 THEN 'yes' ELSE quality || '.0' END AS raw, try_cast(raw AS DOUBLE) AS x FROM labels)
  WHERE x IN (0, 1)""")
def c11(t: Tables) -> DataFrame:
    raw = (F.when(F.col("doc_id") % 5 == 0, "2").when(F.col("doc_id") % 7 == 0, "yes")
           .otherwise(F.concat(F.col("quality").cast("string"), F.lit(".0"))))
    return X.binary_labels(t.labels.withColumn("raw", raw), "raw").select("doc_id", "label")


@query("c12_primary_subset", f"{W}{SEQUENCES} SELECT row_id, label FROM seq WHERE heavy <> '' AND light <> '' AND cdrh3 <> '' AND NOT conflict AND label IN (0, 1)")
def c12(t: Tables) -> DataFrame:
    df = t.sequences.withColumns({"has_h": F.col("heavy") != "", "has_l": F.col("light") != "",
                                  "has_r": F.col("cdrh3") != "", "clean": ~F.col("conflict")})
    return X.primary_subset(df, ["has_h", "has_l", "has_r", "clean"]).select("row_id", "label")


@query("d1_enrich_by_key", """SELECT o_orderkey, CASE WHEN trim(p) = '' THEN coalesce(c_mktsegment, p) ELSE p END AS segment FROM (
  SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE o_orderpriority END AS p FROM orders) LEFT JOIN customer ON o_custkey = c_custkey""")
def d1(t: Tables) -> DataFrame:
    left = t.orders.select("o_orderkey", F.col("o_custkey").alias("key"),
                           F.when(F.col("o_orderkey") % 3 == 0, "").otherwise(F.col("o_orderpriority")).alias("segment"))
    right = t.customer.select(F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("segment"))
    return J.enrich_by_key(left, right, "key", ["segment"]).select("o_orderkey", "segment")


@query("d2_remove_overlap", """SELECT doc_id FROM documents WHERE NOT EXISTS (
  SELECT 1 FROM benchmark b WHERE b.text = documents.text) AND text NOT IN (SELECT text FROM documents WHERE doc_id % 10 = 0)""")
def d2(t: Tables) -> DataFrame:
    known = t.benchmark.select("text").unionByName(t.documents.filter(F.col("doc_id") % 10 == 0).select("text"))
    return J.remove_overlap(t.documents, known, "text").select("doc_id")


@query("d2_overlap_count", "SELECT count(*) AS overlap_rows FROM documents WHERE text IN (SELECT text FROM documents WHERE doc_id % 10 = 0)")
def d2_count(t: Tables) -> DataFrame:
    return J.count_overlap(t.documents, t.documents.filter(F.col("doc_id") % 10 == 0), "text")


SAVED_SQL = """saved AS (SELECT sha256(text) AS score_hash, 'a' AS score_file, avg(doc_id % 11) AS saved_score FROM documents WHERE doc_id % 2 = 0 GROUP BY 1
  UNION ALL SELECT sha256(lower(text)), 'b', avg(doc_id % 13) FROM documents WHERE doc_id % 3 = 0 GROUP BY 1),
hits AS (SELECT DISTINCT doc_id, score_file, saved_score FROM (
  SELECT doc_id, score_file, saved_score FROM documents JOIN saved ON score_hash = sha256(text)
  UNION ALL SELECT doc_id, score_file, saved_score FROM documents JOIN saved ON score_hash = sha256(lower(text))))"""


def saved_scores(t: Tables) -> DataFrame:
    d = t.documents
    a = d.filter("doc_id % 2 = 0").select(hash_id("text").alias("score_hash"), F.lit("a").alias("score_file"), (F.col("doc_id") % 11).alias("saved_score"))
    b = d.filter("doc_id % 3 = 0").select(hash_id(F.lower("text")).alias("score_hash"), F.lit("b").alias("score_file"), (F.col("doc_id") % 13).alias("saved_score"))
    return J.mean_scores(a.unionByName(b), "score_hash", "saved_score", "score_file")


@query("d3_merge_scores", f"""WITH {SAVED_SQL} SELECT d.doc_id, round(avg(h.saved_score), 6) AS saved_score,
  CASE WHEN count(h.score_file) > 0 THEN count(DISTINCT h.score_file) END AS score_files
  FROM documents d LEFT JOIN hits h ON d.doc_id = h.doc_id GROUP BY 1""")
def d3(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", hash_id("text").alias("h1"), hash_id(F.lower("text")).alias("h2"))
    return rounded(J.merge_scores(rows, saved_scores(t), "doc_id", ["h1", "h2"]).select("doc_id", "saved_score", "score_files"))


@query("e17_mean_scores", """SELECT sha256(source) AS key, round(avg(n_chars), 6) AS mean_score, count(DISTINCT lang) AS files FROM documents GROUP BY 1""")
def e17(t: Tables) -> DataFrame:
    return rounded(t.documents.groupBy(hash_id("source").alias("key")).agg(
        F.avg("n_chars").alias("mean_score"), F.count_distinct("lang").alias("files")))


@query("d4_attach_cluster", """SELECT doc_id, cluster FROM documents LEFT JOIN (
  SELECT text, arg_min(source, doc_id) AS cluster FROM documents WHERE doc_id % 2 = 1 GROUP BY text) USING (text)""")
def d4(t: Tables) -> DataFrame:
    clusters = t.documents.filter("doc_id % 2 = 1").select("text", F.col("source").alias("cluster"), F.col("doc_id").alias("place"))
    return J.attach_first(t.documents, clusters, "text", "cluster", "place").select("doc_id", "cluster")


@query("d5_attach_rows", "SELECT l.doc_id, l.quality, d.lang, d.source FROM labels l LEFT JOIN documents d ON l.doc_id = d.doc_id")
def d5(t: Tables) -> DataFrame:
    return J.attach_rows(t.labels.select("doc_id", "quality"), t.documents.select("doc_id", "lang", "source"), "doc_id")


BINS_SQL = SEQUENCES + """,
bins AS (SELECT *, length(heavy) // 5 * 5 || '|' || length(light) // 5 * 5 || '|' || (length(heavy) + length(light)) // 10 * 10
  || '|' || CASE WHEN light <> '' THEN 'True' ELSE 'False' END AS matching_bin FROM seq)"""


def binned(t: Tables) -> DataFrame:
    return t.sequences.withColumn("matching_bin", matching_bin(F.length("heavy"), F.length("light")))


@query("d6_cogroup_bins", f"""{W}{BINS_SQL}, a AS (SELECT matching_bin, count(*) AS n FROM bins WHERE label IS NOT NULL GROUP BY 1),
  b AS (SELECT matching_bin, count(*) AS n FROM bins WHERE label IS NULL GROUP BY 1)
  SELECT coalesce(a.matching_bin, b.matching_bin) AS matching_bin, coalesce(a.n, 0) AS left_rows, coalesce(b.n, 0) AS right_rows,
  least(coalesce(a.n, 0), coalesce(b.n, 0)) AS matched_rows FROM a FULL JOIN b ON a.matching_bin = b.matching_bin""")
def d6(t: Tables) -> DataFrame:
    rows = binned(t)
    return J.cogroup_bins(rows.filter("label IS NOT NULL"), rows.filter("label IS NULL"), "matching_bin")


@query("d7_assemble_blocks", f"{W}{SEQUENCES} SELECT row_id, length(heavy) AS heavy_length, length(light) AS light_length, round(score, 6) AS score FROM seq")
def d7(t: Tables) -> DataFrame:
    s = t.sequences
    blocks = [s.select("row_id", F.length("light").alias("light_length")), s.select("row_id", "score")]
    return rounded(J.assemble(s.select("row_id", F.length("heavy").alias("heavy_length")), blocks, "row_id"))


@query("d8_cross_params", f"""{W}{RECORDS} SELECT threshold, count(*) FILTER (score >= threshold) AS selected FROM rec,
  (SELECT CAST(unnest([0.5, 0.6, 0.7, 0.8, 0.9]) AS DOUBLE) AS threshold) GROUP BY 1""")
def d8(t: Tables) -> DataFrame:
    crossed = J.cross_params(t.records, [0.5, 0.6, 0.7, 0.8, 0.9], "threshold")
    return crossed.groupBy("threshold").agg(F.count_if(F.col("score") >= F.col("threshold")).alias("selected"))


@query("h1_union_classes", """SELECT retrieval_label, count(*) AS rows, CAST(sum(length(text)) AS BIGINT) AS chars FROM (
  SELECT text, 1 AS retrieval_label FROM benchmark UNION ALL SELECT text, 0 FROM documents) GROUP BY 1""")
def h1(t: Tables) -> DataFrame:
    both = H.union_classes(t.benchmark.select("text"), t.documents.select("text"))
    return both.groupBy("retrieval_label").agg(F.count("*").alias("rows"), F.sum(F.length("text")).alias("chars"))


@query("h2_union_parts", "SELECT source, count(*) AS rows FROM (SELECT 'documents' AS source, text FROM documents UNION ALL SELECT 'conversations', text FROM conversations UNION ALL SELECT 'benchmark', text FROM benchmark) GROUP BY 1")
def h2(t: Tables) -> DataFrame:
    parts = [df.select(F.lit(name).alias("source"), "text") for name, df in
             (("documents", t.documents), ("conversations", t.conversations), ("benchmark", t.benchmark))]
    return H.union_parts(parts).groupBy("source").agg(F.count("*").alias("rows"))


@query("h3_group_overlap", """SELECT o_custkey FROM orders WHERE o_orderdate < TIMESTAMP '1998-06-01' INTERSECT
  SELECT o_custkey FROM orders WHERE o_orderdate >= TIMESTAMP '1998-06-01'""")
def h3(t: Tables) -> DataFrame:
    early = F.col("o_orderdate") < F.lit("1998-06-01").cast("timestamp")
    return H.group_overlap(t.orders.filter(early), t.orders.filter(~early), "o_custkey")


@query("h4_distinct", "SELECT DISTINCT lang, source FROM documents")
def h4(t: Tables) -> DataFrame:
    return H.distinct_values(t.documents, ["lang", "source"])


@query("f1_dedup_first", "SELECT doc_id, lang, source FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS rn FROM documents) WHERE rn = 1")
def f1(t: Tables) -> DataFrame:
    return dedup_first(t.documents, ["text"], "doc_id").select("doc_id", "lang", "source")
