"""A and B: scans, sinks, projections and names."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curatrix.catalog.base import RECORDS, Tables, query
from curatrix.constants import FORBIDDEN_PUBLIC_COLUMNS, NEGATIVE_NAME_MARKERS, ROLE_KEYWORDS, ROLE_SEQUENCE_EXCLUDES, SOURCE_COLUMN_CANDIDATES
from curatrix.functions.text import norm_text
from curatrix.lineage import checkpoint_dir, shared_path
from curatrix.operators import columns as C
from curatrix.operators.ordered import with_row_id
from curatrix.sources import sinks
from curatrix.sources import tables as S
from curatrix.sources.files import write_matrix


def scratch(t: Tables, name: str) -> str:
    """A folder in the cluster's shared storage for a round trip."""
    return f"{checkpoint_dir(t.spark)}/roundtrip-{os.getpid()}-{t.spark.sparkContext.applicationId}/{name}"


@query("a1_typed_csv_scan", "SELECT o_orderkey, o_totalprice, o_orderpriority FROM orders")
def a1(t: Tables) -> DataFrame:
    path = scratch(t, "orders_csv")
    sinks.write_csv(t.orders.select("o_orderkey", "o_totalprice", "o_orderpriority"), path)
    schema = T.StructType().add("o_orderkey", "long").add("o_totalprice", "double").add("o_orderpriority", "string")
    return S.read_csv_typed(t.spark, path, schema)


@query("a2_text_csv_scan", "SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, p_name, p_brand FROM part")
def a2(t: Tables) -> DataFrame:
    path = scratch(t, "part_csv")
    sinks.write_csv(t.part.select("p_partkey", "p_name", "p_brand"), path)
    return S.read_csv_text(t.spark, path)


@query("a3_paired_file_scan", """SELECT c_name AS heavy_raw, c_mktsegment AS light_raw FROM customer""")
def a3(t: Tables) -> DataFrame:
    path = scratch(t, "paired_gz")
    rows = t.customer.select(F.col("c_name").alias("heavy_sequence"), F.col("c_mktsegment").alias("light_sequence"))
    rows.write.mode("overwrite").option("header", True).option("compression", "gzip").csv(path)
    return S.scan_paired_files(t.spark, [path]).select("heavy_raw", "light_raw")


@query("a3_quoted_line_breaks", """SELECT c_name || chr(10) || '"' || c_mktsegment || '", ' || chr(10) AS heavy_raw, c_mktsegment AS light_raw,
  row_number() OVER (ORDER BY c_custkey) AS record FROM customer""")
def a3_breaks(t: Tables) -> DataFrame:
    """Records of several lines, in files dealt by another column; the order is read back from key and line number."""
    path = shared_path(t.spark, "paired_breaks")
    heavy = F.concat("c_name", F.lit('\n"'), "c_mktsegment", F.lit('", \n'))
    rows = t.customer.select("c_custkey", heavy.alias("heavy_sequence"), F.col("c_mktsegment").alias("light_sequence"))
    rows.repartitionByRange(5, "c_custkey").sortWithinPartitions("c_custkey").write.option("header", True).option(
        "compression", "gzip").option("quoteAll", True).option("escape", '"').option(
        "ignoreTrailingWhiteSpace", False).csv(path)
    found = S.scan_paired_files(t.spark, [path])
    return with_row_id(found, ["source_file", "line_no"], "record").select("heavy_raw", "light_raw", (F.col("record") + 1).alias("record"))


@query("a5_required_columns", "SELECT o_orderkey, o_custkey FROM orders")
def a5(t: Tables) -> DataFrame:
    return S.require_columns(t.orders, ["o_orderkey", "o_custkey"]).select("o_orderkey", "o_custkey")


@query("a6_first_available_column", RECORDS.join(["WITH ", " SELECT row_id, source AS value FROM rec"]))
def a6(t: Tables) -> DataFrame:
    rec = t.records
    return rec.select("row_id", S.first_available(rec, SOURCE_COLUMN_CANDIDATES).alias("value"))


@query("a7_embeddings_by_id", """SELECT vec_id, label, CAST(len(embedding) AS INTEGER) AS width,
  round(CAST(embedding[1] AS DOUBLE), 6) AS first_value FROM embeddings""")
def a7(t: Tables) -> DataFrame:
    rows = t.embeddings.select("vec_id", "label")
    aligned = S.load_embeddings(t.embeddings, rows, "vec_id")
    return aligned.select("vec_id", "label", F.size("embedding").alias("width"),
                          F.round(F.get("embedding", F.lit(0)).cast("double"), 6).alias("first_value"))


@query("a7_binary_matrix", """SELECT vec_id, label, CAST(len(embedding) AS INTEGER) AS width, round(CAST(embedding[1] AS DOUBLE), 6) AS first_value,
  round(CAST(list_sum(embedding) AS DOUBLE), 4) AS total FROM embeddings""")
def a7_binary(t: Tables) -> DataFrame:
    """The vectors as a row-aligned binary matrix and back."""
    path = shared_path(t.spark, "binary_matrix")
    write_matrix(t.embeddings, ["vec_id"], "embedding", path)
    aligned = S.load_matrix(t.spark, path, t.embeddings.select("vec_id", "label"), ["vec_id"], kind="binary")
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x)
    return aligned.select("vec_id", "label", F.size("embedding").alias("width"), F.round(F.get("embedding", F.lit(0)), 6).alias("first_value"),
                          F.round(total, 4).alias("total"))


@query("a8_metric_json_scan", "SELECT count(*) AS objects, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS k_sum FROM events")
def a8(t: Tables) -> DataFrame:
    path = scratch(t, "metrics_json")
    t.events.select(F.col("props").alias("value")).write.mode("overwrite").text(path)
    files = S.read_metrics(t.spark, [path, path + "-absent"])
    lines = files.select(F.explode(F.split(F.trim("json"), "\n")).alias("line")).filter(F.col("line") != "")
    return lines.agg(F.count("*").alias("objects"), F.sum(F.get_json_object("line", "$.k").cast("long")).alias("k_sum"))


@query("a9_csv_round_trip", "SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def a9(t: Tables) -> DataFrame:
    path = scratch(t, "supplier_csv")
    sinks.write_csv(t.supplier.select("s_suppkey", "s_name", "s_acctbal"), path)
    return t.spark.read.csv(path, header=True, schema="s_suppkey long, s_name string, s_acctbal double")


@query("a10_metric_json_sink", """SELECT '{"n":' || count(*) || ',"source":"' || source || '"}' AS value FROM documents GROUP BY source""")
def a10(t: Tables) -> DataFrame:
    path = scratch(t, "source_metrics")
    sinks.write_metrics(t.documents.groupBy("source").agg(F.count("*").alias("n")), path)
    return t.spark.read.text(path)


@query("b1_project_rename", "SELECT p_brand AS brand, p_partkey AS part_id, p_name AS name FROM part")
def b1(t: Tables) -> DataFrame:
    return C.project_rename(t.part, {"p_partkey": "part_id", "p_name": "name", "p_brand": "brand"}, ["brand", "part_id", "name"])


@query("b2_rename_by_position", "SELECT p_partkey AS sample_name, p_name AS extra_col_01, p_brand AS group_v, p_type AS extra_col_03, p_size AS extra_col_04, p_retailprice AS extra_col_05 FROM part")
def b2(t: Tables) -> DataFrame:
    return C.rename_by_position(t.part, {0: "sample_name", 2: "group_v", 9: "absent"})[0]


@query("b3_rename_by_alias", """SELECT o_orderkey AS extra_col_00,
  CASE WHEN trim(a) <> '' THEN a ELSE b END AS text FROM (
  SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN '  ' ELSE o_orderstatus END AS a, o_orderpriority AS b FROM orders)""")
def b3(t: Tables) -> DataFrame:
    rows = t.orders.select(
        "o_orderkey", F.when(F.col("o_orderstatus") == "O", "  ").otherwise(F.col("o_orderstatus")).alias("a"),
        F.col("o_orderpriority").alias("b"))
    return C.rename_by_alias(rows, {"a": "text", "b": "text"})


@query("b4_reorder_columns", "SELECT c_mktsegment, c_name, c_custkey, c_nationkey, c_acctbal FROM customer")
def b4(t: Tables) -> DataFrame:
    return C.reorder(t.customer, ["c_mktsegment", "absent", "c_name"])


@query("b5_public_projection", RECORDS.join(["WITH ", " SELECT row_id, source, label FROM rec"]))
def b5(t: Tables) -> DataFrame:
    rec = C.drop_sequences(t.records.withColumnRenamed("text", "sequence_pair_text"))
    return C.public_projection(rec, ["row_id", "source", "label", "absent"], FORBIDDEN_PUBLIC_COLUMNS)


@query("b6_detect_roles")
def b6(t: Tables) -> DataFrame:
    names = [c for table in (t.documents, t.part, t.orders, t.customer, t.lineitem) for c in table.columns]
    keywords = {**ROLE_KEYWORDS, "price": ["retail price", "total price"], "key": ["order key", "cust key"]}
    exclude = {"heavy_chain_sequence": ROLE_SEQUENCE_EXCLUDES, "light_chain_sequence": ROLE_SEQUENCE_EXCLUDES}
    roles = C.detect_roles(t.spark, names, keywords, exclude=exclude)
    negative = C.split_signed_columns(names, NEGATIVE_NAME_MARKERS)[1]
    return roles.withColumn("negative", F.col("column").isin(negative))


@query("b7_columns_matching", r"""SELECT * FROM (
  SELECT 'text' AS "column", count(*) FILTER (regexp_matches(text, '(?i)of the')) AS matching_rows FROM documents
  UNION ALL SELECT 'lang', count(*) FILTER (regexp_matches(lang, '(?i)of the')) FROM documents
  UNION ALL SELECT 'source', count(*) FILTER (regexp_matches(source, '(?i)of the')) FROM documents) WHERE matching_rows > 0""")
def b7(t: Tables) -> DataFrame:
    return C.columns_matching(t.documents, "of the")


@query("b8_surrogate_row_id", "SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS row_id FROM orders")
def b8(t: Tables) -> DataFrame:
    return with_row_id(t.orders.select("o_orderkey", "o_totalprice"), ["o_totalprice", "o_orderkey"]).select("o_orderkey", "row_id")


@query("i2_norm_text", r"""SELECT doc_id, md5(CASE WHEN lower(x) IN ('', 'na', 'nan', 'none', 'null', 'nd', 'n/a', 'unknown') THEN 'absent' ELSE x END) AS digest
  FROM (SELECT doc_id, regexp_replace(coalesce(split_part(text, chr(10), 2), ''), '^\s+|\s+$', '', 'g') AS x FROM documents)""")
def i2(t: Tables) -> DataFrame:
    second = F.split_part("text", F.lit("\n"), F.lit(2))
    return t.documents.select("doc_id", F.md5(norm_text(second, "absent")).alias("digest"))
