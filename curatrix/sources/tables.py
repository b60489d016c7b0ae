"""Table scans: typed and all-text CSV, gzip file sets, embeddings, metric JSON."""

from __future__ import annotations

import os
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curatrix.constants import HEAVY_COLUMN_CANDIDATES, LIGHT_COLUMN_CANDIDATES
from curatrix.operators.ordered import global_position
from curatrix.sources.files import read_matrix, scan_pairs

SUPPORTED = (".csv", ".tsv")


def read_csv_typed(
    spark: SparkSession, path: str, schema: T.StructType, sep: str | None = None, multi_line: bool = False
) -> DataFrame:
    """Header CSV or TSV under a fixed schema; common missing tokens become null.

    ``multi_line`` takes quoted line breaks and then reads each file in one task.
    """
    sep = sep or ("\t" if path.lower().endswith(".tsv") else ",")
    df = spark.read.csv(path, header=True, schema=schema, sep=sep, multiLine=multi_line, escape='"')
    tokens = ["", "NA", "N/A", "n/a", "NaN", "nan", "NULL", "null", "None", "#N/A", "<NA>"]
    return df.select(*[
        F.when(F.col(f.name).isin(tokens), F.lit(None)).otherwise(F.col(f.name)).alias(f.name)
        if isinstance(f.dataType, T.StringType) else F.col(f.name)
        for f in df.schema.fields
    ])


def read_csv_text(spark: SparkSession, path: str, sep: str = ",", multi_line: bool = False) -> DataFrame:
    """Every column as string; blank stays blank and is never null. ``multi_line`` as in ``read_csv_typed``."""
    return spark.read.csv(path, header=True, inferSchema=False, sep=sep, escape='"', multiLine=multi_line).na.fill("")


def pick_source(paths: Iterable[str], preferred: tuple[str, ...] = ()) -> str:
    """First supported file, files with a preferred name part first, then by name."""
    usable = [p for p in paths if p.lower().endswith(SUPPORTED)]
    if not usable:
        raise FileNotFoundError(f"no supported file, expected one of {', '.join(SUPPORTED)}")

    def rank(path: str) -> tuple[bool, str]:
        name = os.path.basename(path).lower()
        return not any(part in name for part in preferred), name

    return min(usable, key=rank)


def find_column(columns: list[str], candidates: list[str]) -> str | None:
    """First candidate present, compared without case and outer blanks."""
    present = {c.strip().lower(): c for c in columns}
    return next((present[c] for c in candidates if c in present), None)


def scan_paired_files(
    spark: SparkSession,
    paths: list[str],
    skip_probe: tuple[int, ...] = (0, 1, 2),
    heavy: list[str] = HEAVY_COLUMN_CANDIDATES,
    light: list[str] = LIGHT_COLUMN_CANDIDATES,
) -> DataFrame:
    """Two columns of a set of CSV files, gzip or plain, whose header sits behind 0 to 2 extra lines.

    Every file is read once, by one task: header, real line numbers and quoted line breaks come from the stream.
    ``line_no`` is the line on which a record begins. Lines up to the header, blank lines and records wider than the
    header are dropped; short records are filled with blanks. A file without a header gives no row.
    """
    return scan_pairs(spark, paths, skip_probe, heavy, light)


def union_parts(parts: list[DataFrame]) -> DataFrame:
    """All rows of several frames with the same columns."""
    first, *others = parts
    for other in others:
        first = first.unionByName(other)
    return first


def require_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise KeyError(f"missing required column(s): {', '.join(missing)}")
    return df


def first_available(df: DataFrame, candidates: list[str], default: str = "") -> Column:
    """First column that exists, else a constant."""
    return next((F.col(c) for c in candidates if c in df.columns), F.lit(default))


def load_embeddings(vectors: DataFrame, rows: DataFrame, key: str, vector: str = "embedding") -> DataFrame:
    """Vectors joined to their rows by id; a row without vector or an odd length is an error."""
    aligned = rows.join(vectors.select(key, vector), key, "left")
    checks = aligned.agg(
        F.count_if(F.col(vector).isNull()).alias("lost"),
        F.min(F.size(vector)).alias("shortest"),
        F.max(F.size(vector)).alias("longest"),
    ).first()
    if checks["lost"] or checks["shortest"] != checks["longest"]:
        raise ValueError(f"embedding table does not match the rows: {checks.asDict()}")
    return aligned


def load_matrix(spark: SparkSession, path: str, rows: DataFrame, order: list[str], vector: str = "embedding", kind: str = "parquet") -> DataFrame:
    """Rows with the vectors of a matrix by place: row i of the matrix belongs to row i in the given order.

    ``kind`` "parquet": rows count in order of file and row; "binary": matrix files, whose headers say the rows.
    Another number of rows or an odd length is an error.
    """
    if kind == "binary":
        placed = read_matrix(spark, path).select(F.col("vector").alias(vector), (F.col("row") + 1).alias("_place"))
    else:
        matrix = spark.read.parquet(path).select(vector, F.col("_metadata.file_path").alias("_f"), F.col("_metadata.row_index").alias("_i"))
        placed = global_position(matrix, ["_f", "_i"], "_place").drop("_f", "_i")
    numbered = global_position(rows, order, "_place")
    counts = numbered.agg(F.count("*").alias("rows")).crossJoin(placed.agg(
        F.count("*").alias("vectors"), F.min(F.size(vector)).alias("shortest"), F.max(F.size(vector)).alias("longest"))).first()
    if counts["rows"] != counts["vectors"] or counts["shortest"] != counts["longest"]:
        raise ValueError(f"embedding matrix does not match the rows: {counts.asDict()}")
    return numbered.join(placed, "_place").drop("_place")


def read_metrics(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Metric JSON files as (name, json); files that do not exist are left out."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    found = [p for p in paths if hadoop(p).getFileSystem(conf).exists(hadoop(p))]
    if not found:
        return spark.createDataFrame([], "name string, json string")
    return spark.read.text(found, wholetext=True).select(
        F.regexp_replace(F.col("_metadata.file_name"), r"\.json$", "").alias("name"),
        F.col("value").alias("json"),
    )
