"""Registered queries: each runs operators over the given tables, with SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curatrix.functions.text import clean_sequence
from curatrix.lineage import spread

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The driver's parquet tables, read when named."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @property
    def records(self) -> DataFrame:
        """Documents as records: two text lines, label, conflict flag and a fixed score."""
        labels = self.labels.select("doc_id", F.col("quality").alias("label"), (F.col("toxic") == 1).alias("conflict"))
        return self.documents.join(labels, "doc_id", "left").select(
            F.col("doc_id").alias("row_id"),
            F.split_part("text", F.lit("\n"), F.lit(1)).alias("heavy_raw"),
            F.split_part("text", F.lit("\n"), F.lit(2)).alias("light_raw"),
            "text", "lang", "source", "label",
            F.coalesce("conflict", F.lit(False)).alias("conflict"),
            ((F.col("doc_id") * 7919 % 10007).cast("double") / 10007).alias("score"),
        )

    @property
    def sequences(self) -> DataFrame:
        """Records whose lines are reduced to residue letters; the region is a slice of the first."""
        return spread(self.records).withColumns({
            "heavy": clean_sequence("heavy_raw", "canonical"),
            "light": clean_sequence("light_raw", "canonical"),
        }).withColumn("cdrh3", F.substr("heavy", F.lit(5), F.length("heavy") % 40))


RECORDS = """rec AS (
  SELECT d.doc_id AS row_id, split_part(d.text, chr(10), 1) AS heavy_raw,
         split_part(d.text, chr(10), 2) AS light_raw, d.text, d.lang, d.source,
         CAST(l.quality AS INTEGER) AS label, coalesce(l.toxic = 1, false) AS conflict,
         CAST(d.doc_id * 7919 % 10007 AS DOUBLE) / 10007 AS score
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""


def canonical_sql(column: str) -> str:
    return f"regexp_replace(upper(replace({column}, 'ß', 'SS')), '[^ACDEFGHIKLMNPQRSTVWY]', '', 'g')"


SEQUENCES = RECORDS + f""",
seq0 AS (SELECT *, {canonical_sql('heavy_raw')} AS heavy, {canonical_sql('light_raw')} AS light FROM rec),
seq AS (SELECT *, substr(heavy, 5, CAST(length(heavy) % 40 AS BIGINT)) AS cdrh3 FROM seq0)"""


def query(name: str, sql: str | None = None) -> Callable:
    def register(fn: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")
        QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder))
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles to a fixed number of places, the same as the SQL side."""
    doubles = {name for name, kind in df.dtypes if kind in ("double", "float")}
    return df.select(*[F.round(c, places).alias(c) if c in doubles else F.col(c) for c in df.columns])
