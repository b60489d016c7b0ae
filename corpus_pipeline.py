"""Document pipeline: quality, exact copies, near copies, benchmark passages, mixture.

Every stage is written as Parquet and read again as the next one's input. All but the last return the columns of
documents. Rejected documents, copies and contaminated documents go; the mixture keeps every document and adds how
often it is to be taken.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curatrix.llm import decontamination, exact_dedup, mixing, quality, simhash
from curatrix.llm.common import save

#: Shares of tokens by domain, the language of a document.
WEIGHTS = {"en": 0.4, "de": 0.2, "fr": 0.2, "es": 0.2}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the compression classifier scores at 0.3 or more; labels of held-out ids teach nothing."""
    return quality.keep_good(docs, _table(spark, sf_dir, "labels"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the longest original text, then the smallest id."""
    return exact_dedup.deduplicate(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by fingerprints of at most four differing bits: the smallest id."""
    return simhash.deduplicate(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without an occurrence of a benchmark window of ten words."""
    return decontamination.decontaminate(docs, _table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with rate and copies (at least one each) that bring expected tokens to WEIGHTS."""
    labelled = docs.join(_table(spark, sf_dir, "labels").select("doc_id").distinct(), "doc_id", "left_semi").select(
        "doc_id", F.col("lang").alias("domain"))
    mixed = mixing.mix(docs, labelled, WEIGHTS, lower=1.0)
    return mixed.drop("posterior", "domains")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("decontamination", benchmark_stage),
    ("mixing", mixing_stage),
]

#: Compression sizes, XXH64 fingerprints and components are beyond SQL; tests hold stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
