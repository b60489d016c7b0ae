"""Projections and column names."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curatrix.constants import FORBIDDEN_PUBLIC_COLUMNS, SEQUENCE_COLUMNS, TARGET_MENTION_WIDE
from curatrix.functions.text import first_nonblank_of, norm_text, normalize_marker
from curatrix.sources.tables import require_columns


def project_rename(df: DataFrame, mapping: dict[str, str], order: list[str] | None = None) -> DataFrame:
    require_columns(df, list(mapping))
    renamed = df.select(*[F.col(f"`{old}`").alias(new) for old, new in mapping.items()])
    return renamed.select(*order) if order else renamed


def rename_by_position(df: DataFrame, names: dict[int, str]) -> tuple[DataFrame, list[int]]:
    """Name columns by place, unknown places ``extra_col_NN``; also the places that are absent."""
    width = len(df.columns)
    renamed = df.toDF(*[names.get(i, f"extra_col_{i:02d}") for i in range(width)])
    return renamed, [i for i in sorted(names) if i >= width]


def rename_by_alias(df: DataFrame, aliases: dict[str, str]) -> DataFrame:
    """Rename known columns; several that share a name fill each other's blanks in order."""
    sources: dict[str, list[str]] = {}
    for i, column in enumerate(df.columns):
        sources.setdefault(aliases.get(column, f"extra_col_{i:02d}"), []).append(column)
    return df.select(*[
        (F.col(cols[0]) if len(cols) == 1 else first_nonblank_of([F.col(c) for c in cols])).alias(name)
        for name, cols in sources.items()
    ])


def reorder(df: DataFrame, order: list[str]) -> DataFrame:
    """Known columns in the given order, the others behind them."""
    first = [c for c in order if c in df.columns]
    return df.select(*first, *[c for c in df.columns if c not in first])


def public_projection(
    df: DataFrame, keep: list[str], forbidden: Iterable[str] = FORBIDDEN_PUBLIC_COLUMNS
) -> DataFrame:
    """Chosen columns that exist; an error if a forbidden name is among them."""
    banned = {name.lower() for name in forbidden}
    found = sorted({c.strip().lower() for c in keep if c in df.columns} & banned)
    if found:
        raise ValueError(f"forbidden public columns: {found}")
    return df.select(*[c for c in keep if c in df.columns])


def drop_sequences(df: DataFrame) -> DataFrame:
    """Everything but columns that carry sequence text."""
    return df.drop(*SEQUENCE_COLUMNS)


def detect_roles(
    spark: SparkSession,
    columns: list[str],
    keywords: dict[str, list[str]],
    threshold: float = 0.45,
    exclude: dict[str, list[str]] | None = None,
) -> DataFrame:
    """Likely columns per role, best first.

    Equal names score 1.0, a keyword inside the name 0.9, the name inside a keyword 0.8, else
    the larger of 0.75 x token overlap and 0.65 x edit similarity. Only names are compared.
    """
    names = spark.createDataFrame([(c,) for c in columns], "column string")
    words = spark.createDataFrame(
        [(role, w, (exclude or {}).get(role, [])) for role, ws in keywords.items() for w in ws],
        "role string, keyword string, excluded array<string>",
    ).withColumn("keyword", normalize_marker("keyword"))
    name, word = normalize_marker("column"), F.col("keyword")
    name_tokens, word_tokens = F.array_distinct(F.split(name, " ")), F.array_distinct(F.split(word, " "))
    overlap = F.size(F.array_intersect(name_tokens, word_tokens)) / F.size(word_tokens)
    longest = F.greatest(F.length(name), F.length(word))
    likeness = 1 - F.levenshtein(name, word) / longest
    score = (
        F.when(name == word, F.lit(1.0))
        .when(F.contains(name, word), F.lit(0.9))
        .when(F.contains(word, name), F.lit(0.8))
        .otherwise(F.greatest(overlap * 0.75, likeness * 0.65))
    )
    pairs = names.withColumn("words", F.lit(1)).join(words.withColumn("words", F.lit(1)), "words")
    return (
        pairs.filter(~F.arrays_overlap(F.split(name, " "), "excluded"))
        .groupBy("role", "column").agg(F.max(score).alias("score"))
        .filter(F.col("score") >= threshold)
        .orderBy("role", F.col("score").desc(), "column")
    )


def columns_matching(df: DataFrame, pattern: str = TARGET_MENTION_WIDE, columns: list[str] | None = None) -> DataFrame:
    """Text columns with at least one hit: one pass over the table."""
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    chosen = [c for c in (columns or df.columns) if c in texts]
    hits = df.agg(*[
        F.count_if(F.coalesce(F.col(c), F.lit("")).rlike(f"(?iU){pattern}")).alias(c) for c in chosen
    ])
    return (
        hits.unpivot([], chosen, "column", "matching_rows").filter(F.col("matching_rows") > 0)
    )


def split_signed_columns(columns: list[str], markers: list[str]) -> tuple[list[str], list[str]]:
    """Columns for the positive and for the negative label, by words in their names."""
    negative = [c for c in columns if set("".join(ch if ch.isalnum() else " " for ch in c.lower()).split()) & set(markers)]
    return [c for c in columns if c not in negative], negative
