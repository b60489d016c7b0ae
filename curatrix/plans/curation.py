"""Raw records to clean, labelled and neutral tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curatrix.constants import (
    ALIAS_NAMES, HEAVY_LENGTHS, LIGHT_LENGTHS, METADATA_JOIN_COLUMNS, NEUTRAL_ORDER,
    POSITIONAL_NAMES, RAW_RENAMES, SINGLE_DOMAIN_TYPE, TARGET_MENTION,
)
from curatrix.functions.text import clean_sequence, is_missing, is_valid_alphabet, mentions, pair_text
from curatrix.functions.values import derive_label
from curatrix.operators import columns as C
from curatrix.operators.features import model_columns
from curatrix.operators.filters import filter_mentions, funnel, funnel_counts, strict_label_steps
from curatrix.operators.joins import enrich_by_key, first_nonblank
from curatrix.operators.ordered import cap_rows, dedup_first
from curatrix.sources.tables import require_columns

CLEANED_SEQUENCES = {
    "heavy_or_vhh_sequence": "valid_heavy_or_vhh_sequence", "light_sequence": "valid_light_sequence",
    "cdrh3": "valid_cdrh3", "cdrl3": "valid_cdrl3",
}


def clean_records(raw: DataFrame, order: str) -> DataFrame:
    """Target binders with cleaned sequences, validity flags, label, conflict and key."""
    require_columns(raw, [*RAW_RENAMES, "Binds to", "Neutralising Vs", "Not Neutralising Vs"])
    label, conflict = derive_label("Neutralising Vs", "Not Neutralising Vs", TARGET_MENTION)
    df = filter_mentions(raw, ["Binds to"], TARGET_MENTION).select(
        order, label.alias("neutralising_label"), conflict.alias("neutralising_conflict"),
        *[F.col(f"`{old}`").alias(new) for old, new in RAW_RENAMES.items()],
    )
    df = df.withColumns({c: clean_sequence(c, "placeholder") for c in CLEANED_SEQUENCES})
    df = df.withColumns({flag: is_valid_alphabet(c) for c, flag in CLEANED_SEQUENCES.items()})
    heavy, light = F.col("heavy_or_vhh_sequence").isNotNull(), F.col("light_sequence").isNotNull()
    return df.withColumns({
        "has_heavy_or_vhh": heavy, "has_light": light, "has_paired_heavy_light": heavy & light,
        "is_nanobody_like": mentions("antibody_type", SINGLE_DOMAIN_TYPE),
        "has_structure": ~is_missing("structures"),
        "sequence_key": pair_text("heavy_or_vhh_sequence", "light_sequence", "__"),
    })


def curate(raw: DataFrame, order: str) -> tuple[DataFrame, DataFrame]:
    """Unique clean records, first copy kept, and the counts as (metric, count).

    The copies are counted in the aggregation that keeps the first.
    """
    cleaned = clean_records(raw, order)
    final = dedup_first(cleaned.filter("has_heavy_or_vhh"), ["sequence_key"], order, "duplicate_count")
    label = F.col("neutralising_label")
    counts = cleaned.agg(
        F.count("*").alias("filtered_rows"),
        F.count_if("has_heavy_or_vhh").alias("rows_with_heavy"), F.count_if("has_light").alias("rows_with_light"),
        F.count_if("has_paired_heavy_light").alias("paired_rows"), F.count_if("is_nanobody_like").alias("nanobody_like_rows"),
        F.count_if(label == 1).alias("label_1"), F.count_if(label == 0).alias("label_0"),
        F.count_if(label.isNull()).alias("label_missing"), F.count_if("neutralising_conflict").alias("conflicts"),
        F.count_if(F.col("has_heavy_or_vhh") & ~F.col("valid_heavy_or_vhh_sequence")).alias("invalid_heavy"),
        F.count_if(F.col("has_light") & ~F.col("valid_light_sequence")).alias("invalid_light"),
        F.count_if(~F.col("has_heavy_or_vhh")).alias("removed_without_key"),
    )
    kept = final.agg(
        F.count("*").alias("final_rows"), F.count_if(F.col("duplicate_count") > 1).alias("duplicate_keys"),
        F.coalesce(F.sum(F.col("duplicate_count") - 1), F.lit(0)).alias("removed_copies"),
    )
    total = raw.agg(F.count("*").alias("raw_rows"))
    metrics = None
    for part in (total, counts, kept):
        rows = part.unpivot([], part.columns, "metric", "count")
        metrics = rows if metrics is None else metrics.unionByName(rows)
    return final, metrics


def strict_table(cleaned: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with a safe label and valid sequences plus model columns, and the rows per drop step."""
    tagged = funnel(cleaned, strict_label_steps(
        "neutralising_label", "neutralising_conflict", "has_heavy_or_vhh", "valid_heavy_or_vhh_sequence",
        "has_light", "valid_light_sequence",
    ))
    kept = tagged.filter(F.col("drop_reason").isNull()).drop("drop_reason")
    table = model_columns(kept, "heavy_or_vhh_sequence", "light_sequence", "cdrh3", "cdrl3", "protein_epitope")
    return table.withColumnRenamed("neutralising_label", "label"), funnel_counts(tagged)


def standardise(scan: DataFrame, order: list[str], cap: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Background pairs of plausible length, unique, and the row counts per file; ``cap`` keeps the first rows only.

    ``scan`` has heavy_raw, light_raw, source_file and the order columns.
    """
    df = scan.select(
        "source_file", *[c for c in order if c != "source_file"],
        clean_sequence("heavy_raw", "canonical").alias("heavy_sequence"),
        clean_sequence("light_raw", "canonical").alias("light_sequence"),
    )
    filled = (F.col("heavy_sequence") != "") & (F.col("light_sequence") != "")
    fits = filled & F.length("heavy_sequence").between(*HEAVY_LENGTHS) & F.length("light_sequence").between(*LIGHT_LENGTHS)
    per_file = df.groupBy("source_file").agg(
        F.count("*").alias("rows_scanned"), F.count_if(filled).alias("rows_cleaned"), F.count_if(fits).alias("rows_in_length"))
    usable = df.filter(fits)
    if cap:
        usable = cap_rows(usable, [F.col(c) for c in order], cap)
    usable = usable.withColumns({
        "_order": F.struct(*order),
        "sequence_pair_text": pair_text("heavy_sequence", "light_sequence"),
        "background_source": F.lit("paired_unknown_target_background"),
    })
    unique = dedup_first(usable, ["heavy_sequence", "light_sequence"], "_order").drop("_order")
    return unique, per_file


def sequence_key(df: DataFrame) -> DataFrame:
    """Key for joins over neutral tables; missing sequence columns count as blank."""
    if "sequence_a" not in df.columns:
        df = df.withColumn("sequence_a", F.col("sequence_a_raw") if "sequence_a_raw" in df.columns else F.lit(""))
    if "sequence_b" not in df.columns:
        df = df.withColumn("sequence_b", F.lit(""))
    key = pair_text(clean_sequence("sequence_a"), clean_sequence("sequence_b"), "||", always=True)
    return df.withColumn("sequence_key", key)


def neutralise(source: DataFrame, prepared: DataFrame, table: DataFrame, order: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables under neutral names; the model table takes metadata from the source.

    ``order`` is the column of ``source`` that says which of several values came first.
    """
    plain = [c for c in source.columns if c != order]
    ordered = source.select(*plain, order)
    names = {i: POSITIONAL_NAMES.get(i, f"extra_col_{i:02d}") for i in range(len(plain))}
    neutral_source = sequence_key(ordered.toDF(*names.values(), "_order"))
    neutral_prepared = C.reorder(sequence_key(C.rename_by_alias(prepared, ALIAS_NAMES)), NEUTRAL_ORDER)
    neutral_table = sequence_key(C.rename_by_alias(table, ALIAS_NAMES))
    columns = [c for c in METADATA_JOIN_COLUMNS if c in neutral_source.columns]
    metadata = first_nonblank(neutral_source, "sequence_key", columns, "_order")
    merged = enrich_by_key(neutral_table, metadata, "sequence_key", columns)
    return (C.reorder(neutral_source.drop("_order"), NEUTRAL_ORDER), neutral_prepared, C.reorder(merged, NEUTRAL_ORDER))
