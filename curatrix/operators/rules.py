"""Rule columns: flags, risk, categories, tiers and verdicts. The last matching rule wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curatrix.constants import ACIDIC, AROMATIC, BASIC, CHARGED, HYDROPHOBIC, MISSING_TOKENS
from curatrix.functions.text import hash_id, norm_text
from curatrix.functions.values import char_count, char_fraction, motif_count, region_length_bin


def last_rule(default: str, rules: list[tuple[Column, str]]) -> Column:
    """Later rules overwrite earlier ones."""
    value = F.lit(default)
    for condition, name in rules:
        value = F.when(condition, F.lit(name)).otherwise(value)
    return value


def with_prediction(df: DataFrame, score: str = "score") -> DataFrame:
    """Predicted label, distance from one half and its class."""
    distance = F.abs(F.col(score) - 0.5)
    return df.withColumn("predicted_label", (F.col(score) >= 0.5).cast("int")).withColumn(
        "confidence_score", distance
    ).withColumn("confidence_bin", F.when(distance >= 0.30, "high").when(distance >= 0.15, "medium").otherwise("low"))


def with_sequence_flags(df: DataFrame, heavy: str, light: str, region: str) -> DataFrame:
    """Lengths, counts, fractions and length flags of cleaned sequences."""
    h, c = F.col(heavy), F.col(region)
    added = {
        "heavy_length": F.length(h), "light_length": F.length(light), "cdrh3_length": F.length(c),
        "cysteine_heavy": char_count(h, "C"), "cysteine_light": char_count(light, "C"),
        "cysteine_cdrh3": char_count(c, "C"),
        "aromatic_fraction_heavy": char_fraction(h, AROMATIC),
        "hydrophobic_fraction_heavy": char_fraction(h, HYDROPHOBIC),
        "hydrophobic_fraction_cdrh3": char_fraction(c, HYDROPHOBIC),
        "charged_fraction_heavy": char_fraction(h, CHARGED),
        "acidic_heavy": char_count(h, ACIDIC), "basic_heavy": char_count(h, BASIC),
        "net_charge_heavy": char_count(h, BASIC) - char_count(h, ACIDIC),
        "motifs_heavy": motif_count(h), "methionine_heavy": char_count(h, "M"),
        "tryptophan_heavy": char_count(h, "W"), "proline_fraction_cdrh3": char_fraction(c, "P"),
    }
    df = df.withColumns(added)
    return df.withColumns({
        "long_cdrh3": F.col("cdrh3_length") > 20,
        "very_long_cdrh3": F.col("cdrh3_length") > 30,
        "unusual_heavy_length": ~F.col("heavy_length").between(105, 140),
        "missing_light": F.col(light) == "",
    })


def risk_components() -> dict[str, Column]:
    """The nine yes/no parts of the risk score."""
    zero = F.lit(0.0)
    return {
        "cdrh3_over_20": F.col("cdrh3_length") > 20,
        "cdrh3_over_30": F.col("cdrh3_length") > 30,
        "hydrophobic_cdrh3": F.coalesce("hydrophobic_fraction_cdrh3", zero) > 0.45,
        "hydrophobic_heavy": F.coalesce("hydrophobic_fraction_heavy", zero) > 0.42,
        "cysteines_cdrh3": F.col("cysteine_cdrh3") > 1,
        "cysteines_heavy": F.col("cysteine_heavy") > 4,
        "motif_heavy": F.col("motifs_heavy") > 0,
        "charge_heavy": F.abs("net_charge_heavy") > 12,
        "length_heavy": F.col("unusual_heavy_length"),
    }


def with_risk(df: DataFrame) -> DataFrame:
    total = sum((part.cast("int") for part in risk_components().values()), F.lit(0))
    df = df.withColumn("risk_score", total)
    score = F.col("risk_score")
    return df.withColumn("risk_bin", F.when(score <= 1, "low").when(score <= 3, "medium").otherwise("high"))


def record_category(label: str = "label", conflict: str = "conflict") -> Column:
    value = F.col(label)
    return last_rule("other", [
        (value.isNull(), "missing_label"),
        (value == 0, "known_non_neutralising"),
        (value == 1, "known_neutralising"),
        (F.coalesce(F.col(conflict), F.lit(False)), "conflict_label"),
    ])


def priority_category(score: str = "score") -> Column:
    strong = (F.col(score) >= 0.75) & (F.col("confidence_bin") == "high")
    fine = strong & F.col("risk_bin").isin("low", "medium")
    category = F.col("record_category")
    return last_rule("lower_priority", [
        (F.col("confidence_bin") == "low", "uncertain_prediction"),
        (strong & (F.col("risk_bin") == "high"), "high_score_but_sequence_risk"),
        (fine & (category == "missing_label"), "high_score_missing_label"),
        (fine & (category == "conflict_label"), "high_score_conflict_label"),
        (fine & (category == "known_neutralising"), "high_confidence_known_positive"),
    ])


def shortlist_tier(score: str = "score") -> Column:
    sure = F.col("confidence_bin") == "high"
    return last_rule("tier_2", [
        ((F.col(score) >= 0.85) & sure & (F.col("risk_bin") == "low"), "tier_1"),
        ((F.col("record_category") == "conflict_label") | F.col("model_disagreement"), "review"),
    ])


def with_review_flags(df: DataFrame, heavy: str, light: str) -> DataFrame:
    """Length, cysteine, motif and hydrophobicity flags of a background pair."""
    both = F.concat(F.col(heavy), F.col(light))
    c_heavy, c_light = char_count(heavy, "C"), char_count(light, "C")
    df = df.withColumns({
        "heavy_length": F.length(heavy), "light_length": F.length(light),
        "total_length": F.length(heavy) + F.length(light),
        "cysteine_flag": (c_heavy > 4) | (c_light > 4) | (c_heavy + c_light > 10),
        "motif_count": motif_count(both),
        "hydrophobic_fraction": char_fraction(both, HYDROPHOBIC),
    })
    return df.withColumns({
        "unusual_length_flag": ~F.col("heavy_length").between(105, 140) | ~F.col("light_length").between(85, 130),
        "hydrophobic_flag": F.coalesce("hydrophobic_fraction", F.lit(0.0)) > 0.45,
    })


def review_notes() -> Column:
    return (
        F.when(F.col("selected"), "diverse existing-record shortlist for expert review")
        .when(F.col("near_duplicate"), "similar to a higher-ranked shortlisted record")
        .when(F.col("risk_flag_count") > 0, "aggregate review flag present")
        .otherwise("ranked existing background record")
    )


def group_text(value: Column | str, missing: str) -> Column:
    """Group name; missing tokens get one common name."""
    text = norm_text(value)
    return F.when(F.lower(text).isin(MISSING_TOKENS), F.lit(missing)).otherwise(text)


def with_priority_group(df: DataFrame, v_group: str, region: str, length: str) -> DataFrame:
    """Group key of the prioritised table: V group, region text and length class."""
    v = F.coalesce(F.nullif(norm_text(v_group), F.lit("")), F.lit("unknown_v"))
    r = F.coalesce(F.nullif(norm_text(region), F.lit("")), F.lit("unknown_target_region"))
    key = F.concat_ws(" | ", v, r, region_length_bin(F.col(length)))
    return df.withColumn("region_key", r).withColumn("diversity_group", key)


def diversity_key(
    df: DataFrame, region: str, v_group: str | None, old_key: str | None, cdrh3: str | None
) -> DataFrame:
    """Shortlist group: region, V group, length class and hash of the region text.

    The V group comes from the front of an older key where the column is gone; the hash is a
    constant where the text is gone.
    """
    text = F.col(cdrh3) if cdrh3 else F.lit("")
    if v_group:
        v = group_text(v_group, "unknown_v")
    elif old_key:
        v = group_text(F.split_part(F.col(old_key), F.lit("|"), F.lit(1)), "unknown_v")
    else:
        v = F.lit("unknown_v")
    bins = F.when(text == "", "unknown").otherwise(region_length_bin(F.length(text)))
    return df.withColumns({
        "target_region_group": group_text(region, "unknown_target_region"),
        "v_gene_group": v,
        "cdrh3_length_bin": bins,
        "cdrh3_pattern_hash": hash_id(text, 12, "", "missing_cdrh3"),
    }).withColumn("diversity_group", F.concat_ws(
        " | ", "target_region_group", "v_gene_group", "cdrh3_length_bin", "cdrh3_pattern_hash"
    ))


def clonotype_key(v_group: str, cdrh3: str) -> Column:
    """Leak group: V group, length class, first and last five letters."""
    text = F.coalesce(F.col(cdrh3), F.lit(""))
    return F.concat_ws(
        "|", F.coalesce(F.col(v_group), F.lit("")), region_length_bin(F.length(text)),
        F.left(text, F.lit(5)), F.right(text, F.lit(5)),
    )


def verdicts(df: DataFrame) -> DataFrame:
    """Reading of validation, calibration and background metrics as short codes."""
    macro = F.col("macro_roc_auc").isNotNull() & F.col("macro_pr_auc").isNotNull() & (F.col("valid_groups") > 0)
    matched = F.col("matched_roc_auc").isNotNull() & F.col("matched_pr_auc").isNotNull()
    broad = F.col("broad_roc_auc").isNotNull() & F.col("broad_pr_auc").isNotNull()
    drop = (F.col("broad_roc_auc") - F.col("matched_roc_auc") >= 0.10) | (
        F.col("broad_pr_auc") - F.col("matched_pr_auc") >= 0.10
    )
    return df.withColumns({
        "generalisation": F.when(
            macro & (F.col("macro_roc_auc") >= 0.7) & (F.col("macro_pr_auc") >= 0.7), "supported"
        ).when(macro, "weaker_than_grouped").otherwise("limited_by_groups"),
        "calibration": F.when(
            (F.col("brier") <= 0.18) & (F.col("ece") <= 0.08), "reasonably_calibrated"
        ).when(F.col("brier").isNotNull() & F.col("ece").isNotNull(), "ranking_only").otherwise("unavailable"),
        "background": F.when(
            matched & (F.col("matched_roc_auc") >= 0.9) & (F.col("matched_pr_auc") >= 0.9), "domain_difference"
        ).when(matched & broad & drop, "partly_source_driven").otherwise("conservative_control"),
    })
