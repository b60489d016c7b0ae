"""Scored records to a prioritised table and a diverse shortlist."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curatrix.lineage import cut_lineage
from curatrix.operators import rules as R
from curatrix.operators.filters import choose_pool
from curatrix.operators.models import fit_kmer, score
from curatrix.operators.ordered import best_per_group, global_position, group_size, position_in_group


def prioritise(records: DataFrame, row_id: str, v_group: str, region: str) -> DataFrame:
    """Flags, risk, categories, groups and ranks for scored records.

    ``records`` has heavy, light, cdrh3, label, conflict and score. Risk needs flags, priority
    needs risk and category, ranks need the group keys.
    """
    df = R.with_prediction(records.drop("text", "heavy_raw", "light_raw"))
    df = R.with_risk(R.with_sequence_flags(df, "heavy", "light", "cdrh3"))
    df = R.with_priority_group(df, v_group, region, "cdrh3_length")
    df = df.withColumn("record_category", R.record_category())
    # Written once: the counts and both ranks below read it again.
    df = cut_lineage(df.withColumn("priority_category", R.priority_category()).drop("heavy", "light", "cdrh3"))
    df = group_size(df, ["diversity_group"], "diversity_group_size")
    best = [F.col("score").desc(), F.col(row_id)]
    df = position_in_group(df, ["diversity_group"], best, "rank_in_diversity_group")
    return position_in_group(df, ["region_key"], best, "rank_in_region")


def score_and_prioritise(
    records: DataFrame, row_id: str, text: str, v_group: str, region: str, model=None
) -> DataFrame:
    """As above with the score of a classifier fitted on the labelled rows, or a given one."""
    fitted = model or fit_kmer(records.filter(F.col("label").isNotNull()), text)
    scored = cut_lineage(score(records.select(row_id, text), fitted, [row_id]))
    return prioritise(records.drop(text, "score").join(scored, row_id), row_id, v_group, region)


def diverse_groups(table: DataFrame, row_id: str, region: str, v_group: str | None, old_key: str | None = None,
                   cdrh3: str | None = None) -> DataFrame:
    """One record per diversity group of the candidate pool, ranked and tiered.

    The pools are tried in turn, so the scored table is written once before.
    """
    pool, _ = choose_pool(cut_lineage(table), "score", row_id)
    keyed = R.diversity_key(pool, region, v_group, old_key, cdrh3)
    order = [F.col("score").desc(), F.col("confidence_score").desc(), F.col("risk_score"), F.col(row_id)]
    best = best_per_group(keyed, ["diversity_group"], order, "group_candidates")
    rank = [F.col("score").desc(), F.col("confidence_score").desc(), F.col("risk_score"), F.col("target_region_group"), F.col(row_id)]
    return global_position(best, rank, "shortlist_rank").withColumn("shortlist_tier", R.shortlist_tier())
