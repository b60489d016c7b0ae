"""Order-dependent work that stays distributed: positions, prefix sums, quantiles, draws.

A window without partition keys, or one over a hot key, sorts all its rows in one task. Here
rows are range-partitioned on the whole order key, so even one key with a third of all rows
spreads over many tasks; what crosses the pieces is one small row per piece.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from curatrix.lineage import cut_lineage

QUANTILE_CELLS = 4_096
REPORT_ROWS = 1_000  # a list of this size may be gathered in one task
HOT_GROUPS = 200  # groups that may be broadcast
ROW_BITS = 33  # monotonically_increasing_id keeps the row number of a partition in 33 bits


def join_on(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join in which null keys meet null keys; right keys are dropped."""
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    condition = [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys]
    return left.join(renamed, condition, how).drop(*[f"_r_{k}" for k in keys])


def join_groups(left: DataFrame, groups: DataFrame, keys: list[str], size: str) -> DataFrame:
    """Left join with a frame of one row per group; null keys meet null keys, and ``size``, the rows of the group, is dropped.

    A shuffle on a handful of groups puts all rows into a handful of tasks. Only HOT_GROUPS groups can hold more than
    their share of the rows, so these are broadcast, and their rows are spread by content where the rest is shuffled.
    """
    groups = cut_lineage(groups)
    found = groups.agg(F.count("*").alias("groups"), F.sum(size).alias("rows")).first()
    few = found["groups"] <= HOT_GROUPS
    is_hot = F.lit(True) if few else F.col(size) > found["rows"] // HOT_GROUPS
    values = [c for c in groups.columns if c not in (*keys, size)]
    met = F.struct(F.lit(True).alias("_there"), *values)
    near = join_on(left, F.broadcast(groups.filter(is_hot).select(*keys, met.alias("_hot"))), keys, "left")
    if few:
        return near.select(*left.columns, *[F.col("_hot")[c].alias(c) for c in values])
    zero = F.lit(0).cast("long")
    content = F.xxhash64(*[f.name for f in left.schema.fields if "map<" not in f.dataType.simpleString()])
    salted = near.withColumn("_salt", F.when(F.col("_hot").isNull(), zero).otherwise(content))
    cold = groups.filter(~is_hot).select(*keys, zero.alias("_salt"), met.alias("_cold"))
    far = join_on(salted, cold, [*keys, "_salt"], "left")
    return far.select(*left.columns, *[F.coalesce("_hot", "_cold")[c].alias(c) for c in values])


def global_position(df: DataFrame, order: list[Column | str], name: str = "position") -> DataFrame:
    """Dense 1..n position in a total order.

    One range shuffle and sort, checkpointed so that both readers below see the same pieces;
    then the row number inside the piece plus the rows of all earlier pieces. The window runs
    over one row per piece.
    """
    slot = F.col("_slot")
    marked = cut_lineage(df.orderBy(*order).withColumn("_slot", F.monotonically_increasing_id()))
    marked = marked.withColumn("_piece", F.shiftright(slot, ROW_BITS))
    pieces = marked.groupBy("_piece").agg(F.count("*").alias("_rows"))
    before = W.orderBy("_piece").rowsBetween(W.unboundedPreceding, -1)
    bases = pieces.select("_piece", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_base"))
    inside = slot.bitwiseAND((1 << ROW_BITS) - 1)
    return (
        marked.join(F.broadcast(bases), "_piece")
        .withColumn(name, F.col("_base") + inside + 1)
        .drop("_slot", "_piece", "_base")
    )


def with_row_id(df: DataFrame, order: list[Column | str], name: str = "row_id") -> DataFrame:
    """Dense surrogate id from 0 in a total order."""
    return global_position(df, order, "_pos").withColumn(name, F.col("_pos") - 1).drop("_pos")


def position_in_group(
    df: DataFrame, group: list[str], order: list[Column | str], name: str = "position"
) -> DataFrame:
    """1..n inside each group: the global position minus the start of the group."""
    placed = global_position(df, [*group, *order], "_pos")
    starts = placed.groupBy(*group).agg((F.min("_pos") - 1).alias("_before"), F.count("*").alias("_size"))
    return (
        join_groups(placed, starts, group, "_size")
        .withColumn(name, F.col("_pos") - F.col("_before"))
        .drop("_pos", "_before")
    )


def prefix_sums(df: DataFrame, group: list[str], order: list[Column], sums: dict[str, str]) -> DataFrame:
    """Running sums ``{new: old}`` inside each group along an order without ties.

    Inside a piece by a window, across pieces by the totals of the pieces before. A group has
    at most one total per piece.
    """
    pieces = cut_lineage(
        df.repartitionByRange(*group, *order).withColumn("_piece", F.spark_partition_id())
    )
    keys = [*group, "_piece"]
    inside = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    earlier = W.partitionBy(*group).orderBy("_piece").rowsBetween(W.unboundedPreceding, -1)
    totals = pieces.groupBy(*keys).agg(*[F.sum(old).alias(new) for new, old in sums.items()])
    bases = totals.select(
        *keys, *[F.coalesce(F.sum(new).over(earlier), F.lit(0)).alias(f"_b_{new}") for new in sums]
    )
    running = pieces.select("*", *[F.sum(old).over(inside).alias(new) for new, old in sums.items()])
    joined = join_on(running, bases, keys)
    for new in sums:
        joined = joined.withColumn(new, F.col(new) + F.col(f"_b_{new}"))
    return joined.drop("_piece", *[f"_b_{new}" for new in sums])


def exact_quantiles(
    df: DataFrame, by: list[str], value: str, probabilities: dict[str, float]
) -> DataFrame:
    """Exact linear-interpolation quantiles per group.

    Counts over a coarse grid of values say which cells hold the wanted positions. Only the values of
    those cells are counted and ordered, by prefix sums, so no task holds the values of a whole group.
    """
    rows = df.filter(F.col(value).isNotNull()).select(*by, value)
    bounds = rows.groupBy(*by).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"), F.count("*").alias("_total"))
    span = F.col("_hi") - F.col("_lo")
    share = F.when(span > 0, (F.col(value) - F.col("_lo")) / span * QUANTILE_CELLS)
    # Values that are not finite leave the grid at either end; order is kept.
    cell = F.coalesce(F.when(F.isnan(share), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(float(QUANTILE_CELLS)), share))), F.lit(0.0))
    placed = join_on(rows, bounds, by).withColumn("_cell", F.floor(cell))
    cells = placed.groupBy(*by, "_cell").agg(F.count("*").alias("_n"), F.first("_total").alias("_total"))
    upto = W.partitionBy(*by).orderBy("_cell").rowsBetween(W.unboundedPreceding, W.currentRow)
    cells = cut_lineage(cells.withColumn("_upto", F.sum("_n").over(upto)))
    spots = {name: (F.col("_total") - 1) * F.lit(float(p)) for name, p in probabilities.items()}
    wanted = F.lit(False)
    for spot in spots.values():
        for position in (F.floor(spot), F.ceil(spot)):
            wanted = wanted | ((F.col("_upto") > position) & (F.col("_upto") - F.col("_n") <= position))
    chosen = cells.filter(wanted).select(*by, "_cell", "_total", (F.col("_upto") - F.col("_n")).alias("_base"))
    inside = join_on(placed.drop("_total"), chosen, [*by, "_cell"])
    counted = inside.groupBy(*by, "_cell", value).agg(
        F.count("*").alias("_n"), F.first("_base").alias("_base"), F.first("_total").alias("_total"))
    ranked = prefix_sums(counted, [*by, "_cell"], [F.col(value).asc()], {"_within": "_n"})
    ranked = ranked.withColumn("_upto", F.col("_base") + F.col("_within"))
    picks = []
    for name, spot in spots.items():
        low = F.min(F.when(F.col("_upto") > F.floor(spot), F.col(value)))
        high = F.min(F.when(F.col("_upto") > F.ceil(spot), F.col(value)))
        part = F.max(spot - F.floor(spot))
        picks.append((low + (high - low) * part).alias(name))
    return ranked.groupBy(*by).agg(*picks)


def draw(
    df: DataFrame, key: str, strata: list[str], wanted: DataFrame | Column, seed: int, name: str = "drawn"
) -> DataFrame:
    """Flag, per stratum, the wanted number of rows with the smallest hash of (key, seed).

    ``wanted`` is a frame (strata, wanted) or an expression over the stratum size ``n``. The
    cut is found from counts per four-digit hash prefix, so rows are never sorted as a whole:
    only the one prefix that holds the cut is ranked.
    """
    if not strata:
        return draw(df.withColumn("_all", F.lit(0)), key, ["_all"], wanted, seed, name).drop("_all")
    full = df.withColumn("_hash", F.sha2(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed))), 256))
    # Strata and hashes are written once; the input itself is read for them and for the flags only.
    hashed = cut_lineage(full.select(*strata, "_hash")).withColumn("_bin", F.left("_hash", F.lit(4)))
    bins = hashed.groupBy(*strata, "_bin").agg(F.count("*").alias("_rows"))
    if isinstance(wanted, DataFrame):
        goal = wanted
    else:
        goal = bins.groupBy(*strata).agg(F.sum("_rows").alias("n")).withColumn("wanted", wanted)
    goal = goal.select(*strata, F.col("wanted").cast("long").alias("_wanted"))
    upto = F.sum("_rows").over(W.partitionBy(*strata).orderBy("_bin"))
    cut = (
        join_on(bins.withColumn("_upto", upto), goal, strata)
        .filter((F.col("_upto") >= F.col("_wanted")) & (F.col("_upto") - F.col("_rows") < F.col("_wanted")))
        .select(*strata, F.col("_bin"), (F.col("_wanted") - F.col("_upto") + F.col("_rows")).alias("_need"))
    )
    nth = W.partitionBy(*strata).orderBy("_hash")
    edge = (
        join_on(hashed.select(*strata, "_bin", "_hash"), cut, [*strata, "_bin"])
        .withColumn("_nth", F.row_number().over(nth))
        .filter(F.col("_nth") == F.col("_need"))
        .select(*strata, F.col("_hash").alias("_last"))
    )
    sizes = bins.groupBy(*strata).agg(F.sum("_rows").alias("_size"))
    limits = join_on(join_on(goal, edge, strata, "left"), sizes, strata, "left").na.fill(0, ["_size"])
    taken = F.when(F.col("_wanted") <= 0, False).otherwise(
        F.col("_last").isNull() | (F.col("_hash") <= F.col("_last"))
    )
    return (
        join_groups(full, limits, strata, "_size")
        .withColumn(name, F.coalesce(taken, F.lit(False)))
        .drop("_hash", "_wanted", "_last")
    )


def top_k(df: DataFrame, order: list[Column | str], k: int, name: str = "rank") -> DataFrame:
    """First k rows of a total order with their rank; k is the report size."""
    best = df.orderBy(*order).limit(k)
    return best.withColumn(name, F.row_number().over(W.orderBy(*order)))


def top_n_per_group(
    df: DataFrame, group: list[str], order: list[Column | str], n: int, name: str = "rank"
) -> DataFrame:
    """First n rows per group; each map task keeps n rows per group before the shuffle."""
    ranked = df.withColumn(name, F.row_number().over(W.partitionBy(*group).orderBy(*order)))
    return ranked.filter(F.col(name) <= n)


def dedup_first(df: DataFrame, keys: list[str], order: str, count: str | None = None) -> DataFrame:
    """The row with the smallest order per key, optionally with the number of copies.

    One aggregation on a hash of the keys that combines before the shuffle, so long keys are no
    sort key and copies of a hot key leave each map task as one row.
    """
    aggs = [F.min_by(F.struct(*df.columns), F.col(order)).alias("_first")]
    if count:
        aggs.append(F.count("*").alias(count))
    kept = df.groupBy(key_hash(keys).alias("_hash")).agg(*aggs)
    return kept.select(*[F.col("_first")[c].alias(c) for c in df.columns], *([count] if count else []))


def key_hash(keys: list[str]) -> Column:
    """SHA-256 of a key; null parts differ from empty ones."""
    parts = [F.coalesce(F.concat(F.length(F.col(k).cast("string")).cast("string"), F.lit(":"), F.col(k).cast("string")), F.lit("-")) for k in keys]
    return F.sha2(F.concat_ws("|", *parts), 256)


def duplicate_count(df: DataFrame, keys: list[str], name: str = "duplicate_count") -> DataFrame:
    """Copies per key on every row: counted first, then joined back."""
    return join_on(df, df.groupBy(*keys).agg(F.count("*").alias(name)), keys, "left")


def group_size(df: DataFrame, group: list[str], name: str = "group_size") -> DataFrame:
    return duplicate_count(df, group, name)


def best_per_group(df: DataFrame, group: list[str], order: list[Column | str], size: str = "group_size") -> DataFrame:
    """Top row of each group and the number of candidates it stands for."""
    best = top_n_per_group(df, group, order, 1, "_rank").drop("_rank")
    return join_on(best, df.groupBy(*group).agg(F.count("*").alias(size)), group)


def round_robin(df: DataFrame, group: str, score: str, tie: str, name: str = "position") -> DataFrame:
    """Cycle through the groups: place in group first, then score."""
    filled = df.withColumn(group, F.coalesce(F.col(group), F.lit("missing")))
    placed = position_in_group(filled, [group], [F.col(score).desc(), F.col(tie)], "rank_in_group")
    order = [F.col("rank_in_group"), F.col(score).desc(), F.col(group), F.col(tie)]
    return global_position(placed, order, name)


def short_ids(df: DataFrame, value: str, name: str, tag: str = "source_", digits: int = 3) -> DataFrame:
    """Dense readable ids for hashes, numbered in hash order over the distinct values."""
    numbered = global_position(df.select(value).distinct(), [value], "_no")
    # Ids beyond the padding keep all their digits.
    padded = F.when(F.length(F.col("_no").cast("string")) >= digits, F.col("_no").cast("string")).otherwise(
        F.lpad(F.col("_no").cast("string"), digits, "0")
    )
    named = numbered.select(value, F.concat(F.lit(tag), padded).alias(name))
    return join_on(df, named, [value], "left")


def cap_rows(df: DataFrame, order: list[Column | str], n: int) -> DataFrame:
    """First n rows of a total order; a large n is cut by position, so no task gathers n rows per split."""
    if n <= REPORT_ROWS:
        return df.orderBy(*order).limit(n)
    return global_position(df, order, "_pos").filter(F.col("_pos") <= n).drop("_pos")


def sort_stable(df: DataFrame, keys: list[Column | str], tie: str) -> DataFrame:
    """Global sort with a unique column as the last key."""
    return df.orderBy(*keys, F.col(tie))


def select_best(df: DataFrame, order: list[Column], by: list[str] | None = None) -> DataFrame:
    """Best row overall or per group; order columns state where nulls go."""
    if not by:
        return df.orderBy(*order).limit(1)
    return top_n_per_group(df, by, order, 1, "_rank").drop("_rank")
