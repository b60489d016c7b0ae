"""Shards over a fixed number of virtual slots.

A record's key is hashed into one of some thousands of slots, for good. Spark adds up the bytes of each slot; a map
says which shard holds which slot. Maps are tables with versions: the first deals the slots, heaviest first, to the
lightest shard; later ones are edits of their predecessor that move as few slots as it takes. Records are never
looked at to move them: a record follows its slot.

The map has one row for each slot, so its size does not depend on the data, and it is worked on by the driver.

Rows: a null key is replaced by the text, a null text is empty. Rows of one key share a slot and so a shard; keys of
more bytes than a fair share make their shard as large as they are. Empty tables give a map of empty slots.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from curatrix.llm.common import save
from curatrix.operators.ordered import position_in_group

SLOTS = 4096


def slot_of(key: Column, text: Column, slots: int = SLOTS) -> Column:
    """Virtual slot: the first 32 bits of the key's MD5, modulo the number of slots."""
    digest = F.md5(F.coalesce(key.cast("string"), text, F.lit("")).cast("binary"))
    return F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"), F.lit(slots)).cast("int")


def byte_size(text: Column) -> Column:
    """UTF-8 bytes of the text and one for its end."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


@dataclass(frozen=True)
class SlotMap:
    """Shard of each slot, in slot order."""

    version: int
    shards: int
    shard_of: tuple[int, ...]

    def loads(self, weights: list[int]) -> list[int]:
        totals = [0] * self.shards
        for shard, weight in zip(self.shard_of, weights):
            totals[shard] += weight
        return totals

    def moved(self, other: SlotMap) -> int:
        """Slots that the two maps place differently."""
        return sum(a != b for a, b in zip(self.shard_of, other.shard_of))


def weigh_slots(records: DataFrame, slot_col: str = "virtual_slot", size_col: str = "size", slots: int = SLOTS) -> list[int]:
    """Bytes of each slot; one row per slot reaches the driver."""
    weights = [0] * slots
    for slot, total in records.groupBy(slot_col).agg(F.sum(size_col)).collect():
        weights[slot] = total
    return weights


def first_map(weights: list[int], shards: int) -> SlotMap:
    """Version 1: slots by falling weight, then number, each to the lightest shard, then the smallest number."""
    loads, shard_of = [0] * shards, [0] * len(weights)
    for slot in sorted(range(len(weights)), key=lambda s: (-weights[s], s)):
        lightest = loads.index(min(loads))
        shard_of[slot] = lightest
        loads[lightest] += weights[slot]
    return SlotMap(1, shards, tuple(shard_of))


def _edit(old: SlotMap, weights: list[int], shards: int, only_into: int | None, slack: float) -> SlotMap:
    """Move slots, the best one each time, until no shard is over its share by more than slack, or no move helps."""
    shard_of = list(old.shard_of)
    held: list[set[int]] = [set() for _ in range(shards)]
    for slot, shard in enumerate(shard_of):
        held[shard].add(slot)
    loads = [sum(weights[s] for s in own) for own in held]
    fair = sum(weights) / shards
    while True:
        to = loads.index(min(loads)) if only_into is None else only_into
        source = max((s for s in range(shards) if s != to), key=lambda s: (loads[s], -s), default=to)
        gap = loads[source] - loads[to]
        if loads[source] <= fair * (1 + slack) and loads[to] >= fair * (1 - slack):
            break
        # The slot nearest to half the gap evens the two out best.
        choice = min((s for s in held[source] if 0 < weights[s] < gap), key=lambda s: (abs(2 * weights[s] - gap), s), default=None)
        if choice is None:
            break
        held[source].remove(choice)
        held[to].add(choice)
        shard_of[choice] = to
        loads[source] -= weights[choice]
        loads[to] += weights[choice]
    return SlotMap(old.version + 1, shards, tuple(shard_of))


def rebalance(old: SlotMap, weights: list[int], slack: float = 0.01) -> SlotMap:
    """The next version for changed weights: slots go from the heaviest to the lightest shard only."""
    return _edit(old, weights, old.shards, None, slack)


def grow(old: SlotMap, weights: list[int], slack: float = 0.01) -> SlotMap:
    """The next version with one more shard; every moved slot goes into the new shard."""
    return _edit(old, weights, old.shards + 1, old.shards, slack)


def shrink(old: SlotMap, weights: list[int]) -> SlotMap:
    """The next version without the last shard; only its slots move, heaviest first to the lightest shard."""
    shards = old.shards - 1
    if shards < 1:
        raise ValueError("the only shard cannot go")
    shard_of, loads = list(old.shard_of), old.loads(weights)[:shards]
    for slot in sorted((s for s, shard in enumerate(shard_of) if shard == shards), key=lambda s: (-weights[s], s)):
        shard_of[slot] = loads.index(min(loads))
        loads[shard_of[slot]] += weights[slot]
    return SlotMap(old.version + 1, shards, tuple(shard_of))


def as_table(spark: SparkSession, of: SlotMap) -> DataFrame:
    """(virtual_slot, shard); one row per slot."""
    return spark.createDataFrame(list(enumerate(of.shard_of)), "virtual_slot int, shard int")


def store(spark: SparkSession, of: SlotMap, path: str) -> None:
    """Add one version to the map table at path; a version is never written twice."""
    rows = as_table(spark, of).withColumn("shards", F.lit(of.shards)).coalesce(1)
    rows.write.mode("error").parquet(f"{path}/version={of.version}")


def load(spark: SparkSession, path: str, version: int | None = None) -> SlotMap:
    """A version of the map table, the latest unless one is named."""
    table = spark.read.parquet(path)
    if version is None:
        version = table.agg(F.max("version")).first()[0]
    rows = table.where(F.col("version") == version).select("virtual_slot", "shard", "shards").collect()
    if not rows:
        raise ValueError(f"no version {version} of the map")
    return SlotMap(version, rows[0]["shards"], tuple(r["shard"] for r in sorted(rows)))


def place(records: DataFrame, of: SlotMap) -> DataFrame:
    """records (with virtual_slot) and the shard that the map names."""
    return records.join(F.broadcast(as_table(records.sparkSession, of)), "virtual_slot")


def records_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS) -> DataFrame:
    """(doc_id, size, text_crc32, virtual_slot) of each row."""
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).alias("doc_id"), byte_size(text).alias("size"),
                       F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
                       slot_of(F.col(id_col), text, slots).alias("virtual_slot"))


def shard(docs: DataFrame, path: str, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS) -> DataFrame:
    """One row per row of docs: doc_id, size, text_crc32, virtual_slot, shard, slot (0, 1, ... within the shard).

    The map in force is the latest at path, edited there by rebalance where the bytes have changed; without one the
    first version is made and stored. Within a shard rows lie by virtual slot, id, size and checksum.
    """
    spark = docs.sparkSession
    records = save(records_of(docs, id_col, text_col, slots), "shard-records")
    weights = weigh_slots(records, slots=slots)
    if _exists(spark, path):
        old = load(spark, path)
        if old.shards != shards or len(old.shard_of) != slots:
            raise ValueError("the stored map has other shards or slots; grow or shrink it first")
        current = rebalance(old, weights)
        if current.moved(old):
            store(spark, current, path)
        else:
            current = old
    else:
        current = first_map(weights, shards)
        store(spark, current, path)
    placed = position_in_group(place(records, current), ["shard"], ["virtual_slot", "doc_id", "size", "text_crc32"], "slot")
    return placed.withColumn("slot", (F.col("slot") - 1).cast("long"))


def _exists(spark: SparkSession, path: str) -> bool:
    """Whether Spark's file system has the folder."""
    from pyspark.errors import AnalysisException

    try:
        spark.read.parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return False
        raise
    return True


def write_shards(docs: DataFrame, of: SlotMap, path: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """docs as Parquet folders shard=0, 1, ...; the rows of a shard are written by many tasks, each by ranges of slots.

    Columns of docs named shard or virtual_slot are written with an underscore after the name.
    """
    slot = slot_of(F.col(id_col), F.col(text_col).cast("string"), len(of.shard_of))
    marked = docs.select(*[F.col(c).alias(f"{c}_" if c in ("shard", "virtual_slot") else c) for c in docs.columns],
                         slot.alias("virtual_slot"), F.xxhash64(F.col(text_col)).alias("__spread"))
    ranged = place(marked, of).repartitionByRange("shard", "virtual_slot", "__spread")
    ranged.drop("virtual_slot", "__spread").write.partitionBy("shard").parquet(path)
