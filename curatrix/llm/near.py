"""Near-duplicate documents: texts whose sets of five-word shingles have Jaccard similarity 0.8 or more.

Candidates come from minima of hashed shingles: BANDS bands of ROWS minima each, so that two sets meet in a band with
probability s^ROWS for similarity s. At 0.8 a pair meets in no band with a probability below 4e-9; sets that share
less than half of their shingles seldom meet. A document sends BANDS numbers however long it is.

Equal sets are linked to one of them. Of each band the member of least hashed key is the leader; every other set is
held against it, and the links make components. Only bands that still join different components go on: their members
are held against each other unless a lower bound rules the pair out, the number of bits in which the parities of the
two sets' hashed shingles differ, which never exceeds the number of shingles that only one of them has. Every
remaining pair is verified on the whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curatrix.llm.common import LOCATOR, LOWER, drop_rows, located, lookup, save, text_bytes, wide
from curatrix.llm.components import components
from curatrix.llm.simhash import SEED

SHINGLE = 5
NUMERATOR, DENOMINATOR = 4, 5  # least Jaccard similarity
BANDS, ROWS = 64, 6
PARITY = (1 << 10, 1 << 12)  # bits of the short parity and of the long one, for sets of more shingles than short bits
BLOCK = 1 << 10  # rows of one key that meet in one task
FILTER_BITS = 26


def shingle_set(text: bytes, shingle: int = SHINGLE):
    """Sorted distinct XXH64 of the word shingles; one of the whole text if it has fewer words, none without words."""
    import numpy as np
    import xxhash

    words = text.translate(LOWER).split()
    if not words:
        return np.empty(0, np.int64)
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return np.array([digest(joined, SEED)], np.uint64).view(np.int64)
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    start = (end - size)[: len(words) - shingle + 1].tolist()
    hashes = np.fromiter((digest(joined[s:e], SEED) for s, e in zip(start, end[shingle - 1:].tolist())), np.uint64, len(start))
    return np.unique(hashes.view(np.int64))


class Signer:
    """Band numbers and parities of shingle sets."""

    def __init__(self):
        import numpy as np

        draw = np.random.Generator(np.random.PCG64(SEED))
        half = BANDS * ROWS // 2  # one product of 64 bits gives two hashes of 32
        self.masks = draw.integers(0, 1 << 63, half, np.uint64)
        self.factors = draw.integers(0, 1 << 63, half, np.uint64) * np.uint64(2) + np.uint64(1)
        self.mix = draw.integers(0, 1 << 63, ROWS + 1, np.uint64) * np.uint64(2) + np.uint64(1)

    def bands(self, found):
        """One number for each band of a set that is not empty."""
        import numpy as np

        least = np.full(2 * len(self.masks), np.iinfo(np.uint32).max, np.uint32)
        hashes = found.view(np.uint64)
        for k in range(0, len(hashes), 1024):
            x = hashes[k:k + 1024, None] ^ self.masks
            x *= self.factors
            x ^= x >> np.uint64(29)
            np.minimum(least, x.view(np.uint32).min(axis=0), out=least)
        number = np.arange(1, BANDS + 1, dtype=np.uint64) * self.mix[ROWS]
        for row, factor in zip(least.reshape(ROWS, BANDS).astype(np.uint64), self.mix):
            number = (number ^ row) * factor
            number ^= number >> np.uint64(32)
        return number.view(np.int64)

    @staticmethod
    def parity(found, bits: int):
        """Bit i says whether an odd number of the hashes fall on i; as numbers of 64 bits."""
        import numpy as np

        odd = np.bincount(found & (bits - 1), minlength=bits) & 1
        return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of located(docs): key, doc_id, locator, digest of the set, n shingles, bands, short and long parity."""
    def run(batches: Iterator) -> Iterator:
        import hashlib

        import pyarrow as pa

        signer = Signer()
        longs = pa.list_(pa.int64())
        for batch in batches:
            digests, sizes, bands, short, long = [], [], [], [], []
            for text in text_bytes(batch.column(4)):
                found = shingle_set(text)
                n = len(found)
                digests.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest())
                sizes.append(n)
                bands.append(signer.bands(found) if n else [])
                short.append(signer.parity(found, PARITY[0]))
                long.append(signer.parity(found, PARITY[1]) if n > PARITY[0] else None)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:4], pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()),
                 pa.array(bands, longs), pa.array(short, longs), pa.array(long, longs)],
                names=["key", "doc_id", *LOCATOR, "digest", "n", "bands", "short", "long"])

    columns = docs.select(F.monotonically_increasing_id().alias("key"), F.col(id_col).cast("long").alias("doc_id"), *LOCATOR,
                          F.col(text_col).cast("string").alias("text"))
    return wide(columns).mapInArrow(run, f"key long, doc_id long, {LOCATOR[0]} string, {LOCATOR[1]} long, digest binary, n long, "
                                         "bands array<long>, short array<long>, long array<long>")


def _texts(docs: DataFrame, wanted: DataFrame, text_col: str) -> DataFrame:
    """(key, text) of wanted (key, locator). A bitmap of fixed size keeps most other texts out of the shuffle."""
    import numpy as np

    spark = docs.sparkSession
    bit = F.xxhash64(*LOCATOR).bitwiseAND((1 << FILTER_BITS) - 1)
    words = (wanted.select(bit.alias("bit")).groupBy(F.shiftright("bit", 6).alias("word"))
             .agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("bits")).toArrow())
    bitmap = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    bitmap[words["word"].to_numpy()] = words["bits"].to_numpy()
    shared = spark.sparkContext.broadcast(bitmap)

    def few(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            at = batch.column(3).to_numpy()
            take = np.flatnonzero((shared.value[at >> 6] >> (at & 63)) & 1)
            for part in np.array_split(take, max(1, len(take) // 1000)):
                yield pa.RecordBatch.from_arrays([c.take(pa.array(part)) for c in batch.columns[:3]], names=[*LOCATOR, "text"])

    rows = docs.select(*LOCATOR, F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), bit.alias("bit"))
    near = rows.mapInArrow(few, f"{LOCATOR[0]} string, {LOCATOR[1]} long, text string")
    return near.join(wanted, LOCATOR).select("key", "text")


def _meet(pairs: DataFrame, texts: DataFrame, side: str) -> DataFrame:
    """pairs with the text of one side. A key of many pairs is dealt into blocks, each of which gets the text once."""
    blocks = F.ceil(F.col("uses") / BLOCK).cast("int")
    counts = pairs.groupBy(side).agg(F.count(F.lit(1)).alias("uses"))
    own = (texts.withColumnRenamed("key", side).join(counts, side)
           .select(side, F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"), F.col("text").alias(f"text_{side}")))
    many = counts.where(F.col("uses") > BLOCK).select(side, blocks.alias("blocks"))
    dealt = (pairs.join(many, side, "left")
             .withColumn("block", F.pmod(F.xxhash64("a", "b"), F.coalesce("blocks", F.lit(1))).cast("int")).drop("blocks"))
    return dealt.join(own, [side, "block"]).drop("block")


def verified(pairs: DataFrame, rows: DataFrame, docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Those of pairs (a, b) whose whole sets have the least similarity or more."""
    uses = pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct()
    texts = save(_texts(docs, rows.select("key", *LOCATOR).join(uses, "key"), text_col), "near-texts")
    both = _meet(_meet(pairs, texts, "b"), texts, "a").select("a", "b", "text_a", "text_b")

    def compare(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        last, left = None, None
        for batch in batches:
            keys, kept = batch.column(0).to_numpy(), []
            for k, (x, y) in enumerate(zip(text_bytes(batch.column(2)), text_bytes(batch.column(3)))):
                if keys[k] != last:
                    last, left = keys[k], shingle_set(x)
                right = shingle_set(y)
                common = len(np.intersect1d(left, right, assume_unique=True))
                if DENOMINATOR * common >= NUMERATOR * (len(left) + len(right) - common):
                    kept.append(k)
            yield pa.RecordBatch.from_arrays([c.take(pa.array(kept, pa.int64())) for c in batch.columns[:2]], names=["a", "b"])

    return save(both.mapInArrow(compare, "a long, b long"), "near-links")


def similar_size(x: str, y: str):
    return DENOMINATOR * F.least(x, y) >= NUMERATOR * F.greatest(x, y)


def _differ(x, y):
    bits = F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseXOR(q)))
    return F.aggregate(bits, F.lit(0), lambda total, n: total + n)


def may_be_similar():
    """False only for pairs that cannot have the least similarity: too many parities differ."""
    differ = F.when(F.col("long").isNotNull() & F.col("long_b").isNotNull(), _differ(F.col("long"), F.col("long_b")))
    fewest = F.coalesce(differ, _differ(F.col("short"), F.col("short_b")))
    # |x - y| + |y - x| is at most (1 - s) / (1 + s) of |x| + |y|.
    return fewest * (DENOMINATOR + NUMERATOR) <= (F.col("n") + F.col("n_b")) * (DENOMINATOR - NUMERATOR)


def star_pairs(postings: DataFrame) -> DataFrame:
    """(a, b): one row of each set of a band against the band's leader. postings: band, key, n, sign."""
    leader = F.min(F.struct(F.xxhash64("key").alias("rank"), "key", "n", "sign"))
    bands = postings.groupBy("band").agg(F.count(F.lit(1)).alias("members"), leader.alias("lead")).where("members > 1")
    bands = save(bands.select("band", "members", F.col("lead.key").alias("leader"), F.col("lead.n").alias("m"),
                              F.col("lead.sign").alias("lead_sign")), "near-bands")
    met = lookup(postings, bands, "band", "members").where((F.col("sign") != F.col("lead_sign")) & similar_size("n", "m"))
    return met.groupBy("leader", "sign").agg(F.min("key").alias("b")).select(F.col("leader").alias("a"), "b")


def rest_pairs(postings: DataFrame, rows: DataFrame, roots: DataFrame) -> DataFrame:
    """(a, b) of different components that share a band and may be similar, a < b."""
    joined = postings.join(roots.withColumnRenamed("u", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    joined = save(joined, "near-placed")
    # One row of each set and component is enough: equal sets are linked already.
    bands = (joined.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("size"))
             .where("low != high").select("band", "size"))
    mixed = (lookup(joined, bands, "band", "size").groupBy("band", "sign", "n", "root")
             .agg(F.min("key").alias("key")).withColumn("part", F.pmod(F.xxhash64("key"), F.lit(1 << 20))))
    mixed = save(mixed.select("band", "key", "n", "root", "part"), "near-mixed")
    sizes = mixed.groupBy("band").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    mixed = lookup(mixed, sizes.withColumn("rows", F.col("blocks") * BLOCK), "band", "rows")
    parities = rows.select("key", "short", "long").join(mixed.select("key").distinct(), "key")
    mixed = save(mixed.join(parities, "key"), "near-parities")
    left = mixed.withColumn("block", F.pmod("part", "blocks"))
    right = (mixed.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .select("band", "block", *[F.col(c).alias(f"{c}_b") for c in ("key", "n", "root", "short", "long")]))
    met = left.join(right, ["band", "block"]).where(
        (F.col("key") < F.col("key_b")) & (F.col("root") != F.col("root_b")) & similar_size("n", "n_b") & may_be_similar())
    return met.select(F.col("key").alias("a"), F.col("key_b").alias("b")).distinct()


def links(rows: DataFrame, docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Edges (a, b) between keys that connect what pairs of the least similarity or more connect."""
    groups = rows.groupBy("digest").agg(F.min("key").alias("first"), F.count(F.lit(1)).alias("size")).where("size > 1")
    equal = save(lookup(rows.select("key", "digest"), save(groups, "near-equal"), "digest", "size").where("key != first")
                 .select(F.col("first").alias("a"), F.col("key").alias("b")), "near-equal-links")
    postings = rows.select("key", "n", F.xxhash64("digest").alias("sign"), F.explode("bands").alias("band"))
    star = save(star_pairs(postings), "near-star")
    first = verified(star, rows, docs, text_col)
    roots = save(components(equal.unionByName(first)), "near-roots")
    rest = rest_pairs(postings, rows, roots)
    rest = save(rest.join(star.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti"), "near-rest")
    return equal.unionByName(first).unionByName(verified(rest, rows, docs, text_col))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each component of linked rows: that of the smallest id, then the first locator.

    Texts without words are equal; null texts are empty. Null ids are kept only where a component has no other.
    Other columns of docs, of any name, are not touched. An empty table gives an empty result.
    """
    docs = located(docs)
    rows = save(signatures(docs, id_col, text_col), "near-rows")
    roots = components(links(rows, docs, text_col)).withColumnRenamed("u", "key")
    many = save(rows.select("key", "doc_id", *LOCATOR).join(roots, "key"), "near-many")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", *LOCATOR)).alias("keep")
    kept = many.groupBy("root").agg(best).select(*[F.col(f"keep.{c}").alias(c) for c in LOCATOR])
    return drop_rows(docs, many.join(kept, LOCATOR, "left_anti"))
