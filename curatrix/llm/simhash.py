"""SimHash near-duplicates by segment popcounts.

A 64-bit fingerprint is cut into segments of two bits; its embedding is the vector of the segments' bit counts.
The Manhattan distance of two embeddings never exceeds the Hamming distance of the fingerprints. Counts are kept
in unary within each segment (0: 00, 1: 01, 2: 11), so that the embedding is again 64 bits and the Manhattan
distance of two embeddings is the number of bits in which they differ.

Grid: the segments are dealt into g groups. Within a distance of k, at least g - k groups have equal counts, so
every choice of g - k groups is one grid and the counts of its groups name the cell. Pairs that share a cell are
held against the Manhattan bound, what is left against the exact Hamming distance. Only distinct fingerprints are
placed in cells, and a cell returns a spanning forest of its links, at most one edge per member, never all pairs.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curatrix.llm.common import LOCATOR, LOWER, drop_rows, located, lookup, save, text_bytes, wide
from curatrix.llm.components import components

SEED = 42
SEGMENT_ENTROPY = 1.5  # bits of information in the count of two random bits
CELL_BLOCK = 4096  # fingerprints compared in one task at a time
SMALL_CELL = 24


def fingerprint(text: bytes, shingle: int = 4) -> int:
    """Majority of the XXH64 bits of the word shingles of one UTF-8 text; 0 for no words."""
    import numpy as np
    import xxhash

    words = text.translate(LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return digest(joined, SEED)
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    start = (end - size)[: len(words) - shingle + 1].tolist()
    n = len(start)
    hashes = np.fromiter((digest(joined[s:e], SEED) for s, e in zip(start, end[shingle - 1:].tolist())), np.uint64, n)
    octets = hashes.view(np.uint8).reshape(n, 8)
    if n < 2000:
        ones = np.unpackbits(octets, axis=1, bitorder="little").sum(0, dtype=np.int64)
    else:
        bits = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
        ones = np.concatenate([np.bincount(octets[:, i], minlength=256) @ bits for i in range(8)])
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4,
                 carry: list[str] | None = None) -> DataFrame:
    """(doc_id, carried columns, fp): fp is the unsigned fingerprint in a signed long. Null texts give 0."""
    carry = carry or []

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            fps = np.fromiter((fingerprint(t, shingle) for t in text_bytes(batch.column(batch.num_columns - 1))),
                              np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(fps.view(np.int64))],
                                             names=["doc_id", *carry, "fp"])

    columns = docs.select(F.col(id_col).cast("long").alias("doc_id"), *carry, F.col(text_col).alias("text"))
    kinds = {f.name: f.dataType.simpleString() for f in columns.schema}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in ["doc_id", *carry]) + ", fp long"
    return wide(columns).mapInArrow(run, schema)


def group_count(n: int, distance: int = 4, tolerance: int = 500) -> int:
    """Least number of segment groups at which a random fingerprint meets at most `tolerance` others in its cells."""
    for groups in range(distance + 2, 15):
        keys = math.comb(groups, distance)
        if n * keys * 2.0 ** (-32 * SEGMENT_ENTROPY * (groups - distance) / groups) <= tolerance:
            return groups
    return 15


def grid_masks(groups: int, distance: int = 4) -> list[int]:
    """Bit masks, as signed longs, of every choice of groups - distance groups of two-bit segments."""
    of_group = [sum(3 << (2 * s) for s in range(32) if s * groups // 32 == g) for g in range(groups)]
    masks = [sum(chosen) for chosen in itertools.combinations(of_group, groups - distance)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _unary():
    high = F.shiftrightunsigned("fp", 1)
    odd = 0x5555555555555555
    both = F.col("fp").bitwiseAND(high).bitwiseAND(F.lit(odd))
    either = F.col("fp").bitwiseOR(high).bitwiseAND(F.lit(odd))
    return F.shiftleft(both, 1).bitwiseOR(either)


def cells(fps: DataFrame, masks: list[int]) -> DataFrame:
    """(cell, fp): one row per grid. The grid's number is part of the hashed cell name."""
    names = F.array(*[F.xxhash64(F.lit(i), F.col("unary").bitwiseAND(F.lit(m).cast("long"))) for i, m in enumerate(masks)])
    return fps.select("fp").withColumn("unary", _unary()).select(F.explode(names).alias("cell"), "fp")


def _near(x, y, distance: int):
    """Boolean matrix: Manhattan bound first, exact distance on what it leaves."""
    import numpy as np

    odd = np.uint64(0x5555555555555555)
    one = np.uint64(1)

    def unary(v):
        high = v >> one
        return (((v & high) & odd) << one) | ((v | high) & odd)

    possible = np.bitwise_count(unary(x)[:, None] ^ unary(y)[None, :]) <= distance
    i, j = np.nonzero(possible)
    exact = np.bitwise_count(x[i] ^ y[j]) <= distance
    possible[i[~exact], j[~exact]] = False
    return possible


def forest(fps, distance: int, other=None):
    """Edges of a spanning forest of the links within fps (or those between fps and other)."""
    import numpy as np

    members = fps if other is None else np.concatenate([fps, other])
    side = np.zeros(len(members), bool)
    side[len(fps):] = True
    left = np.arange(len(members))
    edges = []
    while len(left) > 1:
        front, left = left[:1], left[1:]
        while len(front) and len(left):
            batch, front = front[:256], front[256:]
            near = _near(members[batch], members[left], distance)
            if other is not None:
                near &= side[batch][:, None] != side[left][None, :]
            hit = near.any(0)
            if hit.any():
                first = near[:, hit].argmax(0)
                edges.append(np.stack([members[batch][first], members[left[hit]]], 1))
                front, left = np.concatenate([front, left[hit]]), left[~hit]
    return np.concatenate(edges) if edges else np.empty((0, 2), np.uint64)


def _pairs(cell, fp, distance: int):
    """Links of small cells in sorted arrays: each row against the next rows of its cell."""
    import numpy as np

    out = []
    for step in range(1, min(SMALL_CELL, len(fp))):
        same = np.flatnonzero(cell[step:] == cell[:-step])
        if not len(same):
            break
        x, y = fp[same], fp[same + step]
        close = np.bitwise_count(x ^ y) <= distance
        out.append(np.stack([x[close], y[close]], 1))
    return np.concatenate(out) if out else np.empty((0, 2), np.uint64)


def _batch(edges, units):
    import numpy as np
    import pyarrow as pa

    n = len(edges)
    a = np.concatenate([edges[:, 0].view(np.int64), np.fromiter((u[3] for u in units), np.int64, len(units))])
    b = np.concatenate([edges[:, 1].view(np.int64), np.zeros(len(units), np.int64)])
    named = [[None] * n + [u[k] for u in units] for k in range(3)]
    return pa.RecordBatch.from_arrays(
        [pa.array(a), pa.array(b), *[pa.array(v, pa.int64()) for v in named]], names=["a", "b", "cell", "i", "j"])


def _link_cells(distance: int):
    """Task over rows sorted by cell. Cells beyond CELL_BLOCK come back as rows of block pairs, not as links."""
    def run(batches: Iterator) -> Iterator:
        import numpy as np

        none = np.empty((0, 2), np.uint64)

        def finish(cell, fp):
            cuts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1], True])
            size = np.diff(cuts)
            small = np.repeat(size <= SMALL_CELL, size)
            edges = [_pairs(cell[small], fp[small], distance)]
            for k in np.flatnonzero((size > SMALL_CELL) & (size <= CELL_BLOCK)):
                edges.append(forest(fp[cuts[k]:cuts[k + 1]], distance))
            yield _batch(np.concatenate(edges), [])
            for k in np.flatnonzero(size > CELL_BLOCK):
                name, members = int(cell[cuts[k]]), fp[cuts[k]:cuts[k + 1]].view(np.int64).tolist()
                blocks = -(-len(members) // CELL_BLOCK)
                for other in range(blocks):
                    pairs = [(name, min(n // CELL_BLOCK, other), max(n // CELL_BLOCK, other), f) for n, f in enumerate(members)]
                    for at in range(0, len(pairs), 50_000):
                        yield _batch(none, pairs[at:at + 50_000])

        cell, fp = np.empty(0, np.int64), np.empty(0, np.uint64)
        for batch in batches:
            cell = np.concatenate([cell, batch.column(0).to_numpy()])
            fp = np.concatenate([fp, batch.column(1).to_numpy().view(np.uint64)])
            if len(cell) < 200_000 or cell[0] == cell[-1]:
                continue
            last = int(np.searchsorted(cell, cell[-1]))
            yield from finish(cell[:last], fp[:last])
            cell, fp = cell[last:], fp[last:]
        if len(cell):
            yield from finish(cell, fp)
    return run


def _link_blocks(distance: int):
    """Task over rows sorted by (cell, i, j): links within a block where i = j, else between two blocks."""
    def run(batches: Iterator) -> Iterator:
        import numpy as np

        key, fps = None, []

        def finish():
            cell, i, j = key
            members = np.array(fps, np.int64).view(np.uint64)
            if i == j:
                return forest(members, distance)
            cut = CELL_BLOCK if i < j else 0  # rows come sorted by fp, as the blocks were cut
            return forest(members[:cut], distance, members[cut:])

        for batch in batches:
            rows = zip(*[batch.column(c).to_pylist() for c in range(4)])
            for cell, i, j, fp in rows:
                if (cell, i, j) != key:
                    if key is not None:
                        yield _batch(finish(), [])
                    key, fps = (cell, i, j), []
                fps.append(fp)
        if key is not None:
            yield _batch(finish(), [])
    return run


def links(fps: DataFrame, distance: int = 4) -> DataFrame:
    """Edges (a, b) between distinct fingerprints that connect exactly what links of at most `distance` connect."""
    shape = "a long, b long, cell long, i long, j long"
    placed = cells(fps, grid_masks(group_count(fps.count(), distance), distance))
    parts = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = save(placed.repartition(parts, "cell").sortWithinPartitions("cell", "fp")
                 .mapInArrow(_link_cells(distance), shape), "simhash-links")
    units = found.where("cell is not null").select("cell", "i", "j", F.col("a").alias("fp"))
    split = (units.repartition(parts, "cell", "i", "j").sortWithinPartitions("cell", "i", "j", "fp")
             .mapInArrow(_link_blocks(distance), shape))
    return found.where("cell is null").select("a", "b").unionByName(split.select("a", "b")).distinct()


def cluster(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = 4, shingle: int = 4,
            carry: list[str] | None = None) -> DataFrame:
    """One row per row of docs: doc_id, carried columns, fp, component_id (smallest doc_id reachable), n_rows.

    Null and empty texts have fingerprint 0. Ids may repeat; null ids never name a component unless all its ids
    are null. n_rows counts the rows of the component. An empty table gives an empty result.
    """
    rows = save(fingerprints(docs, id_col, text_col, shingle, carry), "simhash-fp")
    distinct = save(rows.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("size")), "simhash-distinct")
    roots = components(links(distinct, distance)).withColumnRenamed("u", "fp")
    of_fp = save(distinct.join(roots, "fp", "left"), "simhash-roots")
    linked = of_fp.where("root is not null")
    named = linked.groupBy("root").agg(F.min("first").alias("component_id"), F.sum("size").alias("n_rows"),
                                       F.count(F.lit(1)).alias("n_fp"))
    classes = lookup(linked.select("fp", "size", "root"), named, "root", "n_fp").drop("root", "n_fp")
    alone = of_fp.where("root is null").select(
        "fp", "size", F.col("first").alias("component_id"), F.col("size").alias("n_rows"))
    classes = classes.unionByName(alone)
    return lookup(rows, save(classes, "simhash-classes"), "fp", "size").drop("size")


def hexadecimal(column: str = "fp"):
    return F.lpad(F.lower(F.hex(column)), 16, "0")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = 4) -> DataFrame:
    """docs with one row of each component: that of the smallest id, among repeated ids the first locator."""
    docs = located(docs)
    rows = cluster(docs, id_col, text_col, distance, carry=LOCATOR)
    many = save(rows.where("n_rows > 1").select("component_id", "doc_id", *LOCATOR), "simhash-many")
    first = many.where("doc_id <=> component_id").groupBy("component_id").agg(F.min(F.struct(*LOCATOR)).alias("keep"))
    kept = first.select(*[F.col(f"keep.{c}").alias(c) for c in LOCATOR])
    return drop_rows(docs, many.join(kept, LOCATOR, "left_anti"))
