"""Hard negatives by the threshold algorithm over sorted lists.

Vectors become integers; a score is the integer inner product with the anchor. Candidates are dealt into blocks and
anchors into chunks; every chunk meets every block through a join on the numbers of both. In a block each dimension
has a list of candidates sorted by value. For one anchor the lists are read from the end that its component's sign
favours (a component of zero adds nothing and its list is not read). Each candidate met for the first time is scored
on its whole vector. The threshold, the anchor times the values last read, bounds the score of every candidate not
met yet; reading stops once it is strictly below the kth score of each window, or below the window where that has
fewer than k. The bests of the blocks are merged by Spark.

Two passes: first the positives of each anchor, from lists of its own label, then, in the windows that their scores
open, the negatives, from lists of all labels.

Rows: a null id, label or vector, and any component that is null or not finite once scaled, take a row out. Vectors
of different lengths are padded with zeros. Ties go to the smaller id. Rows that repeat an id count as rows of their
own, but none that bears the anchor's id is a positive or a negative of it. Sums that leave 53 bits are added up as
whole numbers of any size; a score outside the range of a long is returned as the nearest long.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from curatrix.llm.common import save

SCALE = 256
BLOCK, LEAST_BLOCK = 1 << 15, 1 << 10  # candidates of a block
CHUNK = 1 << 12  # anchors of a chunk
READS = 16  # a block's lists are read in so many steps at most
EXACT = 1 << 53
LONG = (1 << 63) - 1


def participants(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(key, id, label, vector) of the rows that take part, vectors as doubles before scaling; key numbers the rows."""
    vector = F.col(vector_col).cast("array<double>")
    fit = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x * SCALE) < float("inf")))
    return (rows.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & F.col(vector_col).isNotNull() & fit)
            .select(F.monotonically_increasing_id().alias("key"), F.col(id_col).cast("long").alias("id"),
                    F.col(label_col).cast("string").alias("label"), vector.alias("vector")))


def matrix(column, width: int):
    """Scaled vectors as rows of whole numbers, kept as doubles."""
    import numpy as np
    import pyarrow as pa

    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(size), width))
    row = np.repeat(np.arange(len(size)), size)
    place = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    out[row, place] = np.floor(SCALE * column.flatten().to_numpy(zero_copy_only=False))
    return out


def longest(*columns) -> int:
    import pyarrow.compute as pc

    return max([0, *(pc.max(pc.list_value_length(c)).as_py() or 0 for c in columns)])


def common_type(*parts) -> list:
    """parts as doubles where every score and every sum on the way is exact in them, else as whole numbers of any size."""
    import numpy as np

    most = [float(np.abs(p).max(initial=0)) for p in parts]
    if max(most) ** 2 * max(1, parts[0].shape[1]) < EXACT:
        return list(parts)
    whole = np.frompyfunc(int, 1, 1)
    return [whole(p).astype(object) for p in parts]


class Lists:
    """Candidates of one block, with a list for each dimension sorted by value and, among equals, by id descending."""

    def __init__(self, ids, vectors):
        import numpy as np

        by_id = np.argsort(-ids, kind="stable")
        self.ids, self.vectors = ids[by_id], np.ascontiguousarray(vectors[by_id])
        self.original = by_id
        self.order = np.ascontiguousarray(np.argsort(self.vectors, axis=0, kind="stable").T.astype(np.int32))
        self.values = np.take_along_axis(self.vectors.T, self.order, axis=1)

    def search(self, anchor, windows, k: int, allowed):
        """For each window (low, high; None is open) the first k allowed candidates by score, then id: (place, score) lists."""
        import numpy as np

        n = len(self.ids)
        up, down = np.flatnonzero(anchor > 0), np.flatnonzero(anchor < 0)
        best = [(np.empty(0, np.int64), np.empty(0, self.vectors.dtype)) for _ in windows]
        seen = np.zeros(n, bool)
        step, depth = max(1, -(-n // READS)), 0
        while depth < n:
            upto = min(n, depth + step)
            met = np.zeros(n, bool)
            met[self.order[up, n - upto:n - depth]] = True
            met[self.order[down, depth:upto]] = True
            if not len(up) and not len(down):
                met[:], upto = True, n
            new = np.flatnonzero(met & ~seen)
            seen[new] = True
            new = new[allowed[new]]
            scores = self.vectors[new] @ anchor if len(anchor) else np.zeros(len(new))
            for w, (low, high) in enumerate(windows):
                fits = np.ones(len(new), bool)
                if low is not None:
                    fits &= scores >= low
                if high is not None:
                    fits &= scores <= high
                if fits.any():
                    place, score = np.concatenate([best[w][0], new[fits]]), np.concatenate([best[w][1], scores[fits]])
                    if len(place) > 8 * k:  # the kth score first, so that few rows are sorted
                        bar = np.sort(score)[-k] if score.dtype == object else np.partition(score, -k)[-k]
                        place, score = place[score >= bar], score[score >= bar]
                    first = np.lexsort((self.ids[place], -score))[:k] if score.dtype != object else \
                        np.array(sorted(range(len(place)), key=lambda i: (-score[i], self.ids[place[i]]))[:k], np.int64)
                    best[w] = place[first], score[first]
            depth = upto
            if depth < n:
                threshold = (self.values[up, n - depth] * anchor[up]).sum() + (self.values[down, depth - 1] * anchor[down]).sum()
                bars = [score[-1] if len(score) == k else low for (low, _), (_, score) in zip(windows, best)]
                if all(bar is not None and threshold < bar for bar in bars):
                    break
        return best


def _long(score) -> int:
    return max(-LONG - 1, min(LONG, int(score)))


def _meet(anchors: DataFrame, rows: DataFrame, n_rows: int, n_anchors: int, run, schema: str) -> DataFrame:
    """run on every pair of a chunk of anchors and a block of rows; neither grows with the table."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    blocks = max(1, -(-n_rows // BLOCK), min(cores, -(-n_rows // LEAST_BLOCK)))
    chunks = max(1, -(-n_anchors // CHUNK))
    deal = lambda seed, n: F.pmod(F.xxhash64("key", F.lit(seed)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    own = [F.col(c).alias(c) for c in anchors.columns]  # anchors come from rows; new names keep the two sides apart
    left = anchors.select(*own, deal(1, chunks).alias("chunk")).withColumn("block", every(blocks))
    right = rows.select("id", "label", "vector", deal(2, blocks).alias("block")).withColumn("chunk", every(chunks))
    return left.groupBy("chunk", "block").cogroup(right.groupBy("chunk", "block")).applyInArrow(run, schema)


def positives(anchors: DataFrame, rows: DataFrame, n_rows: int, n_anchors: int, k: int = 5) -> DataFrame:
    """(key, place, positive_id, positive_score): the first k other rows of each anchor's label."""
    def run(left, right):
        import numpy as np
        import pyarrow as pa

        out: dict[str, list] = {"key": [], "positive_id": [], "positive_score": []}
        width = longest(left["vector"], right["vector"])
        mine, theirs = common_type(matrix(left["vector"], width), matrix(right["vector"], width))
        ids, labels = right["id"].to_numpy(), np.array(right["label"].to_pylist(), object)
        of_label = {x: np.flatnonzero(labels == x) for x in set(left["label"].to_pylist())}
        lists = {x: Lists(ids[at], theirs[at]) for x, at in of_label.items()}
        for row, (key, own, label) in enumerate(zip(*(left[c].to_pylist() for c in ("key", "id", "label")))):
            of = lists[label]
            for place, score in zip(*of.search(mine[row], [(None, None)], k, of.ids != own)[0]):
                out["key"].append(key)
                out["positive_id"].append(int(of.ids[place]))
                out["positive_score"].append(_long(score))
        return pa.table({c: pa.array(v, pa.int64()) for c, v in out.items()})

    found = _meet(anchors.select("key", "id", "label", "vector"), rows, n_rows, n_anchors, run,
                  "key long, positive_id long, positive_score long")
    order = Window.partitionBy("key").orderBy(F.desc("positive_score"), "positive_id")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def mine(rows: DataFrame, is_anchor: Column, n_positive: int = 5, n_negative: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    rows as given by participants; is_anchor is a condition on id. For each anchor and each of its first n_positive
    rows of its label, the first n_negative rows of other labels whose score is at least low and at most high percent
    of the positive's. Anchors without positives, and positives without such rows, give no row.
    """
    rows = save(rows, "mine-rows")
    anchors = rows.where(is_anchor)
    n_rows, n_anchors = rows.count(), anchors.count()
    near = save(positives(anchors, rows, n_rows, n_anchors, n_positive), "mine-positives")
    windows = near.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("place", "positive_id", "positive_score"))).alias("p"))
    opened = anchors.join(windows.select("key", F.col("p.positive_id").alias("positive_id"),
                                         F.col("p.positive_score").alias("positive_score")), "key")

    def run(left, right):
        import numpy as np
        import pyarrow as pa

        names = ["key", "anchor_id", "place", "positive_id", "positive_score", "negative_id", "negative_score"]
        out: dict[str, list] = {c: [] for c in names}
        width = longest(left["vector"], right["vector"])
        anchors, theirs = common_type(matrix(left["vector"], width), matrix(right["vector"], width))
        of = Lists(right["id"].to_numpy(), theirs)
        labels = np.array(right["label"].to_pylist(), object)[of.original]
        other = {x: labels != x for x in set(left["label"].to_pylist())}
        columns = ("key", "id", "label", "positive_id", "positive_score")
        for row, (key, own, label, ids, scores) in enumerate(zip(*(left[c].to_pylist() for c in columns))):
            bounds = [(-(-low * s // 100), high * s // 100) for s in scores]
            open_at = [w for w, (a, b) in enumerate(bounds) if a <= b]
            if not open_at:
                continue
            found = of.search(anchors[row], [bounds[w] for w in open_at], n_negative, other[label] & (of.ids != own))
            for w, (places, negative) in zip(open_at, found):
                for place, score in zip(places, negative):
                    for c, v in zip(names, (key, own, w + 1, ids[w], scores[w], int(of.ids[place]), _long(score))):
                        out[c].append(v)
        return pa.table({c: pa.array(v, pa.int64()) for c, v in out.items()})

    schema = "key long, anchor_id long, place long, positive_id long, positive_score long, negative_id long, negative_score long"
    found = _meet(opened, rows, n_rows, n_anchors, run, schema)
    order = Window.partitionBy("key", "place").orderBy(F.desc("negative_score"), "negative_id")
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n_negative)
            .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))
