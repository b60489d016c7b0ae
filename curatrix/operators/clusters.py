"""Clusters and low-dimensional coordinates of dense vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curatrix.lineage import saved
from curatrix.operators.models import as_vector

PIECE_ROWS = 1024
TASKS_TO_DRIVER = 64
GROUP_PIECES = 64  # blocks of one side that a task of the silhouette holds


def scaled_vectors(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """Column ``features``: zero mean and unit deviation per dimension."""
    rows = as_vector(df, vector)
    return StandardScaler(inputCol="_v", outputCol="features", withMean=True, withStd=True).fit(rows).transform(rows).drop("_v")


def cluster_count(rows: int) -> int:
    """One cluster per 600 rows, 4 to 12; halves round to even."""
    return min(12, max(4, round(rows / 600)))


@dataclass
class KMeansFit:
    """Means of the best start, its cost, and the cost and passes of every start."""

    centers: np.ndarray
    cost: float
    costs: list[float]
    steps: int


def pack_dense(df: DataFrame, features: str = "features", extra: list[str] | None = None, rows: int = PIECE_ROWS) -> DataFrame:
    """(piece, x, rows): runs of rows as one block of numbers each, with the extra columns as an array."""
    kept = F.struct(*[F.col(c) for c in extra]) if extra else F.struct(F.lit(None).cast("byte").alias("none"))
    flat = df.select(vector_to_array(features).alias("x"), kept.alias("row"))
    shape = T.StructType([T.StructField("piece", T.LongType()), T.StructField("x", T.BinaryType()),
                          T.StructField("rows", T.ArrayType(flat.schema["row"].dataType))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                x = part.column(0).flatten().to_numpy(zero_copy_only=False)
                held = pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column(1))
                yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([x.tobytes()], pa.binary()), held], names=shape.names)
                number += 1

    return flat.mapInArrow(run, shape)


def _square_distances(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """(rows, starts, clusters) squared distances to centers (starts, clusters, width)."""
    flat = centers.reshape(-1, centers.shape[-1])
    far = (x * x).sum(1)[:, None] + (flat * flat).sum(1)[None] - 2 * x @ flat.T
    return np.maximum(far, 0.0).reshape(len(x), *centers.shape[:-1])


def _chances(x: np.ndarray, start: int, round_: int, seed: int) -> np.ndarray:
    """A number in [0, 1) for each row, from its bytes."""
    import xxhash

    data, width = np.ascontiguousarray(x).tobytes(), 8 * x.shape[1]
    salt = (seed * 1_000_003 + start) * 1_000_003 + round_
    return np.array([xxhash.xxh64_intdigest(data[i * width:(i + 1) * width], salt & (2**64 - 1)) for i in range(len(x))]) / 2.0**64


def _sums(pieces: DataFrame, work: Callable, shape: tuple[int, ...]) -> np.ndarray:
    """Sum over all pieces of an array that ``work`` makes of a block; added up in tasks, then in some tens of tasks."""
    size = int(np.prod(shape))

    def add(make: Callable) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(size)
            for batch in batches:
                for value in batch.column(0):
                    total += make(np.frombuffer(value.as_buffer()))
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["total"])
        return run

    parts = pieces.select("x").mapInArrow(add(work), "total binary")
    if pieces.rdd.getNumPartitions() > TASKS_TO_DRIVER:
        parts = parts.repartition(TASKS_TO_DRIVER).mapInArrow(add(lambda v: v), "total binary")
    return sum((np.frombuffer(v.as_buffer()) for v in parts.toArrow()["total"]), np.zeros(size)).reshape(shape)


def _seed_centers(pieces: DataFrame, k: int, starts: int, seed: int, width: int, rounds: int = 5) -> np.ndarray:
    """k-means||: a few rounds draw about 2 k candidates each in proportion to their squared distance from those
    already drawn, for all starts in the same pass; weighted k-means++ picks k of the candidates of a start."""
    def drawn(chosen: list[np.ndarray] | None, costs: np.ndarray | None, round_: int) -> list[np.ndarray]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for value in batch.column(0):
                    x = np.frombuffer(value.as_buffer()).reshape(-1, width)
                    for start in range(starts):
                        chance = _chances(x, start, round_, seed)
                        if chosen is None:  # the first candidate of a start: the row of the least number
                            at = np.argmin(chance)[None]
                        else:
                            far = _square_distances(x, chosen[start][None])[:, 0].min(axis=1)
                            at = np.flatnonzero(chance * max(costs[start], 1e-300) < 2 * k * far)
                        for i in at:
                            yield pa.RecordBatch.from_arrays([pa.array([start]), pa.array([chance[i]]), pa.array([x[i].tobytes()], pa.binary())],
                                                             names=["start", "chance", "x"])
        found = pieces.select("x").mapInArrow(run, "start long, chance double, x binary")
        if chosen is None:
            found = found.groupBy("start").agg(F.min_by("x", F.struct("chance", "x")).alias("x"), F.min("chance").alias("chance"))
        rows = found.orderBy("start", "chance", "x").collect()  # about 2 k candidates a start
        return [np.array([np.frombuffer(r["x"]) for r in rows if r["start"] == s]).reshape(-1, width) for s in range(starts)]

    chosen = drawn(None, None, 0)
    for round_ in range(1, rounds + 1):
        costs = _sums(pieces, lambda v, held=chosen: np.array(
            [_square_distances(v.reshape(-1, width), c[None])[:, 0].min(axis=1).sum() for c in held]), (starts,))
        more = drawn(chosen, costs, round_)
        chosen = [np.unique(np.concatenate([c, m]), axis=0) for c, m in zip(chosen, more)]
    most = max(len(c) for c in chosen)

    def weigh(v: np.ndarray) -> np.ndarray:
        x, total = v.reshape(-1, width), np.zeros((starts, most))
        for start, held in enumerate(chosen):
            near = _square_distances(x, held[None])[:, 0].argmin(axis=1)
            total[start, :len(held)] = np.bincount(near, minlength=len(held))
        return total.ravel()

    weights = _sums(pieces, weigh, (starts, most))
    centers = np.zeros((starts, k, width))
    for start, held in enumerate(chosen):
        draw, w = np.random.default_rng([seed, start]), weights[start, :len(held)]
        picked = [int(draw.choice(len(held), p=w / w.sum()))]
        while len(picked) < k:
            far = w * _square_distances(held, held[picked][None])[:, 0].min(axis=1)
            picked.append(int(draw.choice(len(held), p=far / far.sum())) if far.sum() > 0 else picked[-1])
        centers[start] = held[picked]
    return centers


def best_kmeans(df: DataFrame, k: int, starts: int = 20, seed: int = 42, max_steps: int = 100, tol: float = 1e-4) -> KMeansFit:
    """k-means of ``features`` from several starts; the one with the least cost.

    All starts share one pass per step: a task adds up rows and squared distances by start and cluster, so jobs do not
    grow with the starts. A start stops on its own once its means move by less than ``tol`` deviations in all. A mean
    without rows stays where it is.
    """
    pieces = saved(pack_dense(df), "dense")
    first = pieces.select("x", F.size("rows").alias("n")).first()
    if first is None:
        raise ValueError("no rows to cluster")
    width = len(first["x"]) // 8 // first["n"]
    pieces = pieces.persist()
    try:
        moments = _sums(pieces, lambda v: np.concatenate([[len(v) // width], v.reshape(-1, width).sum(0), (v.reshape(-1, width) ** 2).sum(0)]), (2 * width + 1,))
        n, mean = moments[0], moments[1:width + 1] / moments[0]
        spread = float((moments[width + 1:] / n - mean ** 2).mean())
        centers = _seed_centers(pieces, k, starts, seed, width)
        active, steps, costs = np.ones(starts, bool), 0, np.zeros(starts)
        while active.any() and steps < max_steps:
            now = np.flatnonzero(active)

            def step(v: np.ndarray, held=centers[now]) -> np.ndarray:
                x = v.reshape(-1, width)
                far = _square_distances(x, held)
                near = far.argmin(axis=2)
                total = np.zeros((len(held), k, width + 2))
                for s in range(len(held)):
                    total[s, :, 0] = np.bincount(near[:, s], minlength=k)
                    total[s, :, 1] = np.bincount(near[:, s], far[np.arange(len(x)), s, near[:, s]], k)
                    np.add.at(total[s, :, 2:], near[:, s], x)
                return total.ravel()

            total = _sums(pieces, step, (len(now), k, width + 2))
            steps += 1
            costs[now] = total[:, :, 1].sum(axis=1)
            rows = total[:, :, 0]
            means = np.where(rows[..., None] > 0, total[:, :, 2:] / np.maximum(rows, 1)[..., None], centers[now])
            moved = ((means - centers[now]) ** 2).sum(axis=(1, 2))
            centers[now] = means
            active[now] = moved > tol * spread
        costs = _sums(pieces, lambda v: _square_distances(v.reshape(-1, width), centers).min(axis=2).sum(axis=0), (starts,))
    finally:
        pieces.unpersist()
    best = int(np.argmin(costs))
    return KMeansFit(centers[best], float(costs[best]), costs.tolist(), steps)


def assign(df: DataFrame, centers: np.ndarray, name: str = "cluster_id") -> DataFrame:
    """df with the nearest mean of each row; ties go to the smaller number."""
    numbers = F.array(*[F.array(*[F.lit(float(v)) for v in c]) for c in centers])
    x = vector_to_array("features")
    far = F.transform(numbers, lambda c: F.aggregate(F.zip_with(x, c, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda t, v: t + v))
    return df.withColumn(name, (F.array_position(far, F.array_min(far)) - 1).cast("int"))


def cluster(df: DataFrame, k: int | None = None, starts: int = 20) -> DataFrame:
    """Rows of scaled vectors with their cluster."""
    return assign(df, best_kmeans(df, k or cluster_count(df.count()), starts).centers)


def silhouette(df: DataFrame, cluster_column: str = "cluster_id", sample: int | None = 2_000, seed: int = 42) -> DataFrame:
    """Mean silhouette under Euclidean distance over a sample of rows chosen by hash; None takes every row.

    Each sampled row is held against all rows: blocks of the sample and of the table are dealt into groups of bounded
    size, each pair of groups meets in one task that gets every block once, keeps sums of distances by sampled row and
    cluster, and lets no pair out. Rows alone in their cluster count 0; one cluster gives 0. (silhouette, rows: how
    many were sampled)
    """
    spark = df.sparkSession
    rows = df.select("features", F.col(cluster_column).cast("string").alias("c"))
    sizes = {r["c"]: r["count"] for r in rows.filter(F.col("c").isNotNull()).groupBy("c").count().collect()}  # one row per cluster
    names = sorted(sizes)
    number = F.map_from_arrays(F.array(*[F.lit(n) for n in names]), F.array(*[F.lit(i) for i in range(len(names))])) if names else None
    if len(names) < 2:
        return spark.createDataFrame([(0.0, sum(sizes.values()))], "silhouette double, rows long")
    table = saved(rows.filter(F.col("c").isNotNull()).select("features", F.element_at(number, F.col("c")).alias("c"), F.monotonically_increasing_id().alias("key")), "clusters")
    picked = table
    if sample is not None and sum(sizes.values()) > sample:
        rank = F.xxhash64("key", F.lit(seed))
        bound = table.select(rank.alias("r")).orderBy("r").limit(sample).agg(F.max("r")).first()[0]
        picked = table.filter(rank <= bound)
    all_pieces = saved(pack_dense(table, extra=["c"]), "dense")
    some = saved(pack_dense(picked, extra=["c"]), "sample").select("piece", F.col("x").alias("sx"), F.col("rows.c").alias("sc"))
    blocks = all_pieces.count()
    of_table = max(1, min(spark.sparkContext.defaultParallelism, blocks), -(-blocks // GROUP_PIECES))
    of_sample = max(1, -(-some.count() // GROUP_PIECES))

    def group(count: int) -> Column:
        return F.pmod(F.xxhash64("piece"), F.lit(count)).cast("int")

    def every(count: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(count - 1)))

    left = all_pieces.select("x", F.col("rows.c").alias("c"), group(of_table).alias("g")).withColumn("h", every(of_sample))
    right = some.withColumn("h", group(of_sample)).withColumn("g", every(of_table))
    k, counts = len(names), np.array([sizes[n] for n in names], float)

    def meet(table: pa.Table, sampled: pa.Table) -> pa.Table:
        """Sums of distances of every block of a group of the sample to a group of the table, by cluster."""
        held = []
        for x, c in zip(table["x"], table["c"]):
            own = np.asarray(c.values)
            held.append((np.frombuffer(x.as_buffer()).reshape(len(own), -1), [np.flatnonzero(own == j) for j in range(k)]))
        sums = []
        for x, c in zip(sampled["sx"] if held else [], sampled["sc"]):
            block = np.frombuffer(x.as_buffer()).reshape(len(c), -1)
            total = np.zeros((len(c), k))
            for rows, own in held:
                far = np.sqrt(_square_distances(block, rows[None])[:, 0])
                total += np.stack([far[:, j].sum(axis=1) for j in own], axis=1)
            sums.append(total.tobytes())
        met = sampled if held else sampled.slice(0, 0)
        return pa.table({"piece": met["piece"], "sums": pa.array(sums, pa.binary()), "sc": met["sc"]})

    def close(met: pa.Table) -> pa.Table:
        sc = np.asarray(met["sc"][0].values)
        total = sum(np.frombuffer(v.as_buffer()).reshape(-1, k) for v in met["sums"])
        mine, at = counts[sc], np.arange(len(sc))
        inside = total[at, sc] / np.maximum(mine - 1, 1)
        means = total / counts
        means[at, sc] = np.inf
        outside = means.min(axis=1)
        wide = np.maximum(inside, outside)
        width = np.where((mine > 1) & (wide > 0), (outside - inside) / np.where(wide > 0, wide, 1), 0.0)
        return pa.table({"width": pa.array([width.sum()]), "n": pa.array([len(width)])})

    met = left.groupBy("g", "h").cogroup(right.groupBy("g", "h")).applyInArrow(meet, "piece long, sums binary, sc array<int>")
    sums = met.groupBy("piece").applyInArrow(close, "width double, n long")
    return sums.agg((F.sum("width") / F.sum("n")).alias("silhouette"), F.sum("n").alias("rows"))


def reduce_pca(df: DataFrame, key: str, k: int = 2) -> DataFrame:
    """First principal coordinates of scaled vectors; their signs are arbitrary."""
    model = PCA(k=k, inputCol="features", outputCol="coordinates").fit(df)
    points = vector_to_array("coordinates")
    return model.transform(df).select(key, *[points[i].alias(f"pc{i + 1}") for i in range(k)])


def reduce_svd(df: DataFrame, key: str, k: int = 2) -> DataFrame:
    """Truncated SVD coordinates: vectors times the leading right singular vectors.

    X'X is summed in blocks, one d x d matrix per task; its eigenvectors are found on the driver.
    """
    x = vector_to_array("features")
    width = df.select(F.size(x)).first()[0]

    def gram(batches):
        total = np.zeros((width, width))
        for batch in batches:
            block = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            total += block.T @ block
        cells = pa.array(np.arange(width * width))
        yield pa.RecordBatch.from_arrays([cells, pa.array(total.ravel())], names=["cell", "value"])

    sums = df.select(x.alias("x")).mapInArrow(gram, "cell long, value double").groupBy("cell").agg(F.sum("value").alias("value")).toPandas()
    matrix = np.zeros(width * width)
    matrix[sums["cell"]] = sums["value"]
    right = np.linalg.eigh(matrix.reshape(width, width))[1][:, ::-1]
    coordinates = []
    for i in range(k):
        axis = F.array(*[F.lit(float(v)) for v in right[:, i]])
        product = F.aggregate(F.zip_with(x, axis, lambda a, b: a * b), F.lit(0.0), lambda acc, v: acc + v)
        coordinates.append(product.alias(f"sv{i + 1}"))
    return df.select(key, *coordinates)


def cluster_enrichment(df: DataFrame, cluster_column: str, label: str) -> DataFrame:
    """Rows, labels and share of positives among labelled rows per cluster."""
    counts = df.groupBy(cluster_column).agg(
        F.count("*").alias("row_count"),
        F.count_if(F.col(label) == 0).alias("label_0"), F.count_if(F.col(label) == 1).alias("label_1"),
        F.count(label).alias("_labelled"),
    )
    share = F.col("label_1") / F.nullif(F.col("_labelled"), F.lit(0))
    return counts.withColumn("positive_fraction", share).drop("_labelled")


__all__ = ["KMeansFit", "assign", "best_kmeans", "cluster", "cluster_count", "cluster_enrichment", "reduce_pca", "reduce_svd",
           "scaled_vectors", "silhouette"]
