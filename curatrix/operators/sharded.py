"""Balanced logistic regressions on n-gram TF-IDF whose weights never stand in one place.

Terms are numbered and cut into slices; rows are cut into pieces that know which terms of which slice they hold. One
step takes the weights from the slices to the pieces (only the terms a piece holds), works out margins, residuals and
the piece's part of the gradient there, and adds the parts up slice by slice, in a tree where there are many pieces.
Pieces and their lists of terms stay where they are for the whole fit; a step shuffles one number for each distinct
term of a piece and model, not one for each entry, and no task holds more than a slice or a piece.

The optimiser is L-BFGS in its vector-free form. It starts from zero, so weights, gradients and steps are sums of rows:
X'a for numbers a of the rows. A vector is kept as a, and as Xa', its products with the rows; dot products of two
vectors are dot products of one's numbers with the other's products. The history is thus a few numbers for each row
and model that lie with the row's piece, whatever the number of terms; a step makes one product, of the new
residuals, and the driver sees dot products and intercepts only. Several models are fitted in the same steps: a model is a
choice of training rows, with document frequencies, class weights and row lengths of its own over the shared counts.
The number of jobs does not depend on the number of models.

Loss of a model: sum of class weight times log loss, plus half the squared length of the weights over C; the
intercept is free.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curatrix.lineage import saved
from curatrix.operators.ordered import position_in_group

SLICE = 1 << 16  # terms of a slice
SLICE_NUMBERS = 1 << 21  # terms of a slice times numbers for each
PIECE_ENTRIES = 1 << 22  # entries of a piece
PIECE_NUMBERS = 1 << 22  # distinct terms of a piece times numbers for each
ROW_NUMBERS = 1 << 18  # rows of a piece times models
FAN_IN = 64  # parts that meet in one sum
FAN_NUMBERS = 1 << 23  # numbers of the parts that meet
HISTORY = 8
INTERCEPT = -1  # the slice of the intercept
STATE, SAID = -2, -3  # stand for a slice where a piece's state and report are kept

REPORT = (2 * HISTORY + 1) ** 2 + 4  # dot products, squared length, slope, loss, slope of the intercept
IN_PIECE = "piece long, shard int, values binary"


def _f8(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values, np.float64).tobytes()


def _floats(scalar, models: int) -> np.ndarray:
    return np.frombuffer(scalar.as_buffer(), np.float64).reshape(models, -1)


def _ints(scalar) -> np.ndarray:
    return np.frombuffer(scalar.as_buffer(), np.int32)


PIECES = ("piece long, n int, label binary, train binary, starts binary, col binary, tf binary, shards array<int>, "
          "columns array<binary>")


def cut_pieces(counted: DataFrame, label: str, uses: list[Column], keep: list[str], size: int = SLICE,
               entries: int = PIECE_ENTRIES, numbers: int | None = None) -> DataFrame:
    """Pieces of ``counted`` (label, ix array, tf array): entries by place in the piece's list of distinct terms.

    ``uses`` says for each model which rows it learns from; ``keep`` are columns that the scores go back with.
    """
    models = len(uses)
    rows = counted.select(F.struct(*[F.col(c) for c in keep]).alias("kept"), F.col(label).cast("double").alias("y"),
                          F.array(*[F.coalesce(u, F.lit(False)).cast("double") for u in uses]).alias("train"),
                          F.col("ix").alias("ix"), F.col("tf").alias("tf"))
    numbers = numbers or models
    most_rows = max(1, ROW_NUMBERS // models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            kept, y, train, ix, tf = batch.columns
            ends = ix.offsets.to_numpy()
            flat_ix, flat_tf = ix.values.to_numpy(), tf.values.to_numpy()
            labels = y.to_numpy(zero_copy_only=False)
            learn = train.values.to_numpy().reshape(-1, models) * np.isfinite(labels)[:, None]
            labels = np.nan_to_num(labels)
            at = 0
            while at < batch.num_rows:
                upto = max(at + 1, int(np.searchsorted(ends, ends[at] + entries, "right")) - 1)
                upto = min(upto, at + most_rows, batch.num_rows)
                while True:
                    part = slice(ends[at], ends[upto])
                    distinct, place = np.unique(flat_ix[part], return_inverse=True)
                    if upto == at + 1 or len(distinct) * numbers <= PIECE_NUMBERS:
                        break
                    upto = at + (upto - at) // 2
                shard, local = np.divmod(distinct.astype(np.int64), size)
                shards, begins = np.unique(shard, return_index=True)
                cuts = [*begins.tolist(), len(distinct)]
                columns = [local[i:j].astype(np.int32).tobytes() for i, j in zip(cuts, cuts[1:])]
                starts = (ends[at:upto + 1] - ends[at]).astype(np.int32)
                values = [number, upto - at, _f8(labels[at:upto]), _f8(learn[at:upto].T), starts.tobytes(),
                          place.astype(np.int32).tobytes(), flat_tf[part].astype(np.float32).tobytes(), [INTERCEPT, *shards.tolist()],
                          [np.zeros(1, np.int32).tobytes(), *columns]]
                held = pa.ListArray.from_arrays(pa.array([0, upto - at], pa.int32()), kept.slice(at, upto - at))
                yield pa.RecordBatch.from_arrays([*[pa.array([v], f.type) for v, f in zip(values, arrow)], held],
                                                 names=[*[f.name for f in arrow], "kept"])
                number += 1
                at = upto

    shape = T.StructType.fromDDL(PIECES)
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32()),
             "array<binary>": pa.list_(pa.binary())}
    arrow = [pa.field(f.name, kinds[f.dataType.simpleString()]) for f in shape.fields]
    full = T.StructType([*shape.fields, T.StructField("kept", T.ArrayType(rows.schema["kept"].dataType))])
    return rows.mapInArrow(run, full)


@dataclass
class Fit:
    """Fitted models: ``weights`` has one row per slice with idf and weights of every model."""

    weights: DataFrame
    models: int
    size: int
    steps: int
    gradient: list[float]  # length of each model's gradient
    free: np.ndarray  # intercepts

    def terms(self, model: int = 0) -> DataFrame:
        """(ix, idf, weight) of one model; terms that its rows do not support have weight 0 and idf 0."""
        models, size = self.models, self.size

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in range(batch.num_rows):
                    idf, w = (_floats(batch.column(c)[k], models)[model] for c in (1, 2))
                    ix = batch.column(0)[k].as_py() * size + np.arange(len(w))
                    yield pa.RecordBatch.from_arrays([pa.array(ix.astype(np.int64)), pa.array(idf), pa.array(w)], names=["ix", "idf", "weight"])

        table = self.weights.filter(F.col("shard") != INTERCEPT).select("shard", "idf", "w")
        return table.mapInArrow(run, "ix long, idf double, weight double")

    def intercepts(self) -> np.ndarray:
        return self.free


class Shards:
    """The pieces of a table, placed once, and the ways between pieces and slices."""

    def __init__(self, counted: DataFrame, label: str, uses: list[Column], n_terms: int, keep: list[str],
                 size: int | None = None, entries: int = PIECE_ENTRIES, fan_in: int = FAN_IN, numbers: int | None = None):
        """``numbers`` per term go to and fro, one for each of ``uses`` unless said otherwise."""
        self.spark = counted.sparkSession
        self.models, self.n_terms = numbers or len(uses), n_terms
        self.size = size or max(1, min(SLICE, SLICE_NUMBERS // self.models))
        table = saved(cut_pieces(counted, label, uses, keep, self.size, entries, self.models), "pieces")
        self.n_pieces = table.count()
        # As many pieces meet in one sum as keep it bounded, by what they hold of the fullest slice on average.
        held = table.select(F.explode(F.arrays_zip("shards", "columns")).alias("c")).groupBy("c.shards").agg(F.sum(F.octet_length("c.columns")).alias("bytes"))
        fullest = (held.agg(F.max("bytes")).first()[0] or 0) / 4 / max(1, self.n_pieces)
        self.fan_in = max(2, min(fan_in, int(FAN_NUMBERS // max(1.0, fullest * self.models))))
        self.tasks = max(1, min(self.spark.sparkContext.defaultParallelism, self.n_pieces)) if self.n_pieces < 1 << 12 else self.n_pieces >> 4
        table = table.withColumn("part", F.pmod(F.xxhash64("piece"), F.lit(self.parts)).cast("int"))
        self.pieces = table.repartition(self.tasks, "piece").persist()
        listed = table.select("piece", "part", F.explode(F.arrays_zip("shards", "columns")).alias("c"))
        self.wants = (listed.select("piece", "part", F.col("c.shards").alias("shard"), F.col("c.columns").alias("cols"))
                      .repartition(self.tasks, "shard", "part").persist())

    @property
    def parts(self) -> int:
        """Into how many parts the pieces of a slice are dealt, so that each part is of bounded size."""
        return max(1, -(-self.n_pieces // self.fan_in))

    def release(self) -> None:
        self.pieces.unpersist()
        self.wants.unpersist()

    def to_pieces(self, slices: DataFrame) -> DataFrame:
        """(piece, shard, values) from ``slices`` (shard, values): of each slice the terms that the piece holds."""
        models = self.models
        spread_out = slices.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(self.parts - 1))))

        def pick(left: pa.Table, right: pa.Table) -> pa.Table:
            if not left.num_rows:
                values = None
            else:
                values = _floats(left["values"][0], models)
            out = []
            for cols in right["cols"]:
                at = _ints(cols)
                out.append(_f8(values[:, at] if values is not None else np.zeros((models, len(at)))))
            return pa.table({"piece": right["piece"], "shard": right["shard"], "values": pa.array(out, pa.binary())})

        return (spread_out.groupBy("shard", "part").cogroup(self.wants.groupBy("shard", "part"))
                .applyInArrow(pick, "piece long, shard int, values binary"))

    def in_pieces(self, values: DataFrame, work: Callable, schema: str | T.StructType) -> DataFrame:
        """``work(piece, terms)`` for each piece: its columns, and by slice the values of its terms for each model."""
        models = self.models

        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            piece = {c: left[c][0] for c in left.column_names}
            of_shard = {s: _floats(v, models) for s, v in zip(right["shard"].to_pylist(), right["values"])}
            if STATE in of_shard:
                piece["state"] = of_shard[STATE]
            return work(piece, [of_shard[s] for s in piece["shards"].as_py() if s in of_shard])

        return self.pieces.groupBy("piece").cogroup(values.groupBy("piece")).applyInArrow(run, schema)

    def to_slices(self, parts: DataFrame, rows: int) -> DataFrame:
        """(shard, values) sums of ``parts`` (shard, part, cols, values); values have ``rows`` numbers for each term.

        Parts meet ``fan_in`` at a time, level by level, as dense slices.
        """
        size, n_terms, level = self.size, self.n_terms, self.parts

        def first(table: pa.Table) -> pa.Table:
            shard = table["shard"][0].as_py()
            total = np.zeros((rows, 1 if shard < 0 else min(size, n_terms - shard * size)))
            for cols, values in zip(table["cols"], table["values"]):
                total[:, _ints(cols)] += _floats(values, rows)  # a piece names a term once
            return pa.table({"shard": pa.array([shard], pa.int32()), "part": table["part"][:1], "values": pa.array([_f8(total)], pa.binary())})

        def later(table: pa.Table) -> pa.Table:
            total = sum(_floats(v, rows) for v in table["values"])
            return pa.table({"shard": table["shard"][:1], "part": table["part"][:1], "values": pa.array([_f8(total)], pa.binary())})

        schema = "shard int, part int, values binary"
        sums = parts.groupBy("shard", "part").applyInArrow(first, schema)
        while level > 1:
            sums = sums.withColumn("part", F.floor(F.col("part") / self.fan_in).cast("int")).groupBy("shard", "part").applyInArrow(later, schema)
            level = -(-level // self.fan_in)
        return sums.drop("part")


def _scatter(piece: dict, rows: list[np.ndarray]) -> pa.Table:
    """Rows for to_slices: one array (numbers x terms) for each slice of the piece, that of the intercept first."""
    shards, cols = piece["shards"].as_py(), piece["columns"].as_py()
    part = [piece["part"].as_py()] * len(shards)
    return pa.table({"shard": pa.array(shards, pa.int32()), "part": pa.array(part, pa.int32()), "cols": pa.array(cols, pa.binary()),
                     "values": pa.array([_f8(r) for r in rows], pa.binary())})


def _entries(piece: dict) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    n, starts = piece["n"].as_py(), _ints(piece["starts"])
    return n, np.repeat(np.arange(n), np.diff(starts)), _ints(piece["col"]).astype(np.int64), np.frombuffer(piece["tf"].as_buffer(), np.float32)


def _cut(values: np.ndarray, sizes: list[int]) -> list[np.ndarray]:
    """Columns of the piece's list of terms back to its slices; the intercept's slice comes first."""
    return np.split(values, np.cumsum(sizes)[:-1], axis=1) if sizes else []


def _sizes(piece: dict) -> list[int]:
    return [len(c.as_buffer()) // 4 for c in piece["columns"].values][1:]


def _moved(piece: dict, plan: dict, weight: np.ndarray) -> tuple[np.ndarray, ...]:
    """Accepted vectors, history and trial of a piece after ``plan``, and the trial's residuals and loss.

    A vector is two arrays (models x 2 x rows): its numbers of the rows, and its products with them. ``weight`` is by
    model and class.
    """
    models, n = len(weight), piece["n"].as_py()
    held = piece["state"].reshape(models, -1, 2, n) if "state" in piece else np.zeros((models, 2 * HISTORY + 4, 2, n))
    held = held.copy()
    at, slope, s, y = held[:, 0], held[:, 1], held[:, 2:2 + HISTORY], held[:, 2 + HISTORY:2 + 2 * HISTORY]
    new_at, new_slope = held[:, -2], held[:, -1]
    for m in range(models):
        if plan["accept"][m]:
            _remember(s, m, new_at[m] - at[m])
            _remember(y, m, new_slope[m] - slope[m])
            at[m], slope[m] = new_at[m], new_slope[m]
    basis = np.concatenate([s, y, slope[:, None]], axis=1)
    moves = np.asarray(plan["steps"])[:, None] * plan["coefs"]
    trial = at + (moves[:, None, :] @ basis.reshape(models, 2 * HISTORY + 1, 2 * n)).reshape(models, 2, n)
    label = np.frombuffer(piece["label"].as_buffer(), np.float64)
    importance = _floats(piece["train"], models) * weight[:, (label == 1).astype(int)]
    z = trial[:, 1] + np.asarray(plan["free"])[:, None]
    loss = (importance * (np.logaddexp(0, z) - label * z)).sum(axis=1)
    return at, slope, s, y, trial, importance * (0.5 * (1 + np.tanh(z / 2)) - label), loss


def _back(piece: dict, rows: np.ndarray) -> pa.Table:
    """The piece's part of the sum of its rows, each times a number of each model, before the terms' idf."""
    _, row, col, tf = _entries(piece)
    models, sizes = len(rows), _sizes(piece)
    scaled = rows / _floats(piece["norms"], models)
    sums = np.array([np.bincount(col, tf * v[row], sum(sizes)) for v in scaled]).reshape(models, -1)
    return _scatter(piece, [np.zeros((models, 1)), *_cut(sums, sizes)])


class ManyLogistic:
    """Balanced logistic regressions over shared n-gram counts, one for each choice of training rows."""

    def __init__(self, counted: DataFrame, label: str, uses: list[Column], n_terms: int, keep: list[str] | None = None,
                 min_df: int = 2, max_terms: int | None = None, c: float = 1.0, **bounds: int):
        self.shards = Shards(counted, label, uses, n_terms, keep or [label], **bounds)
        self.spark, self.models, self.c, self.min_df, self.max_terms = counted.sparkSession, len(uses), c, min_df, max_terms
        sums = []
        for m, use in enumerate(uses):
            taken = F.coalesce(use, F.lit(False))
            sums += [F.count_if(taken & (F.col(label) == 0)).alias(f"n0_{m}"), F.count_if(taken & (F.col(label) == 1)).alias(f"n1_{m}")]
        found = counted.agg(*sums).first()
        self.counts = np.array([[found[f"n0_{m}"], found[f"n1_{m}"]] for m in range(self.models)], float)
        self.idf = saved(self._idf(), "idf")
        # The lengths of the rows join the pieces once; every step then reads them from one place.
        plain = self.shards.pieces
        self.shards.pieces = saved(plain.join(self._norms(), "piece"), "pieces").repartition(self.shards.tasks, "piece").persist()
        plain.unpersist()

    def _idf(self) -> DataFrame:
        """(shard, values): inverse document frequency of each term over each model's rows, 0 for too rare terms."""
        shards, models, min_df = self.shards, self.models, self.min_df
        total = self.counts.sum(axis=1)[:, None]

        def count(table: pa.Table) -> pa.Table:
            parts = []
            for k in range(table.num_rows):
                piece = {c: table[c][k] for c in table.column_names}
                n, row, col, tf = _entries(piece)
                train = _floats(piece["train"], models)
                sizes = _sizes(piece)
                terms = sum(sizes)
                both = np.array([np.bincount(col, w, terms) for t in train for w in (t[row], t[row] * tf)]).reshape(2 * models, terms)
                parts.append(_scatter(piece, [np.zeros((2 * models, 1)), *_cut(both, sizes)]))
            return pa.concat_tables(parts)

        parts = shards.pieces.groupBy("piece").applyInArrow(
            count, "shard int, part int, cols binary, values binary")
        sums = shards.to_slices(parts, 2 * models)
        if self.max_terms:
            sums = self._capped(saved(sums, "term-sums"))

        def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in range(batch.num_rows):
                    df = _floats(batch.column(1)[k], 2 * models)[0::2]
                    idf = np.where(df >= max(1, min_df), np.log((1.0 + total) / (1.0 + df)) + 1.0, 0.0)
                    if batch.column(0)[k].as_py() == INTERCEPT:
                        idf = np.ones((models, 1))
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1), pa.array([_f8(idf)], pa.binary())], names=["shard", "values"])

        return sums.mapInArrow(weigh, "shard int, values binary")

    def _capped(self, sums: DataFrame) -> DataFrame:
        """sums with the counts of all but the ``max_terms`` most frequent terms of each model set to 0."""
        models, size, min_df = self.models, self.shards.size, self.min_df

        def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in range(batch.num_rows):
                    shard = batch.column(0)[k].as_py()
                    both = _floats(batch.column(1)[k], 2 * models)
                    for m in range(models if shard != INTERCEPT else 0):
                        at = np.flatnonzero(both[2 * m] >= max(1, min_df))
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(at), m, np.int32)), pa.array(at + shard * size), pa.array(both[2 * m + 1][at])],
                            names=["model", "ix", "total"])

        long = sums.mapInArrow(listed, "model int, ix long, total double")
        kept = position_in_group(long, ["model"], [F.col("total").desc(), "ix"], "place").filter(F.col("place") <= self.max_terms)
        shard = F.floor(F.col("ix") / size).cast("int").alias("shard")
        kept = kept.select(shard, "model", F.pmod("ix", F.lit(size)).cast("int").alias("at"))

        def only(left: pa.Table, right: pa.Table) -> pa.Table:
            both = _floats(left["values"][0], 2 * models).copy()
            mask = np.zeros((models, both.shape[1]), bool)
            mask[right["model"].to_numpy(), right["at"].to_numpy()] = True
            both[0::2] *= mask
            return pa.table({"shard": left["shard"], "values": pa.array([_f8(both)], pa.binary())})

        return sums.groupBy("shard").cogroup(kept.groupBy("shard")).applyInArrow(only, "shard int, values binary")

    def _norms(self) -> DataFrame:
        """(piece, norms): length of each row under each model's weights, 1 for rows without terms."""
        def work(piece: dict, terms: list[np.ndarray]) -> pa.Table:
            n, row, col, tf = _entries(piece)
            idf = np.concatenate(terms[1:], axis=1) if len(terms) > 1 else np.zeros((len(terms[0]), 0))
            norms = np.array([np.sqrt(np.bincount(row, (tf * v[col]) ** 2, n)) for v in idf])
            return pa.table({"piece": pa.array([piece["piece"].as_py()], pa.int64()),
                             "norms": pa.array([_f8(np.where(norms > 0, norms, 1.0))], pa.binary())})

        return self.shards.in_pieces(self.shards.to_pieces(self.idf), work, "piece long, norms binary")

    def _times_idf(self, parts: DataFrame, power: int) -> DataFrame:
        """(shard, idf, values): ``parts`` added up, times a power of idf."""
        models = self.models

        def scale(left: pa.Table, right: pa.Table) -> pa.Table:
            idf = _floats(left["values"][0], models)
            total = _floats(right["values"][0], models) if right.num_rows else np.zeros_like(idf)
            return pa.table({"shard": left["shard"], "idf": left["values"], "values": pa.array([_f8(total * idf ** power)], pa.binary())})

        sums = self.shards.to_slices(parts, models)
        return self.idf.groupBy("shard").cogroup(sums.groupBy("shard")).applyInArrow(scale, "shard int, idf binary, values binary")

    def _step(self, state: DataFrame, plan: dict) -> DataFrame:
        """(piece, shard, values): state and report of every piece after one evaluation at the trial that ``plan`` names.

        The report has dot products of history and gradient, squared length of the weights and slope along the step,
        all without the intercepts, then the loss and its slope along the intercept.
        """
        shards, models, c = self.shards, self.models, self.c
        weight = np.where(self.counts > 0, self.counts.sum(axis=1)[:, None] / (2 * np.maximum(self.counts, 1)), 0.0)

        def residuals(piece: dict, _: list[np.ndarray]) -> pa.Table:
            return _back(piece, _moved(piece, plan, weight)[5])

        def close(piece: dict, terms: list[np.ndarray]) -> pa.Table:
            at, slope, s, y, trial, residual, loss = _moved(piece, plan, weight)
            n, row, col, tf = _entries(piece)
            values = np.concatenate(terms, axis=1)[:, 1:]
            products = np.array([np.bincount(row, tf * v[col], n) for v in values]).reshape(models, n) / _floats(piece["norms"], models)
            new = np.stack([residual, products], axis=1) + trial / c
            report = np.zeros((models, REPORT))
            for m in range(models):
                basis = np.concatenate([s[m, 1:], (trial - at)[m:m + 1], y[m, 1:], (new - slope)[m:m + 1], new[m:m + 1]])
                report[m, :-4] = (basis[:, 0] @ basis[:, 1].T).ravel()
            report[:, -4] = (trial[:, 0] * trial[:, 1]).sum(axis=1) / c
            report[:, -3] = (slope[:, 0] * (trial - at)[:, 1]).sum(axis=1)
            report[:, -2], report[:, -1] = loss, residual.sum(axis=1)
            held = np.concatenate([at[:, None], slope[:, None], s, y, trial[:, None], new[:, None]], axis=1)
            return pa.table({"piece": pa.array([piece["piece"].as_py()] * 2, pa.int64()), "shard": pa.array([STATE, SAID], pa.int32()),
                             "values": pa.array([_f8(held), _f8(report)], pa.binary())})

        parts = shards.in_pieces(state, residuals, "shard int, part int, cols binary, values binary")
        products = shards.to_pieces(self._times_idf(parts, 2).select("shard", "values"))
        return saved(shards.in_pieces(products.unionByName(state), close, IN_PIECE), "state")

    def fit(self, tol: float = 1e-3, max_steps: int = 300) -> Fit:
        """Minimise all models to a gradient of length ``tol`` or less; every model stops on its own."""
        models = self.models
        state = self.spark.createDataFrame([], IN_PIECE)
        plan = {"accept": [False] * models, "coefs": np.zeros((models, 2 * HISTORY + 1)), "steps": np.zeros(models), "free": np.zeros(models)}
        free, free_slope, free_s, free_y = np.zeros(models), np.zeros(models), np.zeros((models, HISTORY)), np.zeros((models, HISTORY))
        steps = 0
        dots = value = length = None
        active = np.ones(models, bool)
        while steps < max_steps:
            table = self._step(state, plan)
            state = table.filter(F.col("shard") == STATE)
            steps += 1
            report = _sum_binary(table.filter(F.col("shard") == SAID).select("values"), "values", (models, REPORT))
            new_slope, moved = report[:, -1], plan["free"] - free
            basis = np.concatenate([free_s[:, 1:], moved[:, None], free_y[:, 1:], (new_slope - free_slope)[:, None], new_slope[:, None]], axis=1)
            new_dots = report[:, :-4].reshape(models, 2 * HISTORY + 1, -1)
            new_dots = (new_dots + new_dots.transpose(0, 2, 1)) / 2 + basis[:, :, None] * basis[:, None, :]
            new_value, slope = report[:, -2] + report[:, -4] / 2, report[:, -3] + free_slope * moved
            if value is None:
                accept = np.ones(models, bool)
                value, dots = new_value, new_dots
            else:
                # The smallest decrease asked for is below what rounding of the loss shows near the end.
                accept = active & (new_value <= value + 1e-4 * slope + 1e-10 * np.abs(value))
                value = np.where(accept, new_value, value)
                dots = np.where(accept[:, None, None], new_dots, dots)
            length = np.sqrt(np.maximum(dots[:, -1, -1], 0))
            coefs, trials = plan["coefs"].copy(), np.where(accept, 1.0, plan["steps"] / 2)
            for m in range(models):
                if accept[m]:
                    _remember(free_s, m, moved[m])
                    _remember(free_y, m, new_slope[m] - free_slope[m])
                    free[m], free_slope[m] = plan["free"][m], new_slope[m]
                    coefs[m], scale = _direction(dots[m])
                    trials[m] = scale
            active = (length > tol) & (trials > 1e-12)
            trials = np.where(active, trials, 0.0)
            along = (coefs * np.concatenate([free_s, free_y, free_slope[:, None]], axis=1)).sum(axis=1)
            plan = {"accept": accept.tolist(), "coefs": coefs, "steps": trials, "free": free + trials * along}
            if not active.any():
                break
        weights = self._closed(state, plan["accept"], free)
        return Fit(saved(weights, "weights"), models, self.shards.size, steps, [float(x) for x in length], free)

    def _closed(self, state: DataFrame, accept: list[bool], free: np.ndarray) -> DataFrame:
        """(shard, idf, w): the last accepted weights."""
        models = self.models

        def work(piece: dict, _: list[np.ndarray]) -> pa.Table:
            held = piece["state"].reshape(models, -1, 2, piece["n"].as_py())
            return _back(piece, np.where(np.asarray(accept)[:, None], held[:, -2, 0], held[:, 0, 0]))

        def intercept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                w = [_f8(free) if s == INTERCEPT else v.as_py() for s, v in zip(batch.column(0).to_pylist(), batch.column(2))]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(w, pa.binary())], names=["shard", "idf", "w"])

        parts = self.shards.in_pieces(state, work, "shard int, part int, cols binary, values binary")
        return self._times_idf(parts, 1).mapInArrow(intercept, "shard int, idf binary, w binary")

    def scores(self, fit: Fit) -> DataFrame:
        """The kept columns of every row and ``scores``, the probability of label 1 by each model."""
        models, kept_type = self.models, self.shards.pieces.schema["kept"].dataType.elementType

        def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in range(batch.num_rows):
                    idf, w = (_floats(batch.column(c)[k], models) for c in (1, 2))
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1), pa.array([_f8(idf * w)], pa.binary())], names=["shard", "values"])

        def work(piece: dict, terms: list[np.ndarray]) -> pa.Table:
            n, row, col, tf = _entries(piece)
            norms = _floats(piece["norms"], models)
            values = np.concatenate(terms[1:], axis=1) if len(terms) > 1 else np.zeros((models, 0))
            z = np.array([np.bincount(row, tf * values[m][col], n) / norms[m] + terms[0][m, 0] for m in range(models)])
            probability = 0.5 * (1 + np.tanh(z / 2))
            ends = pa.array(np.arange(n + 1) * models, pa.int32())
            return pa.table({"kept": piece["kept"].values, "scores": pa.ListArray.from_arrays(ends, pa.array(probability.T.ravel()))})

        slices = fit.weights.mapInArrow(product, "shard int, values binary")
        shape = T.StructType([T.StructField("kept", kept_type), T.StructField("scores", T.ArrayType(T.DoubleType()))])
        found = self.shards.in_pieces(self.shards.to_pieces(slices), work, shape)
        return found.select("kept.*", "scores")

    def release(self) -> None:
        self.shards.release()


def _remember(history: np.ndarray, m: int, new: np.ndarray) -> None:
    """Add an entry to the history of a model; the oldest goes."""
    history[m, :-1] = history[m, 1:].copy()
    history[m, -1] = new


def _direction(dots: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights of S, Y and g in the descent direction, by the two loops of L-BFGS on dot products; and the first step."""
    coef = np.zeros(2 * HISTORY + 1)
    coef[-1] = -1.0
    pairs = [k for k in range(HISTORY) if dots[k, HISTORY + k] > 1e-14]
    if not pairs:
        return coef, 1.0 / max(1e-12, float(np.sqrt(dots[-1, -1])))
    alpha = {}
    for k in reversed(pairs):
        alpha[k] = dots[k] @ coef / dots[k, HISTORY + k]
        coef[HISTORY + k] -= alpha[k]
    last = pairs[-1]
    coef *= dots[last, HISTORY + last] / dots[HISTORY + last, HISTORY + last]
    for k in pairs:
        beta = dots[HISTORY + k] @ coef / dots[k, HISTORY + k]
        coef[k] += alpha[k] - beta
    return coef, 1.0


def _sum_binary(df: DataFrame, column: str, shape: tuple[int, ...]) -> np.ndarray:
    """Sum of small arrays, one partial sum for each task."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in batches:
            for value in batch.column(0):
                if len(value.as_buffer()):
                    total += np.frombuffer(value.as_buffer(), np.float64).reshape(shape)
        yield pa.RecordBatch.from_arrays([pa.array([_f8(total)], pa.binary())], names=["total"])

    parts = df.select(column).mapInArrow(add, "total binary").toArrow()
    return sum((np.frombuffer(v.as_buffer(), np.float64).reshape(shape) for v in parts["total"]), np.zeros(shape))
