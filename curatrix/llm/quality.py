"""Compression classifier: zstandard dictionaries of good and of bad text, and a calibrated difference of sizes.

A text is compressed in blocks of BLOCK bytes, once with either dictionary. The difference of the two compressed
sizes per byte of text says which vocabulary explains the text better; blocks keep a dictionary at work over the
whole of a long text. Text that repeats itself shrinks to little with either dictionary, and so does the
difference; the calibration therefore also sees the size that is left per byte. A logistic curve of both, fitted on
labelled texts that the dictionaries have not seen, gives the probability of label 1.

The fit takes at most `per_class` labelled texts of each class, chosen by hash of the id, and of these at most
FIT_BYTES of text for a dictionary and FIT_TOTAL in all; texts above FIT_TEXT bytes are not fitted on. Scoring takes
every whole text.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from curatrix.llm.common import text_bytes, wide

BLOCK = 1024
DICTIONARY = 16 << 10
FIT_BYTES = 2 << 20
FIT_TEXT = 64 << 10
FIT_TOTAL = 32 << 20  # bytes of text of a class that reach the driver
PER_CLASS = 4000


@dataclass(frozen=True)
class CompressionModel:
    """Two dictionaries (bad, good) and the curve: P(good) = 1 / (1 + exp(-(curve . (1, difference, size))))."""

    dictionaries: tuple[bytes, bytes]
    curve: tuple[float, float, float]
    prior: float  # score of a text without a byte

    def compressors(self) -> list:
        import zstandard as zstd

        made = []
        for raw in self.dictionaries:
            trained = zstd.ZstdCompressionDict(raw)
            trained.precompute_compress(level=1)
            made.append(zstd.ZstdCompressor(level=1, dict_data=trained, write_content_size=False,
                                            write_checksum=False, write_dict_id=False))
        return made

    def score(self, text: bytes, compressors: list) -> float:
        if not text:
            return self.prior
        difference, size = measure(text, compressors)
        z = self.curve[0] + self.curve[1] * difference + self.curve[2] * size
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, z))))


def measure(text: bytes, compressors: list) -> tuple[float, float]:
    """Per byte: size with the bad dictionary less that with the good one (higher is better), and the latter."""
    bad, good = (c.compress for c in compressors)
    with_bad = with_good = 0
    for at in range(0, len(text), BLOCK):
        block = text[at:at + BLOCK]
        with_bad += len(bad(block))
        with_good += len(good(block))
    return (with_bad - with_good) / len(text), with_good / len(text)


def blocks_of(text: bytes) -> list[bytes]:
    return [text[at:at + BLOCK] for at in range(0, len(text), BLOCK)]


def dictionary_of(blocks: list[bytes]) -> bytes:
    """A trained dictionary; where the blocks are too few or too small to train one, their own bytes, the last ones."""
    import zstandard as zstd

    try:
        return zstd.train_dictionary(DICTIONARY, blocks, k=16, d=8, level=1).as_bytes()
    except zstd.ZstdError:
        return b"".join(blocks)[-DICTIONARY:]


def train(bad: list[bytes], good: list[bytes], prior: float) -> CompressionModel:
    """Half of a class makes its dictionary, the other half fits the curve: texts in turn, or the blocks of one text.

    A class of one block serves both. The classes were drawn apart, so weights give them back their shares.
    """
    made, left = [], []
    for texts in (bad, good):
        texts = [t for t in texts if t]
        parts = texts if len(texts) > 1 else blocks_of(texts[0])
        blocks, size = [], 0
        for part in parts[::2]:
            if size >= FIT_BYTES:
                break
            blocks += blocks_of(part)
            size += len(part)
        made.append(dictionary_of(blocks))
        left.append(parts[1::2] or parts)
    compressors = CompressionModel((made[0], made[1]), (0.0, 0.0, 0.0), prior).compressors()
    x = [[measure(t, compressors) for t in texts] for texts in left]
    n = len(x[0]) + len(x[1])
    weight = [(1 - prior) * n / len(x[0])] * len(x[0]) + [prior * n / len(x[1])] * len(x[1])
    curve = calibrate(x[0] + x[1], [0.0] * len(x[0]) + [1.0] * len(x[1]), weight)
    return CompressionModel((made[0], made[1]), curve, prior)


def calibrate(x: list[tuple[float, float]], y: list[float], weight: list[float]) -> tuple[float, float, float]:
    """Weighted logistic regression by Newton's method with a small ridge on the standardised slopes."""
    import numpy as np

    v, t, w = np.array(x), np.array(y), np.array(weight)
    mean = np.average(v, axis=0, weights=w)
    scale = np.maximum(1e-9, np.sqrt(np.average((v - mean) ** 2, axis=0, weights=w)))
    design = np.c_[np.ones(len(v)), (v - mean) / scale]
    beta, ridge = np.zeros(3), np.array([1e-6, 1.0, 1.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        step = np.linalg.solve((design * (w * p * (1 - p))[:, None]).T @ design + np.diag(ridge),
                               design.T @ (w * (p - t)) + ridge * beta)
        beta -= step
        if np.abs(step).max() < 1e-9:
            break
    slopes = beta[1:] / scale
    return float(beta[0] - slopes @ mean), float(slopes[0]), float(slopes[1])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
        per_class: int = PER_CLASS) -> CompressionModel:
    """Fit on rows of labels (those held out must not be in it). Rows with null id, label or text are left out.

    One text of either class is enough. Without a text of a class there is nothing to tell apart: every score is then
    the share of label 1 among labels, or one half if there are none.
    """
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where(
        "id is not null and label in (0, 1)")
    counts = {r[0]: r[1] for r in known.groupBy("label").count().collect()}
    bad, good = counts.get(0, 0), counts.get(1, 0)
    prior = good / (bad + good) if bad + good else 0.5
    order = F.xxhash64("id", F.lit("quality-fit"))
    texts: dict[int, list[bytes]] = {}
    for label in (0, 1):
        chosen = F.broadcast(known.where(F.col("label") == label).orderBy(order, "id").limit(per_class).select("id"))
        size = F.octet_length("text")
        few = (docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where((size > 0) & (size <= FIT_TEXT))
               .join(chosen, "id", "left_semi").orderBy(order, "id", "text").limit(per_class))
        # At most per_class rows are left, so one window over all of them is small.
        upto = F.sum(size).over(Window.orderBy(order, "id", "text").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        texts[label] = [r["text"].encode() for r in few.withColumn("upto", upto).where(F.col("upto") <= FIT_TOTAL).collect()]
    if not texts[0] or not texts[1]:
        return CompressionModel((b"", b""), (0.0, 0.0, 0.0), prior)
    return train(texts[0], texts[1], prior)


def score(docs: DataFrame, model: CompressionModel, text_col: str = "text", into: str = "score") -> DataFrame:
    """docs with the score of every whole text; null texts are empty texts and get the share of label 1.

    A column of docs that is named like ``into`` is replaced.
    """
    kept = [c for c in docs.columns if c != into]
    docs = docs.select(*kept, F.col(text_col).alias("__text"))
    kept_fields = docs.schema.fields[:-1]
    broadcast = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        model = broadcast.value
        made = model.compressors() if model.dictionaries[0] else None
        for batch in batches:
            texts = text_bytes(batch.column(batch.num_columns - 1))
            scores = [model.score(t, made) if made else model.prior for t in texts]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(scores, pa.float64())], names=[*kept, into])

    return wide(docs).mapInArrow(run, T.StructType([*kept_fields, T.StructField(into, T.DoubleType())]))


def held_out(id_col: str = "doc_id") -> Column:
    """Rows no label may be learnt from: crc32 of the id as text is divisible by five. A null id counts as ''."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """docs without the rows scored below the threshold; columns unchanged."""
    model = fit(docs, labels.where(~held_out()))
    return score(docs, model, into="__score").where(F.col("__score") >= threshold).drop("__score")
