"""Sinks: CSV, metric JSON and fitted models."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import PySparkException
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from py4j.protocol import Py4JJavaError

from curatrix.operators.models import KmerModel, score


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_metrics(df: DataFrame, path: str) -> None:
    """One JSON object per row with the keys in sorted order."""
    keys = F.struct(*[F.col(c) for c in sorted(df.columns)])
    df.select(F.to_json(keys, {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)


def load_model(rows: DataFrame, path: str):
    """A saved n-gram model or pipeline that can score five rows; None if there is none."""
    loaders = (lambda: KmerModel.load(rows.sparkSession, path), lambda: PipelineModel.load(path))
    for load in loaders:
        try:
            model = load()
            score(rows.limit(5), model).select("score").collect()
            return model
        except (Py4JJavaError, PySparkException, ValueError):
            continue
    return None


def save_model(model, path: str) -> None:
    model.save(path) if isinstance(model, KmerModel) else model.write().overwrite().save(path)


def load_or_fit(path: str, rows: DataFrame, fit: Callable[[DataFrame], object]) -> tuple[object, bool]:
    """The saved model, else a new fit on the rows; (model, was loaded)."""
    model = load_model(rows, path)
    if model is not None:
        return model, True
    model = fit(rows)
    save_model(model, path)
    return model, False
