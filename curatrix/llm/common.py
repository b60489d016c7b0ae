"""Small helpers shared by the operators: shared scratch tables, row locators, joins on hot keys."""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curatrix.lineage import checkpoint_dir, spread

FILE, ROW = "__file", "__row"
LOCATOR = [FILE, ROW]

SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))  # A-Z only, safe on UTF-8 bytes

A_TO_Z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder that the cluster names."""
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def save(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and go on from the files: lineage is cut, columns can still be pruned."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _is_scan(docs: DataFrame) -> bool:
    """Whether the plan is one file scan under projections and filters, so that no scanned row shows up twice."""
    plan = docs._jdf.queryExecution().analyzed()
    while plan.children().size() == 1 and plan.nodeName() in ("Project", "Filter", "SubqueryAlias", "View"):
        plan = plan.children().head()
    return plan.nodeName() == "LogicalRelation"


def located(docs: DataFrame) -> DataFrame:
    """docs with the file and row number of each row. A frame that is not a plain scan is written first: rows that
    joins or generators multiply would share a locator."""
    def add(df: DataFrame) -> DataFrame:
        return df.withColumns({FILE: F.col("_metadata.file_path"), ROW: F.col("_metadata.row_index")})
    try:
        if _is_scan(docs):
            return add(docs)
    except AnalysisException:
        pass
    return add(save(docs, "located"))


def drop_rows(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """docs (as given to located) without the rows whose locators are in dropped."""
    return docs.join(dropped.select(*LOCATOR), LOCATOR, "left_anti").drop(*LOCATOR)


def wide(df: DataFrame) -> DataFrame:
    """One task per core for CPU-heavy row work on small inputs; large inputs keep their splits."""
    return spread(df)


def lookup(left: DataFrame, right: DataFrame, key: str, size: str, share: int = 200) -> DataFrame:
    """Inner join of left with right, which has one row per key and in `size` the key's rows on the left.

    At most `share` keys can hold more than 1/share of all rows, so these few are broadcast and
    their rows stay where they are; all other keys are joined through a shuffle.
    """
    total = right.agg(F.sum(size)).first()[0] or 0
    bound = max(1, total // share)
    hot = F.broadcast(right.where(F.col(size) > bound))
    cold = right.where(F.col(size) <= bound)
    return left.join(hot, key).unionByName(left.join(hot.select(key), key, "left_anti").join(cold, key))


def text_bytes(column) -> Iterable[bytes]:
    """The UTF-8 bytes of an Arrow string column, null as empty."""
    import pyarrow as pa

    for value in column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()):
        yield value.as_py() or b""
