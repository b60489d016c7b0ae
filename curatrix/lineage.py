"""Materialisation that survives lost executors: reliable checkpoints in shared storage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession

SMALL_PER_CORE = 32 << 20  # bytes
JOBS_AT_ONCE = 4
ROW_GROUPS = {"parquet.block.size": str(32 << 20), "parquet.page.size.row.check.min": "1"}


def checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; a private one only in local mode, where none is named."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not sc.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="curatrix-ckpt-")
    sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and go on from the files; unlike a checkpoint, columns can still be pruned.

    Rows may be blocks of megabytes: sizes are looked at from the first row on, so a writer holds one row group.
    """
    path = shared_path(df.sparkSession, name)
    df.write.options(**ROW_GROUPS).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write df to the checkpoint folder and continue from the written copy."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def side_by_side(job: Callable, items: Iterable) -> list:
    """Results of a driver-side job per item, in order; a few jobs share the cluster at a time."""
    with ThreadPoolExecutor(JOBS_AT_ONCE) as pool:
        return list(pool.map(job, items))


def source_bytes(df: DataFrame) -> int:
    """Estimated size of the tables the plan reads; nothing is run."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))


def spread(df: DataFrame) -> DataFrame:
    """Give CPU-heavy row work one task per core where the input is too small to have as many splits.

    Large inputs have enough splits already and are left alone, so nothing big is shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if source_bytes(df) < cores * SMALL_PER_CORE else df
