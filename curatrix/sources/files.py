"""Files that Spark has no reader for, as Python data sources: row-aligned binary matrices and paired CSV file sets.

Both plan from listings and file heads only; bodies are read by the tasks, in batches. Paths are local or shared
folders, or addresses that Arrow's file systems reach (file, hdfs, s3, gs).
"""

from __future__ import annotations

import ast
import csv
import gzip
import io
import json
import posixpath
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as afs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from curatrix.lineage import cut_lineage

MAGIC = b"\x93NUMPY"
PARTITION_BYTES = 64 << 20
BATCH_BYTES = 4 << 20
BATCH_ROWS = 10_000


def open_fs(path: str) -> tuple[afs.FileSystem, str]:
    """Arrow's file system of a path or address, and the path in it."""
    if "://" in path or path.startswith("file:"):
        if path.startswith("file:") and not path.startswith("file://"):
            path = "file://" + path[5:]
        return afs.FileSystem.from_uri(path)
    return afs.LocalFileSystem(), path


def list_files(path: str) -> list[str]:
    """The file itself, or all files below a folder in order of their names; hidden ones are left out."""
    system, inner = open_fs(path)
    info = system.get_file_info(inner)
    if info.type == afs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.is_file:
        return [path]
    found = [f.path for f in system.get_file_info(afs.FileSelector(inner, recursive=True)) if f.is_file]
    prefix = path[:len(path) - len(inner)] if path.endswith(inner) else ""
    return sorted(prefix + f for f in found if not posixpath.basename(f).startswith(("_", ".")))


# Binary matrices -----------------------------------------------------------------------------------------------------

def matrix_head(kind: np.dtype, rows: int, width: int) -> bytes:
    """Header of a version 1 matrix file in row order, padded to 64 bytes."""
    text = repr({"descr": np.dtype(kind).str, "fortran_order": False, "shape": (rows, width)})
    size = -(-(len(MAGIC) + 4 + len(text) + 1) // 64) * 64
    return MAGIC + b"\x01\x00" + struct.pack("<H", size - len(MAGIC) - 4) + text.ljust(size - len(MAGIC) - 5).encode() + b"\n"


@dataclass
class Head:
    offset: int
    kind: np.dtype
    rows: int
    width: int

    @staticmethod
    def read(path: str) -> Head:
        """The header of one matrix file, held against the size of the file."""
        system, inner = open_fs(path)
        with system.open_input_file(inner) as file:
            start = file.read(12)
            if start[:6] != MAGIC:
                raise ValueError(f"{path} is not a binary matrix")
            long = start[6] > 1
            size = struct.unpack("<I", start[8:12])[0] if long else struct.unpack("<H", start[8:10])[0]
            offset = (12 if long else 10) + size
            file.seek(12 if long else 10)
            said = ast.literal_eval(file.read(size).decode("latin1"))
            whole = file.size()
        shape, kind = said["shape"], np.dtype(said["descr"])
        if said["fortran_order"] or len(shape) != 2 or kind.kind not in "fiu":
            raise ValueError(f"{path} holds no row-ordered matrix of numbers: {said}")
        if whole != offset + shape[0] * shape[1] * kind.itemsize:
            raise ValueError(f"{path} has {whole} bytes, its header says {said}")
        return Head(offset, kind, *shape)


@dataclass
class Rows(InputPartition):
    """A run of rows of one file; ``first`` is the number of its first row in the whole matrix."""

    path: str
    first: int
    offset: int
    rows: int
    width: int
    kind: str

    def __init__(self, path: str, first: int, offset: int, rows: int, width: int, kind: str):
        self.path, self.first, self.offset, self.rows, self.width, self.kind = path, first, offset, rows, width, kind


class MatrixSource(DataSource):
    """``row`` (from 0, over all files in order of their names) and ``vector``; partitions are byte ranges."""

    @classmethod
    def name(cls) -> str:
        return "matrix"

    def schema(self) -> str:
        return "row long, vector array<double>"

    def reader(self, schema) -> DataSourceReader:
        return MatrixReader(self.options["path"], int(self.options.get("partitionBytes", PARTITION_BYTES)))


class MatrixReader(DataSourceReader):
    def __init__(self, path: str, size: int):
        self.path, self.size = path, size

    def partitions(self) -> list[InputPartition]:
        parts, first, width = [], 0, None
        for path in list_files(self.path):
            head = Head.read(path)
            if head.rows and width not in (None, head.width):
                raise ValueError(f"{path} has rows of {head.width} numbers, earlier files of {width}")
            width = head.width if head.rows else width
            line = max(1, head.width * head.kind.itemsize)
            step = max(1, self.size // line)
            for at in range(0, head.rows, step):
                parts.append(Rows(path, first + at, head.offset + at * line, min(step, head.rows - at), head.width, head.kind.str))
            first += head.rows
        return parts or [Rows("", 0, 0, 0, 0, "<f4")]

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        if not partition.rows:
            return
        kind = np.dtype(partition.kind)
        line = partition.width * kind.itemsize
        step = max(1, BATCH_BYTES // max(1, line))
        system, inner = open_fs(partition.path)
        with system.open_input_file(inner) as file:
            file.seek(partition.offset)
            for at in range(0, partition.rows, step):
                rows = min(step, partition.rows - at)
                data = file.read(rows * line)
                if len(data) != rows * line:
                    raise ValueError(f"{partition.path} ends early")
                values = np.frombuffer(data, kind).astype(np.float64)
                ends = pa.array(np.arange(rows + 1) * partition.width, pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(rows) + partition.first + at), pa.ListArray.from_arrays(ends, pa.array(values))],
                                                 names=["row", "vector"])


def read_matrix(spark: SparkSession, path: str, partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    """(row, vector) of a matrix file, or of a folder of them taken one after another."""
    spark.dataSource.register(MatrixSource)
    return spark.read.format("matrix").option("path", path).option("partitionBytes", partition_bytes).load()


def write_matrix(df: DataFrame, order: list[Column | str], vector: str, path: str, kind: str = "<f4") -> int:
    """The vectors of df in the given order as matrix files in a folder; the number of rows.

    One file for each range of the order. Headers need the number of rows, so these are counted first; a task writes
    under a name of its own and moves the file once it is whole. A null vector or another length is an error.
    """
    spark = df.sparkSession
    rows = cut_lineage(df.orderBy(*order).select(F.col(vector).cast("array<double>").alias("v")).withColumn("part", F.spark_partition_id()))
    counts = {r["part"]: (r["n"], r["least"], r["most"], r["lost"]) for r in rows.groupBy("part").agg(
        F.count("*").alias("n"), F.min(F.size("v")).alias("least"), F.max(F.size("v")).alias("most"),
        F.count_if(F.col("v").isNull() | F.exists("v", lambda x: x.isNull())).alias("lost")).collect()}  # one row per part
    widths = {w for _, a, b, _ in counts.values() for w in (a, b)}
    if len(widths) > 1 or any(lost for *_, lost in counts.values()):
        raise ValueError("the rows do not make a matrix: null values or several lengths")
    width = widths.pop() if widths else 0
    sizes = {part: n for part, (n, *_) in counts.items()}

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        system, inner = open_fs(path)
        system.create_dir(inner, recursive=True)
        file = part = None
        temporary = f"{inner}/_{TaskContext.get().taskAttemptId()}"
        for batch in batches:
            if not batch.num_rows:
                continue
            if file is None:
                part = batch.column(1)[0].as_py()
                file = system.open_output_stream(temporary)
                file.write(matrix_head(np.dtype(kind), sizes[part], width))
            file.write(batch.column(0).flatten().to_numpy(zero_copy_only=False).astype(kind).tobytes())
        if file is not None:
            file.close()
            system.move(temporary, f"{inner}/part-{part:08d}.npy")
            yield pa.RecordBatch.from_arrays([pa.array([sizes[part]], pa.int64())], names=["rows"])

    written = rows.select("v", "part").mapInArrow(write, "rows long").agg(F.sum("rows")).first()[0]
    return written or 0


# Paired CSV file sets ------------------------------------------------------------------------------------------------

@dataclass
class OneFile(InputPartition):
    path: str

    def __init__(self, path: str):
        self.path = path


class PairedSource(DataSource):
    """Two columns of CSV files, gzip or plain, whose header sits behind a few other lines."""

    @classmethod
    def name(cls) -> str:
        return "paired_csv"

    def schema(self) -> str:
        return "heavy_raw string, light_raw string, source_file string, line_no long"

    def reader(self, schema) -> DataSourceReader:
        return PairedReader(*(json.loads(self.options[o]) for o in ("paths", "skips", "heavy", "light")))


class PairedReader(DataSourceReader):
    def __init__(self, paths: list[str], skips: list[int], heavy: list[str], light: list[str]):
        self.paths, self.skips, self.heavy, self.light = paths, sorted(skips), heavy, light

    def partitions(self) -> list[InputPartition]:
        return [OneFile(f) for f in dict.fromkeys(f for p in self.paths for f in list_files(p))] or [OneFile("")]

    def _spots(self, cells: list[str]) -> tuple[int, int] | None:
        names = [c.strip().strip('"').strip().lower() for c in cells]
        found = [next((names.index(c.strip().lower()) for c in wanted if c.strip().lower() in names), None) for wanted in (self.heavy, self.light)]
        return None if None in found else (found[0], found[1])

    def read(self, partition: OneFile) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        csv.field_size_limit(1 << 30)
        system, inner = open_fs(partition.path)
        names = [n.split()[0] for n in PairedSource.schema(self).split(", ")]
        with system.open_input_stream(inner, compression=None) as raw:
            plain = gzip.GzipFile(fileobj=raw) if inner.endswith(".gz") else raw
            text = io.TextIOWrapper(plain, encoding="utf-8", errors="replace", newline="")
            spots, head = None, 0
            for head in range(1, self.skips[-1] + 2):  # the lines that may be the header
                line = text.readline()
                if not line:
                    return
                if head - 1 in self.skips and (spots := self._spots(cells := next(csv.reader([line]), []))):
                    break
            if spots is None:
                return
            width, rows = len(cells), []
            reader = csv.reader(text)
            before = 0
            for record in reader:
                line_no, before = head + before + 1, reader.line_num
                if not record or len(record) > width:
                    continue
                rows.append([record[s] if s < len(record) else "" for s in spots] + [posixpath.basename(inner), line_no])
                if len(rows) == BATCH_ROWS:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=names)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=names)


def scan_pairs(spark: SparkSession, paths: list[str], skips: tuple[int, ...], heavy: list[str], light: list[str]) -> DataFrame:
    """(heavy_raw, light_raw, source_file, line_no): one pass over each file, which finds the header on the way."""
    spark.dataSource.register(PairedSource)
    reader = spark.read.format("paired_csv")
    for name, value in (("paths", paths), ("skips", list(skips)), ("heavy", heavy), ("light", light)):
        reader = reader.option(name, json.dumps(value))
    return reader.load()
