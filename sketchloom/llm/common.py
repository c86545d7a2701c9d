"""Shared storage and Arrow plumbing of the operators.

Every operator treats a NULL text as empty, ignores columns that it doesn't know, whatever their names, and gives an
empty result of the same schema for an empty table.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text that are worked on at a time; a longer single text is worked on alone.
SLICE = 1 << 20
#: Bytes of text that a task of later passes works on.
TASK_BYTES = 256 << 20


_ROOTS: dict[str, str] = {}


def qualified(spark: SparkSession, path: str) -> str:
    """The path as a URI; without a scheme it is on Spark's default file system, as everywhere in Spark."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    uri = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(p).toString()
    return re.sub(r"^file:/+", "file:///", uri)


def _root(spark: SparkSession) -> str:
    """This application's folder below spark.checkpoint.dir; where that is unset, as in tests, below the warehouse, which is shared too.

    The folder goes when the driver ends.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    name = f"{base.rstrip('/')}/sketchloom/{spark.sparkContext.applicationId}"
    if name not in _ROOTS:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        system.mkdirs(path)
        system.deleteOnExit(path)
        _ROOTS[name] = qualified(spark, name)
    return _ROOTS[name]


def shared_dir(spark: SparkSession, name: str) -> str:
    """The URI of a new folder on shared storage."""
    return f"{_root(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes the rows to shared storage and reads them back: lineage ends there, and lost executors take nothing along."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.__dict__["_stored_at"] = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes what ``stored`` has written, once nothing reads it any more."""
    for t in tables:
        if path := t.__dict__.get("_stored_at"):
            p = t.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(t.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def open_uri(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path, for Python tasks, which don't know Spark's default file system."""
    if ":" not in uri:
        raise ValueError(f"{uri} has no scheme")
    return fs.FileSystem.from_uri(uri)


def tasks(spark: SparkSession, n_bytes: int) -> int:
    """Number of tasks for work on so many bytes: some for each core, and each with up to TASK_BYTES, so that little is done again when one is lost."""
    return max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_bytes // TASK_BYTES))


def whole_ids(df: DataFrame, key: str) -> Column:
    """The id column as long, for operators that order ids or write them as numbers; TypeError unless it holds whole numbers."""
    kind = df.schema[key].dataType
    if not isinstance(kind, T.IntegralType):
        raise TypeError(f"{key} is {kind.simpleString()}: ids must be whole numbers")
    return F.col(f"`{key}`").cast("long")


def fresh(taken: list[str], *names: str) -> list[str]:
    """The names, with underscores before those that ``taken`` has, in whatever case."""
    have, out = {c.lower() for c in taken}, []
    for n in names:
        while n.lower() in have:
            n = "_" + n
        have.add(n.lower())
        out.append(n)
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts end to end, and len + 1 offsets into them. NULL is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "") if column.null_count else column
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if offsets is None or not len(column):
        return np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    off = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def slices(batches: Iterator[pa.RecordBatch], text: int = 1, limit: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of rows whose texts (column number ``text``) have up to ``limit`` bytes, or one row."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        _, off = text_bytes(batch.column(text))
        at = 0
        while at < n:
            end = max(at + 1, int(np.searchsorted(off, off[at] + limit, side="right")) - 1)
            yield batch.slice(at, end - at)
            at = end
