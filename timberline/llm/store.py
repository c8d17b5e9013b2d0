"""Tables that an operator writes midway, in the folder that all executors share."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, with its file system. Where none is named, a local session
    (tests) gets a temporary one; a cluster, whose machines don't share such a folder, gets an error."""
    there = spark.conf.get("spark.checkpoint.dir", None)
    if not there:
        context = spark.sparkContext
        there = context.getCheckpointDir()
        if not there:
            if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
                raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
            context.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='timberline-')}")
            there = context.getCheckpointDir()
    where = spark._jvm.org.apache.hadoop.fs.Path(there)
    whole = where.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(where).toString()
    return re.sub("^file:/+", "file:///", whole).rstrip("/")


#: Folders that this process has made.
_MADE: list[str] = []


def new_path(spark: SparkSession, what: str) -> str:
    _MADE.append(f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}")
    return _MADE[-1]


def clear(spark: SparkSession) -> None:
    """Removes the tables and shards of this process; results that read them can't be used any more."""
    for path in _MADE:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    _MADE.clear()


def staged(df: DataFrame, what: str) -> DataFrame:
    """``df`` written as a table and read again: computed once, whatever executors are lost later."""
    spark = df.sparkSession
    path = new_path(spark, what)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Removes tables of :func:`staged` that only later staged tables have been made from: nothing reads them again."""
    for table in tables:
        path, spark = table.staged_at, table.sparkSession
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        _MADE.remove(path)


def bucket_count(df: DataFrame, least: int = 2048) -> int:
    """How many groups to deal blocks to: in proportion to the input's partitions, so that a group's share of
    the input stays the same at every size."""
    want = min(1 << 30, max(least, 16 * df.rdd.getNumPartitions()))
    return 1 << (want - 1).bit_length()


def trim() -> None:
    """Gives memory that is free back to the system: Python workers stay for later stages."""
    pa.default_memory_pool().release_unused()
    free = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if free:
        free(0)


def released(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``work`` for mapInArrow, with its memory given back at the end of each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(batches)
        finally:
            trim()

    return run


def widened(schema: T.StructType, ddl: str) -> T.StructType:
    """``schema`` with more fields; the one given stays as it is."""
    return T.StructType([*schema.fields, *T.StructType.fromDDL(ddl).fields])
