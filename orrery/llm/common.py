"""Shared folders, tables between steps, and small helpers for the operators of this subpackage."""

from __future__ import annotations

import atexit
import ctypes
import gc
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.sources.shared import shared_dir

#: A word of the contracts: a run of characters other than the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Tables written by materialize() and not deleted yet.
_TABLES: dict[str, SparkSession] = {}


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: the lineage ends at files that outlive any executor. They are
    deleted by discard(), by released(), or when the program ends."""
    path = shared_dir(df.sparkSession, name)
    _TABLES[path] = df.sparkSession
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._table_path = path
    return out


def _delete(path: str) -> None:
    spark = _TABLES.pop(path, None)
    with suppress(Exception):  # the session may have ended; what is left over does no harm
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def scratch(spark: SparkSession, name: str) -> str:
    """A new shared folder for files that tasks write themselves. It is deleted as tables are."""
    path = shared_dir(spark, name)
    _TABLES[path] = spark
    return path


def discard(*tables: DataFrame | str) -> None:
    """Delete materialized tables, or folders from scratch(), that nothing reads any more."""
    for x in tables:
        _delete(x if isinstance(x, str) else x._table_path)


@contextmanager
def released() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Delete at the end whatever was materialized inside, but for the tables that the given function was called on."""
    before, kept = set(_TABLES), set()

    def keep(df: DataFrame) -> DataFrame:
        kept.add(df._table_path)
        return df

    try:
        yield keep
    finally:
        for path in [x for x in _TABLES if x not in before and x not in kept]:
            _delete(path)


@atexit.register
def _delete_all() -> None:
    for path in list(_TABLES):
        _delete(path)


def filesystem(uri: str):
    """(pyarrow file system, path in it) of a shared URI: file, hdfs, s3 or gs."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def partitions(df: DataFrame, rows: int, each: int) -> int:
    """So many partitions that each has `each` rows, and no fewer than the session's shuffle partitions."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // each))


#: Bytes of a batch of rows that Spark sends to a Python worker, or one longer row.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """From now on the session sends rows to Python workers in batches of few bytes: texts differ a thousandfold in length,
    so that a number of rows bounds nothing."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


#: What Python workers remember between tasks, by operator: how to forget it.
_MEMORIES: dict[str, Callable[[], None]] = {}


def memory_of(operator: str, forget: Callable[[], None]) -> None:
    _MEMORIES[operator] = forget


_LAST = [""]
#: Of the C library: the setting for the size from which memory is mapped apart, and that size.
_MAPPED_FROM, _MAPPED_SIZE = -3, 1 << 19


def enter(operator: str) -> None:
    """A task of an operator begins: the worker, which Spark uses again, forgets what other operators remember and gives
    memory that is free back to the system. Large arrays are mapped apart, so that they go back as soon as they are
    freed and leave no holes that the worker keeps."""
    for name, forget in _MEMORIES.items():
        if name != operator:
            forget()
    if _LAST[0] != operator:
        library = ctypes.CDLL(None)
        with suppress(AttributeError):  # where the C library has no such functions
            if not _LAST[0]:
                library.mallopt(_MAPPED_FROM, _MAPPED_SIZE)
            gc.collect()
            pa.default_memory_pool().release_unused()
            library.malloc_trim(0)
        _LAST[0] = operator
