"""Shared helpers: durable intermediate tables and the keys by which rows find their decisions again."""

from __future__ import annotations

import ctypes
import inspect
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import cache, wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from centra.functions.storage import checkpointed, shared_dir

__all__ = ["WORD", "checkpointed", "delete", "durable", "lean", "recorded", "row_sign", "unused"]

#: Numbers of glibc's mallopt() settings, and what is set: arrays from 4 MB on are handed back as soon as they are freed.
_TRIM_THRESHOLD, _MMAP_THRESHOLD, _HELD = -1, -3, 4 << 20


@cache
def _libc():
    """The C library, told to hand freed memory back; None where it has no such settings."""
    try:
        lib = ctypes.CDLL("libc.so.6")
        lib.mallopt(_MMAP_THRESHOLD, _HELD)
        lib.mallopt(_TRIM_THRESHOLD, _HELD)
        pa.set_memory_pool(pa.system_memory_pool())
        return lib
    except (OSError, AttributeError):
        return None


def lean(run: Callable) -> Callable:
    """For functions that Arrow batches or groups go through: Python workers live on from stage to stage, and what one
    has freed should not count against the next."""
    if inspect.isgeneratorfunction(run):

        @wraps(run)
        def wrapped(batches):
            _libc()
            yield from run(batches)
            _trim()

        return wrapped

    def whole(*args):
        _libc()
        out = run(*args)
        _trim()
        return out

    # Spark counts the arguments of functions on groups.
    return (lambda key, rows: whole(key, rows)) if len(inspect.signature(run).parameters) == 2 else (lambda key, own, found: whole(key, own, found))


def _trim() -> None:
    if lib := _libc():
        lib.malloc_trim(0)


WORD = r"[^\x20\x09-\x0D]+"


_scope: ContextVar[list[str] | None] = ContextVar("tables", default=None)


@contextmanager
def recorded() -> Iterator[list[str]]:
    """A list of the paths that durable() writes meanwhile, apart from those of other runs in the session."""
    mine: list[str] = []
    before = _scope.set(mine)
    try:
        yield mine
    finally:
        _scope.reset(before)


def delete(spark: SparkSession, paths: list[str]) -> None:
    """Delete tables that nothing reads any more."""
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def durable(df: DataFrame, label: str) -> DataFrame:
    """Write df once to the shared folder and return the reread table: lineage is cut, lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/tables/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    if (mine := _scope.get()) is not None:
        mine.append(path)
    return spark.read.schema(df.schema).parquet(path)


def row_sign() -> Column:
    """A hash of doc_id and text, by which rows find their decisions again."""
    return F.xxhash64(F.col("doc_id").isNull(), "doc_id", F.col("text").isNull(), "text")


def unused(columns: list[str], *names: str) -> list[str]:
    """names, each with underscores before it until no column is called so, in any case."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out
