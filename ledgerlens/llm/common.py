"""What the operators of this subpackage share: scratch tables, batch bounds."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Iterator
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..staging import delete, new_path

#: Most rows and bytes that one Arrow batch hands to a Python worker.
BATCH_ROWS = 256
BATCH_BYTES = 16 << 20
ROWS_KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"
BYTES_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def bounded_batches(spark: SparkSession) -> None:
    """Bound what a Python worker holds at once; long texts make large batches.

    The session's two limits go down to these and stay, as frames that an
    operator returns run later; lower limits are left alone.
    """
    if not 0 < int(spark.conf.get(ROWS_KEY)) <= BATCH_ROWS:
        spark.conf.set(ROWS_KEY, str(BATCH_ROWS))
    spark.conf.set(BYTES_KEY, str(BATCH_BYTES))


@contextlib.contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A session setting for what runs inside."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


#: The scratch tables of the run that is going on, if it has a list of its own.
_run: ContextVar[list[str] | None] = ContextVar("scratch tables", default=None)


@contextlib.contextmanager
def scratch_run(spark: SparkSession) -> Iterator[None]:
    """Tables that ``written`` makes inside are deleted at the end.

    Only for what is complete by then.  Tables made elsewhere, before or at the
    same time, stay until the driver ends, as frames may still read them.
    """
    made: list[str] = []
    token = _run.set(made)
    try:
        yield
    finally:
        _run.reset(token)
        for path in made:
            delete(spark, path)


def new_scratch(spark: SparkSession, name: str) -> str:
    """The path of a scratch table or folder, which goes when the run ends."""
    path = new_path(spark, name)
    if (made := _run.get()) is not None:
        made.append(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a table in the shared folder and read back.

    This cuts the lineage: a lost executor costs no recomputation of what lies
    before, and later readers share one computation.
    """
    spark = df.sparkSession
    path = new_scratch(spark, name)
    # the table replaces the shuffles that made it, so their files can go at once
    with setting(spark, CLEANUP, "true"):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Most rows of a few numbers that a join sends to every executor (some 50 MB).
BROADCAST_ROWS = 1 << 20


def small(table: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """A table of a few numbers a row, to be broadcast if it is small enough.

    It has to be a written one, as it is counted; beyond the limit the join
    shuffles.
    """
    return F.broadcast(table) if table.count() <= limit else table


def given_back(result):
    """``result``, after the process has returned its free memory to the system.

    For the end of a task's call: idle Python workers keep it otherwise.
    """
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL(None).malloc_trim(0)
    return result


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of frames that are out of use."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def hashed_sample(df: DataFrame, size: int, total: int | None = None) -> DataFrame:
    """At most ``size`` distinct rows, the first by hash of all columns.

    A cut on the hash, from the number of rows, leaves about twice that many
    before anything is sorted or gathered, however large the table is.
    """
    total = df.count() if total is None else total
    key = F.xxhash64(F.lit("sample"), *[F.col(f"`{c}`") for c in df.columns])
    if total > 2 * size:
        df = df.where(F.pmod(key, F.lit(1 << 40)) < int(2 * size / total * (1 << 40)))
    return df.distinct().orderBy(key, *df.columns).limit(size)


def text_bytes(df: DataFrame, text_col: str) -> int:
    """UTF-8 bytes of all texts; one narrow aggregate."""
    return df.agg(F.sum(F.octet_length(text_col)).alias("n")).first()["n"] or 0


def blank_to_empty(column):
    return F.coalesce(column, F.lit(""))
