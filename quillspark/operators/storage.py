"""Intermediate tables that must not change when they are read twice."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which all executors share; a local session without one gets a folder of its own."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    at = f"file://{tempfile.gettempdir()}/quillspark-{spark.sparkContext.applicationId}"
    spark.conf.set("spark.checkpoint.dir", at)
    return at


def _own_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/tables-{spark.sparkContext.applicationId}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read back.

    This cuts the lineage (a lost executor costs no recomputation beyond the
    table) and fixes row identity for the steps after it. The table stays until drop_written().
    """
    path = f"{_own_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    # snappy's buffers outside the heap wait for a garbage collection
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_written(spark: SparkSession) -> bool:
    """Delete all tables that this session has written; results that still read them can't be read any more."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_own_folder(spark))
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: Rows of ids and numbers that a broadcast may carry, some 50 MB.
BROADCAST_ROWS = 1_000_000


def small(df: DataFrame) -> DataFrame:
    """df, to be broadcast if its rows, which are counted, are few; df should be cheap to read twice."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


#: Bounds of an Arrow batch, where the session has Spark's own: whole texts and sets of shingles are long rows.
_BOUNDS = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "1000"), "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "8388608b")}


def bounded_batches(spark: SparkSession) -> None:
    """Let batches of rows with whole texts take some MB, not tens of MB, in each executor's JVM and Python workers."""
    for name, (usual, own) in _BOUNDS.items():
        if spark.conf.get(name) == usual:
            spark.conf.set(name, own)


#: Batches after which a task gives freed memory back.
_TIDY = 16


def _release() -> None:
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function for mapInArrow that gives freed memory back to the system now and then, and at its end: workers live on, idle or for other work."""

    def tidied(batches: Iterator) -> Iterator:
        try:
            for k, out in enumerate(run(batches), 1):
                yield out
                if k % _TIDY == 0:
                    _release()
        finally:
            _release()

    return tidied


#: Input below so many bytes for each task slot is dealt out anew before heavy work on each row.
SMALL_SHARE = 4 << 20


def spread(df: DataFrame) -> DataFrame:
    """df, dealt to all task slots if it is small.

    A small file is often one row group, which only one task can read; all rows
    would then be parsed there. Larger input keeps the partitions of its scan.
    """
    bounded_batches(df.sparkSession)
    slots = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(2 * slots) if size < SMALL_SHARE * slots else df
