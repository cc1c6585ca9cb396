"""Putting DataFrames together and spreading them."""

from __future__ import annotations

import ctypes
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stacked(first: DataFrame, *others: DataFrame, allow_missing: bool = False) -> DataFrame:
    """All rows of the frames, by column name.

    Spark 4.1 lets a union keep the hash partitioning of its parts and then zips their partitions. Where the parts share
    a reused exchange that adaptive execution coalesced for one of them, it zips different partitions, and rows come
    twice ("Can't zip RDDs with unequal numbers of partitions" if the counts differ). So that is turned off here.
    """
    first.sparkSession.conf.set("spark.sql.unionOutputPartitioning", "false")
    for other in others:
        first = first.unionByName(other, allowMissingColumns=allow_missing)
    return first


def spread(df: DataFrame, task_mb: int = 8) -> DataFrame:
    """df over all cores where its files are so few or small that a scan would keep to some of them.

    A file of one row group is read by one task, whatever its splits. Inputs of more than task_mb for each core are left as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(cores) if size < cores * (task_mb << 20) else df


def near(df: DataFrame, most: int = 100_000) -> DataFrame:
    """df, marked for a broadcast if it has at most so many (narrow) rows; a larger one is joined by a shuffle."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def apart(df: DataFrame) -> DataFrame:
    """df, never broadcast by an estimate: Spark takes exploded rows and small files of much repeated text for far smaller than they are."""
    return df.hint("merge")


def exploded(df: DataFrame, array: str, out: str) -> DataFrame:
    """df with a row for each element of array that is not null, as the column out in its place.

    A plain explode is preceded by a filter for arrays that are not empty, which goes below the projection and computes the array once more.
    """
    return df.select(*[c for c in df.columns if c != array], F.explode_outer(array).alias(out)).where(F.col(out).isNotNull())


#: Bytes of an Arrow batch of whole texts; a worker and its executor each hold a few of them.
BATCH_BYTES = 8 << 20


def in_small_batches(df: DataFrame) -> DataFrame:
    """df, after making sure that the session sends Python at most BATCH_BYTES at once (a longer single row goes alone)."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    held = re.fullmatch(r"(\d+)b?", str(conf.get(key, None) or ""))
    if held is None or not 0 < int(held[1]) <= BATCH_BYTES:
        conf.set(key, str(BATCH_BYTES))
    return df


def trim() -> None:
    """Gives memory that a worker no longer uses back to the system, as idle workers stay for later stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass
