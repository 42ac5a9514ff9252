"""Intermediate tables in the folder that driver and executors share, and memory that workers give back."""

from __future__ import annotations

import ctypes
import functools
import gc
import time
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from weftgraph.shared import remove, scratch, shared_dir

__all__ = ["bucket_of", "freed", "freed_group", "keys_in_bucket", "parts_for", "release", "remove", "save", "save_bucketed", "scratch", "shared_dir", "trim"]


#: Seconds between two times that a worker gives memory back while it works on groups.
TRIM_SECONDS = 0.3
_trimmed = 0.0


def trim(seconds: float = 0.0) -> None:
    """Gives freed memory back to the system, unless it did so within the last seconds, and has Arrow take its memory from where that works."""
    global _trimmed
    if time.monotonic() - _trimmed < seconds:
        return
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    pa.set_memory_pool(pa.system_memory_pool())
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)
    _trimmed = time.monotonic()


def freed(run):
    """A generator function for mapInArrow that gives freed memory back when its task ends.

    Spark uses a worker again for the next stage; without this, each would keep what its largest task took.
    """

    @functools.wraps(run)
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            trim()

    return wrapped


def freed_group(run):
    """A function for applyInArrow that gives freed memory back now and then."""

    @functools.wraps(run)
    def wrapped(table):
        out = run(table)
        trim(TRIM_SECONDS)
        return out

    return wrapped


def save(df: DataFrame, path: str, compression: str = "zstd", partition_by: str | None = None) -> DataFrame:
    """Writes df and reads it back: lineage ends there, and a lost executor costs no recomputation."""
    spark = df.sparkSession
    writer = df.write.option("compression", compression)
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    schema = df.schema
    release(spark)
    return spark.read.schema(schema).parquet(path)


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """The buckets in which Spark puts long keys: murmur3 of 32 bits, seed 42."""
    u32 = np.uint32
    turned = lambda x, r: (x << u32(r)) | (x >> u32(32 - r))
    keys = np.asarray(keys, np.int64).view(np.uint64)
    with np.errstate(over="ignore"):
        h = np.full(len(keys), 42, u32)
        for k in ((keys & np.uint64(0xFFFFFFFF)).astype(u32), (keys >> np.uint64(32)).astype(u32)):
            h = turned(h ^ turned(k * u32(0xCC9E2D51), 15) * u32(0x1B873593), 13) * u32(5) + u32(0xE6546B64)
        h ^= u32(8)
        h = (h ^ (h >> u32(16))) * u32(0x85EBCA6B)
        h = (h ^ (h >> u32(13))) * u32(0xC2B2AE35)
        h ^= h >> u32(16)
    return h.view(np.int32).astype(np.int64) % buckets


def keys_in_bucket(part: int, buckets: int):
    """Keys of a task's own, part in their upper half, that all lie in the bucket part % buckets: its rows need no shuffle to be bucketed."""
    step = 16 * buckets
    for first in range(0, 1 << 32, step):
        keys = (part << 32) | np.arange(first, first + step, dtype=np.int64)
        yield from keys[bucket_of(keys, buckets) == part % buckets].tolist()


def save_bucketed(df: DataFrame, path: str, key: str, buckets: int) -> DataFrame:
    """Writes df, a file for each task and each bucket of key in it, and reads it back: joins by key do not move its rows again.

    Rows are not dealt out first; keys from keys_in_bucket give a task one file.
    Bucketing needs a name in the catalog while the table is opened; the name goes, the files stay.
    """
    spark = df.sparkSession
    name = f"weft_{uuid.uuid4().hex}"
    df.write.format("parquet").bucketBy(buckets, key).option("path", path).option("compression", "uncompressed").saveAsTable(name)
    opened = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    release(spark)
    return opened


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner drop the shuffle files of finished jobs now, not at its next collection.

    Spark's scheduler threads hold the last job that they saw, so another, of one row, follows it first.
    """
    gc.collect()
    spark.range(0, 1, 1, 1).collect()
    spark.sparkContext._jvm.System.gc()


def parts_for(spark: SparkSession, total_bytes: int, target: int = 16 << 20) -> int:
    """Partitions so that each holds about target bytes; never fewer than the session's setting."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(total_bytes) // target), 1)
