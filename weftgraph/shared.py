"""The folder that driver and executors share, and tables written there between rounds."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where the session has none, a temporary folder on a local master; an error on a cluster."""
    found = spark.conf.get(SETTING, None) or spark.sparkContext.getConf().get(SETTING)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError(f"{SETTING} is not set: intermediate tables need a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="weft-shared-")
        spark.conf.set(SETTING, found)
    return found.rstrip("/")


def scratch(spark: SparkSession, tag: str) -> str:
    """A new folder name below the shared folder."""
    return f"{shared_dir(spark)}/weft-{tag}-{uuid.uuid4().hex}"


def saved(df: DataFrame, path: str) -> DataFrame:
    """df, written as Parquet and read back: lineage ends there, and a lost executor costs no recomputation."""
    schema = df.schema
    df.write.parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes an intermediate table that no later plan reads."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner drop the shuffle files of finished jobs now, not at its next collection."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
