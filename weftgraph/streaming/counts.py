"""Event-time counts that run alike on batch tables and streams (an extension).

Streams need an instant as event time; a time stamp without a zone is read in the session's zone. In a
stream, rows that come later than the watermark are dropped; a batch keeps all rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Arrivals of one range of late_rows; a range's greatest time is one row.
RANGE = 100_000


def _timed(events: DataFrame, late: str) -> DataFrame:
    """events with ts as an instant, and the watermark where it is a stream."""
    instant = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return instant.withWatermark("ts", late) if events.isStreaming else instant


def _as_given(events: DataFrame, column: str):
    """A time of the result in the type of the given event times."""
    return F.col(column).cast(events.schema["ts"].dataType)


def tumbling(events: DataFrame, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """day, event_type, n, total in tumbling windows."""
    out = _timed(events, late).groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return out.select(_as_given(events, "window.start").alias("day"), "event_type", "n", "total")


def sliding(events: DataFrame, window: str = "1 day", slide: str = "6 hours", late: str = "1 hour") -> DataFrame:
    """begin, event_type, n in windows that start every slide."""
    out = _timed(events, late).groupBy(F.window("ts", window, slide), "event_type").agg(F.count("*").alias("n"))
    return out.select(_as_given(events, "window.start").alias("begin"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """user_id, begin, n of each session; a gap of the given length ends one."""
    out = _timed(events, late).groupBy("user_id", F.session_window("ts", gap)).agg(F.count("*").alias("n"))
    return out.select("user_id", _as_given(events, "session_window.start").alias("begin"), "n")


def distinct_events(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """First row of each event_id (in a stream: within the watermark)."""
    timed = _timed(events, late)
    return timed.dropDuplicatesWithinWatermark(["event_id"]) if events.isStreaming else timed.dropDuplicates(["event_id"])


def late_rows(events: DataFrame, arrival: str = "event_id", late: str = "1 hour") -> DataFrame:
    """event_id, event_type, behind (seconds) of rows that a stream in order of arrival (a whole number) would drop.

    A row is late if its time is more than late behind the greatest time that arrived before it. The
    greatest times of ranges of arrivals are carried forward, so no task sorts the whole table. Rows
    without a time or an arrival are left out.
    """
    rows = events.select("event_id", "event_type", F.col("ts").cast("timestamp").alias("ts"), F.expr(arrival).cast("long").alias("at")).filter("at is not null and ts is not null")
    rows = rows.withColumn("part", F.floor(F.col("at") / RANGE))
    tops = rows.groupBy("part").agg(F.max("ts").alias("top"))
    before = tops.withColumn("carried", F.max("top").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))).select("part", "carried")
    own = F.max("ts").over(Window.partitionBy("part").orderBy("at").rangeBetween(Window.unboundedPreceding, -1))
    seen = rows.withColumn("own", own).join(before, "part").withColumn("seen", F.greatest("own", "carried"))
    behind = (F.unix_micros("seen") - F.unix_micros("ts")) / 1e6
    return seen.filter(F.col("ts") < F.col("seen") - F.expr(f"interval {late}")).select("event_id", "event_type", behind.alias("behind"))


def upsert_triples(path: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that appends the new triples (s, p, o) of a micro-batch to the table at path.

    Triples that are there already, or twice in the batch, are not written again. Each batch writes its own
    folder batch=<id> whole, so a batch that is run again after a failure replaces what it wrote before.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = batch.select("s", "p", "o").distinct()
        known = read_triples(spark, path)
        if known is not None:
            rows = rows.join(known.filter(F.col("batch") != batch_id).select("s", "p", "o"), ["s", "p", "o"], "left_anti")
        rows.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def read_triples(spark: SparkSession, path: str) -> DataFrame | None:
    """The triples that upsert_triples has written to path, with their batch; None before the first."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return None
    return spark.read.schema("s string, p string, o string, batch long").parquet(path)
