"""Windowed counts of an event stream, with late events up to a watermark. The same plan runs on a batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """A folder of Parquet files, or one file, as a stream, in the order in which they appear."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_per_trigger)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isFile():
        return reader.option("pathGlobFilter", at.getName()).parquet(at.getParent().toString())
    return reader.parquet(path)


def windowed(events: DataFrame, *, every: str = "1 hour", slide: str | None = None, late: str = "2 hours", keys: list[str] = ("event_type",)) -> DataFrame:
    """Events, their sum and greatest value by window and key."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        timed = timed.withWatermark("ts", late)
    groups = timed.groupBy(F.window("ts", every, slide) if slide else F.window("ts", every), *keys)
    told = groups.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"), F.max("value").alias("most"))
    return told.select(F.col("window.start").cast("timestamp_ntz").alias("start"), *keys, "n", "total", "most")


def sessions(events: DataFrame, *, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Sessions by user: runs of events less than ``gap`` apart."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        timed = timed.withWatermark("ts", late)
    told = timed.groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return told.select(F.col("session_window.start").cast("timestamp_ntz").alias("start"), "user_id", "n")
