"""Streams: event-time windows, sessions and deduplication with watermarks. Each works on a batch table too."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, path: str, schema: str, files: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def windowed(events: DataFrame, time: str, key: str, value: str, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """start, key, n, total, per window; rows later than `late` behind the newest are dropped in a stream."""
    own = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return own.groupBy(F.window(time, size), key).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("window.start").alias("start"), key, "n", "total")


def sessions(events: DataFrame, time: str, key: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    own = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return own.groupBy(F.session_window(time, gap), key).agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), key, "n")


def deduplicated(events: DataFrame, time: str, keys: list[str], late: str = "1 hour") -> DataFrame:
    own = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return own.dropDuplicatesWithinWatermark(keys) if events.isStreaming else own.dropDuplicates(keys)
