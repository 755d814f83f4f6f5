"""Streaming extensions over an event table. The batch library has no streams; these are additions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, path: str, schema) -> DataFrame:
    """Parquet files as they arrive."""
    return spark.readStream.schema(schema).parquet(path)


def _watermarked(events: DataFrame, late: str) -> DataFrame:
    """A stream's event time must be an instant: zone-free times are read in the session's zone."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def windowed_counts(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Count and sum of each type in fixed windows, with a watermark."""
    if events.isStreaming:
        events = _watermarked(events, late)
    return (
        events.groupBy(F.window("ts", width).alias("w"), "event_type")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
        .select(F.col("w.start").alias("start"), "event_type", "n", "total")
    )


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Sessions of each user, ended by a gap."""
    if events.isStreaming:
        events = _watermarked(events, gap)
    return (
        events.groupBy("user_id", F.session_window("ts", gap).alias("s"))
        .agg(F.count(F.lit(1)).alias("n"))
        .select("user_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")
    )


def once(events: DataFrame, key: str = "event_id", late: str = "10 minutes") -> DataFrame:
    """Each event once; a stream forgets keys after the watermark."""
    return _watermarked(events, late).dropDuplicatesWithinWatermark([key]) if events.isStreaming else events.dropDuplicates([key])
