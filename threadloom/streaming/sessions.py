"""Streaming mode: sessions and budgets over an event stream with watermarks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, folder: str, schema: str, files_at_once: int = 16) -> DataFrame:
    """A stream over a folder of Parquet files, so many at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(folder)


def session_counts(events: DataFrame, gap: str = "6 hours", lateness: str = "1 day") -> DataFrame:
    """Sessions by user: counts and sums, final once the watermark has passed. A gap
    of exactly ``gap`` stays in the session."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness)
    grouped = timed.groupBy("user_id", F.session_window("ts", gap).alias("s")).agg(F.count("*").alias("n"), F.sum("value").alias("value"))
    return grouped.select("user_id", F.col("s.start").alias("started"), "n", "value")


def window_counts(events: DataFrame, width: str = "1 day", lateness: str = "1 day") -> DataFrame:
    """Tumbling counts by kind."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness)
    return timed.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("started"), "event_type", "n")
