"""Structured Streaming over event folders, with batch twins of the same logic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def events_stream(spark: SparkSession, folder: str, schema: object, files_per_trigger: int = 8) -> DataFrame:
    """A stream over the parquet files that arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def tumbling_counts(events: DataFrame, width: str = "1 hour", lateness: str = "2 hours") -> DataFrame:
    """Events, their value and errors per window and type. Works on streams and tables; late rows beyond the watermark are dropped on streams only."""
    rows = events.select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    if events.isStreaming:
        rows = rows.withWatermark("ts", lateness)
    counts = rows.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n_events"), F.round(F.sum("value"), 2).alias("total_value"))
    return counts.select(F.col("w.start").alias("window_start"), "event_type", "n_events", "total_value")


def sessions(events: DataFrame, gap: str = "30 minutes", lateness: str = "2 hours") -> DataFrame:
    """Sessions of users: events less than ``gap`` apart belong together."""
    rows = events.select(F.col("ts").cast("timestamp").alias("ts"), "user_id")
    if events.isStreaming:
        rows = rows.withWatermark("ts", lateness)
    found = rows.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n_events"), F.min("ts").alias("session_start"))
    return found.select("user_id", "session_start", "n_events")
