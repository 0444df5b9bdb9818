"""Structured Streaming over event files: windowed counts with late data, sessions, deduplication."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


def read_events(spark: SparkSession, folder: str, files_per_trigger: int = 10) -> DataFrame:
    """Stream of parquet files that arrive in a folder."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def windowed_counts(events: DataFrame, window: str = "1 hour", lateness: str | None = "1 day") -> DataFrame:
    """Events and their value per type and tumbling window; events later than ``lateness`` are dropped by the watermark. None keeps a watermark that is set already."""
    return (
        (events.withWatermark("ts", lateness) if lateness else events)
        .groupBy(F.window("ts", window).alias("w"), "event_type")
        .agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(~F.isnan("value"), F.col("value"))).alias("value"))
        .select(F.col("w.start").alias("window_start"), "event_type", "n", "value")
    )


def sessions(events: DataFrame, gap: str = "30 minutes", lateness: str = "1 day") -> DataFrame:
    """Sessions of a user: events with less than ``gap`` between them."""
    return events.withWatermark("ts", lateness).groupBy(F.session_window("ts", gap).alias("s"), "user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("s.start").alias("session_start"), "n")


def first_deliveries(events: DataFrame, lateness: str = "1 day") -> DataFrame:
    """Each event once, however often it is delivered within the watermark."""
    return events.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["event_id"])


def run_to_table(stream: DataFrame, checkpoint: str, target: str, mode: str = "append") -> None:
    """Process what there is and write it as parquet; state and progress live in ``checkpoint``, in the shared folder."""
    stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", target).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
