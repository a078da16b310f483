"""Streaming ingest of events: deduplicated, windowed, carried state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, path: str, schema, files_each: int = 16) -> DataFrame:
    """Parquet files under ``path`` as a stream; times without zone are read as UTC."""
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_each).parquet(path)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def deduplicated(events: DataFrame, key: str = "event_id", late: str = "1 hour") -> DataFrame:
    """First row of each key; state is dropped behind the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def windowed_counts(events: DataFrame, size: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Events and value by type and window."""
    windows = events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type")
    return windows.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("value")).select(F.col("window.start").alias("window_start"), "event_type", "n", "value")


def ingest(stream: DataFrame, target: str, checkpoint: str):
    """Appends a stream to Parquet until its present input is used up; exactly once by the checkpoint."""
    return stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
