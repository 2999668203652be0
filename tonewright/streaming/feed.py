"""Structured Streaming over event logs and scan results, with late data and repeats handled by watermarks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


def event_stream(spark: SparkSession, folder: str, schema: str = EVENTS) -> DataFrame:
    """Lines of JSON as they arrive in a folder."""
    return spark.readStream.schema(schema).json(folder)


def windowed_counts(events: DataFrame, late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """Events and their values by type and window; rows later than the watermark are left out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def first_scans(scans: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each file key once within the watermark."""
    return scans.withWatermark("last_update_at", late).dropDuplicatesWithinWatermark(["file_key"])


def drain(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process what is there and stop; a later call goes on from the checkpoint."""
    stream.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
