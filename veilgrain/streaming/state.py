"""Event-time windows, and running a stream to the end of what is there."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed(events: DataFrame, at: str, *keys: str, late: str = "1 hour", size: str = "1 day") -> DataFrame:
    """Counts and sums by event-time window; rows later than the watermark are dropped."""
    counted = events.withWatermark(at, late).groupBy(F.window(at, size), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return counted.select(F.col("window.start").alias("window_start"), *keys, "n", "total")


def run_available(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is there, into a table in `folder`, and reads it."""
    query = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{folder}/state").option("path", f"{folder}/out").trigger(availableNow=True).start()
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out")
