"""Streaming forms: windowed counts with late data, and calls that grow turn by turn. An extension."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, width: str = "1 hour", lateness: str | None = "10 minutes") -> DataFrame:
    """Events and sum of values per tumbling window and type; the same for a table and for a stream.

    On a stream the watermark drops rows later than ``lateness`` and lets closed windows go.
    """
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))  # a watermark needs a time with a zone
    rows = rows.withWatermark("ts", lateness) if lateness and events.isStreaming else rows
    g = rows.groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


def growing_calls(turns: DataFrame) -> DataFrame:
    """Turns so far and the last turn's number of each call; on a stream for update or complete output."""
    return turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_turns"), F.max("turn").alias("last_turn"))
