"""The batch form of the streaming operators, checked by SQL; tests run them as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnloom.plans.registry import query
from turnloom.sources.tables import table
from turnloom.streaming.live import growing_calls, windowed_counts


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL")
def stream_windowed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windowed_counts(table(spark, sf_dir, "events", "ts", "event_type", "value")).withColumn("total", F.round("total", 6))


@query("SELECT conv_id, count(*) AS n_turns, max(turn) AS last_turn FROM conversations GROUP BY conv_id")
def stream_growing_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return growing_calls(table(spark, sf_dir, "conversations", "conv_id", "turn"))
