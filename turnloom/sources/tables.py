"""Parquet tables of a dataset folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """A table, or the named columns of it; filters and columns reach the Parquet scan."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return df.select(*columns) if columns else df


def turns(spark: SparkSession, folder: str) -> DataFrame:
    """Conversation turns: conv_id, turn_id from 1, speaker, text."""
    speaker = F.when(F.col("role") == "user", "Caller").when(F.col("role") == "assistant", "Nurse").otherwise(F.col("role"))
    return table(spark, folder, "conversations").select("conv_id", (F.col("turn") + 1).alias("turn_id"), speaker.alias("speaker"), "role", "text")
