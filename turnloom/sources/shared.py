"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a session on one machine that names none gets one of its own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="turnloom-checkpoint-"))
    return sc.getCheckpointDir()


def worked_out(df: DataFrame) -> DataFrame:
    """``df`` computed once, for several readers; the plan begins anew behind it."""
    shared_folder(df.sparkSession)
    return df.checkpoint()
