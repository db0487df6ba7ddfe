"""What a checkpoint leaves behind."""

import time

from pyspark.sql import functions as F

from turnloom.llm.common import FILE_CLEANUP, checkpointed


def shuffle_files(spark):
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks()
    return {str(b) for b in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(blocks) if str(b).startswith("shuffle_")}


def test_no_shuffle_files(spark):
    """Files of exchanges behind a checkpoint once stayed until the driver collected its garbage; with many tasks they filled the disk."""
    before, setting = shuffle_files(spark), spark.conf.get(FILE_CLEANUP)
    rows = spark.range(1000).selectExpr("id % 7 AS k", "id").repartition(5, "id").groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    kept = checkpointed(rows)
    deadline = time.monotonic() + 20
    while shuffle_files(spark) - before and time.monotonic() < deadline:
        time.sleep(0.1)
    assert not shuffle_files(spark) - before
    assert spark.conf.get(FILE_CLEANUP) == setting
    assert sorted(map(tuple, kept.collect())) == sorted(map(tuple, rows.collect()))
