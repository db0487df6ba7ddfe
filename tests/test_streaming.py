"""A stream that has read everything equals the batch result."""

from pyspark.sql import functions as F

from turnloom.streaming.live import growing_calls, windowed_counts

SF = "/root/testdata/sf0.001"


def test_streams_equal_batches(spark, tmp_path):
    for name, operator in (("events", lambda d: windowed_counts(d, "1 day")), ("conversations", growing_calls)):
        table = spark.read.parquet(f"{SF}/{name}.parquet")
        table.repartition(4).write.parquet(f"{tmp_path}/{name}")
        stream = operator(spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/{name}"))
        run = stream.writeStream.outputMode("complete").format("memory").queryName(f"s_{name}").trigger(availableNow=True).start()
        assert run.awaitTermination(300)
        rounded = lambda d: d.withColumn("total", F.round("total", 6)) if "total" in d.columns else d
        assert sorted(map(tuple, rounded(spark.table(f"s_{name}")).collect())) == sorted(map(tuple, rounded(operator(table)).collect()))
