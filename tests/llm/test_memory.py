"""What operators hold in a task and its Python worker."""

import random
import tracemalloc

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from turnloom.llm import common
from turnloom.llm.common import listed, tasks
from turnloom.llm.line_dedup import _documents, _grams
from turnloom.llm.simhash import SIMILAR, fingerprints


def test_short_lists_start_no_python_workers(spark, monkeypatch):
    """The list of heavy keys once was a Python RDD, for which every executor started workers that then stayed."""
    monkeypatch.setattr(common, "HEAVY_ROWS", 5)
    rows = spark.range(90).selectExpr("id % 3 AS key", "id AS v").checkpoint()
    keyed = spark.range(5).selectExpr("id AS key", "concat('n', id) AS name")
    joined = common.spread_join(rows, keyed, "key")
    assert "LocalTableScan [key" in joined._jdf.queryExecution().sparkPlan().toString()
    assert sorted((r.key, r.v, r.name) for r in joined.collect()) == sorted((k % 3, k, f"n{k % 3}") for k in range(90))


def test_short_lists_of_any_key(spark):
    for kind, values in (("long", [3, None, -1]), ("binary", [b"\x00\xff", None]), ("string", ["é", "", None]), ("long", [])):
        got = listed(spark, StructType().add("k", kind).add("heavy", "boolean"), k=values, heavy=[True] * len(values)).collect()
        assert [(bytes(r.k) if kind == "binary" and r.k is not None else r.k, r.heavy) for r in got] == [(v, True) for v in values]


def test_hashes_of_a_batch_are_not_held(spark, monkeypatch):
    """A batch's shingle hashes once were held as lists and sets of Python numbers, many times the texts' bytes."""
    df = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    found, make = [], type(df).mapInArrow
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, f, *a, **k: found.append(f) or make(self, f, *a, **k))
    fingerprints(df, SIMILAR)
    draw = random.Random(5)
    texts = [" ".join(str(draw.randrange(10_000)) for _ in range(250)).encode() for _ in range(2000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(2000)), pa.array([b"k"] * 2000), pa.array(texts)], ["doc_id", "key", "text"])
    list(found[0](iter([batch.slice(0, 2)])))  # imports
    tracemalloc.start()
    out = list(found[0](iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert out[0].num_rows == 2000
    assert peak < 20e6, peak


def test_line_tasks_do_not_shrink_with_the_exchanged_bytes(spark):
    """Line hashes exchange small, so adaptive execution once sorted those of the whole corpus in a few tasks."""
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.concat_ws("\n", *(F.concat(F.lit("a line of words "), F.col("id") * k) for k in range(8))).alias("text"))
    assert _grams(_documents(docs, "doc_id", "text"), 40, 11).checkpoint().rdd.getNumPartitions() == tasks(spark)
