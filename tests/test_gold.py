"""Gold checks on the authored calls, and sinks."""

import json

import pytest
from pyspark.sql import functions as F

from tests.calls import authored, documents
from turnloom.operators.gold_checks import gold_findings
from turnloom.sources import sinks
from turnloom.sources.transcripts import authored_calls, calls_of, json_lines, lenient_turns, lexicon, listed_calls, optional, strict_turns, whole_texts


def test_gold_calls(spark):
    calls = calls_of(documents(spark, [authored(f"va-00{k}") for k in (1, 2)])).cache()
    turns = strict_turns(calls).cache()
    found = gold_findings(calls, turns).collect()
    assert [f for f in found if f.level == "ERROR"] == []
    one = calls.filter("call_id = 'va-001'")
    broken = one.withColumn("setup", F.map_concat(F.map_filter("setup", lambda k, v: k != "scenario_category"), F.create_map(F.lit("scenario_category"), F.lit("odd"))))
    broken = broken.withColumn("gold", F.regexp_replace("gold", '"A1"', '"A99"')).unionByName(one.withColumn("call_id", F.lit("va-copy")))
    codes = {(f.call_id, f.code) for f in gold_findings(broken, turns).collect()}
    assert {("va-001", "G1"), ("va-001", "G7"), ("va-001", "G8"), ("va-001", "LEAK")} <= codes


def test_sources(spark, tmp_path):
    calls = [authored(f"va-00{k}") for k in (1, 2, 3)]
    for c in calls[:2]:
        (tmp_path / "val").mkdir(exist_ok=True)
        (tmp_path / "val" / f"{c['call_id']}.json").write_text(json.dumps(c))
    (tmp_path / "list.json").write_text(json.dumps({"examples": calls}))
    read = authored_calls(spark, str(tmp_path), "val").orderBy("call_id").collect()
    assert [(r.call_id, r.setup["length_bucket"], r.assessment[0]["item_id"]) for r in read] == [("va-001", "short", "A1"), ("va-002", "short", "A1")]
    listed = listed_calls(whole_texts(spark, str(tmp_path), "list.json").withColumnRenamed("value", "raw"))
    assert [(r.place, r.call_id, r.split) for r in listed.orderBy("place").collect()] == [(0, "va-001", "val"), (1, "va-002", "val"), (2, "va-003", "val")]
    turns = strict_turns(calls_of(documents(spark, calls[:1]))).orderBy("turn_id").collect()
    assert [(t.turn_id, t.speaker, t.tags) for t in turns][3:] == [(4, "Caller", []), (5, "Nurse", ["small_talk"])]
    with pytest.raises(Exception, match="not a turn"):
        strict_turns(calls_of(documents(spark, [calls[0] | {"transcript": "Nurse -> a\nodd line"}]))).collect()
    loose = spark.createDataFrame([("x", "hello\nNurse -> Hi.\nstill me\n\nCaller->  yes ")], "call_id string, transcript string")
    assert [tuple(r)[1:] for r in lenient_turns(loose).orderBy("turn_id").collect()] == [(1, "Caller", "hello"), (2, "Nurse", "Hi. still me"), (3, "Caller", "yes")]
    (tmp_path / "words.txt").write_text("# names\n alpha \n\nbeta\n")
    assert {r.term for r in lexicon(spark, f"{tmp_path}/words.txt").collect()} == {"alpha", "beta"}
    (tmp_path / "rows.jsonl").write_text('{"a": 1}\n\n{"a": 2}\n')
    assert sorted(r.a for r in json_lines(spark, f"{tmp_path}/rows.jsonl", "a int").collect()) == [1, 2]
    assert optional(spark, f"{tmp_path}/none.jsonl", "a int")[1] is False and optional(spark, f"{tmp_path}/rows.jsonl", "a int")[1] is True


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], "id string, n int, split string")
    sinks.fan_out(df, str(tmp_path), {"ids": [F.col("id")], "numbers": [F.col("id"), F.col("n")]}, ("split",))
    assert spark.read.json(f"{tmp_path}/numbers").count() == 2
    assert sinks.checksums(spark, str(tmp_path), "*.json").count() >= 2
    assert sinks.markdown(df.orderBy("id")).splitlines()[2] == "| a | 1 | x |"
    sinks.gated(df.select(F.lit("WARN").alias("level")))
    with pytest.raises(ValueError):
        sinks.gated(df.select(F.lit("ERROR").alias("level")))
