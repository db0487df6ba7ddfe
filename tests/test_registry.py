"""SQL functions, published tables, medication errors and order statistics."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tests.test_validation import TURNS
from turnloom.operators.med_errors import error_table, medication_errors, name_scores
from turnloom.operators.risk import risk_scan
from turnloom.operators.selection import nearest_rank, order_statistics
from turnloom.operators.sql_functions import register_functions
from turnloom.sources import sinks


def test_functions_in_sql(spark):
    said = [*TURNS, (5, "Caller", "He can't breathe. He wants to die. The pain is terrible!"), (6, "Nurse", "Is it ten out of ten?"), (7, "Caller", "Ten.")]
    turns = spark.createDataFrame([(c, *t) for c in ("a", "b") for t in said] + [("c", 1, None, None)], "call_id string, turn_id int, speaker string, text string")
    turns.repartition(5).createOrReplaceTempView("turns")
    register_functions(spark, ["morphine"])
    got = sorted(tuple(r) for r in spark.sql("SELECT call_id, category, rule, turn_id, quote FROM risk_hits(TABLE(turns))").collect())
    want = sorted(tuple(r) for r in risk_scan(turns, ["morphine"]).select("call_id", "category", "rule", "turn_id", "quote").collect())
    assert got == want and got
    row = spark.sql("SELECT number_candidates('six thirty') AS n, spoken_date('December eighth, nineteen thirty three') AS d, seq_ratio('abcd', 'abce') AS r").first()
    assert "6:30" in row.n or "630" in row.n
    assert row.d == "1933-12-08" and row.r == 0.75
    with pytest.raises(Exception, match="lack"):
        spark.sql("SELECT * FROM risk_hits(TABLE(SELECT 1 AS x))").collect()


def test_publish(spark, tmp_path):
    folder = f"file://{tmp_path}/out"
    make = lambda *n: spark.createDataFrame([(k,) for k in n], "n int")
    read = lambda t: sorted((r.system, r.n) for r in sinks.published(spark, folder, t, "n int").collect())
    assert read("rules") == []
    assert sinks.publish(spark, folder, "a", {"rules": make(1), "gold": make(2)}) == []
    assert sinks.publish(spark, folder, "b", {"rules": make(5), "gold": make(6)}) == []
    assert read("rules") == [("a", 1), ("b", 5)] and read("gold") == [("a", 2), ("b", 6)]
    stale = sinks.publish(spark, folder, "a", {"rules": make(3, 4)})  # this run has no gold
    assert sorted(s.split("/")[0] for s in stale) == ["gold", "rules"]
    assert read("rules") == [("a", 3), ("a", 4), ("b", 5)] and read("gold") == [("b", 6)]
    assert len(list((tmp_path / "out").glob("*/system=a/run=*"))) == 1 and len(list((tmp_path / "out").glob("*/system=b/run=*"))) == 2
    with pytest.raises(ValueError, match="over 1 rows"):
        sinks.markdown(make(1, 2), most=1)


def test_medication_errors(spark):
    ddl = "call_id string, ord int, name string, dose string, unit string"
    gold = spark.createDataFrame([("c", 1, "morphine", "5", "mg"), ("c", 2, "senna", "2", "tablets"), ("c", 3, "warfarin", "1", "mg"), ("c", 4, "lasix", "20", "mg"), ("c", 5, "zofran", "4", "mg"), ("d", 1, "keppra", None, None)], ddl)
    model = spark.createDataFrame([("c", 1, "Morphine", "5.0", "milligrams"), ("c", 2, "senna", None, None), ("c", 3, "warfarin", "1", "mL"), ("c", 4, "lasix", "40", "mg"), ("c", 5, "aspirin", "81", "mg"), ("c", 6, "ASPIRIN", "1", "mg"), ("d", 1, "keppra", "", None)], ddl)
    texts = spark.createDataFrame([("c", "Took zofran 4 mg today. Senna 2 later."), ("d", None)], "call_id string, text string")
    rows = medication_errors(gold, model, ["call_id"], texts).collect()
    kinds = {(r.side, r.call_id, r.ord): r.kind for r in rows}
    assert [kinds["gold", "c", k] for k in range(1, 6)] == ["ok", "dose_missing", "unit_wrong", "dose_wrong", "not_found"]
    assert kinds["model", "c", 5] == kinds["model", "c", 6] == "extra"
    seen = {(r.call_id, r.name): (r.named, r.dosed) for r in rows}
    assert seen["c", "zofran"] == (True, True) and seen["c", "senna"] == (True, True) and seen["c", "warfarin"] == (False, False)
    table = error_table(medication_errors(gold, model, ["call_id"]), ["call_id"]).filter("call_id = 'c'").first().asDict()
    assert table == {"call_id": "c", "ok": 1, "dose_missing": 1, "unit_wrong": 1, "dose_wrong": 1, "not_found": 1, "extra": 2}
    s = name_scores(gold, model, ["call_id"], ["call_id"]).filter("call_id = 'c'").first()
    assert (s.distinct_names, s.hit, s.gold, s.found, s.ok) == (5, 4, 5, 4, 1) and abs(s.f1 - 0.8) < 1e-9


def test_order_statistics(spark):
    rng = random.Random(8)
    rows = [(g, rng.choice([None, 1.0, 1.0, 2.0]) if g == "few" else rng.choice([rng.random(), 0.5])) for g in ("few", "many", None) for _ in range(700 if g == "many" else 40)] + [("one", 3.0), ("nothing", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    ranks = {"p50": nearest_rank(0.5), "p95": nearest_rank(0.95), "low": F.lit(0), "high": F.col("n") + 9}
    by = defaultdict(list)
    for g, v in rows:
        if v is not None:
            by[g].append(v)
    want = {g: (v[-(-len(v) // 2) - 1], v[-(-len(v) * 95 // 100) - 1], v[0], v[-1]) for g, v in ((g, sorted(v)) for g, v in by.items())}
    for ranges in (2, 64):
        got = {r.g: (r.p50, r.p95, r.low, r.high) for r in order_statistics(df, ["g"], "v", ranks, ranges).collect()}
        assert got == want and Counter(got) == Counter(want)
