"""Damage to summaries against the rules, and the batch schedule."""

import json
from collections import Counter

from pyspark.sql import functions as F

from tests.calls import authored, documents

from turnloom.operators.mutations import REGISTRY, apply_damage, detection_study
from turnloom.operators.schedule import batch_schedule
from turnloom.sources.transcripts import calls_of, strict_turns, target_summary


def test_schedule(spark):
    rows = [(f"c{k}", ("short", "medium", "long")[k % 7 % 3], f"cat{k % 5}" if k % 9 else "not_applicable") for k in range(101)]
    got = batch_schedule(spark.createDataFrame(rows, "call_id string, length string, category string"), epochs=2).collect()
    category = {r[0]: r[2] for r in rows}
    for epoch in (1, 2):
        assert Counter(r.call_id for r in got if r.epoch == epoch) == Counter(r[0] for r in rows)
    for key in {(r.epoch, r.step) for r in got}:
        seen = Counter(category[r.call_id] for r in got if (r.epoch, r.step) == key)
        assert max(seen.values()) <= 3 and seen["not_applicable"] <= 2


def test_registry():
    assert len(REGISTRY) == 33
    assert apply_damage("bullet_removed", '{"assessment": []}', [], "x") is None


def test_detection(spark):
    given = [authored(f"va-{k:03}") for k in range(6)]
    for call in given:  # a section of two bullets: without one of them it is not empty, which a rule would see
        gold = json.loads(call["gold"])
        gold["response"].append({"text": "Planned to call back.", "speaker": "Nurse", "turns": [3], "quote": "I'll call you back.", "explanation": "Documents plan", "facts": []})
        call["gold"] = json.dumps(gold)
    calls = calls_of(documents(spark, given)).select("call_id", "gold", "transcript").cache()
    names = ["truncated_json", "missing_section", "turn_out_of_range", "number_changed_in_text", "status_flipped_to_done", "bullet_duplicated", "bullet_text_emptied", "bullet_removed"]
    summaries = calls.select("call_id", target_summary(F.col("gold")).alias("summary"))
    got = {r.mutation: r for r in detection_study(summaries, strict_turns(calls), names, 6).collect()}
    rate = {k: r.caught_any / r.n for k, r in got.items()}
    for name in ("truncated_json", "missing_section", "turn_out_of_range", "bullet_text_emptied", "bullet_duplicated"):
        assert rate[name] == 1.0, (name, rate)
    assert rate["number_changed_in_text"] >= 0.75 and rate["bullet_removed"] < 0.3, rate
