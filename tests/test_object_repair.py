"""Whole summaries after the repair of quotes and the medication check."""

import json

from tests.test_validation import TURNS, summary
from turnloom.operators.object_repair import checked_medication, repaired_summaries

DRUGS = ["morphine", "lorazepam", "warfarin"]
SAID = [*TURNS, (5, "Caller", "And lorazepam, half a tablet. Also the warfarin, one tablet a day."), (6, "Nurse", "The morphine again then.")]


def frames(spark, *objects):
    rows = [("m", f"c{k}", o if isinstance(o, str) or o is None else json.dumps(o)) for k, o in enumerate(objects)]
    turns = [(f"c{k}", *t) for k in range(len(objects)) for t in SAID]
    return spark.createDataFrame(rows, "system string, call_id string, summary string"), spark.createDataFrame(turns, "call_id string, turn_id int, speaker string, text string")


def test_quotes(spark):
    flag = {"category": "other_urgent", "turns": [3], "quote": "I already paged a doctor"}
    given = [summary(), summary(assessment__quote="I think she had a fever since six thirty"), summary(assessment__turns=[77], assessment__quote="far"), summary() | {"risk_flags": [flag]}, "no json", None]
    s, t = frames(spark, *given)
    got = {r.call_id: (r.summary, r.patches) for r in repaired_summaries(s, t).collect()}
    assert got["c0"] == (json.dumps(given[0]), 0) and got["c2"] == (json.dumps(given[2]), 0) and got["c4"] == ("no json", 0) and got["c5"] == (None, 0)
    want = json.loads(json.dumps(given[1]))
    want["assessment"][0]["quote"] = "I think she has had a fever since six thirty."
    assert got["c1"][1] == 1 and json.dumps(json.loads(got["c1"][0])) == json.dumps(want)
    assert json.loads(got["c3"][0])["risk_flags"][0]["quote"] == "I already paged the doctor." and got["c3"][1] == 1


def test_medication(spark):
    one = summary(assessment__text="Morphine 5 mg was taken; warfarin one tablet.", assessment__facts=[{"type": "medication", "name": "morphine", "strength": None, "certainty": "stated"}])
    strong = summary(assessment__text="Morphine 5 mg was taken.", assessment__facts=[{"type": "medication", "name": "morphine", "strength": "5 mg/mL", "certainty": "stated"}])
    s, t = frames(spark, one, strong)
    objects, findings = checked_medication(s, t, DRUGS)
    said = {(r.call_id, r.rule, r.severity, r.drug) for r in findings.collect()}
    assert ("c0", "M2", "INFO", "morphine") in said and ("c0", "M1", "INFO", "warfarin") in said and ("c0", "M3", "WARN", "lorazepam") in said
    assert {x for x in said if x[0] == "c1"} == {("c1", "M3", "WARN", "lorazepam"), ("c1", "M3", "WARN", "warfarin")}
    got = {r.call_id: json.loads(r.summary) for r in objects.collect()}
    facts = got["c0"]["assessment"][0]["facts"]
    assert list(facts[0].items()) == [("type", "medication"), ("name", "morphine"), ("dose", "5"), ("unit", "mg"), ("strength", None), ("certainty", "stated")]
    assert facts[1]["name"] == "warfarin" and facts[1]["certainty"] == "stated" and len(facts) == 2
    got["c0"]["assessment"][0]["facts"] = one["assessment"][0]["facts"]
    assert json.dumps(got["c0"]) == json.dumps(one) and json.dumps(got["c1"]) == json.dumps(strong)
