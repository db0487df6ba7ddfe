"""Export sheets, statuses, flags, training examples."""

import json

import pytest
from pyspark.sql import functions as F

from tests.calls import documents
from tests.test_gold_facts import whole
from turnloom.operators import exports as E
from turnloom.operators.gold_facts import tag_findings
from turnloom.sources.transcripts import calls_of, strict_turns, target_summary


def frames(spark):
    one = whole(call__noise_events=[{"turn": 4, "type": "drug_garble", "true_form": "morphine", "heard_form": "more fine", "fact_id": "A2"}], call__risk_flags=[{"flag_id": "F1", "risk_category": "other_urgent", "trigger_description": "pain", "trigger_speaker": "Caller"}], call__chief_complaint={"patient_name_true": "Ann", "patient_name_heard_as": ["An", "Anne"], "reason_for_call": "fever"})
    one["assessment"][1] |= {"prn": True, "frequency": "daily", "medication_status": "extra", "note": "liquid", "other": ["a", "b"]}
    calls = calls_of(documents(spark, [one]))
    return calls, strict_turns(calls)


def test_sheets(spark):
    calls, turns = frames(spark)
    c = E.call_sheet(calls, turns).first()
    assert (c.scenario_category, c.turns, c.noise_events, c.assessment_items, c.risk_flags, c.patient) == ("routine", 5, 1, 2, "other_urgent", "Ann") and len(c) == 22
    facts = {r.item: r for r in E.fact_sheet(calls).collect()}
    assert [r.item for r in E.fact_sheet(calls).orderBy("place").collect()] == ["patient_name", "patient_dob", "caller_name", "callback_phone", "relationship", "cc", "A1", "A2", "R1", "F1"]
    assert (facts["A2"].fact, facts["A2"].details, facts["A2"].speaker, facts["A2"].turns) == ("Morphine 5 MG daily PRN [extra]", "note: liquid; other: a; b", "Caller", "4")
    assert facts["patient_name"].details == "spoken: None; heard as: An; Anne" and facts["patient_dob"].fact == "(not stated)"
    assert facts["R1"].fact == "page completed" and facts["F1"].speaker == "Caller" and facts["cc"].quote.startswith("a fever")
    t = {r.turn_id: r for r in E.transcript_sheet(calls, turns).collect()}
    assert t[4].tags == "A2" and t[4].noise == 'drug_garble: said "morphine" -> heard "more fine"' and t[1].noise == ""
    (n,) = E.noise_sheet(calls, turns).collect()
    assert n.line == "Caller -> She took 5 mg of morphine." and n.fact_id == "A2" and len(n) == 10
    s = E.summary_sheet(calls).first()
    assert s.patient == "None (DOB not stated)" and s.response.startswith("\u2022 Doctor was paged.\n    Nurse: ") and s.risk_flags == "other_urgent: pain" and s.education == ""
    v = {r.code or r.checks: (r.train, r.val) for r in E.validator_sheet(tag_findings(calls, turns, []), calls, {"G10": "tags", "G11": "drugs"}).collect()}
    assert v == {"G10": (0, 2), "G11": (0, 0), "calls checked": (0, 1), "calls with any finding": (0, 1)}


def test_statuses_and_flags(spark):
    rows = [(1, False, 0, 0, 0, []), (2, True, 4, 2, 1, ["x"]), (3, True, 1, 0, 1, []), (4, True, 0, 0, 0, ["senna", "keppra"]), (5, True, 0, 0, 0, None)]
    got = {r.id: (r.status, r.why) for r in E.statuses(spark.createDataFrame(rows, "id int, parse_ok boolean, raw_errors int, errors int, repaired int, absent array<string>")).collect()}
    assert [got[k][0] for k in range(1, 6)] == ["FAILED", "REVIEW", "PASS", "REVIEW", "PASS"]
    assert got[4][1] == "the caller named senna, keppra, the summary does not (no rule error)" and got[3][1].startswith("1 quotes were repaired")
    ddl = "call_id string, category string, turns array<int>, quote string"
    model, rules = spark.createDataFrame([("a", "x", [1], "q")], ddl), spark.createDataFrame([("a", "x", [2], "r"), ("a", "y", [3], "s"), ("b", "y", [1], "t")], ddl)
    calls = spark.createDataFrame([("a", False), ("b", True)], "call_id string, is_na boolean")
    assert sorted((r.call_id, r.category, r.source) for r in E.final_flags(model, rules, calls, ["call_id"]).collect()) == [("a", "x", "model"), ("a", "y", "rule")]
    p = E.payloads(spark.createDataFrame([("a", "s2", 1.5), ("a", "s1", None)], "id string, system string, t double"), "id", "system", ["t"]).first()
    assert json.loads(p.payload) == {"s1": {}, "s2": {"t": 1.5}} and list(json.loads(p.payload)) == ["s1", "s2"]


def test_training_examples(spark):
    calls, turns = frames(spark)
    one = E.training_examples(calls, turns, "Summarise.", target_summary(F.col("gold")), 100_000).first()
    system, user, answer = json.loads(one.messages)
    assert system == {"role": "system", "content": "Summarise."} and user["content"].startswith("CALL TRANSCRIPT\n[1] Nurse: Hospice line")
    assert answer["content"] == one.target and "covers" not in one.target and one.n_target == len(one.target)
    with pytest.raises(Exception, match="too long: va-001"):
        E.training_examples(calls, turns, "Summarise.", target_summary(F.col("gold")), 50).collect()
