"""Validator rules on a small call and its summary, and the authored calls' invariants."""

import json

from pyspark.sql import functions as F

from turnloom.operators.validation import BULLET_RULES, Rule, _finding, validate

TURNS = [
    (1, "Nurse", "Hospice line, this is Lena. How can I help?"),
    (2, "Caller", "I think she has had a fever since six thirty. No cough."),
    (3, "Nurse", "I already paged the doctor. I'll call you back."),
    (4, "Caller", "She took 5 mg of morphine."),
]

_UNSAID = {"value": None, "certainty": "not_stated", "heard_as": [], "turns": []}
NOBODY = {k: _UNSAID for k in ("patient_name", "patient_dob", "caller_name", "callback_phone")} | {"relationship": {k: v for k, v in _UNSAID.items() if k != "heard_as"}}


def summary(**changes):
    caller = {"text": "Possible fever since 6:30.", "speaker": "Caller", "turns": [2], "quote": "I think she has had a fever since six thirty.", "explanation": "Documents fever", "facts": [{"type": "symptom", "name": "fever", "certainty": "unclear"}]}
    nurse = {"text": "Doctor was paged.", "speaker": "Nurse", "turns": [3], "quote": "I already paged the doctor.", "explanation": "Documents page", "facts": [{"type": "action", "status": "completed", "certainty": "stated"}]}
    out = {
        "not_applicable": {"is_na": False, "reason": None}, "identity": NOBODY, "risk_flags": [],
        "chief_complaint": {"reason": "Fever", "speaker": "Caller", "turns": [2], "quote": "a fever since six thirty", "explanation": "Documents why"},
        "assessment": [caller], "response": [nurse], "education": [],
    }
    for path, value in changes.items():
        section, key = path.split("__")
        out[section][0][key] = value
    return out


def run(spark, *texts, drugs=None):
    s = spark.createDataFrame([("m", f"c{k}", t if isinstance(t, str) or t is None else json.dumps(t)) for k, t in enumerate(texts)], "system string, call_id string, summary string")
    turns = spark.createDataFrame([(f"c{k}", *t) for k in range(len(texts)) for t in TURNS], "call_id string, turn_id int, speaker string, text string")
    findings, counters = validate(s, turns, drugs)
    rules = {}
    for r in findings.filter("severity <> 'INFO'").collect():
        rules.setdefault(r.call_id, set()).add((r.rule, r.severity))
    return [rules.get(f"c{k}", set()) for k in range(len(texts))], {(r.call_id, r.name): (r.ok, r.total) for r in counters.collect()}


def test_rules(spark):
    got, counters = run(
        spark,
        summary(),
        "not json",
        json.dumps({"not_applicable": {"is_na": True, "reason": ""}, "identity": NOBODY, "assessment": [], "response": [], "education": [], "risk_flags": []}),
        summary(assessment__turns=[9]),
        summary(assessment__quote="She took 5 mg of morphine."),
        summary(assessment__speaker="Nurse"),
        summary(assessment__text="Possible fever since 7:45."),
        summary(response__text="Will page the doctor.", response__quote="I already paged the doctor."),
        summary(assessment__text="Fever since 6:30.", assessment__facts=[{"type": "symptom", "name": "fever", "certainty": "stated"}]),
        summary(assessment__text="Cough was reported.", assessment__facts=[{"type": "pertinent_negative", "name": "cough", "certainty": "unclear"}]),
        summary(assessment__text=""),
        summary(assessment__quote="I think she had a fever since six thirty"),
        None,
    )
    assert got[0] == set()
    assert counters[("c0", "quote_exact")] == (3, 3) and counters[("c0", "numbers_in_window")][0] == counters[("c0", "numbers_in_window")][1] > 0
    assert got[1] == {("V1", "ERROR")} and got[12] == {("V1", "ERROR")}
    assert got[2] == {("V2", "ERROR")}
    assert ("V3", "ERROR") in got[3]
    assert ("V4", "ERROR") in got[4]
    assert got[5] == {("V5", "WARN")}
    assert ("V6", "ERROR") in got[6]
    assert got[7] == {("V10", "ERROR")}
    assert got[8] == {("V11", "WARN")}
    assert got[9] == {("V12", "ERROR")}
    assert ("V16", "ERROR") in got[10]
    assert got[11] == {("V4", "WARN")}


def test_rules_with_drugs(spark):
    flag = lambda category: {"category": category, "turns": [2], "quote": "a fever since six thirty"}
    med = {"type": "medication", "certainty": "stated"}
    na = {"not_applicable": {"is_na": True, "reason": "wrong number"}, "identity": NOBODY, "assessment": [], "response": [], "education": [], "risk_flags": []}
    got, counters = run(
        spark,
        summary(),
        summary(assessment__facts=[med | {"name": "digoxin"}]),
        summary(assessment__facts=[med | {"name": "morfine"}]),
        summary() | {"risk_flags": [flag("suicidal_statement")]},
        na,
        summary() | {"response": []},
        summary(assessment__text="A seizure was reported, possibly."),
        drugs=["morphine", "digoxin"],
    )
    assert got[0] == set()
    assert got[1] == {("V7", "ERROR")} and got[2] == {("V7", "WARN")}
    assert got[3] == {("V13", "WARN")} and got[4] == {("V14", "ERROR")} and got[5] == {("V15", "WARN")} and got[6] == {("V8", "ERROR")}
    assert counters[("c1", "drugs_in_call")] == (0, 1)


def test_authored_calls(spark):
    from tests.calls import authored, documents
    from turnloom.sources.transcripts import calls_of, lenient_turns, strict_turns, target_summary

    calls = calls_of(documents(spark, [authored(f"va-{k:03}") for k in range(30)])).cache()
    assert calls.filter("_error is not null").count() == 0 and calls.count() == 30
    turns = strict_turns(calls)
    assert turns.count() == turns.select("call_id", "turn_id").distinct().count() == lenient_turns(calls).count() == 150
    gold = calls.select(F.lit("gold").alias("system"), "call_id", target_summary(F.col("gold")).alias("summary"))
    findings, counters = validate(gold, turns, ["morphine", "lorazepam", "acetaminophen", "warfarin"])
    by = {r["name"]: r for r in counters.groupBy("name").agg(F.sum("ok").alias("ok"), F.sum("total").alias("total")).collect()}
    for name in ("parse_ok", "schema_valid", "quote_valid", "turns_valid", "numbers_in_call"):
        assert by[name].ok == by[name].total > 0, name
    assert findings.filter("severity = 'ERROR'").count() == 0


def test_a_failing_rule_is_isolated(spark):
    """A rule that fails on one summary gives V0 there; all other rules, and the rule elsewhere, go on."""
    broken = Rule("V99", "fails on a text", lambda: ([F.when(F.col("text").contains("poison"), F.raise_error(F.lit("boom")).cast("array<struct<rule:string,severity:string,path:string,message:string>>")).otherwise(_finding(F.col("section") == "response", "V99", "INFO", F.col("path"), "seen"))], []))
    given = [summary(), summary(assessment__text="poison", assessment__quote="not said"), summary(assessment__text="")]
    s = spark.createDataFrame([("m", f"c{k}", json.dumps(t)) for k, t in enumerate(given)], "system string, call_id string, summary string")
    turns = spark.createDataFrame([(f"c{k}", *t) for k in range(3) for t in TURNS], "call_id string, turn_id int, speaker string, text string")
    findings, counters = validate(s, turns, rules=(*BULLET_RULES, broken))
    rows = findings.collect()
    by = {k: {r.rule for r in rows if r.call_id == k} for k in ("c0", "c1", "c2")}
    assert by["c0"] == {"V99"} and by["c1"] == {"V0", "V4"} and by["c2"] == {"V16", "V99"}
    assert [r.message for r in rows if r.rule == "V0"] == ["rule V99 failed on this summary"]
    assert {r.call_id: (r.ok, r.total) for r in counters.filter("name = 'quote_valid'").collect()} == {"c0": (3, 3), "c1": (2, 3), "c2": (3, 3)}
