"""The identity rule on small calls, each with one fault."""

from pyspark.sql import functions as F

from tests.test_validation import NOBODY, TURNS, summary
from turnloom.operators.identity import date_state, phone_state, relationship_said
from turnloom.operators.validation import validate

SAID = [
    (5, "Caller", "My name is Anna Kowalska, I am her daughter. Mom was born on December eighth,"),
    (6, "Caller", "nineteen thirty three."),
    (7, "Nurse", "And your number?"),
    (8, "Caller", "It is two one two, five five five, zero one nine nine. Ask for Annah."),
]


def with_identity(**fields):
    given = {k: NOBODY[k] | {"value": v, "certainty": c, "turns": [5]} for k, (v, c) in fields.items()}
    return summary() | {"identity": NOBODY | given}


def test_identity_rule(spark):
    import json

    cases = {
        "fine": with_identity(caller_name=("Anna Kowalska", "unclear"), patient_dob=("1933-12-08", "stated"), relationship=("daughter", "stated"), callback_phone=("212-555-0199", "stated")),
        "empty": with_identity(patient_name=(None, "stated")),
        "unsaid": with_identity(patient_name=("Peter Brown", "stated")),
        "close": with_identity(caller_name=("Anna Kowalski", "unclear")),
        "drift": with_identity(caller_name=("Anna", "stated")),
        "date": with_identity(patient_dob=("1934-12-08", "stated")),
        "form": with_identity(patient_dob=("12/08/1933", "stated")),
        "phone": with_identity(callback_phone=("212-555-0198", "stated")),
        "kin": with_identity(relationship=("grandson", "stated")),
        "sure": with_identity(relationship=("daughter", "not_stated")),
        "na": with_identity(patient_dob=("1934-12-08", "stated")) | {"not_applicable": {"is_na": True, "reason": "x"}},
    }
    s = spark.createDataFrame([("m", k, json.dumps(v)) for k, v in cases.items()], "system string, call_id string, summary string")
    turns = spark.createDataFrame([(k, *t) for k in cases for t in TURNS + SAID], "call_id string, turn_id int, speaker string, text string")
    findings, counters = validate(s, turns)
    got = {}
    for r in findings.filter("rule = 'V9'").collect():
        got.setdefault(r.call_id, set()).add((r.path.removeprefix("identity."), r.severity))
    assert got == {
        "empty": {("patient_name", "ERROR")}, "unsaid": {("patient_name", "ERROR")}, "close": {("caller_name", "WARN")}, "drift": {("caller_name", "WARN")},
        "date": {("patient_dob", "ERROR")}, "form": {("patient_dob", "ERROR")}, "phone": {("callback_phone", "ERROR")}, "kin": {("relationship", "WARN")},
        "sure": {("relationship", "ERROR")},
    }
    sums = {r.call_id: (r.ok, r.total) for r in counters.filter("name = 'identity_supported'").collect()}
    assert sums["fine"] == (4, 4) and sums["date"] == (0, 1) and sums["kin"] == (0, 1) and "na" not in sums


def test_states(spark):
    ddl = "v string, call array<string>, near array<array<string>>"
    rows = [("1933-12-08", ["1933", "12", "8"], [["1933"], ["12", "8"]]), ("1933-12-08", ["1933", "12", "8"], [["1933", "12", "8", "4"]]), ("1933-12-8", ["1933", "12", "8"], []), ("2125550199", [], [["2125550199"]])]
    df = spark.createDataFrame(rows, ddl).select(date_state(F.col("v"), F.col("call"), F.col("near")).alias("d"), phone_state(F.col("v"), F.col("call"), F.col("near")).alias("p"))
    assert [(r.d, r.p) for r in df.collect()] == [("scattered", "bad"), ("ok", "bad"), ("bad", "bad"), ("bad", "ok")]
    kin = spark.createDataFrame([("paid aide", "the CNA came"), ("mother-in-law", "my mother in law"), ("son", "a person"), ("son", "my Dad"), (None, ""), ("a.b", "axb")], "r string, t string")
    assert [r.s for r in kin.select(relationship_said(F.col("r"), F.col("t")).alias("s")).collect()] == [True, True, False, True, True, False]
