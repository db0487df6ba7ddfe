"""Risk scan, medication check and formats."""

from pyspark.sql import functions as F

from turnloom.functions import render as R
from turnloom.operators.medication import medication_findings, spoken_drugs
from turnloom.operators.risk import clinical_score, first_flags, risk_scan

DRUGS = ["warfarin", "lisinopril", "morphine", "tylenol"]
DDL = "call_id string, turn_id int, speaker string, text string"


def test_risk_scan(spark):
    said = [
        ("a", 1, "Nurse", "Is he having trouble breathing?"),
        ("a", 2, "Caller", "No trouble breathing. He fell and hit his head last night."),
        ("b", 1, "Nurse", "How bad is the pain on a scale of zero to ten?"),
        ("b", 2, "Caller", "It's an eight."),
        ("c", 1, "Nurse", "Call 911 right away if you get chest pain."),
        ("c", 2, "Caller", "Okay, chest pain, I will."),
        ("d", 1, "Caller", "She ran out of her pills. She said she wants to die."),
        ("e", 1, "Caller", "She ran out of milk."),
        ("f", 1, "Caller", "Years ago he had a seizure."),
        ("g", 1, "Nurse", "I'm calling 911 now."),
    ]
    hits = risk_scan(spark.createDataFrame(said, DDL), DRUGS)
    got = {(r.call_id, r.category) for r in hits.collect()}
    assert got == {("a", "other_urgent"), ("b", "uncontrolled_symptom"), ("d", "medication_concern"), ("d", "suicidal_statement"), ("g", "escalation_request")}
    assert first_flags(hits).count() == 5
    scores = {r.call_id: r.score for r in clinical_score(spark.createDataFrame(said, DDL), DRUGS).collect()}
    assert scores["e"] == 0 and scores["d"] >= 1


def test_medication_check(spark):
    turns = spark.createDataFrame([("a", 1, "Caller", "He takes warfarin five milligrams."), ("a", 2, "Caller", "And lisinopril 10, and Tylenol twice, one of them."), ("b", 1, "Nurse", "Any morphine?")], DDL)
    said = {(r.call_id, r.drug): r.expected for r in spoken_drugs(turns, DRUGS).collect()}
    assert said == {("a", "warfarin"): True, ("a", "lisinopril"): True, ("a", "tylenol"): True, ("b", "morphine"): False}
    bullets = spark.createDataFrame([("a", 0, "Takes warfarin 5 mg daily.", []), ("a", 1, "Acetaminophen given.", ["acetaminophen"])], "call_id string, ord int, text string, names array<string>")
    got = {(r.rule, r.drug, r.dose, r.unit) for r in medication_findings(bullets, turns, DRUGS).collect()}
    assert got == {("M1", "warfarin", "5", "mg"), ("M3", "lisinopril", None, None)}


def test_formats(spark):
    row = spark.range(1).select(
        R.birth_date(F.lit("1951-06-04")).alias("dob"), R.phone(F.lit("2025550101")).alias("phone"), R.timestamp(F.lit("2000-01-01T14:41:00Z")).alias("at"),
        R.any_date(F.lit("March 3rd, 1940")).alias("d1"), R.any_date(F.lit("03/04/1940")).alias("d2"), R.any_date(F.lit("soon")).alias("d3"),
        R.bullets(F.array(F.lit("x"), F.lit("y"))).alias("b"),
    ).first()
    assert (row.dob, row.phone, row.at) == ("06/04/1951", "(202)-555-0101", "[2000-01-01 14:41 UTC]")
    assert (row.d1, row.d2, row.d3, row.b) == ("1940-03-03", "1940-03-04", None, "- x\n- y")
