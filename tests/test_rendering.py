"""Rendered summaries and checklist sentences, written out by hand."""

import json

from turnloom.operators import rendering as R


def field(value=None, certainty="stated", heard=()):
    return {"value": value, "certainty": certainty, "heard_as": list(heard)}


def call(**who):
    people = {k: field() for k in ("patient_name", "patient_dob", "caller_name", "relationship", "callback_phone")} | who
    entry = {"speaker": "Caller", "quote": "it hurts", "explanation": "Documents pain"}
    return {"not_applicable": {"is_na": False}, "identity": people, "chief_complaint": {"reason": "Pain.", **entry}, "assessment": [{"text": "Pain reported.", **entry}], "response": [], "education": None}


def test_rendered(spark):
    bare = "Patient name not provided, DOB not provided. Caller name not provided, relationship not provided, calling on their behalf, callback number not provided."
    given = [
        (call(), bare),
        (call(patient_name=field("Ann Lee"), patient_dob=field("1951-06-04"), relationship=field("self"), callback_phone=field("2025550101")), "Patient Ann Lee, DOB 06/04/1951, calling on own behalf, (202)-555-0101."),
        (call(patient_name=field("Ann", "unclear", ["Anne", "Jan"]), relationship=field("son", "unclear"), caller_name=field("Bo", "unclear"), patient_pronoun="her"), "Patient Ann (unclear; heard as Anne / Jan), DOB not provided. Patient's son (unclear), Bo (unclear), calling on her behalf, callback number not provided."),
        (call(patient_dob=field("June 4, 1951", "unclear", ["1951-06-05"]), callback_phone=field("555", "unclear", ["2025550101"])), "Patient name not provided, DOB 06/04/1951 (unclear; heard as 06/05/1951). Caller name not provided, relationship not provided, calling on their behalf, 555 (unclear; heard as (202)-555-0101)."),
        (call(patient_dob=field("some day")), bare),
        (call(patient_dob=field("1951-06-04", "unclear", ["June"])), None),
    ]
    texts = [json.dumps(c) for c, _ in given] + [json.dumps({"not_applicable": {"is_na": True, "reason": ""}}), "{}", "no json", None]
    rows = spark.createDataFrame([(k, t, "2000-01-01T14:41:00Z" if k else None) for k, t in enumerate(texts)], "id int, summary string, call_timestamp_utc string")
    got = {r.id: r.rendered for r in R.rendered(rows).collect()}
    said = '\n  Caller: "it hurts"\n  Explanation: Documents pain\n'
    for k, (_, sentence) in enumerate(given):
        at = "[2000-01-01 14:41 UTC]" if k else "[timestamp not provided]"
        whole = f"Chief Complaint\n{at}\n{sentence} Pain.{said}\nAssessment\n• Pain reported.{said}\nResponse\n• None documented during call.\n\nEducation\n• None documented during call.\n"
        assert got[k] == (whole if sentence else None)
    assert got[6] == "Not Applicable\n[2000-01-01 14:41 UTC]\nReason: Insufficient clinical content.\n" and [got[7], got[8], got[9]] == [None] * 3


def test_checklist(spark):
    items = [
        ("assessment", {"item_type": "symptom", "symptom_present": "true", "symptom_name": "pain", "trend": "worse", "severity": ""}, "Symptom present: pain, worse"),
        ("assessment", {"item_type": "pertinent_negative", "symptom_name": "fever"}, "Pertinent negative: fever"),
        ("assessment", {"item_type": "medication", "medication_name_true": "morphine", "dose": "5", "unit": "mg", "prn": "true", "medication_status": "ran", "supply_remaining": "3"}, "Medication: morphine, 5 mg, as needed, status: ran out, 3  remaining"),
        ("assessment", {"item_type": "vital", "vital_name": "pulse", "vital_value": "80"}, "Measurement: pulse 80"),
        ("assessment", {"item_type": "supply", "supply_item": "gloves", "supply_remaining": "None", "supply_unit": "boxes"}, "Supply: gloves, none remaining (boxes)"),
        ("assessment", {"item_type": "context", "caller_concern_text": "afraid"}, "Background: afraid"),
        ("response", {"action_type": "page_doctor", "action_status": "planned", "reason_or_trigger": "pain"}, "Nurse action (planned): page doctor, because pain"),
        ("education", {"education_type": "call_back", "instruction_content": "call us", "trigger_condition": "it gets worse"}, "Instruction given (call back): call us, when: it gets worse"),
    ]
    by = lambda s: [i for x, i, _ in items if x == s]
    rows = [("a", {"reason_for_call": "pain", "relevant_context": "new"}, by("assessment"), by("response"), by("education")), ("b", None, None, [], None)]
    maps = "array<map<string,string>>"
    df = spark.createDataFrame(rows, f"call_id string, chief_complaint map<string,string>, assessment {maps}, response {maps}, education {maps}")
    got = sorted((r.call_id, r.n, r.fact) for r in R.checklist(df).collect())
    assert got == [("a", k + 1, t) for k, t in enumerate(["Reason for call: pain (new)", *(t for _, _, t in items)])]
