"""Authored calls as JSON documents, one of each kind that the sources, gold checks and studies read."""

import json

from tests.test_validation import TURNS, summary

FILLER = "Let me write that down for you before we go on with the next point. "


def authored(call_id, split="val", **setup):
    """A whole call: the record's items, the transcript and the gold summary that covers each item."""
    gold = summary()
    gold["chief_complaint"]["covers"] = ["cc"]
    for section, item in (("assessment", "A1"), ("response", "R1")):
        gold[section][0]["covers"] = [item]
    lines = [f"{speaker} -> {text}" for _, speaker, text in TURNS] + [f"Nurse -> {FILLER * 30} || small_talk"]
    return {
        "call_id": call_id,
        "split": split,
        "setup": {"scenario_category": "routine", "length_bucket": "short"} | setup,
        "chief_complaint": {"patient_name_true": f"Name of {call_id}"},
        "assessment": [{"item_id": "A1", "type": "symptom", "name": "fever"}],
        "response": [{"item_id": "R1", "type": "action", "status": "completed"}],
        "education": [],
        "risk_flags": [],
        "transcript": "\n".join(lines),
        "gold": json.dumps(gold),
    }


def documents(spark, calls):
    return spark.createDataFrame([(json.dumps(c),) for c in calls], "raw string")
