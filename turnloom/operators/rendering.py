"""Summaries and checklist items as fixed-format text, as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnloom.functions import render as R
from turnloom.functions.text import tall_man

_IDENTITY = ("patient_name", "patient_dob", "caller_name", "relationship", "callback_phone")
_ENTRY = "struct<text: string, reason: string, speaker: string, quote: string, explanation: string>"
SUMMARY = (
    "not_applicable struct<is_na: boolean, reason: string>, identity struct<"
    + ", ".join(f"{k}: struct<value: string, certainty: string, heard_as: array<string>>" for k in _IDENTITY)
    + f", patient_pronoun: string>, chief_complaint {_ENTRY}, assessment array<{_ENTRY}>, response array<{_ENTRY}>, education array<{_ENTRY}>"
)
TITLES = {"assessment": "Assessment", "response": "Response", "education": "Education"}
EMPTY_SECTION = "• None documented during call."


def _given(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def _birth_date(c: Column) -> Column:
    """Month, day and year of a date in three parts; null for another text."""
    parts = F.split(c, "-")
    return F.when(F.size(parts) == 3, F.concat_ws("/", F.get(parts, F.lit(1)), F.get(parts, F.lit(2)), F.get(parts, F.lit(0))))


def _heard(field: Column, show: Callable[[Column], Column]) -> Column:
    """What follows an unclear value; null if something heard cannot be shown."""
    heard = F.transform(F.coalesce(field["heard_as"], F.array().cast("array<string>")), show)
    listed = F.when(~F.exists(heard, lambda h: h.isNull()), F.concat(F.lit(" (unclear; heard as "), F.array_join(heard, " / "), F.lit(")")))
    return F.when(~F.coalesce(field["certainty"] == "unclear", F.lit(False)), "").when(F.size(heard) == 0, " (unclear)").otherwise(listed)


def identity_sentence(identity: Column) -> Column:
    """Who calls about whom.

    Seven forms: patient, birth date and phone each given or not; the patient calls, a relation
    calls, or a caller of unknown relation does. A birth date in another writing is read if
    possible, else shown as not provided; one heard otherwise that cannot be shown makes the
    sentence null.
    """
    name, dob, caller, relation, phone = (identity[k] for k in _IDENTITY)
    same = lambda x: x
    value = lambda f: _given(f["value"])
    born = F.coalesce(_birth_date(value(dob)), _birth_date(R.any_date(value(dob))))
    patient = F.when(value(name).isNull(), "Patient name not provided").otherwise(F.concat(F.lit("Patient "), value(name), _heard(name, same)))
    birth = F.when(born.isNull(), ", DOB not provided").otherwise(F.concat(F.lit(", DOB "), born, _heard(dob, _birth_date)))
    number = F.when(value(phone).isNull(), "callback number not provided").otherwise(F.concat(R.phone(value(phone)), _heard(phone, R.phone)))
    who = F.when(value(caller).isNull(), "name not provided").otherwise(F.concat(value(caller), _heard(caller, same)))
    unsure = F.when(relation["certainty"] == "unclear", " (unclear)").otherwise("")
    behalf = F.concat(F.lit(", calling on "), F.coalesce(_given(identity["patient_pronoun"]), F.lit("their")), F.lit(" behalf, "), number, F.lit("."))
    return (
        F.when(value(relation) == "self", F.concat(patient, birth, F.lit(", calling on own behalf, "), number, F.lit(".")))
        .when(value(relation).isNotNull(), F.concat(patient, birth, F.lit(". Patient's "), value(relation), unsure, F.lit(", "), who, behalf))
        .otherwise(F.concat(patient, birth, F.lit(". Caller "), who, F.lit(", relationship not provided"), behalf))
    )


def call_time(c: Column) -> Column:
    """[2000-01-01 14:41 UTC] of an ISO text, by its own clock; null for a text that is none."""
    form = r"^(\d{4}-\d{2}-\d{2})[T ](\d{2}:\d{2}).*$"
    return F.when(_given(c).isNull(), "[timestamp not provided]").when(c.rlike(form), F.regexp_replace(c, form, "[$1 $2 UTC]"))


def _evidence(b: Column) -> Column:
    return F.concat(F.lit("\n  "), b["speaker"], F.lit(': "'), b["quote"], F.lit('"\n  Explanation: '), tall_man(b["explanation"]), F.lit("\n"))


def rendered(summaries: DataFrame, summary: str = "summary", timestamp: str = "call_timestamp_utc") -> DataFrame:
    """``summaries`` with ``rendered``: the text of a JSON summary; null where a part that must be shown is missing.

    A call that is not applicable shows its reason alone; a section without bullets says so; drug
    names get their fixed casing, quotes stay as they are.
    """
    s = F.from_json(F.col(summary), SUMMARY)
    rows = summaries.withColumn("__s", s)
    s, at = F.col("__s"), call_time(F.col(timestamp))
    na = F.coalesce(s["not_applicable"]["is_na"], F.lit(False))
    chief = s["chief_complaint"]

    def section(name: str) -> Column:
        items = F.transform(s[name], lambda b: F.concat(F.lit("• "), tall_man(b["text"]), _evidence(b)))
        whole = F.when(~F.exists(items, lambda t: t.isNull()), F.array_join(items, ""))
        return F.concat(F.lit(f"\n{TITLES[name]}\n"), F.when(F.coalesce(F.size(s[name]), F.lit(0)) < 1, EMPTY_SECTION + "\n").otherwise(whole))

    reason = F.coalesce(_given(s["not_applicable"]["reason"]), F.lit("Insufficient clinical content."))
    empty = F.concat(F.lit("Not Applicable\n"), at, F.lit("\nReason: "), reason, F.lit("\n"))
    head = F.concat(F.lit("Chief Complaint\n"), at, F.lit("\n"), F.when(s["identity"].isNotNull(), identity_sentence(s["identity"])), F.lit(" "), tall_man(chief["reason"]), _evidence(chief))
    return rows.withColumn("rendered", F.when(na, empty).otherwise(F.concat(head, *map(section, TITLES)))).drop("__s")


# Statuses that a checklist writes in other words.
STATUS_WORDS = {"ran": "ran out", "given_during_call": "given during the call"}


def checklist_sentence(section: Column, item: Column) -> Column:
    """One sentence for a fact-record item, a map of texts, of a section; parts that are not given are left out.

    In a map of texts a remaining supply of 0 reads as the text "0": none remaining.
    """
    get = lambda k: _given(F.try_element_at(item, F.lit(k)))
    shown = lambda k: F.coalesce(F.try_element_at(item, F.lit(k)), F.lit("None"))
    listed = lambda *parts: F.concat_ws(", ", *parts)
    plain = lambda c: F.replace(c, F.lit("_"), F.lit(" "))
    left = F.concat(get("supply_remaining"), F.lit(" "), F.coalesce(get("supply_unit"), F.lit("")), F.lit(" remaining"))

    present = F.when(F.lower(get("symptom_present")) == "true", "present").otherwise("absent")
    symptom = F.concat(F.lit("Symptom "), present, F.lit(": "), listed(*map(get, ("symptom_name", "severity", "body_location", "onset_or_duration", "trend"))))
    status = get("medication_status")
    worded = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in STATUS_WORDS.items() for x in kv)), status), status)
    dose = _given(F.replace(F.concat_ws(" ", get("dose"), get("unit")), F.lit(", "), F.lit(" ")))
    medication = listed(
        F.coalesce(get("medication_name_spoken"), get("medication_name_true")), get("strength"), dose, get("route"), get("frequency"),
        F.when(F.lower(get("prn")) == "true", "as needed"), F.concat(F.lit("status: "), worded), F.concat(F.lit("last dose: "), get("last_dose")),
        get("history_or_context_text"), left,
    )
    none_left = F.concat(F.lit("none remaining ("), shown("supply_unit"), F.lit(")"))
    supply = listed(get("supply_item"), F.when(F.lower(get("supply_remaining")).isin("none", "0"), none_left).otherwise(left))
    kind = get("item_type")
    assessment = (
        F.when(kind == "symptom", symptom)
        .when(kind == "pertinent_negative", F.concat(F.lit("Pertinent negative: "), listed(get("symptom_name"), get("history_or_context_text"))))
        .when(kind == "medication", F.concat(F.lit("Medication: "), medication))
        .when(kind == "vital", F.concat(F.lit("Measurement: "), shown("vital_name"), F.lit(" "), shown("vital_value")))
        .when(kind == "supply", F.concat(F.lit("Supply: "), supply))
        .otherwise(F.concat(F.lit("Background: "), listed(get("history_or_context_text"), get("caller_concern_text"))))
    )
    because, when = F.concat(F.lit("because "), get("reason_or_trigger")), F.concat(F.lit("when: "), get("trigger_condition"))
    action = listed(plain(shown("action_type")), get("recipient_or_target"), get("medication_name_spoken"), get("timeframe"), because)
    context = F.coalesce(F.concat(F.lit(" ("), get("relevant_context"), F.lit(")")), F.lit(""))
    return (
        F.when(section == "chief_complaint", F.concat(F.lit("Reason for call: "), shown("reason_for_call"), context))
        .when(section == "assessment", assessment)
        .when(section == "response", F.concat(F.lit("Nurse action ("), shown("action_status"), F.lit("): "), action))
        .otherwise(F.concat(F.lit("Instruction given ("), plain(shown("education_type")), F.lit("): "), listed(get("instruction_content"), when)))
    )


def checklist(calls: DataFrame, id_col: str = "call_id") -> DataFrame:
    """(id, n, fact): the numbered checklist of each fact record, the reason for the call first."""
    one = lambda section, item: F.struct(F.lit(section).alias("section"), item.alias("item"))
    head = F.filter(F.array(one("chief_complaint", F.col("chief_complaint"))), lambda x: x["item"].isNotNull())

    def part(section: str) -> Column:
        return F.coalesce(F.transform(F.col(section), lambda i: one(section, i)), F.slice(head, 1, 0))

    rows = calls.select(id_col, F.posexplode(F.concat(head, *map(part, TITLES))).alias("k", "x"))
    return rows.select(id_col, (F.col("k") + 1).alias("n"), checklist_sentence(F.col("x.section"), F.col("x.item")).alias("fact"))
