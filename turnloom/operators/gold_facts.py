"""Gold checks of facts: numbers and drugs by evidence, attributes by the record's items, identity, tags."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnloom.functions import text as T
from turnloom.functions.spoken import number_candidates_udf
from turnloom.operators.first_match import differing, first_match
from turnloom.operators.relational import texts_of
from turnloom.sources.shared import worked_out

SECTIONS = ("assessment", "response", "education")
# Fields with numbers, fields of a medication, wording of plans, tags of identity.
NUMBER_FIELDS = ("dose", "strength", "severity", "value", "supply", "quantity", "last_dose", "frequency", "timeframe")
MEDICATION_FIELDS = ("strength", "dose", "unit", "route", "frequency", "prn")
PLAN_WORDS = r"(?i)\b(plan|planned|plans|will|would|to be|going to|to follow|pending|later|intends?)\b"
IDENTITY_TAGS = ("patient_name", "patient_dob", "caller_name", "relationship", "callback_phone")
_FACT = ", ".join(f"{c}: string" for c in dict.fromkeys(("type", "name", "certainty", "present", "status", "action_type", "education_type", "medication", *NUMBER_FIELDS, *MEDICATION_FIELDS)))
_BULLET = f"struct<text:string,reason:string,speaker:string,turns:array<int>,covers:array<string>,facts:array<struct<{_FACT}>>>"
_FIELD = "struct<value:string,certainty:string,turns:array<int>>"
GOLD = (
    f"not_applicable struct<is_na:boolean>, chief_complaint {_BULLET}, "
    + ", ".join(f"{s} array<{_BULLET}>" for s in SECTIONS)
    + f", identity struct<{', '.join(f'{k}:{_FIELD}' for k in IDENTITY_TAGS)}, patient_pronoun:string>"
)
#: The record's value and certainty of each field of identity.
RECORD = {
    "patient_name": ("patient_name_spoken", "patient_name_certainty"),
    "patient_dob": ("patient_dob_spoken", "patient_dob_certainty"),
    "caller_name": ("caller_name_spoken", "caller_name_certainty"),
    "relationship": ("relationship_to_patient", "relationship_certainty"),
    "callback_phone": ("callback_phone_spoken", "callback_phone_certainty"),
}


def _said(rows: DataFrame, when: Column, code: str, *message: Column | str, level: str = "ERROR") -> DataFrame:
    parts = [F.lit(m) if isinstance(m, str) else F.coalesce(m.cast("string"), F.lit("none")) for m in message]
    return rows.filter(F.coalesce(when, F.lit(False))).select("call_id", F.lit(level).alias("level"), F.lit(code).alias("code"), F.concat(*parts).alias("message"))


def _plain(c: Column) -> Column:
    return T.normalize(F.coalesce(c, F.lit("")))


def _calls(calls: DataFrame, turns: DataFrame) -> DataFrame:
    """Calls with ``g`` (gold), ``items`` (the record's, in order), ``texts`` and ``tagged`` (tag and turn)."""
    heard = turns.groupBy("call_id").agg(F.array_sort(F.collect_list(F.struct("turn_id", "text", "tags"))).alias("t"))
    tagged = F.flatten(F.transform("t", lambda x: F.transform(x["tags"], lambda tag: F.struct(tag.alias("tag"), x["turn_id"].alias("turn")))))
    none = F.array().cast("array<map<string,string>>")
    items = F.flatten(F.array(*(F.coalesce(F.col(s), none) for s in SECTIONS)))
    rows = calls.withColumn("g", F.from_json("gold", GOLD)).withColumn("items", items).join(heard, "call_id")
    return rows.withColumn("texts", F.col("t.text")).withColumn("tagged", tagged)


def _bullets(c: DataFrame) -> DataFrame:
    """call_id, label, b, evidence (the cited turns and those tagged with what the bullet covers), ev_text, items covered in order."""
    one = lambda label, b: F.struct(label.alias("label"), b.alias("b"))
    head = F.filter(F.array(one(F.lit("chief_complaint"), F.col("g.chief_complaint"))), lambda x: x["b"].isNotNull())
    part = lambda s: F.coalesce(F.transform(f"g.{s}", lambda b, i: one(F.concat(F.lit(f"{s}["), i, F.lit("]")), b)), F.slice(head, 1, 0))
    live = c.filter(~F.coalesce("g.not_applicable.is_na", F.lit(False)))
    rows = live.select("call_id", "items", "texts", "tagged", F.inline(F.concat(head, *map(part, SECTIONS))))
    covers = F.coalesce("b.covers", F.array().cast("array<string>"))
    by_tag = F.transform(F.filter("tagged", lambda p: F.array_contains(covers, p["tag"])), lambda p: p["turn"])
    rows = rows.withColumn("evidence", F.array_sort(F.array_distinct(F.concat(F.coalesce("b.turns", F.array().cast("array<int>")), by_tag))))
    covered = F.flatten(F.transform(covers, lambda k: F.filter("items", lambda i: i["item_id"] == k)))
    return rows.withColumn("ev_text", texts_of(F.col("evidence"), F.col("texts"))).withColumn("covered", covered)


def _keys() -> list[tuple[Column, Column]]:
    """Keys of a fact ``f`` and an item ``i`` from the strictest: an action with its status comes before one without."""
    f, i = F.col("f"), F.col("i")
    of = lambda kind, when, *parts: F.when(when, F.concat(F.lit(kind), *(F.concat(F.lit("|"), F.coalesce(p, F.lit("-"))) for p in parts)))
    action, drug = f["type"] == "action", _plain(f["medication"]) != ""
    spoken = _plain(i["medication_name_spoken"])
    return [
        (of("med", f["type"] == "medication", _plain(f["name"])), of("med", spoken != "", spoken)),
        (of("sym", f["type"].isin("symptom", "pertinent_negative"), _plain(f["name"])), of("sym", _plain(i["symptom_name"]) != "", _plain(i["symptom_name"]))),
        (of("actds", action & drug, f["action_type"], _plain(f["medication"]), f["status"]), of("actds", i["action_type"].isNotNull(), i["action_type"], spoken, i["action_status"])),
        (of("actd", action & drug, f["action_type"], _plain(f["medication"])), of("actd", i["action_type"].isNotNull(), i["action_type"], spoken)),
        (of("acts", action & ~drug, f["action_type"], f["status"]), of("acts", i["action_type"].isNotNull(), i["action_type"], i["action_status"])),
        (of("act", action & ~drug, f["action_type"]), of("act", i["action_type"].isNotNull(), i["action_type"])),
        (of("edu", f["type"] == "education", f["education_type"]), of("edu", i["education_type"].isNotNull(), i["education_type"])),
    ]


def fact_findings(calls: DataFrame, turns: DataFrame) -> DataFrame:
    """call_id, level, code, message: G3 numbers, G4 drugs, G5 fields and identity, G6 actions, education and wording.

    ``calls`` as of ``calls_of``, ``turns`` as of ``strict_turns``. Not-Applicable calls are left out but for
    their identity. Every fact takes the first item that its bullet covers by its key.
    """
    c = worked_out(_calls(calls, turns))
    b = worked_out(_bullets(c))
    said = F.coalesce(F.when(F.col("label") == "chief_complaint", F.col("b.reason")).otherwise(F.col("b.text")), F.lit(""))
    numbered = b.select("call_id", "label", said.alias("said"), F.col("b.facts").alias("facts"), number_candidates_udf("ev_text").alias("heard"))
    lost = lambda text: F.filter(T.numbers_in(text), lambda x: ~T.supported(x, F.col("heard")))
    out = [_said(numbered.withColumn("x", F.explode(lost(F.col("said")))), F.lit(True), "G3", F.col("label"), ": number ", F.col("x"), " is not in the evidence")]
    values = numbered.select("call_id", "label", "heard", F.explode("facts").alias("f"))
    values = values.select("call_id", "label", "heard", F.col("f.type").alias("type"), F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.col(f"f.{k}").alias("v")) for k in NUMBER_FIELDS))).alias("x"))
    values = values.filter("x.v IS NOT NULL AND x.v NOT IN ('true', 'false') AND NOT array_contains(heard, x.v)").withColumn("n", F.explode(lost(F.col("x.v"))))
    out.append(_said(values, F.lit(True), "G3", F.col("label"), ": ", F.col("type"), ".", F.col("x.k"), " number ", F.col("n"), " is not in the evidence"))

    real = b.filter("label <> 'chief_complaint'")
    facts = real.select("call_id", "label", _plain(F.col("ev_text")).alias("heard"), F.posexplode("b.facts").alias("k", "f"))
    items = real.select("call_id", "label", F.posexplode("covered").alias("k", "i"))
    m = worked_out(first_match(facts, items, ["call_id", "label"], _keys(), "k", "k"))
    f, i, label = F.col("f"), F.col("item.i"), F.col("label")
    medication, symptom = f["type"] == "medication", f["type"].isin("symptom", "pertinent_negative")
    drug = F.when(medication, f["name"]).when(f["type"] == "action", f["medication"])
    found = F.col("item").isNotNull()
    sure = F.coalesce(i["certainty"], F.lit("stated"))
    out += [
        _said(m, (F.coalesce(drug, F.lit("")) != "") & ~F.contains(F.col("heard"), _plain(drug)), "G4", label, ": drug ", drug, " is not in the evidence"),
        _said(m, medication & ~found, "G4", label, ": medication ", f["name"], " is no covered item"),
        _said(m, medication & found & ~f["certainty"].eqNullSafe(sure), "G4", label, ": certainty of ", f["name"], " differs from the record"),
        _said(m, symptom & ~found, "G5", label, ": symptom ", f["name"], " is no covered item"),
        _said(m, symptom & found & ~f["certainty"].eqNullSafe(sure), "G5", label, ": certainty of ", f["name"], " differs from the record"),
        _said(m, symptom & found & ((F.coalesce(i["symptom_present"], F.lit("true")) != "false") != ((f["type"] == "symptom") & (F.coalesce(f["present"], F.lit("true")) != "false"))), "G5", label, ": presence of ", f["name"], " differs from the record"),
        _said(m, symptom & found & i["severity"].isNotNull() & (_plain(i["severity"]) != _plain(f["severity"])), "G5", label, ": severity of ", f["name"], " differs from the record"),
        _said(m, (f["type"] == "action") & ~found, "G6", label, ": action ", f["action_type"], " is no covered item"),
        _said(m, (f["type"] == "action") & F.col("priority").isin(4, 6), "G6", label, ": status of action ", f["action_type"], " differs from the record"),
        _said(m, (f["type"] == "education") & ~found, "G6", label, ": education ", f["education_type"], " is no covered item"),
    ]
    fields = F.struct(*(F.try_element_at(i, F.lit(k)).alias(k) for k in MEDICATION_FIELDS))
    unlike = m.filter(medication & found).withColumn("d", F.explode(differing(f, fields, {k: k for k in MEDICATION_FIELDS})))
    out.append(_said(unlike, F.lit(True), "G5", label, ": ", F.col("d.field"), " of ", f["name"], " differs from the record"))
    states = F.array_distinct(F.transform(F.filter("b.facts", lambda x: x["type"] == "action"), lambda x: x["status"]))
    worded = real.withColumn("states", states)
    out += [
        _said(worded, F.array_contains("states", "planned") & ~F.coalesce("b.text", F.lit("")).rlike(PLAN_WORDS), "G6", label, ": a planned action without the wording of a plan"),
        _said(worded, (F.col("states") == F.array(F.lit("completed"))) & F.col("b.text").rlike(r"(?i)\bplanned\b"), "G6", label, ": a completed action worded as planned"),
    ]

    cc = F.col("chief_complaint")
    cells = F.array(*(F.struct(F.lit(k).alias("k"), F.col(f"g.identity.{k}").alias("gold"), cc[v].alias("value"), cc[s].alias("sure")) for k, (v, s) in RECORD.items()))
    idn = c.select("call_id", "texts", F.explode(cells).alias("x")).select("call_id", "x.*", texts_of(F.coalesce("x.gold.turns", F.array().cast("array<int>")), F.col("texts")).alias("cited"))
    idn = idn.withColumn("cands", number_candidates_udf("cited")).withColumn("words", F.split(F.concat_ws(" ", T.normalize(T.collapse_spelled(F.col("cited"))), T.normalize(F.col("cited"))), " "))
    key, value = F.col("k"), F.col("value")
    certain = F.coalesce("sure", F.when(value.isNull(), "not_stated").otherwise("stated"))
    given = value.isNotNull() & ~((key == "relationship") & (value == "self"))
    cites = F.size(F.coalesce("gold.turns", F.array().cast("array<int>"))) > 0
    parts = F.transform(F.split(value, "-"), lambda p: F.regexp_replace(p, "^0+", ""))
    names = key.isin("patient_name", "caller_name")
    out += [
        _said(idn, _plain(F.col("gold.value")) != _plain(value), "G5", "identity.", key, " differs from the record"),
        _said(idn, ~F.col("gold.certainty").eqNullSafe(certain), "G5", "identity.", key, ": certainty differs from the record"),
        _said(idn, given & ~cites, "G5", "identity.", key, " cites no turn"),
        _said(idn, given & cites & names & (F.size(F.array_except(F.split(T.normalize(value), " "), F.col("words"))) > 0), "G5", "identity.", key, ": a part is not in the cited turns"),
        _said(idn, given & cites & (key == "patient_dob") & (F.size(F.array_except(parts, F.col("cands"))) > 0), "G5", "identity.", key, ": a part is not in the cited turns"),
        _said(idn, given & cites & (key == "callback_phone") & ~F.array_contains("cands", value), "G5", "identity.", key, " is not in the cited turns"),
        _said(c, ~F.nullif(F.col("g.identity.patient_pronoun"), F.lit("")).eqNullSafe(F.nullif(cc["patient_pronoun"], F.lit(""))), "G5", "identity.patient_pronoun differs from the record"),
    ]
    return reduce(DataFrame.unionByName, out)


def tag_findings(calls: DataFrame, turns: DataFrame, drugs: list[str]) -> DataFrame:
    """call_id, level, code, message: G10 tags and noise against the record, G11 drugs in turns without an item's tag."""
    c = worked_out(_calls(calls, turns))
    flags = F.coalesce(F.transform("risk_flags", lambda x: x["flag_id"]), F.array().cast("array<string>"))
    ids = F.transform("items", lambda x: x["item_id"])
    c = c.withColumn("flag_ids", flags).withColumn("item_ids", ids).withColumn("used", F.array_distinct(F.transform("tagged", lambda p: p["tag"])))
    known = F.concat("item_ids", "flag_ids", F.array(*map(F.lit, (*IDENTITY_TAGS, "cc"))))
    each = c.select("call_id", "texts", "tagged", "used", F.explode("items").alias("i"))
    at = F.transform(F.filter("tagged", lambda p: p["tag"] == F.col("i")["item_id"]), lambda p: p["turn"])
    each = each.withColumn("said", _plain(texts_of(at, F.col("texts")))).withColumn("is_tagged", F.array_contains("used", F.col("i")["item_id"]))
    med, item = F.col("i")["medication_name_spoken"], F.col("i")["item_id"]
    cc = F.col("chief_complaint")
    identity = F.filter(F.array(*(F.when(F.coalesce(cc[RECORD[k][0]], F.lit("")) != "", F.lit(k)) for k in IDENTITY_TAGS if k != "relationship")), lambda k: k.isNotNull())
    strange = c.select("call_id", F.explode("tagged").alias("p"), known.alias("known")).filter(~F.array_contains("known", F.col("p.tag")))
    noise = c.select("call_id", "texts", F.explode("noise_events").alias("e")).withColumn("turn", F.col("e")["turn"].cast("int"))
    noise = noise.withColumn("heard", F.get("texts", F.col("turn") - 1))
    forms = F.filter(F.transform(F.split(F.coalesce(F.col("e")["heard_form"], F.lit("")), "/"), lambda x: T.normalize(x)), lambda x: x != "")
    hears = F.exists(forms, lambda x: F.contains(_plain(F.col("heard")), x) | F.contains(T.normalize(T.collapse_spelled(F.coalesce("heard", F.lit("")))), x))
    events = F.coalesce(F.size("noise_events"), F.lit(0))
    category = F.col("setup")["scenario_category"]
    out = [
        _said(each, ~F.col("is_tagged"), "G10", "item ", item, " is tagged on no turn"),
        _said(each, F.col("is_tagged") & (F.coalesce(med, F.lit("")) != "") & ~F.contains(F.col("said"), _plain(med)), "G10", "item ", item, ": ", med, " is not in its tagged turns"),
        _said(c.withColumn("x", F.explode(F.array_except("flag_ids", "used"))), F.lit(True), "G10", "flag ", F.col("x"), " is tagged on no turn"),
        _said(c, ~category.eqNullSafe(F.lit("not_applicable")) & ~F.array_contains("used", "cc"), "G10", "no turn is tagged 'cc'"),
        _said(c.withColumn("x", F.explode(F.array_except(identity, F.col("used")))), F.lit(True), "G10", "identity ", F.col("x"), " has a value but no tagged turn"),
        _said(strange, F.lit(True), "G10", "turn ", F.col("p.turn"), ": unknown tag ", F.col("p.tag")),
        _said(noise, F.col("heard").isNull(), "G10", "a noise event is on the missing turn ", F.col("turn")),
        _said(noise, F.col("heard").isNotNull() & (F.size(forms) > 0) & ~hears, "G10", "turn ", F.col("turn"), " does not have the heard form"),
        _said(c, events != F.coalesce(F.col("setup")["noise_event_count"].cast("int"), events), "G10", "the count of noise events differs from the logged ones", level="WARN"),
    ]
    names = sorted({plain_name(d) for d in drugs if d}, key=lambda d: (-len(d), d))
    spoken = F.regexp_extract_all(F.concat(F.lit(" "), T.normalize(F.col("t.text")), F.lit(" ")), F.lit(r"(?<= )(" + "|".join(map(re.escape, names)) + r")(?= )"), 1)
    distract = F.transform(F.coalesce(F.from_json(F.col("setup")["distractor_meds"], "array<string>"), F.array().cast("array<string>")), lambda x: T.normalize(x))
    free = c.select("call_id", "item_ids", distract.alias("distract"), F.explode("t").alias("t")).filter(~F.arrays_overlap("item_ids", F.coalesce("t.tags", F.array().cast("array<string>"))) | (F.size("item_ids") == 0))
    loose = free.withColumn("drug", F.explode(F.array_except(F.array_distinct(spoken), F.col("distract"))))
    out.append(_said(loose, F.lit(True), "G11", "turn ", F.col("t.turn_id"), ": drug ", F.col("drug"), " in a turn without an item's tag", level="WARN"))
    return reduce(DataFrame.unionByName, out)


def plain_name(text: str) -> str:
    return " ".join(re.sub(r"[^a-z0-9]+", " ", text.lower()).split())
