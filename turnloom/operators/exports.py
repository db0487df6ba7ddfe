"""Frames for export sheets, status payloads and training examples: one view each, written by any sink."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnloom.operators.gold_facts import GOLD, RECORD, SECTIONS

#: Keys of an item that are no detail of it.
_SKIPPED = ("item_id", "item_type", "certainty", "reporter", "actor", "speaker")
_NONE = ("", "[]", "false")


def _listed(json_text: Column) -> Column:
    """A JSON list as 'a; b', any other text as it is."""
    items = F.from_json(json_text, "array<string>")
    return F.when(F.startswith(json_text, F.lit("[")), F.array_join(items, "; ")).otherwise(json_text)


def _given(item: Column, key: str) -> Column:
    """A key's value, the key itself for 'true', null where there is nothing."""
    value = F.try_element_at(item, F.lit(key))
    return F.when(value.isNull() | value.isin(*_NONE), F.lit(None)).when(value == "true", F.lit(key)).otherwise(_listed(value))


def item_headline(item: Column, section: Column) -> tuple[Column, Column]:
    """(headline, details) of a record item by its section and type: what names it, and all its other keys in order of key."""
    kind, joined = item["item_type"], lambda *keys: F.concat_ws(" ", *(_given(item, k) for k in keys))
    of = lambda *keys: F.array(*map(F.lit, keys))
    symptom, drug = F.coalesce(item["symptom_name"], F.lit("None")), F.coalesce(_given(item, "medication_name_spoken"), _given(item, "medication_name_true"), F.lit("None"))
    prn = F.when(F.coalesce(item["prn"], F.lit("")) == "true", "PRN")
    state = F.when(_given(item, "medication_status").isNotNull(), F.concat(F.lit("["), item["medication_status"], F.lit("]")))
    dose = ("strength", "dose", "unit", "route", "frequency")
    assessed = (
        F.when(kind == "symptom", F.concat(symptom, F.when(F.coalesce(item["symptom_present"], F.lit("false")) == "true", " (present)").otherwise(" (absent)")))
        .when(kind == "pertinent_negative", F.concat(F.lit("No "), symptom))
        .when(kind == "medication", F.concat_ws(" ", drug, *(_given(item, k) for k in dose), prn, state))
        .when(kind == "supply", joined("supply_item", "supply_remaining", "supply_unit"))
        .when(kind == "vital", joined("vital_name", "vital_value"))
        .otherwise(joined("history_or_context_text", "caller_concern_text"))
    )
    used = (
        F.when(kind.isin("symptom", "pertinent_negative"), of("symptom_name", "symptom_present"))
        .when(kind == "medication", of("medication_name_spoken", "medication_name_true", "prn", "medication_status", *dose))
        .when(kind == "supply", of("supply_item", "supply_remaining", "supply_unit"))
        .when(kind == "vital", of("vital_name", "vital_value"))
        .otherwise(of("history_or_context_text", "caller_concern_text"))
    )
    acted = ("action_type", "action_status", "recipient_or_target", "timeframe")
    taught = F.concat_ws(": ", _given(item, "education_type"), _given(item, "instruction_content"))
    head = F.when(section == "assessment", assessed).when(section == "response", joined(*acted)).otherwise(taught)
    used = F.when(section == "assessment", used).when(section == "response", of(*acted)).otherwise(of("education_type", "instruction_content"))
    left = F.map_filter(item, lambda k, v: v.isNotNull() & ~v.isin(*_NONE) & ~k.isin(*_SKIPPED) & ~F.array_contains(used, k))
    rest = F.transform(F.array_sort(F.map_entries(left)), lambda e: F.concat(e["key"], F.lit(": "), _listed(e["value"])))
    return F.trim(head), F.array_join(rest, "; ")


def _or_empty(name: str) -> Column:
    return F.coalesce(F.col(name), F.array().cast("array<map<string,string>>"))


def call_sheet(calls: DataFrame, turns: DataFrame) -> DataFrame:
    """One row a call: its setup, sizes, numbers of items and reason."""
    n = turns.groupBy("call_id").agg(F.count(F.lit(1)).alias("turns"))
    s, cc = F.col("setup"), F.col("chief_complaint")
    keys = ("scenario_category", "subtype", "agency_name", "agency_type", "relationship_group", "patient_age_group", "length_bucket")
    blueprint = F.get_json_object("raw", "$.blueprint")
    return calls.join(n, "call_id", "left").select(
        "call_id", "split", *(s[k].alias(k) for k in keys), F.coalesce("turns", F.lit(0)).alias("turns"), F.length("transcript").alias("characters"), s["asr_noise_level"].alias("asr_noise_level"),
        F.size(_or_empty("noise_events")).alias("noise_events"), F.array_join(F.transform(_or_empty("risk_flags"), lambda f: f["risk_category"]), "; ").alias("risk_flags"),
        *(F.size(_or_empty(k)).alias(f"{k}_items") for k in SECTIONS), _listed(s["secondary_tags"]).alias("tags"),
        cc["patient_name_true"].alias("patient"), cc["caller_name_true"].alias("caller"), cc["reason_for_call"].alias("reason"), blueprint.alias("blueprint"),
    )


def _evidence(calls: DataFrame) -> DataFrame:
    """(call_id, item, speaker, quote, turns): the last bullet that covers each item."""
    g = calls.select("call_id", F.from_json("gold", GOLD.replace("turns:array<int>,covers", "turns:array<int>,quote:string,covers")).alias("g"))
    one = lambda b: F.struct(*(b[k].alias(k) for k in ("speaker", "quote", "turns", "covers")))
    parts = [F.filter(F.array(one(F.col("g.chief_complaint"))), lambda x: x["covers"].isNotNull())]
    parts += [F.coalesce(F.transform(f"g.{s}", one), F.slice(parts[0], 1, 0)) for s in SECTIONS]
    rows = g.select("call_id", F.posexplode(F.concat(*parts)).alias("place", "b")).select("call_id", "place", "b", F.explode("b.covers").alias("item"))
    last = rows.groupBy("call_id", "item").agg(F.max_by("b", "place").alias("b"))
    return last.select("call_id", "item", "b.speaker", "b.quote", F.array_join("b.turns", "; ").alias("turns"))


def fact_sheet(calls: DataFrame) -> DataFrame:
    """One row a fact, in the record's order (``place``): section, item, type, fact, details, certainty, speaker, quote, turns."""
    cc, setup = F.col("chief_complaint"), F.col("setup")
    text = lambda c: F.coalesce(c, F.lit(""))
    row = lambda section, item, kind, fact, details, sure, who: F.struct(*(v.alias(n) for v, n in zip((section, item, kind, fact, details, sure, who), ("section", "item", "type", "fact", "details", "certainty", "speaker"), strict=True)))
    lit, empty = F.lit, F.lit("")
    labels = {"patient_name": "Patient name", "patient_dob": "Date of birth", "caller_name": "Caller name", "callback_phone": "Callback phone"}

    def identity(key: str) -> Column:
        heard = text(_listed(cc[f"{key}_heard_as"]))
        said = F.concat(lit("spoken: "), F.coalesce(cc[f"{key}_spoken"], lit("None")), F.when(heard != "", F.concat(lit("; heard as: "), heard)).otherwise(empty))
        return row(lit("Identity"), lit(key), lit(labels[key]), F.coalesce(F.nullif(cc[f"{key}_true"], empty), lit("(not stated)")), said, text(cc[f"{key}_certainty"]), empty)

    na = row(lit("Identity"), lit("-"), lit("not applicable"), text(setup["na_reason"]), empty, empty, empty)
    who = [*(identity(k) for k in labels), row(lit("Identity"), lit("relationship"), lit("Relationship"), text(cc["relationship_to_patient"]), empty, text(cc[RECORD["relationship"][1]]), empty)]
    chief = row(lit("Chief complaint"), lit("cc"), text(cc["reason_category"]), text(cc["reason_for_call"]), text(cc["relevant_context"]), lit("stated"), empty)

    def item(section: str):
        def one(i: Column) -> Column:
            head, rest = item_headline(i, lit(section))
            return row(lit(section.capitalize()), i["item_id"], F.coalesce(i["item_type"], i["action_type"], i["education_type"], empty), head, rest, text(i["certainty"]), empty)

        return one

    flag = lambda f: row(lit("Risk flag"), f["flag_id"], text(f["risk_category"]), text(f["trigger_description"]), F.concat(lit("required: "), F.coalesce(f["flag_required"], lit("None"))), empty, text(f["trigger_speaker"]))
    first = F.when(setup["scenario_category"].eqNullSafe(lit("not_applicable")), F.array(na)).otherwise(F.array(*who))
    every = F.concat(first, F.array(chief), *(F.transform(_or_empty(s), item(s)) for s in SECTIONS), F.transform(_or_empty("risk_flags"), flag))
    rows = calls.select("call_id", "split", F.posexplode(every).alias("place", "r")).select("call_id", "split", "place", "r.*")
    met = rows.join(_evidence(calls).withColumnRenamed("speaker", "said_by"), ["call_id", "item"], "left")
    return met.select("call_id", "split", "place", "section", "item", "type", "fact", "details", "certainty", F.coalesce(F.nullif("speaker", empty), "said_by", empty).alias("speaker"), F.coalesce("quote", empty).alias("quote"), F.coalesce("turns", empty).alias("turns"))


def _events(calls: DataFrame) -> DataFrame:
    s = F.col("setup")
    rows = calls.select("call_id", "split", s["scenario_category"].alias("category"), s["asr_noise_level"].alias("asr_noise_level"), F.posexplode(_or_empty("noise_events")).alias("place", "e"))
    return rows.withColumn("turn_id", F.col("e")["turn"].cast("int"))


def transcript_sheet(calls: DataFrame, turns: DataFrame) -> DataFrame:
    """One row a turn: speaker, text, tags and the noise logged on it."""
    e = F.col("e")
    note = F.concat(e["type"], F.lit(': said "'), F.coalesce(e["true_form"], F.lit("None")), F.lit('" -> heard "'), F.coalesce(e["heard_form"], F.lit("None")), F.lit('"'))
    notes = _events(calls).withColumn("note", note).groupBy("call_id", "turn_id").agg(F.array_sort(F.collect_list(F.struct("place", "note"))).alias("n"))
    rows = turns.join(calls.select("call_id", "split"), "call_id").join(notes, ["call_id", "turn_id"], "left")
    return rows.select("call_id", "split", "turn_id", "speaker", "text", F.array_join("tags", "; ").alias("tags"), F.coalesce(F.array_join("n.note", " | "), F.lit("")).alias("noise"))


def noise_sheet(calls: DataFrame, turns: DataFrame) -> DataFrame:
    """One row a noise event, with the line that it stands on."""
    e = F.col("e")
    line = F.concat(F.coalesce("speaker", F.lit("")), F.lit(" -> "), F.coalesce("text", F.lit("")))
    rows = _events(calls).join(turns.select("call_id", "turn_id", "speaker", "text"), ["call_id", "turn_id"], "left")
    return rows.select("call_id", "split", "category", "asr_noise_level", "turn_id", e["type"].alias("type"), e["true_form"].alias("said"), e["heard_form"].alias("heard"), e["fact_id"].alias("fact_id"), line.alias("line"))


_SHOWN = "struct<text:string,reason:string,speaker:string,quote:string>"
_SUMMARY = f"not_applicable struct<is_na:boolean,reason:string>, identity struct<patient_name:struct<value:string>,patient_dob:struct<value:string>>, chief_complaint {_SHOWN}, " + ", ".join(f"{s} array<{_SHOWN}>" for s in SECTIONS)


def summary_sheet(calls: DataFrame, rendered: DataFrame | None = None) -> DataFrame:
    """One row a call: patient, complaint, sections as bullet lists, flags, and ``rendered`` (call_id, rendered) if given."""
    rows = calls.select("call_id", "split", F.col("setup")["scenario_category"].alias("category"), "risk_flags", F.from_json("gold", _SUMMARY).alias("g"))
    na = F.coalesce("g.not_applicable.is_na", F.lit(False))
    said = lambda b: F.when(F.coalesce(b["quote"], F.lit("")) != "", F.concat(F.lit("\n    "), F.coalesce(b["speaker"], F.lit("None")), F.lit(': "'), b["quote"], F.lit('"'))).otherwise("")
    listed = lambda s: F.when(na, "").otherwise(F.array_join(F.transform(f"g.{s}", lambda b: F.concat(F.lit("• "), F.coalesce(b["text"], F.lit("None")), said(b))), "\n"))
    patient = F.concat(F.coalesce("g.identity.patient_name.value", F.lit("None")), F.lit(" (DOB "), F.coalesce(F.nullif("g.identity.patient_dob.value", F.lit("")), F.lit("not stated")), F.lit(")"))
    chief = F.concat(F.coalesce("g.chief_complaint.reason", F.lit("None")), said(F.col("g.chief_complaint")))
    flags = F.array_join(F.transform(_or_empty("risk_flags"), lambda f: F.concat(f["risk_category"], F.lit(": "), F.coalesce(f["trigger_description"], F.lit("None")))), "\n")
    out = rows.select(
        "call_id", "split", "category", F.when(na, "-").otherwise(patient).alias("patient"),
        F.when(na, F.concat(F.lit("NOT APPLICABLE: "), F.coalesce("g.not_applicable.reason", F.lit("")))).otherwise(chief).alias("chief_complaint"),
        *(F.coalesce(listed(s), F.lit("")).alias(s) for s in SECTIONS), F.when(na, "").otherwise(flags).alias("risk_flags"),
    )
    return out if rendered is None else out.join(rendered, "call_id", "left")


def validator_sheet(findings: DataFrame, calls: DataFrame, rules: dict[str, str], splits: tuple[str, ...] = ("train", "val")) -> DataFrame:
    """(code, checks, one column a split): findings of each rule by split, rules without any too; then calls and calls with findings."""
    known = findings.join(calls.select("call_id", "split"), "call_id")
    counts = known.groupBy("code").pivot("split", list(splits)).agg(F.count(F.lit(1)))
    names = calls.sparkSession.createDataFrame(list(rules.items()), "code string, checks string")
    rows = names.join(counts, "code", "left").select("code", "checks", *(F.coalesce(s, F.lit(0)).alias(s) for s in splits))
    total = lambda df, label: df.groupBy().pivot("split", list(splits)).agg(F.count_distinct("call_id")).select(F.lit("").alias("code"), F.lit(label).alias("checks"), *(F.coalesce(s, F.lit(0)).alias(s) for s in splits))
    return rows.unionByName(total(calls, "calls checked")).unionByName(total(known, "calls with any finding"))


def statuses(cases: DataFrame) -> DataFrame:
    """``cases`` with status and why. ``cases``: parse_ok, raw_errors, errors (after quote repair), repaired (quotes), absent (drugs).

    FAILED: no JSON. REVIEW: errors are left after the repair, or the summary lacks a drug that the caller
    named (which only lowers a PASS). PASS: all else.
    """
    ok, left, lacking = F.coalesce("parse_ok", F.lit(False)), F.col("errors") > 0, F.size(F.coalesce("absent", F.array().cast("array<string>"))) > 0
    plain = F.when(F.col("raw_errors") > 0, F.concat(F.col("repaired").cast("string"), F.lit(" quotes were repaired; no rule error is left"))).otherwise("no rule error")
    why = (
        F.when(~ok, "the output is not valid JSON")
        .when(left, F.concat(F.col("errors").cast("string"), F.lit(" rule errors are left after quote repair")))
        .when(lacking, F.concat(F.lit("the caller named "), F.array_join("absent", ", "), F.lit(", the summary does not ("), plain, F.lit(")")))
        .otherwise(plain)
    )
    return cases.withColumn("status", F.when(~ok, "FAILED").when(left | lacking, "REVIEW").otherwise("PASS")).withColumn("why", why)


def final_flags(model: DataFrame, rules: DataFrame, calls: DataFrame, keys: list[str]) -> DataFrame:
    """keys, category, turns, quote, source: a model's flags and those of the rules whose category it lacks; none on Not-Applicable ``calls`` (keys, is_na)."""
    columns = [*keys, "category", "turns", "quote"]
    added = rules.join(model.select(*keys, "category").distinct(), [*keys, "category"], "left_anti").select(*columns, F.lit("rule").alias("source"))
    live = calls.filter(~F.coalesce("is_na", F.lit(False))).select(*keys)
    return model.select(*columns, F.lit("model").alias("source")).unionByName(added.join(live, keys, "left_semi"))


def training_examples(calls: DataFrame, turns: DataFrame, system: str, target: Column, limit: int, size: Column | None = None) -> DataFrame:
    """call_id, messages (JSON of system, user and assistant), target, n_target, n_prompt.

    The user message is the numbered transcript, the target the compact JSON of ``target`` (text) with
    its keys in order. A row whose ``size`` (its characters, unless another measure is given) is over
    ``limit`` ends the job: nothing is cut.
    """
    lines = F.array_sort(F.collect_list(F.struct("turn_id", F.concat(F.lit("["), F.col("turn_id"), F.lit("] "), "speaker", F.lit(": "), "text").alias("line"))))
    said = turns.groupBy("call_id").agg(lines.alias("l")).select("call_id", F.concat(F.lit("CALL TRANSCRIPT\n"), F.array_join("l.line", "\n")).alias("user"))
    rows = calls.withColumn("target", target).join(said, "call_id").withColumn("n_prompt", F.length("user") + len(system)).withColumn("n_target", F.length("target"))
    whole = size if size is not None else F.col("n_prompt") + F.col("n_target")
    checked = F.when(whole <= limit, F.col("target")).otherwise(F.raise_error(F.concat(F.lit("too long: "), "call_id", F.lit(", "), whole.cast("string"))))
    turn = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    messages = F.to_json(F.array(turn("system", F.lit(system)), turn("user", F.col("user")), turn("assistant", checked)))
    return rows.select("call_id", messages.alias("messages"), "target", "n_target", "n_prompt")


def payloads(rows: DataFrame, key: str, system: str, columns: list[str]) -> DataFrame:
    """(key, payload): a JSON map of systems to their columns, in order of system."""
    entry = F.struct(F.col(system).alias("k"), F.struct(*columns).alias("v"))
    pairs = F.array_sort(F.collect_list(entry))
    return rows.groupBy(key).agg(F.to_json(F.map_from_entries(pairs)).alias("payload"))

