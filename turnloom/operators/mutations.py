"""Reproducible damage to summaries, and the study of which rules see it."""

from __future__ import annotations

import json
import random
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnloom.operators.medication import ALIASES
from turnloom.operators.validation import SECTIONS, validate


@dataclass
class Draft:
    """A summary under damage, its transcript, and the seeded choice of places."""

    summary: dict
    turns: list[dict]
    rng: random.Random
    raw: str | None = None  # set by damage to the JSON text itself

    def bullets(self) -> Iterator[tuple[str, int, dict]]:
        return ((s, i, b) for s in SECTIONS for i, b in enumerate(self.summary.get(s) or []))

    def facts(self, *types: str) -> list[tuple[dict, dict]]:
        return [(b, f) for _, _, b in self.bullets() for f in b.get("facts") or [] if f.get("type") in types]

    def any_of(self, places):
        """One of the places, or a stop of this damage where there is none."""
        found = list(places)
        if not found:
            raise LookupError
        return self.rng.choice(found)

    def identity(self, field: str) -> dict:
        got = (self.summary.get("identity") or {}).get(field) or {}
        if not got.get("value"):
            raise LookupError
        return got

    @property
    def is_na(self) -> bool:
        return bool((self.summary.get("not_applicable") or {}).get("is_na"))


Damage = Callable[[Draft], None]
#: name: (damage, rules expected to see it, least severity)
REGISTRY: dict[str, tuple[Damage, tuple[str, ...], str]] = {}
OTHER_NAMES, OTHER_DRUGS = ("Theodora Quill", "Barnaby Frost"), ("metformin", "digoxin", "fluoxetine")


def damage(*rules: str, level: str = "ERROR") -> Callable[[Damage], Damage]:
    def add(f: Damage) -> Damage:
        REGISTRY[f.__name__] = (f, rules, level)
        return f

    return add


def _other_digit(text: str, rng: random.Random, first: int = 0) -> str:
    at = rng.choice([i for i, c in enumerate(text) if c.isdigit() and i >= first])
    return text[:at] + rng.choice([d for d in "123456789" if d != text[at]]) + text[at + 1 :]


@damage("V1")
def truncated_json(d: Draft) -> None:
    text = json.dumps(d.summary, ensure_ascii=False)
    d.raw = text[: int(len(text) * d.rng.uniform(0.4, 0.9))]


@damage("V1")
def missing_section(d: Draft) -> None:
    del d.summary[d.any_of(s for s in SECTIONS if s in d.summary)]


@damage("V1")
def bad_speaker_value(d: Draft) -> None:
    d.any_of(b for _, _, b in d.bullets())["speaker"] = "Doctor"


@damage("V3")
def turn_out_of_range(d: Draft) -> None:
    d.any_of(b for _, _, b in d.bullets())["turns"] = [len(d.turns) + d.rng.randint(1, 9)]


@damage("V4")
def quote_from_other_turn(d: Draft) -> None:
    b = d.any_of(b for _, _, b in d.bullets() if b.get("turns"))
    far = [t["text"] for t in d.turns if min(abs(t["turn_id"] - i) for i in b["turns"]) > 3 and len(t["text"].split()) > 6]
    b["quote"] = d.any_of(far)


@damage("V4")
def quote_paraphrased(d: Draft) -> None:
    b = d.any_of(b for _, _, b in d.bullets() if len((b.get("quote") or "").split()) > 4)
    b["quote"] = "It was mentioned that " + " ".join(sorted(b["quote"].split(), reverse=True))


@damage("V4", level="WARN")
def quote_one_word_changed(d: Draft) -> None:
    b = d.any_of(b for _, _, b in d.bullets() if len((b.get("quote") or "").split()) > 10)
    words = b["quote"].split()
    words[d.rng.randrange(2, len(words) - 2)] = "whatever"
    b["quote"] = " ".join(words)


@damage("V5", level="WARN")
def speaker_flipped(d: Draft) -> None:
    b = d.any_of(b for _, _, b in d.bullets() if b.get("speaker") in ("Caller", "Nurse"))
    b["speaker"] = "Nurse" if b["speaker"] == "Caller" else "Caller"


@damage("V6")
def number_changed_in_text(d: Draft) -> None:
    b = d.any_of(b for _, _, b in d.bullets() if re.search(r"\d", b.get("text") or ""))
    b["text"] = re.sub(r"\d+(?:\.\d+)?", lambda m: str(int(float(m[0])) + 877), b["text"], count=1)


@damage("V6")
def dose_changed_in_fact(d: Draft) -> None:
    _, f = d.any_of(x for x in d.facts("medication") if re.search(r"\d", str(x[1].get("dose") or "")))
    f["dose"] = str(d.rng.randint(811, 989))


def _swap_drug(d: Draft, in_text: bool) -> None:
    b, f = d.any_of(x for x in d.facts("medication") if x[1].get("name") and (not in_text or str(x[1]["name"]).lower() in (x[0].get("text") or "").lower()))
    said = " ".join(t["text"] for t in d.turns).lower()
    new = d.any_of(n for n in OTHER_DRUGS if n not in said)
    if in_text:
        b["text"] = re.sub(re.escape(str(f["name"])), new, b["text"], flags=re.IGNORECASE)
    else:
        f["name"] = new


@damage("V7")
def drug_swapped_in_text(d: Draft) -> None:
    _swap_drug(d, True)


@damage("V7")
def drug_swapped_in_fact(d: Draft) -> None:
    _swap_drug(d, False)


def _invent(d: Draft, text: str, name: str) -> None:
    like = d.any_of(b for _, _, b in d.bullets() if b.get("quote"))
    d.summary.setdefault("assessment", []).append(like | {"text": text, "facts": [{"type": "symptom", "name": name, "certainty": "stated"}]})


@damage("V6", "V8")
def invented_fever_101(d: Draft) -> None:
    _invent(d, "Fever of 101.7 was reported.", "fever")


@damage("V8")
def invented_listed_finding(d: Draft) -> None:
    _invent(d, "A seizure was reported.", "seizure")


@damage()
def invented_unlisted_finding(d: Draft) -> None:
    _invent(d, "Itchy ears were reported.", "itchy ears")


def _rename(d: Draft, field: str) -> None:
    got = d.identity(field)
    got["value"] = d.any_of(n for n in OTHER_NAMES if n != got["value"])


@damage("V9")
def patient_name_changed(d: Draft) -> None:
    _rename(d, "patient_name")


@damage("V9")
def caller_name_changed(d: Draft) -> None:
    _rename(d, "caller_name")


@damage("V9")
def dob_year_changed(d: Draft) -> None:
    got = d.identity("patient_dob")
    got["value"] = re.sub(r"^\d{4}", lambda m: str(int(m[0]) + d.rng.choice((-13, 17))), got["value"])


@damage("V9")
def phone_digit_changed(d: Draft) -> None:
    got = d.identity("callback_phone")
    got["value"] = _other_digit(got["value"], d.rng, 3)


@damage()
def names_swapped(d: Draft) -> None:
    a, b = d.identity("patient_name"), d.identity("caller_name")
    if a["value"] == b["value"]:
        raise LookupError
    a["value"], b["value"] = b["value"], a["value"]


def _action(d: Draft, status: str) -> tuple[dict, dict]:
    return d.any_of(x for x in d.facts("action") if x[1].get("status") == status and x[0].get("speaker") == "Nurse")


@damage("V10")
def status_flipped_to_done(d: Draft) -> None:
    _action(d, "planned")[1]["status"] = "completed"


@damage("V10")
def planned_rewritten_as_done(d: Draft) -> None:
    b, _ = _action(d, "planned")
    b["text"] = "Completed: " + re.sub(r"^\s*(planned|plans|will)\b[: ]*", "", b["text"], flags=re.IGNORECASE)


@damage("V10")
def done_rewritten_as_planned(d: Draft) -> None:
    b, f = _action(d, "completed")
    f["status"], b["text"] = "planned", "Already " + b["text"]


@damage("V11", level="WARN")
def hedge_removed(d: Draft) -> None:
    b, f = d.any_of(x for x in d.facts("symptom", "medication", "vital", "context") if x[1].get("certainty") == "unclear" and x[0].get("speaker") == "Caller")
    for g in b["facts"]:
        g["certainty"] = "stated"
    b["text"] = f"{f.get('name') or 'It'} was reported."


@damage("V12")
def negative_flipped(d: Draft) -> None:
    b, f = d.any_of(x for x in d.facts("pertinent_negative") if x[1].get("name"))
    b["text"] = f"{str(f['name']).capitalize()} was reported."


@damage("V13", level="WARN")
def risk_flag_dropped(d: Draft) -> None:
    d.summary["risk_flags"].remove(d.any_of(d.summary.get("risk_flags") or []))


@damage("V13", level="WARN")
def spurious_suicidal_flag(d: Draft) -> None:
    b = d.any_of(b for _, _, b in d.bullets() if b.get("turns"))
    d.summary.setdefault("risk_flags", []).append({"category": "suicidal_statement", "turns": b["turns"], "quote": b.get("quote") or ""})


@damage("V14")
def clinical_call_marked_na(d: Draft) -> None:
    if d.is_na:
        raise LookupError
    d.summary |= {"not_applicable": {"is_na": True, "reason": "wrong number"}, **{s: [] for s in SECTIONS}, "risk_flags": []}
    d.summary.pop("chief_complaint", None)


@damage("V14", level="WARN")
def non_clinical_made_clinical(d: Draft) -> None:
    if not d.is_na:
        raise LookupError
    t = d.any_of(d.turns)
    b = {"text": "Caller asked for help.", "speaker": t["speaker"], "turns": [t["turn_id"]], "quote": t["text"], "explanation": "Documents it", "facts": []}
    d.summary |= {"not_applicable": {"is_na": False, "reason": None}, "assessment": [b]}


@damage()
def bullet_removed(d: Draft) -> None:
    s, i, _ = d.any_of(d.bullets())
    del d.summary[s][i]


@damage("V16", level="WARN")
def bullet_duplicated(d: Draft) -> None:
    s, _, b = d.any_of(d.bullets())
    d.summary[s].append(json.loads(json.dumps(b)))


@damage("V16")
def bullet_text_emptied(d: Draft) -> None:
    d.any_of(b for _, _, b in d.bullets())["text"] = ""


@damage()
def dose_swapped_within_call(d: Draft) -> None:
    doses = [f for _, f in d.facts("medication") if f.get("dose")]
    a = d.any_of(doses)
    b = d.any_of(f for f in doses if f["dose"] != a["dose"])
    a["dose"], b["dose"] = b["dose"], a["dose"]


def apply_damage(name: str, summary: str, turns: list[dict], seed: str) -> str | None:
    """The damaged summary as JSON text; null where the damage has no place. The same seed, the same damage."""
    draft = Draft(json.loads(summary), turns, random.Random(f"{name}:{seed}"))
    try:
        REGISTRY[name][0](draft)
    except (LookupError, ValueError, TypeError, KeyError, IndexError):
        return None
    return draft.raw if draft.raw is not None else json.dumps(draft.summary, ensure_ascii=False)


def damaged(cases: DataFrame, turns: DataFrame, names: list[str] | None = None, per_mutation: int = 30) -> DataFrame:
    """mutation, call_id, summary: up to ``per_mutation`` damaged cases of each mutation, in an order of hashes."""
    names = list(names or REGISTRY)

    @F.pandas_udf("array<struct<mutation:string,summary:string>>")
    def run(ids: pd.Series, summaries: pd.Series, rows: pd.Series) -> pd.Series:
        def one(i: str, s: str, t) -> list[dict]:
            said = [dict(x) for x in t]
            made = ((n, apply_damage(n, s, said, i)) for n in names)
            return [{"mutation": n, "summary": m} for n, m in made if m is not None]

        return pd.Series([one(*r) for r in zip(ids, summaries, rows, strict=True)])

    said = turns.groupBy("call_id").agg(F.array_sort(F.collect_list(F.struct("turn_id", "speaker", "text"))).alias("t"))
    made = cases.join(said, "call_id").select("call_id", F.explode(run("call_id", "summary", "t")).alias("m")).select("m.mutation", "call_id", "m.summary")
    order = Window.partitionBy("mutation").orderBy(F.xxhash64("mutation", "call_id"), "call_id")
    return made.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= per_mutation).drop("k")


def detection_study(cases: DataFrame, turns: DataFrame, names: list[str] | None = None, per_mutation: int = 30, drugs: list[str] | None = None) -> DataFrame:
    """mutation, n, caught_error, caught_any, caught_expected: new findings against the undamaged case.

    ``drugs`` are the names that the rules on drugs and flags know; they default to the known brands and generics.
    """
    drugs = sorted({*ALIASES, *ALIASES.values()}) if drugs is None else drugs
    base, _ = validate(cases.select(F.lit("base").alias("system"), "call_id", "summary"), turns, drugs)
    made = damaged(cases, turns, names, per_mutation)
    found, _ = validate(made.select(F.col("mutation").alias("system"), "call_id", "summary"), turns, drugs)
    key = ["call_id", "rule", "path", "severity"]
    new = found.filter("severity IN ('WARN', 'ERROR')").join(base.select(*key).distinct(), key, "left_anti")
    expected = F.create_map(*(F.lit(x) if isinstance(x, str) else F.array(*map(F.lit, x)).cast("array<string>") for n, (_, r, _) in REGISTRY.items() for x in (n, r)))
    item = new.withColumn("mutation", F.col("system")).groupBy("mutation", "call_id").agg(
        F.bool_or(F.col("severity") == "ERROR").alias("error"), F.bool_or(F.array_contains(expected[F.col("system")], F.col("rule"))).alias("as_expected")
    )
    both = made.select("mutation", "call_id").join(item, ["mutation", "call_id"], "left")
    return both.groupBy("mutation").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("error").alias("caught_error"), F.count_if(F.col("error").isNotNull()).alias("caught_any"), F.count_if("as_expected").alias("caught_expected")
    )
