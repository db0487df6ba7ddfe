"""Rules over summaries and their transcripts: findings and (ok, total) counters.

Every rule is a pair of column expressions over one row, arrays of findings and of counters; all
rules run in one pass over the bullets and one over the summaries, and what they say is exploded at
the end. A rule's regular expressions are literals and its text work is shared through columns.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnloom.functions import clinical_terms as K
from turnloom.functions import cues as C
from turnloom.functions import text as T
from turnloom.functions.fuzzy import best_ratio_udf, window_ratio_udf
from turnloom.functions.spoken import number_candidates_udf
from turnloom.operators.identity import identity_findings
from turnloom.operators.relational import id_window, texts_of
from turnloom.operators.risk import ESCALATION, SUICIDAL, clinical_score, first_flags, risk_scan
from turnloom.operators.schema_check import schema_errors, summary_nodes
from turnloom.sources.shared import worked_out

RADIUS = 2
REPAIRABLE = 0.9
SECTIONS = ("assessment", "response", "education")
NUMBER_FIELDS = ("dose", "strength", "severity", "value", "supply", "last_dose", "frequency", "timeframe", "duration", "onset")
_FIELDS = ("type", "name", "status", "certainty", "present", "med_name", "medication", "item", "unit", "action_type", "education_type", *NUMBER_FIELDS)
FACT = ", ".join(f"{c}: string" for c in _FIELDS)
BULLET = f"text: string, reason: string, speaker: string, turns: array<int>, quote: string, explanation: string, facts: array<struct<{FACT}>>"
IDENTITY = ("patient_name", "patient_dob", "caller_name", "relationship", "callback_phone")
SUMMARY = (
    "not_applicable struct<is_na: boolean, reason: string>, "
    f"identity struct<{', '.join(f'{k}: struct<value: string, certainty: string>' for k in IDENTITY)}>, "
    f"chief_complaint struct<{BULLET}>, "
    + ", ".join(f"{s} array<struct<{BULLET}>>" for s in SECTIONS)
    + ", risk_flags array<struct<category: string, turns: array<int>, quote: string>>"
)
KEYS = ("system", "call_id")
#: What a rule says of a row: arrays of findings, arrays of counters.
Said = tuple[list[Column], list[Column]]


def _finding(when: Column, rule: str, severity: str, path: Column, message: Column | str) -> Column:
    text = F.lit(message) if isinstance(message, str) else message
    said = F.struct(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), path.alias("path"), text.alias("message"))
    return F.when(F.coalesce(when, F.lit(False)), F.array(said)).otherwise(F.array().cast("array<struct<rule:string,severity:string,path:string,message:string>>"))


def _counter(name: str, ok: Column, when: Column | None = None) -> Column:
    one = F.array(F.struct(F.lit(name).alias("name"), F.coalesce(ok, F.lit(False)).cast("long").alias("ok"), F.lit(1).cast("long").alias("total")))
    none = F.array().cast("array<struct<name:string,ok:bigint,total:bigint>>")
    return one if when is None else F.when(F.coalesce(when, F.lit(False)), one).otherwise(none)


def call_context(turns: DataFrame) -> DataFrame:
    """One row per call: its texts and speakers in order, their normal forms, the whole call's candidates."""
    ordered = F.array_sort(F.collect_list(F.struct("turn_id", "speaker", "text")))
    c = turns.groupBy("call_id").agg(ordered.alias("t")).select("call_id", F.col("t.text").alias("texts"), F.col("t.speaker").alias("speakers"))
    plain = F.transform("texts", lambda x: T.normalize(T.collapse_spelled(x)))
    c = c.withColumn("norms", plain).withColumn("n", F.size("texts"))
    return c.withColumn("call_numbers", number_candidates_udf(F.array_join("texts", " ")))


def parsed(summaries: DataFrame, text_col: str = "summary") -> DataFrame:
    """system, call_id, raw, parsed: JSON summaries; a text that is no object is null."""
    whole = F.when(F.try_parse_json(text_col).isNotNull() & F.json_object_keys(text_col).isNotNull(), F.col(text_col))
    rows = summaries.select(*KEYS, F.col(text_col).alias("raw"), F.from_json(whole, SUMMARY).alias("s"), F.json_object_keys(whole).alias("keys"))
    return summary_nodes(rows).withColumn("errors", schema_errors(F.col("nodes"))).drop("nodes")


def bullets(summaries: DataFrame) -> DataFrame:
    """system, call_id, section, ord, path and the bullet's fields; the chief complaint comes first."""
    one = lambda section, k, path, b: F.struct(F.lit(section).alias("section"), k.alias("ord"), path.alias("path"), b.alias("b"))
    head = F.filter(F.array(one("chief_complaint", F.lit(0), F.lit("chief_complaint"), F.col("s.chief_complaint"))), lambda x: x["b"].isNotNull())

    def part(section: str) -> Column:
        numbered = F.transform(F.col(f"s.{section}"), lambda b, i: one(section, i, F.concat(F.lit(f"{section}["), i, F.lit("]")), b))
        return F.coalesce(numbered, F.slice(head, 1, 0))

    rows = summaries.select(*KEYS, F.explode(F.concat(head, *map(part, SECTIONS))).alias("x")).select(*KEYS, "x.*")
    said = F.when(F.col("section") == "chief_complaint", F.col("b.reason")).otherwise(F.col("b.text"))
    return rows.select(*KEYS, "section", "ord", "path", F.coalesce(said, F.lit("")).alias("text"), "b.speaker", F.coalesce("b.turns", F.array().cast("array<int>")).alias("ids"), F.coalesce("b.quote", F.lit("")).alias("quote"), "b.explanation", F.coalesce("b.facts", F.array().cast(f"array<struct<{FACT}>>")).alias("facts"))


def _prepared(rows: DataFrame, context: DataFrame) -> DataFrame:
    """Bullets with what several rules need, worked out once."""
    b = rows.join(context, "call_id").withColumn("window", id_window(F.col("ids"), F.col("n"), RADIUS))
    b = b.withColumn("cited_text", texts_of(F.col("ids"), F.col("texts"))).withColumn("cited", T.normalize(T.collapse_spelled(F.col("cited_text"))))
    b = b.withColumn("plain_quote", T.normalize(T.collapse_spelled(F.col("quote"))))
    b = b.withColumn("exact", T.padded_contains(F.col("cited"), F.col("plain_quote")))
    close = F.when(F.col("exact"), F.lit(1.0)).otherwise(window_ratio_udf("plain_quote", "cited"))
    b = b.withColumn("ratio", close).withColumn("window_numbers", number_candidates_udf(texts_of(F.col("window"), F.col("texts"))))
    stated = F.flatten(F.transform("facts", lambda f: F.array(*(T.numbers_in(F.coalesce(f[k], F.lit(""))) for k in NUMBER_FIELDS))))
    b = b.withColumn("numbers", F.concat(T.numbers_in(F.col("text")), F.flatten(stated)))
    b = b.withColumn("cues", _status_cues())
    again = Window.partitionBy(*KEYS, T.normalize(F.col("text")), "plain_quote").orderBy("section_no", "ord")
    order = F.array_position(F.array(*(F.lit(s) for s in ("chief_complaint", *SECTIONS))), F.col("section"))
    return b.withColumn("section_no", order).withColumn("copy", F.row_number().over(again))


def _turn_rule() -> Said:
    """V3: the cited turns are there."""
    inside = (F.size("ids") > 0) & F.forall("ids", lambda i: (i >= 1) & (i <= F.col("n")))
    found = _finding(~inside, "V3", "ERROR", F.concat("path", F.lit(".turns")), "cited turns are empty or outside the call")
    return [found], [_counter("turns_valid", inside)]


def _status_cues() -> Column:
    """What the wording of a bullet and of its evidence says of an action, once for all its facts."""
    text, quote = F.col("text"), F.col("quote")
    evidence = F.concat_ws(" ", quote, F.col("cited_text"))
    return F.struct(
        (C.says(evidence, C.COMPLETION) | C.says(evidence, C.NOW_PROGRESS)).alias("evidenced"),
        C.says(text, C.PLANNED_TEXT).alias("worded_planned"),
        C.says(text, C.DONE_TEXT).alias("worded_done"),
        (C.says(quote, C.COMPLETION) & ~C.says(quote, C.NOW_PROGRESS) & ~C.says(quote, C.FUTURE)).alias("only_done"),
    )


def _status_findings() -> Column:
    """V10: for each action fact of a bullet the array of what is wrong with its status, empty if nothing is."""
    cues, path = F.col("cues"), F.col("path")

    def of_fact(f: Column) -> Column:
        f, i = f["f"], f["i"]
        done, planned = f["status"] == "completed", f["status"] == "planned"
        at = F.concat(path, F.lit(".facts["), i, F.lit("].status"))
        return F.concat(
            _finding(done & cues["worded_planned"], "V10", "ERROR", F.concat(path, F.lit(".text")), "status is completed but the text is worded as planned"),
            _finding(done & ~cues["worded_planned"] & ~cues["evidenced"], "V10", "ERROR", at, "completed without a completion cue"),
            _finding(planned & cues["worded_done"], "V10", "ERROR", F.concat(path, F.lit(".text")), "status is planned but the text is worded as done"),
            _finding(planned & ~cues["worded_done"] & cues["only_done"], "V10", "ERROR", at, "planned but the nurse says it is done"),
        )

    numbered = F.transform("facts", lambda f, i: F.struct(i.alias("i"), f.alias("f")))
    return F.transform(F.filter(numbered, lambda f: f["f"]["type"] == "action"), of_fact)


def _valid() -> tuple[Column, Column]:
    """Whether a bullet's quote is empty, and whether it is in the cited turns or near enough to repair."""
    blank = F.trim("quote") == ""
    return blank, ~blank & (F.col("exact") | (F.col("ratio") >= REPAIRABLE))


def _at(end: str) -> Column:
    return F.concat("path", F.lit(end))


def _quote_rule() -> Said:
    """V4: the quote stands in the cited turns."""
    blank, valid = _valid()
    elsewhere = F.exists("norms", lambda x: T.padded_contains(x, F.col("plain_quote")))
    found = [
        _finding(blank, "V4", "ERROR", _at(".quote"), "empty quote"),
        _finding(valid & ~F.col("exact"), "V4", "WARN", _at(".quote"), "quote differs slightly from the cited turns"),
        _finding(~blank & ~valid & elsewhere, "V4", "ERROR", _at(".quote"), "quote is in other turns than those cited"),
        _finding(~blank & ~valid & ~elsewhere, "V4", "ERROR", _at(".quote"), "quote not found in the call"),
    ]
    return found, [_counter("quote_exact", F.col("exact") & ~blank), _counter("quote_valid", valid)]


def _speaker_rule() -> Said:
    """V5: the quoted turns have the bullet's speaker."""
    _, valid = _valid()
    good = F.filter("ids", lambda i: (i >= 1) & (i <= F.col("n")))
    holders = F.filter(good, lambda i: T.padded_contains(F.element_at("norms", i), F.col("plain_quote")))
    holders = F.when(F.size(holders) > 0, holders).otherwise(good)
    spoken = F.exists(holders, lambda i: F.element_at("speakers", i) == F.col("speaker"))
    return [_finding(valid & ~spoken, "V5", "WARN", _at(".speaker"), "the quoted turns have another speaker")], [_counter("speaker_ok", spoken, valid)]


def _number_rule() -> Said:
    """V6: numbers were said in the call, near the cited turns."""
    in_window = lambda x: T.supported(x, F.col("window_numbers"))
    in_call = lambda x: in_window(x) | T.supported(x, F.col("call_numbers"))
    say = lambda x, sev, msg: F.struct(F.lit("V6").alias("rule"), F.lit(sev).alias("severity"), F.col("path").alias("path"), F.concat(F.lit("number "), x, F.lit(msg)).alias("message"))
    found = [
        F.transform(F.filter("numbers", lambda x: ~in_call(x)), lambda x: say(x, "ERROR", " is not in the call")),
        F.transform(F.filter("numbers", lambda x: in_call(x) & ~in_window(x)), lambda x: say(x, "INFO", " is in the call but not near the cited turns")),
    ]
    tally = lambda name, test: F.transform("numbers", lambda x: F.struct(F.lit(name).alias("name"), F.coalesce(test(x), F.lit(False)).cast("long").alias("ok"), F.lit(1).cast("long").alias("total")))
    return found, [tally("numbers_in_window", in_window), tally("numbers_in_call", in_call)]


def _status_rule() -> Said:
    """V10: planned and completed actions are worded as the nurse said them."""
    wrong = F.when(F.col("speaker") == "Nurse", _status_findings()).otherwise(F.slice(_status_findings(), 1, 0))
    return [F.flatten(wrong)], [F.transform(wrong, lambda w: F.struct(F.lit("status_consistent").alias("name"), (F.size(w) == 0).cast("long").alias("ok"), F.lit(1).cast("long").alias("total")))]


def _hedge_rule() -> Said:
    """V11: a caller's hedge is kept."""
    told = (F.col("section") != "chief_complaint") & (F.col("speaker") == "Caller") & (F.size("facts") > 0)
    hedged = C.says(F.col("quote"), C.HEDGE)
    kept = F.exists("facts", lambda f: f["certainty"] == "unclear") | C.says(F.col("text"), C.SOFTENER)
    return [_finding(told & hedged & ~kept, "V11", "WARN", F.col("path"), "the quote has a hedge but the bullet states it as certain")], [_counter("hedge_kept", ~hedged | kept, told)]


def _form_rule() -> Said:
    """V16: text, repeats and explanation."""
    found = [
        _finding(F.trim("text") == "", "V16", "ERROR", _at(".text"), "empty text"),
        _finding(F.col("copy") > 1, "V16", "WARN", F.col("path"), "duplicate bullet"),
        _finding(~F.coalesce(F.col("explanation"), F.lit("")).startswith("Documents"), "V16", "INFO", _at(".explanation"), "explanation does not start with 'Documents'"),
    ]
    return found, []


def _term_rules() -> Said:
    """V8: a clinical term of the summary that the call never mentions, or only by a loose synonym."""
    named = F.filter("facts", lambda f: f["type"].isin("symptom", "pertinent_negative", "vital", "context"))
    said = F.concat_ws(" ", "text", F.array_join(F.transform(named, lambda f: F.coalesce(f["name"], F.lit(""))), " "))
    call, path = F.array_join("texts", " "), F.concat("path", F.lit(".text"))
    found, counts = [], []
    for term, in_summary, in_call in K.TERMS:
        used, known = said.rlike(f"(?i){in_summary}"), call.rlike(f"(?i){in_call}")
        severity = "WARN" if term in K.GENERIC_TERMS else "ERROR"
        found.append(_finding(used & ~known, "V8", severity, path, f"'{term}' is in the summary but nothing in the call mentions it"))
        if term in K.SPECIFIC_TERMS:
            found.append(_finding(used & known & ~call.rlike(f"(?i){in_summary}"), "V8", "WARN", path, f"the call has only a loose synonym of '{term}'"))
        counts.append(_counter("clinical_terms_supported", known, used))
    return found, counts


def _drug_findings(b: DataFrame, drugs: list[str]) -> DataFrame:
    """V7: drugs that a bullet names and the call, or the turns around those cited, do not."""
    long = sorted({d for d in drugs if len(d) > 3}, key=lambda d: (-len(d), d))
    in_text = F.regexp_extract_all(F.lower("text"), F.lit(r"\b(" + "|".join(re.escape(d) for d in long) + r")\b"), 1)
    typed = F.transform(F.filter("facts", lambda f: f["type"] == "medication"), lambda f: f["name"])
    acted = F.flatten(F.transform(F.filter("facts", lambda f: f["type"] == "action"), lambda f: F.array(f["med_name"], f["medication"])))
    names = F.filter(F.concat(in_text, typed, acted), lambda n: F.coalesce(n, F.lit("")) != "")
    near = T.normalize(T.collapse_spelled(texts_of(F.col("window"), F.col("texts"))))
    rows = b.select(*KEYS, "path", F.explode(names).alias("drug"), F.array_join("norms", " ").alias("call"), near.alias("near")).withColumn("plain", T.normalize(F.col("drug")))
    words = F.split("plain", " ")

    def stands(text: str) -> Column:
        return T.padded_contains(F.col(text), F.col("plain")) | ((F.col("plain") != "") & (F.size(F.array_except(words, F.split(F.col(text), " "))) == 0))

    rows = rows.withColumn("in_call", stands("call")).withColumn("in_near", F.col("in_call") & stands("near"))
    rows = rows.withColumn("alike", F.when(F.col("in_call"), F.lit(1.0)).otherwise(best_ratio_udf("plain", F.filter(F.split("call", " "), lambda w: F.length(w) > 3))))
    said = lambda text: F.concat(F.lit("drug "), "drug", F.lit(text))
    found = F.concat(
        _finding(~F.col("in_call") & (F.col("alike") >= 0.8), "V7", "WARN", F.col("path"), said(" differs from the spelling in the call")),
        _finding(~F.col("in_call") & (F.col("alike") < 0.8), "V7", "ERROR", F.col("path"), said(" is not in the call")),
        _finding(F.col("in_call") & ~F.col("in_near"), "V7", "INFO", F.col("path"), said(" is in the call but not near the cited turns")),
    )
    return rows.select(*KEYS, found.alias("findings"), F.concat(_counter("drugs_in_call", F.col("in_call")), _counter("drugs_in_window", F.col("in_near"))).alias("counters"))


def _flag_findings(s: DataFrame, turns: DataFrame, drugs: list[str]) -> DataFrame:
    """V13 to V15: rule hits without a flag, the Not-Applicable gate, promises without a response."""
    strong = (SUICIDAL, ESCALATION)
    flags = first_flags(risk_scan(turns, drugs)).groupBy("call_id").agg(F.collect_set("category").alias("hit"))
    promise = r"(?i)\b(send|page|message|call|schedule|order|notify|arrange|contact|submit)\b"
    made = (F.col("speaker") == "Nurse") & C.says(F.col("text"), C.FUTURE) & F.col("text").rlike(promise)
    size = turns.groupBy("call_id").agg(F.count(F.lit(1)).alias("n"), F.bool_or(made).alias("promised"))
    r = s.join(size, "call_id").join(clinical_score(turns, drugs), "call_id").join(flags, "call_id", "left")
    hit, root = F.coalesce("hit", F.array().cast("array<string>")), F.lit("risk_flags")
    own = F.coalesce(F.transform("s.risk_flags", lambda f: f["category"]), F.array().cast("array<string>"))
    na = F.coalesce(F.col("s.not_applicable.is_na"), F.lit(False))
    urgent = F.arrays_overlap(hit, F.array(*map(F.lit, strong)))
    buried, thin = na & ((F.col("score") >= 4) | urgent), ~na & (F.col("score") <= 1) & (F.col("n") < 20)
    missed = F.array_except(hit, own)
    name = lambda category: F.concat(F.lit("a rule found "), category, F.lit(" but the output has no such flag"))
    say = lambda c: F.struct(F.lit("V13").alias("rule"), F.when(c.isin(*strong), "ERROR").otherwise("WARN").alias("severity"), root.alias("path"), name(c).alias("message"))
    none = F.array().cast("array<struct<rule:string,severity:string,path:string,message:string>>")
    found = F.concat(
        F.when(na, none).otherwise(F.transform(missed, say)),
        _finding(~na & F.array_contains(own, SUICIDAL) & ~F.array_contains(hit, SUICIDAL), "V13", "WARN", root, "suicidal_statement flag without such wording"),
        _finding(buried, "V14", "ERROR", F.lit("not_applicable"), "marked Not Applicable but the call has clinical content"),
        _finding(thin, "V14", "WARN", F.lit("not_applicable"), "summarized as clinical but the call has almost no clinical content"),
        _finding(~na & F.col("promised") & (F.coalesce(F.size("s.response"), F.lit(0)) == 0), "V15", "WARN", F.lit("response"), "the nurse promised actions but the response section is empty"),
    )
    covered = lambda c, kind: F.struct(F.lit(kind).alias("name"), F.array_contains(own, c).cast("long").alias("ok"), F.lit(1).cast("long").alias("total"))
    is_strong = lambda c: c.isin(*strong)
    counts = F.concat(
        F.when(na, F.array().cast("array<struct<name:string,ok:bigint,total:bigint>>")).otherwise(
            F.concat(
                F.transform(F.filter(hit, is_strong), lambda c: covered(c, "rule_flags_covered_strong")),
                F.transform(F.filter(hit, lambda c: ~is_strong(c)), lambda c: covered(c, "rule_flags_covered_loose")),
            )
        ),
        _counter("na_gate_ok", ~buried & ~thin),
    )
    return r.select(*KEYS, found.alias("findings"), counts.alias("counters"))


# Words that say nothing about a negative finding.
NEGATION_STOP_WORDS = (
    "with", "from", "that", "this", "have", "does", "were", "been", "when", "than", "into", "over", "some", "more", "much", "very", "other", "while", "there", "their",
)


def _negation_findings(b: DataFrame) -> DataFrame:
    """V12: a negative finding whose whole name stands in the text without any negation."""
    facts = b.select(*KEYS, "path", "text", F.explode("facts").alias("f")).filter((F.col("f.type") == "pertinent_negative") | ((F.col("f.type") == "symptom") & (F.col("f.present") == "false")))
    words = F.filter(F.split(T.normalize(F.coalesce("f.name", F.lit(""))), " "), lambda w: (F.length(w) >= 4) & ~w.isin(*NEGATION_STOP_WORDS))
    rows = facts.withColumn("stems", F.transform(words, T.stem))
    named = (F.size("stems") > 0) & F.forall("stems", lambda s: F.rlike(F.col("text"), F.concat(F.lit(r"(?i)\b"), s)))
    rest = F.aggregate("stems", F.col("text"), lambda t, s: F.regexp_replace(t, F.concat(F.lit("(?i)"), s, F.lit(r"\w*")), F.lit(" ")))
    flipped = named & ~C.says(rest, C.NEGATION) & ~C.says(rest, C.NORMAL_STATE)
    path = F.concat("path", F.lit(".text"))
    return rows.select(*KEYS, _finding(flipped, "V12", "ERROR", path, "a negative finding is named without any negation").alias("findings"), _counter("negation_consistent", ~flipped).alias("counters"))


def _summary_rules(s: DataFrame) -> DataFrame:
    """V1 and V2: the summary as a whole."""
    good, root = F.col("s").isNotNull() & F.col("keys").isNotNull(), F.lit("$")
    na = F.coalesce(F.col("s.not_applicable.is_na"), F.lit(False))
    reason = F.coalesce(F.col("s.not_applicable.reason"), F.lit("")) != ""
    full = reduce(lambda a, b: a | b, (F.coalesce(F.size(f"s.{x}"), F.lit(0)) > 0 for x in SECTIONS))
    flagged = F.coalesce(F.size("s.risk_flags"), F.lit(0)) > 0
    chief = F.col("s.chief_complaint").isNotNull()
    found = [
        _finding(~good, "V1", "ERROR", root, "output is not valid JSON"),
        F.transform("errors", lambda e: F.struct(F.lit("V1").alias("rule"), F.lit("ERROR").alias("severity"), e["path"].alias("path"), e["message"].alias("message"))),
        _finding(good & na & ~reason, "V2", "ERROR", F.lit("not_applicable.reason"), "Not Applicable without a reason"),
        _finding(good & na & (full | flagged), "V2", "ERROR", F.lit("not_applicable"), "Not Applicable output still has sections or risk flags"),
        _finding(good & ~na & ~chief, "V2", "ERROR", F.lit("chief_complaint"), "missing chief_complaint on a clinical call"),
        _finding(good & ~na & ~full, "V2", "WARN", root, "no bullets on a clinical call"),
    ]
    counts = [
        _counter("parse_ok", good),
        _counter("schema_valid", good & (F.size("errors") == 0)),
        _counter("na_consistent", reason & ~full & ~flagged & ~chief, good & na),
    ]
    return s.select(*KEYS, F.concat(*found).alias("findings"), F.concat(*counts).alias("counters"))


@dataclass(frozen=True)
class Rule:
    """A rule on one bullet: its name, what it holds, and its columns over ``_prepared`` rows."""

    name: str
    holds: str
    columns: Callable[[], Said]


#: The rules on bullets in their order; all of them are one projection. A caller may pass others to ``validate``.
BULLET_RULES: tuple[Rule, ...] = (
    Rule("V3", "cited turns exist", _turn_rule),
    Rule("V4", "quotes stand in the cited turns", _quote_rule),
    Rule("V5", "quotes have the speaker", _speaker_rule),
    Rule("V6", "numbers were said", _number_rule),
    Rule("V8", "clinical terms were said", _term_rules),
    Rule("V10", "planned and completed as said", _status_rule),
    Rule("V11", "hedges are kept", _hedge_rule),
    Rule("V16", "text, repeats, explanation", _form_rule),
)
#: Parts of the summaries at most in which a failing rule is looked for at once.
MOST_SUSPECTS = 64


def _said_by(rows: DataFrame, *rules: Rule) -> DataFrame:
    said = [r.columns() for r in rules]
    none = _finding(F.lit(False), "", "", F.lit(""), ""), _counter("", F.lit(False), F.lit(False))
    found, counts = ([c for one in said for c in one[k]] or [none[k]] for k in (0, 1))
    return rows.select(*KEYS, F.concat(*found).alias("findings"), F.concat(*counts).alias("counters"))


def _works(rows: DataFrame) -> bool:
    try:
        rows.write.format("noop").mode("overwrite").save()
    except PySparkException:
        return False
    return True


def _isolated(name: str, rows: DataFrame, rule: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What a rule says of ``rows``, and V0 for the summaries on which it fails.

    The failing summaries are found by halving: only halves in which the rule still fails are parted
    again, by one more bit of the key's hash. Beyond ``MOST_SUSPECTS`` failing parts each part gets V0 whole.
    """
    try:
        return worked_out(rule(rows))
    except PySparkException:
        pass
    h, suspects = F.xxhash64(*KEYS), [0]
    for bit in range(48):
        halves = [v | (side << bit) for v in suspects for side in (0, 1)]
        failing = [v for v in halves if not _works(rule(rows.filter(h.bitwiseAND(F.lit((2 << bit) - 1).cast("long")) == v)))]
        suspects, within = failing, F.lit((2 << bit) - 1).cast("long")
        inside = h.bitwiseAND(within).isin(*suspects) if suspects else F.lit(False)
        if len(suspects) > MOST_SUSPECTS or rows.filter(inside).select(*KEYS).distinct().count() <= len(suspects):
            break
    bad = worked_out(rows.filter(inside).select(*KEYS).distinct())
    failed = _finding(F.lit(True), "V0", "ERROR", F.lit("$"), f"rule {name} failed on this summary")
    blank = bad.select(*KEYS, failed.alias("findings"), _counter("", F.lit(False), F.lit(False)).alias("counters"))
    return worked_out(rule(rows.filter(~inside))).unionByName(blank)


def validate(summaries: DataFrame, turns: DataFrame, drugs: list[str] | None = None, rules: tuple[Rule, ...] = BULLET_RULES) -> tuple[DataFrame, DataFrame]:
    """(findings, counters) of JSON ``summaries`` (system, call_id, summary) over ``turns`` (call_id, turn_id, speaker, text).

    findings: system, call_id, rule, severity, path, message. counters: system, call_id, name, ok,
    total, summed. A summary that breaks the closed schema (V1) gets V2 and V3 only. With ``drugs``
    (names in lower case) V7 and V13 to V15 run as well. Parsed summaries, call texts, prepared bullets
    and what all rules say are worked out once, in the shared folder. If that job fails, each rule is
    worked out apart and a summary on which a rule fails gets V0 in its place.
    """
    s = worked_out(parsed(summaries))
    whole, odd = (s.filter(F.col("keys").isNotNull() & good) for good in (F.size("errors") == 0, F.size("errors") > 0))
    context = worked_out(call_context(turns))
    b = worked_out(_prepared(bullets(whole), context))
    cited = bullets(odd).join(context.select("call_id", "n"), "call_id")
    turn_rule = tuple(r for r in rules if r.name == "V3")
    parts: list[tuple[str, DataFrame, Callable[[DataFrame], DataFrame]]] = [
        ("V12", b, _negation_findings),
        ("V1", s, _summary_rules),
        ("V3", cited, lambda x: _said_by(x, *turn_rule)),
        ("V9", whole, lambda x: identity_findings(x, context)),
    ]
    if drugs is not None:
        parts += [("V7", b, lambda x: _drug_findings(x, drugs)), ("V13", whole, lambda x: _flag_findings(x, turns, drugs))]
    try:
        said = worked_out(reduce(DataFrame.unionByName, (rule(rows) for _, rows, rule in parts), _said_by(b, *rules)))
    except PySparkException:
        apart = [(r.name, b, lambda x, r=r: _said_by(x, r)) for r in rules] + parts
        said = reduce(DataFrame.unionByName, (_isolated(*part) for part in apart))
    findings = said.select(*KEYS, F.explode("findings").alias("f")).select(*KEYS, "f.*")
    counters = said.select(*KEYS, F.explode("counters").alias("c")).select(*KEYS, "c.*")
    return findings, counters.groupBy(*KEYS, "name").agg(F.sum("ok").alias("ok"), F.sum("total").alias("total"))
