"""Repairs that give whole summaries back: quotes by their cited turns, medication facts by what was said.

Findings become patches (path, value) that one pass applies to the JSON text; all else keeps its text
and its order of keys, and the input is never changed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnloom.functions import text as T
from turnloom.functions.fuzzy import with_repaired_quotes
from turnloom.functions.spoken import extract_dose_udf
from turnloom.operators.medication import medication_findings, names_of
from turnloom.operators.patch import APPEND, apply_patches
from turnloom.operators.relational import texts_of
from turnloom.operators.validation import KEYS, SUMMARY, bullets
from turnloom.sources.shared import worked_out

CHIEF = "chief_complaint"


def _parsed(summaries: DataFrame) -> DataFrame:
    whole = F.when(F.try_parse_json("summary").isNotNull(), F.col("summary"))
    return summaries.select(*KEYS, F.from_json(whole, SUMMARY).alias("s"))


def _where(section: Column, ord_: Column, *more: Column | str) -> Column:
    """The path of a bullet or of something below it."""
    rest = [F.lit(m) if isinstance(m, str) else m for m in more]
    return F.when(section == CHIEF, F.array(section, *rest)).otherwise(F.array(section, ord_.cast("string"), *rest))


def _json(text: Column) -> Column:
    return F.regexp_extract(F.to_json(F.struct(text.alias("v"))), r"(?s)^\{\"v\":(.*)\}$", 1)


def repaired_summaries(summaries: DataFrame, turns: DataFrame) -> DataFrame:
    """``summaries`` (system, call_id, summary) with repaired quotes and ``patches``, the number replaced.

    A quote of a bullet or a risk flag that does not stand in its cited turns becomes the closest span of
    one or two of their sentences, if that is close enough. Without a cited turn of the call it stays.
    """
    s = _parsed(summaries)
    calls = turns.groupBy("call_id").agg(F.array_sort(F.collect_list(F.struct("turn_id", "text"))).alias("t")).select("call_id", F.col("t.text").alias("texts"))
    flags = s.select(*KEYS, F.posexplode("s.risk_flags").alias("ord", "f")).select(*KEYS, F.lit("risk_flags").alias("section"), "ord", F.col("f.turns").alias("ids"), F.col("f.quote").alias("quote"))
    quoted = bullets(s).select(*KEYS, "section", "ord", "ids", "quote").unionByName(flags).filter("quote is not null")
    cited = F.filter("ids", lambda i: (i >= 1) & (i <= F.size("texts")))
    rows = quoted.join(calls, "call_id").withColumn("cited", cited).filter(F.size("cited") > 0).withColumn("said", texts_of(F.col("cited"), F.col("texts")))
    new = with_repaired_quotes(rows, "new", F.array("quote"), F.col("said")).withColumn("new", F.get("new", F.lit(0))).filter("new <> quote")
    patches = new.select(*KEYS, F.lit(0).alias("ord"), _where(F.col("section"), F.col("ord"), "quote").alias("path"), F.lit(None).cast("string").alias("after"), _json(F.col("new")).alias("value"))
    return apply_patches(summaries, patches, list(KEYS), "summary")


def checked_medication(summaries: DataFrame, turns: DataFrame, drugs: list[str]) -> tuple[DataFrame, DataFrame]:
    """(summaries with typed facts added and doses filled, findings: system, call_id, rule, severity, drug, dose, unit).

    M2: a medication fact without a dose takes the one that its bullet's text gives, next to its name,
    unless that number is its strength. M1: an expected drug that a bullet names but no fact types gets a
    fact on the first such bullet. M3: an expected drug that the summary does not name; nothing changes.
    """
    b = worked_out(bullets(_parsed(summaries)))
    facts = b.select(*KEYS, "section", "ord", "text", F.posexplode("facts").alias("k", "f"))
    bare = facts.filter((F.col("f.type") == "medication") & (F.coalesce("f.dose", F.lit("")) == "") & (F.coalesce("f.name", F.lit("")) != ""))
    dosed = bare.withColumn("got", extract_dose_udf(drugs)("text", "f.name")).filter("got.dose is not null")
    strengths = F.regexp_extract_all(F.coalesce("f.strength", F.lit("")), F.lit(r"(\d+(?:\.\d+)?)"), 1)
    dosed = worked_out(dosed.filter(~F.array_contains(strengths, F.col("got.dose"))))
    filled = [
        dosed.select(*KEYS, F.lit(k).alias("ord"), _where(F.col("section"), F.col("ord"), "facts", F.col("k").cast("string"), F.lit(key)).alias("path"), F.lit(after).alias("after"), _json(F.col(f"got.{key}")).alias("value"))
        for k, (key, after) in enumerate((("dose", "name"), ("unit", "dose")))
    ]

    typed = F.filter(F.transform("facts", lambda f: F.when(f["type"] == "medication", f["name"]).when(f["type"] == "action", F.coalesce(f["med_name"], f["medication"]))), lambda n: F.coalesce(n, F.lit("")) != "")
    order = F.when(F.col("section") == CHIEF, F.lit(-1)).otherwise(F.array_position(F.array(*map(F.lit, ("assessment", "response", "education"))), F.col("section")) * 100_000 + F.col("ord"))
    listed = b.select(*KEYS, "section", F.col("ord").alias("at"), order.cast("int").alias("ord"), "text", typed.alias("names"))
    found = worked_out(medication_findings(listed.filter(F.col("section") != CHIEF), turns, drugs, KEYS))
    chief = listed.filter(F.col("section") == CHIEF).select(*KEYS, F.col("text").alias("reason"))
    named = F.exists(names_of(F.col("drug")), lambda n: T.padded_contains(T.normalize(F.coalesce("reason", F.lit(""))), T.normalize(n)))
    found = found.join(chief, list(KEYS), "left").filter(~((F.col("rule") == "M3") & named)).drop("reason")
    hosts = found.filter("rule = 'M1'").join(listed.select(*KEYS, "section", "at", F.col("ord").alias("host")), [*KEYS, "host"])
    fact = F.to_json(F.struct(F.lit("medication").alias("type"), F.col("drug").alias("name"), "dose", "unit", F.lit("stated").alias("certainty")))
    added = hosts.select(*KEYS, F.lit(9).alias("ord"), _where(F.col("section"), F.col("at"), "facts", APPEND).alias("path"), F.lit(None).cast("string").alias("after"), fact.alias("value"))
    patches = filled[0].unionByName(filled[1]).unionByName(added)
    said = found.select(*KEYS, "rule", F.when(F.col("rule") == "M3", "WARN").otherwise("INFO").alias("severity"), "drug", "dose", "unit")
    said = said.unionByName(dosed.select(*KEYS, F.lit("M2").alias("rule"), F.lit("INFO").alias("severity"), F.col("f.name").alias("drug"), "got.dose", "got.unit"))
    return apply_patches(summaries, patches, list(KEYS), "summary"), said
