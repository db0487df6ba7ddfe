"""Checks of authored calls: record against gold summary, both against the transcript, calls against each other."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnloom.functions import text as T

# Vocabularies and length ranges.
CATEGORIES = ("routine", "ambiguous", "asr_error", "medication", "supply", "high_risk", "not_applicable")
RISKS = ("uncontrolled_symptom", "medication_concern", "suicidal_statement", "breathing_concern", "escalation_request", "other_urgent")
LENGTHS = {"short": (1500, 4500), "medium": (4500, 7500), "long": (7500, 13500)}
LENGTHS_V2 = {"short": (4500, 9000), "medium": (7500, 12500), "long": (10500, 18000)}
SECTIONS = ("assessment", "response", "education")
_BULLET = "struct<speaker:string,turns:array<int>,quote:string,covers:array<string>>"
GOLD = (
    f"not_applicable struct<is_na:boolean>, chief_complaint {_BULLET}, "
    + ", ".join(f"{s} array<{_BULLET}>" for s in SECTIONS)
    + ", risk_flags array<struct<category:string,turns:array<int>,quote:string>>"
)


def _said(rows: DataFrame, when: Column, level: str, code: str, message: Column | str) -> DataFrame:
    text = F.lit(message) if isinstance(message, str) else message
    return rows.filter(F.coalesce(when, F.lit(False))).select("call_id", F.lit(level).alias("level"), F.lit(code).alias("code"), text.alias("message"))


def _range(bucket: Column, ranges: dict[str, tuple[int, int]], end: int) -> Column:
    return reduce(lambda c, k: F.when(bucket == k, ranges[k][end]).otherwise(c), ranges, F.lit(None).cast("int"))


def gold_findings(calls: DataFrame, turns: DataFrame) -> DataFrame:
    """call_id, level, code, message of ``calls`` (see ``authored_calls``) and their ``turns`` (see ``strict_turns``).

    G1 vocabularies, ids and the Not-Applicable label; G2 quotes and speakers; G7 and G8 coverage both
    ways; G9 flags; G12 length; LEAK values that two calls share; DUP call ids.
    """
    c = calls.withColumn("g", F.from_json("gold", GOLD))
    na = F.coalesce(F.col("g.not_applicable.is_na"), F.lit(False))
    category, bucket = F.col("setup")["scenario_category"], F.col("setup")["length_bucket"]
    ids = F.flatten(F.array(*(F.coalesce(F.transform(s, lambda i: i["item_id"]), F.array().cast("array<string>")) for s in SECTIONS), F.coalesce(F.transform("risk_flags", lambda f: f["flag_id"]), F.array().cast("array<string>"))))
    flags = F.coalesce(F.transform("g.risk_flags", lambda f: f["category"]), F.array().cast("array<string>"))
    full = reduce(lambda a, b: a | b, (F.coalesce(F.size(f"g.{s}"), F.lit(0)) > 0 for s in SECTIONS))
    needed = F.filter(F.coalesce("risk_flags", F.array().cast("array<map<string,string>>")), lambda f: F.coalesce(f["flag_required"], F.lit("true")) != "false")
    wanted = F.array_sort(F.array_distinct(F.transform(needed, lambda f: f["risk_category"])))
    v2 = F.coalesce(F.col("setup")["length_regime"] == "v2", F.lit(False))
    low = F.when(category == "not_applicable", 150).when(v2, _range(bucket, LENGTHS_V2, 0)).otherwise(_range(bucket, LENGTHS, 0))
    high = F.when(v2, _range(bucket, LENGTHS_V2, 1)).otherwise(_range(bucket, LENGTHS, 1))
    out = [
        _said(c, ~F.coalesce(category.isin(*CATEGORIES), F.lit(False)), "ERROR", "G1", "scenario category is not in the vocabulary"),
        _said(c, ~F.coalesce(bucket.isin(*LENGTHS), F.lit(False)), "ERROR", "G1", "length bucket is not in the vocabulary"),
        _said(c, F.size(F.array_distinct(ids)) != F.size(ids), "ERROR", "G1", "an item or flag id is used twice"),
        _said(c, F.size(F.array_except(flags, F.array(*map(F.lit, RISKS)))) > 0, "ERROR", "G1", "a gold flag's category is not in the vocabulary"),
        _said(c, (category == "not_applicable") != na, "ERROR", "G1", "record and gold differ on Not Applicable"),
        _said(c, na & full, "ERROR", "G1", "a Not Applicable call has sections"),
        _said(c, na & (F.size(flags) > 0), "ERROR", "G9", "a Not Applicable call has risk flags"),
        _said(c, F.array_sort(F.array_distinct(flags)) != wanted, "ERROR", "G9", "flags of record and gold differ"),
    ]
    live = c.filter(~na)
    heads = live.select("call_id", F.lit("chief_complaint").alias("section"), F.lit("chief_complaint").alias("label"), F.col("g.chief_complaint").alias("b"))
    rows = [heads.filter("b is not null")]
    for s in SECTIONS:
        r = live.select("call_id", F.lit(s).alias("section"), F.posexplode(f"g.{s}").alias("k", "b"))
        rows.append(r.select("call_id", "section", F.concat(F.lit(f"{s}["), "k", F.lit("]")).alias("label"), "b"))
    bullets = reduce(DataFrame.unionByName, rows)
    quoted = bullets.select("call_id", "label", "b.*").unionByName(
        live.select("call_id", F.explode("g.risk_flags").alias("f")).select("call_id", F.lit("risk_flags").alias("label"), F.lit(None).cast("string").alias("speaker"), "f.turns", "f.quote", F.lit(None).cast("array<string>").alias("covers"))
    )
    other = F.when(F.col("label_error"), F.when(F.col("speaker") == "Nurse", "Caller").otherwise("Nurse")).otherwise(F.col("speaker"))
    heard = turns.groupBy("call_id").agg(F.array_sort(F.collect_list(F.struct("turn_id", "text", other.alias("who")))).alias("t"))
    q = quoted.join(heard, "call_id").withColumn("cited", F.transform(F.filter("turns", lambda i: (i >= 1) & (i <= F.size("t"))), lambda i: F.element_at("t", i)))
    text = T.normalize(F.array_join(F.transform("cited", lambda x: x["text"]), " "))
    out += [
        _said(q, ~text.contains(T.normalize(F.col("quote"))), "ERROR", "G2", F.concat("label", F.lit(": quote not found in the cited turns"))),
        _said(q, F.col("speaker").isNotNull() & F.exists("cited", lambda x: x["who"] != F.col("speaker")), "ERROR", "G2", F.concat("label", F.lit(": a cited turn has another speaker"))),
    ]
    items = reduce(DataFrame.unionByName, (live.select("call_id", F.lit(s).alias("of"), F.explode(s).alias("i")).select("call_id", "of", F.col("i")["item_id"].alias("item_id")) for s in SECTIONS))
    covers = bullets.select("call_id", "section", "label", F.explode_outer("b.covers").alias("item_id"))
    known = covers.filter("item_id is not null AND item_id <> 'cc'")
    out += [
        _said(covers, F.col("item_id").isNull(), "ERROR", "G8", F.concat("label", F.lit(": covers nothing"))),
        _said(known.join(items, ["call_id", "item_id"], "left_anti"), F.lit(True), "ERROR", "G8", F.concat("label", F.lit(": covers unknown item "), "item_id")),
        _said(items.join(known, ["call_id", "item_id"], "left_anti"), F.lit(True), "ERROR", "G7", F.concat("item_id", F.lit(" is not covered by any bullet"))),
        _said(known.join(items, ["call_id", "item_id"]), (F.col("section") != "chief_complaint") & (F.col("section") != F.col("of")), "WARN", "G8", F.concat("label", F.lit(": covers an item of section "), "of")),
        _said(live.join(covers.filter("label = 'chief_complaint' AND item_id = 'cc'"), "call_id", "left_anti"), F.lit(True), "ERROR", "G7", "chief complaint does not cover 'cc'"),
        _said(c, ~F.length("transcript").between(low, high), "WARN", "G12", "transcript length is outside its bucket"),
    ]
    keys = ("patient_name_true", "patient_dob_true", "callback_phone_true")
    values = c.select("call_id", "split", F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.col("chief_complaint")[k].alias("v")) for k in keys))).alias("x"))
    shared = values.filter("x.v <> ''").groupBy("x.k", "x.v").agg(F.count_distinct("call_id").alias("n"), F.count_distinct("split").alias("splits"), F.min("call_id").alias("call_id"))
    leak = shared.filter("n > 1").select("call_id", F.when(F.col("splits") > 1, "ERROR").otherwise("WARN").alias("level"), F.lit("LEAK").alias("code"), F.concat("k", F.lit(" is used in "), "n", F.lit(" calls")).alias("message"))
    twice = c.groupBy("call_id").agg(F.count(F.lit(1)).alias("n"))
    out += [leak, _said(twice, F.col("n") > 1, "ERROR", "DUP", "call_id is used twice")]
    return reduce(DataFrame.unionByName, out)
