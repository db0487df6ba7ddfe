"""The identity rule V9: names, date of birth, phone and relationship against what was said in the call."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from turnloom.functions import text as T
from turnloom.functions.fuzzy import best_ratio_udf
from turnloom.functions.spoken import number_candidates

KEYS = ("system", "call_id")
CLOSE = 0.8
DATE_TURNS, PHONE_TURNS = 4, 5

# How a relationship is said, in their natural order.
RELATIONSHIP_WORDS = {
    "mother": ["mother", "mom", "mum", "mama", "mommy", "ma"], "father": ["father", "dad", "daddy", "papa", "pop"],
    "wife": ["wife", "my wife"], "husband": ["husband", "hubby"], "daughter": ["daughter"], "son": ["son"], "sister": ["sister"], "brother": ["brother"],
    "spouse": ["spouse", "wife", "husband", "partner"], "partner": ["partner", "boyfriend", "girlfriend", "fiance"], "grandmother": ["grandmother", "grandma", "nana", "granny"],
    "grandfather": ["grandfather", "grandpa", "granddad"], "grandson": ["grandson"], "granddaughter": ["granddaughter"], "niece": ["niece"], "nephew": ["nephew"],
    "aunt": ["aunt", "auntie"], "uncle": ["uncle"], "friend": ["friend"], "neighbor": ["neighbor", "neighbour"], "aide": ["aide", "caregiver", "caretaker", "home health aide", "hha", "cna"],
    "caregiver": ["caregiver", "aide", "caretaker", "cna"], "nurse": ["nurse", "rn", "lpn"], "daughter-in-law": ["daughter in law", "daughter-in-law"], "son-in-law": ["son in law", "son-in-law"],
    "self": ["myself", "me", "my own", "i'm the patient", "i am the patient", "calling for myself", "it's me", "this is"],
    "staff": ["staff", "nurse", "aide", "caregiver", "facility", "assisted living", "nursing home", "resident"], "guardian": ["guardian", "foster"], "parent": ["mom", "dad", "mother", "father", "parent"],
    "volunteer": ["volunteer"], "cousin": ["cousin"], "mother-in-law": ["mother in law"], "father-in-law": ["father in law"], "roommate": ["roommate"], "pastor": ["pastor", "chaplain"],
}
# How a caller of each relationship names the patient, in their natural order.
PATIENT_WORDS = {
    "daughter": ["mom", "mother", "dad", "father", "mama", "papa", "parent", "grandma", "grandmother", "grandpa", "grandfather", "mum"],
    "son": ["mom", "mother", "dad", "father", "mama", "papa", "parent", "grandma", "grandmother", "grandpa", "grandfather", "mum"],
    "wife": ["husband", "hubby"], "husband": ["wife"], "spouse": ["husband", "wife", "hubby"], "partner": ["partner", "boyfriend", "girlfriend", "husband", "wife"],
    "mother": ["son", "daughter", "child", "baby", "boy", "girl", "kid", "toddler", "infant"], "father": ["son", "daughter", "child", "baby", "boy", "girl", "kid", "toddler", "infant"],
    "parent": ["son", "daughter", "child", "baby", "boy", "girl", "kid", "toddler", "infant"], "sister": ["brother", "sister"], "brother": ["brother", "sister"],
    "granddaughter": ["grandma", "grandmother", "grandpa", "grandfather", "nana"], "grandson": ["grandma", "grandmother", "grandpa", "grandfather", "nana"],
    "niece": ["aunt", "uncle", "auntie"], "nephew": ["aunt", "uncle", "auntie"], "friend": ["friend"], "neighbor": ["neighbor", "neighbour"],
    "aide": ["client", "patient", "resident", "lady", "gentleman"], "caregiver": ["client", "patient", "resident", "lady", "gentleman"], "staff": ["resident", "patient", "client"],
}
# Parts of a relationship that name no person.
NO_PERSON = ("paid", "home", "group", "facility", "law", "in")


def _said_as(part: Column) -> Column:
    """The words of one part of a relationship; an unknown part stands for itself."""
    own, patient = (F.create_map(*(x for k, v in words.items() for x in (F.lit(k), F.array(*map(F.lit, v))))) for words in (RELATIONSHIP_WORDS, PATIENT_WORDS))
    return F.concat(F.coalesce(F.try_element_at(own, part), F.array(part)), F.coalesce(F.try_element_at(patient, part), F.array().cast("array<string>")))


def relationship_said(relationship: Column, text: Column) -> Column:
    """Whether any word for a relationship, whole or by its parts, stands in a text; 'self' and none always."""
    whole = F.lower(F.coalesce(relationship, F.lit("")))
    parts = F.filter(F.split(whole, r"[\s-]+"), lambda p: (F.length(p) >= 3) & ~p.isin(*NO_PERSON))
    words = F.concat(F.array(whole, F.regexp_replace(whole, "-", " ")), F.flatten(F.transform(F.concat(F.array(whole), parts), _said_as)))
    low = F.lower(text)
    return (whole == "") | (whole == "self") | F.exists(words, lambda w: F.rlike(low, F.concat(F.lit(r"\b\Q"), w, F.lit(r"\E\b"))))


def _parts_of_date(iso: Column) -> Column:
    """Year, month and day of a YYYY-MM-DD text as said: without leading zeros; null if it is none."""
    split = F.split(iso, "-")
    return F.when(F.rlike(iso, F.lit(r"^\d{4}-\d{2}-\d{2}$")), F.array(split[0], split[1].cast("int").cast("string"), split[2].cast("int").cast("string")))


def date_state(iso: Column, call_numbers: Column, window_numbers: Column) -> Column:
    """'ok': all parts said within some window; 'scattered': said, but apart; 'bad': no date or not said."""
    parts = _parts_of_date(iso)
    said = lambda numbers: F.forall(parts, lambda x: T.supported(x, numbers))
    return F.when(parts.isNull() | ~said(call_numbers), "bad").when(F.exists(window_numbers, said), "ok").otherwise("scattered")


def phone_state(phone: Column, call_numbers: Column, window_numbers: Column) -> Column:
    """'ok': ten digits said as one number in the call or some window; else 'bad'."""
    digits = F.regexp_replace(F.coalesce(phone, F.lit("")), r"\D", "")
    said = F.array_contains(call_numbers, digits) | F.exists(window_numbers, lambda n: F.array_contains(n, digits))
    return F.when((F.length(digits) == 10) & said, "ok").otherwise("bad")


@F.pandas_udf(ArrayType(ArrayType(StringType())))
def numbers_of_runs(runs: pd.Series) -> pd.Series:
    """The numbers said in each text of an array of texts."""
    return runs.map(lambda texts: [] if texts is None else [sorted(number_candidates(t)) for t in texts])


_FINDINGS = "array<struct<rule:string,severity:string,path:string,message:string>>"
_COUNTERS = "array<struct<name:string,ok:bigint,total:bigint>>"


def _said(when: Column, severity: Column | str, key: str | Column, message: str) -> Column:
    """A finding of V9 as an array, empty where ``when`` does not hold."""
    level, name = (F.lit(x) if isinstance(x, str) else x for x in (severity, key))
    one = F.struct(F.lit("V9").alias("rule"), level.alias("severity"), F.concat(F.lit("identity."), name).alias("path"), F.lit(message).alias("message"))
    return F.when(F.coalesce(when, F.lit(False)), F.array(one)).otherwise(F.array().cast(_FINDINGS))


def _counted(when: Column, ok: Column) -> Column:
    one = F.struct(F.lit("identity_supported").alias("name"), F.coalesce(ok, F.lit(False)).cast("long").alias("ok"), F.lit(1).cast("long").alias("total"))
    return F.when(F.coalesce(when, F.lit(False)), F.array(one)).otherwise(F.array().cast(_COUNTERS))


def identity_findings(summaries: DataFrame, context: DataFrame) -> DataFrame:
    """system, call_id, findings, counters of V9 over parsed summaries (system, call_id, s) and their calls (call_context).

    Calls marked not applicable are left out. A name part that was not said is a warning where a close
    spelling was said; a stated name with other close spellings among the call's proper names is one too.
    One row a name and one a summary: dates and phones are read in windows of the call in the same row.
    """
    c = context.select("call_id", "texts", "n", "call_numbers", F.split(F.array_join("norms", " "), " ").alias("words"), F.array_join("texts", " ").alias("whole"))
    proper = F.transform(F.regexp_extract_all("whole", F.lit(r"(?<![.?!]\s)(?<!^)\b([A-Z][a-z]{3,})\b"), 1), F.lower)
    c = c.withColumn("proper", F.array_distinct(proper))
    rows = summaries.filter("s is not null and not coalesce(s.not_applicable.is_na, false)").join(c, "call_id")
    value = lambda key: F.col(f"s.identity.{key}.value")
    filled = lambda key: F.coalesce(value(key), F.lit("")) != ""

    fields = ("patient_name", "patient_dob", "caller_name", "relationship", "callback_phone")
    sure = [_said(filled(k) & (F.col(f"s.identity.{k}.certainty") == "not_stated"), "ERROR", k, "value present but certainty is 'not_stated'") for k in fields]
    names = ("patient_name", "caller_name")
    sure += [_said(~filled(k) & (F.col(f"s.identity.{k}.certainty") == "stated"), "ERROR", k, "certainty is 'stated' but the value is empty") for k in names]

    runs = lambda turns, last: F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.array_join(F.slice("texts", i, turns), " "))
    none = F.array().cast("array<string>")
    rows = rows.withColumn("date_near", numbers_of_runs(F.when(filled("patient_dob"), runs(DATE_TURNS, F.col("n"))).otherwise(none)))
    rows = rows.withColumn("phone_near", numbers_of_runs(F.when(filled("callback_phone"), runs(PHONE_TURNS, F.col("n") - 3)).otherwise(none)))
    rows = rows.withColumn("born", F.when(filled("patient_dob"), date_state(value("patient_dob"), F.col("call_numbers"), F.col("date_near"))))
    rows = rows.withColumn("called", F.when(filled("callback_phone"), phone_state(value("callback_phone"), F.col("call_numbers"), F.col("phone_near"))))
    kin = ~F.lower(F.coalesce(value("relationship"), F.lit(""))).isin("", "self")
    rows = rows.withColumn("kin", F.when(kin, relationship_said(value("relationship"), F.col("whole"))))
    found = [
        *sure,
        _said(F.col("born") == "bad", "ERROR", "patient_dob", "no date, or one with parts that were never said"),
        _said(F.col("born") == "scattered", "WARN", "patient_dob", "year, month and day are said, but not close together"),
        _said(F.col("called") == "bad", "ERROR", "callback_phone", "not ten digits, or never said as one number"),
        _said(~F.col("kin"), "WARN", "relationship", "the relationship is never mentioned in the call"),
    ]
    counts = [_counted(F.col("born").isNotNull(), F.col("born") != "bad"), _counted(F.col("called").isNotNull(), F.col("called") == "ok"), _counted(F.col("kin").isNotNull(), F.col("kin"))]
    whole = rows.select(*KEYS, F.concat(*found).alias("findings"), F.concat(*counts).alias("counters"))

    named = F.filter(F.array(*(F.struct(F.lit(k).alias("key"), value(k).alias("value"), F.col(f"s.identity.{k}.certainty").alias("certainty")) for k in names)), lambda x: F.coalesce(x["value"], F.lit("")) != "")
    each = rows.select(*KEYS, F.explode(named).alias("f"), "words", "proper").withColumn("parts", F.filter(F.split(T.normalize(F.col("f.value")), " "), lambda w: F.length(w) > 1))
    each = each.withColumn("missing", F.array_except("parts", "words"))
    stated = (F.size("missing") == 0) & (F.col("f.certainty") == "stated")
    asked = F.when(F.size("missing") > 0, F.col("missing")).when(stated, F.filter("parts", lambda w: F.length(w) >= 4)).otherwise(F.array().cast("array<string>"))
    parts = each.select(*KEYS, "f.key", "missing", stated.alias("stated"), "words", "proper", F.explode_outer(asked).alias("part"))
    others = F.filter("proper", lambda w: (w != F.col("part")) & (F.length(w) >= 4))
    alike = F.coalesce(best_ratio_udf(F.coalesce("part", F.lit("")), F.when(F.size("missing") > 0, F.col("words")).otherwise(others)) >= CLOSE, F.lit(False))
    parts = parts.withColumn("alike", F.when(F.col("part").isNotNull(), alike))
    judged = parts.groupBy(*KEYS, "key").agg(F.max(F.size("missing") > 0).alias("lost"), F.max("stated").alias("stated"), F.bool_and("alike").alias("all"), F.bool_or("alike").alias("any"))
    severity = F.when(F.col("all"), "WARN").otherwise("ERROR")
    of_names = judged.select(
        *KEYS,
        F.concat(_said(F.col("lost"), severity, F.col("key"), "name parts that are not in the call"), _said(F.col("stated") & F.col("any"), "WARN", F.col("key"), "a stated name with similar spellings in the call")).alias("findings"),
        _counted(F.lit(True), ~F.col("lost")).alias("counters"),
    )
    return whole.unionByName(of_names)
