"""Errors of recorded medications against gold ones, and precision and recall over distinct names."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from turnloom.functions import text as T
from turnloom.operators.greedy import greedy_match, names_match
from turnloom.operators.scoring import same_dose
from turnloom.sources.shared import worked_out

KINDS = ("ok", "dose_missing", "unit_wrong", "dose_wrong", "not_found", "extra")


def _number(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"[^\d.]", "").try_cast("double")


def said_near(text: Column, name: Column, dose: Column) -> tuple[Column, Column]:
    """Whether a text names a drug, and whether its number stands between that name and the next sentence's end."""
    plain, word = T.normalize(F.coalesce(text, F.lit(""))), T.normalize(F.coalesce(name, F.lit("")))
    named = T.padded_contains(plain, word)
    behind = F.substring_index(F.substring(F.lower(text), F.greatest(F.instr(F.lower(text), F.lower(name)), F.lit(1)), F.length(text)), ". ", 1)
    number = F.regexp_extract(F.coalesce(dose, F.lit("")), r"(\d+(?:\.\d+)?)", 1)
    return named, named & (number != "") & F.array_contains(F.regexp_extract_all(behind, F.lit(r"(\d+(?:\.\d+)?)"), 1), number)


def medication_errors(gold: DataFrame, model: DataFrame, keys: list[str], texts: DataFrame | None = None) -> DataFrame:
    """keys, side, ord, kind, name, dose, unit, named, dosed: every gold medication with what became of it, and the extra ones.

    ``gold`` and ``model``: keys, ord, name, dose, unit (texts). A gold one takes the first unused model one
    in order whose name matches; its ``kind`` is the first that holds: ok (same dose and unit),
    dose_missing, unit_wrong (equal numbers), dose_wrong; not_found without a match. ``texts`` (keys, text),
    the summaries, tell whether the name and the dose stand there at all.
    """
    hit = worked_out(greedy_match(gold, model, keys, "ord", "name"))
    g = hit.select(*keys, "ord", "match_order").join(gold, [*keys, "ord"])
    m = model.select(*keys, F.col("ord").alias("match_order"), F.col("dose").alias("m_dose"), F.col("unit").alias("m_unit"), F.lit(True).alias("met"))
    j = g.join(m, [*keys, "match_order"], "left")
    kind = (
        F.when(F.col("met").isNull(), "not_found")
        .when(F.coalesce(same_dose(F.col("dose"), F.col("unit"), F.col("m_dose"), F.col("m_unit")), F.lit(False)), "ok")
        .when(F.coalesce("m_dose", F.lit("")) == "", "dose_missing")
        .when(F.coalesce(_number(F.col("dose")) == _number(F.col("m_dose")), F.lit(False)), "unit_wrong")
        .otherwise("dose_wrong")
    )
    rows = j.select(*keys, F.lit("gold").alias("side"), "ord", kind.alias("kind"), "name", "dose", "unit")
    used = hit.filter("match_order is not null").select(*keys, F.col("match_order").alias("ord"))
    rows = rows.unionByName(model.join(used, [*keys, "ord"], "left_anti").select(*keys, F.lit("model").alias("side"), "ord", F.lit("extra").alias("kind"), "name", "dose", "unit"))
    if texts is None:
        return rows
    named, dosed = said_near(F.col("text"), F.col("name"), F.col("dose"))
    return rows.join(texts, keys, "left").withColumn("named", F.coalesce(named, F.lit(False))).withColumn("dosed", F.coalesce(dosed, F.lit(False))).drop("text")


@F.pandas_udf(BooleanType())
def any_name(name: pd.Series, known: pd.Series) -> pd.Series:
    """Whether a name matches one of some names."""
    return pd.Series([any(names_match(n or "", k or "") for k in (() if ks is None else ks)) for n, ks in zip(name, known, strict=True)], dtype="bool")


def error_table(errors: DataFrame, by: list[str]) -> DataFrame:
    """One row per ``by`` with a count of each kind."""
    counts = errors.groupBy(*by).pivot("kind", list(KINDS)).agg(F.count(F.lit(1)))
    return counts.select(*by, *(F.coalesce(k, F.lit(0)).alias(k) for k in KINDS))


def distinct_names(model: DataFrame, keys: list[str]) -> DataFrame:
    """Names merged by their normal form within ``keys``; of equal ones the last in order wins."""
    columns = [c for c in model.columns if c not in keys]
    last = model.groupBy(*keys, T.normalize(F.coalesce("name", F.lit(""))).alias("normal")).agg(F.max_by(F.struct(*columns), "ord").alias("x"))
    return last.select(*keys, "normal", "x.*")


def name_scores(gold: DataFrame, model: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """by, distinct_names, gold, found, ok, hit, precision, recall, f1: over merged names, so that a drug listed twice is no invention."""
    errors = medication_errors(gold, model, keys)
    mine = distinct_names(model, keys)
    # any gold name of the call, taken or not, makes a distinct name a hit
    names = gold.groupBy(*keys).agg(F.collect_set("name").alias("known"))
    hits = mine.join(names, keys, "left").withColumn("hit", any_name("name", "known"))
    hits = hits.groupBy(*by).agg(F.count(F.lit(1)).alias("distinct_names"), F.count_if("hit").alias("hit"))
    found = errors.filter("side = 'gold'").groupBy(*by).agg(F.count(F.lit(1)).alias("gold"), F.count_if(F.col("kind") != "not_found").alias("found"), F.count_if(F.col("kind") == "ok").alias("ok"))
    j = hits.join(found, by, "full")
    p, r = F.col("hit") / F.nullif(F.col("distinct_names"), F.lit(0)), F.col("found") / F.nullif(F.col("gold"), F.lit(0))
    return j.withColumn("precision", p).withColumn("recall", r).withColumn("f1", 2 * p * r / F.nullif(p + r, F.lit(0.0)))
