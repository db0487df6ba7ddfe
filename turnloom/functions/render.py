"""Formats of rendered documents."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MISSING = "Not provided"


def timestamp(c: Column) -> Column:
    """[2000-01-01 14:41 UTC] of an ISO text; a null stays a placeholder."""
    at = F.date_format(F.try_to_timestamp(c), "yyyy-MM-dd HH:mm")
    return F.concat(F.lit("["), F.coalesce(at, F.lit(MISSING)), F.when(at.isNotNull(), " UTC]").otherwise("]"))


def birth_date(c: Column) -> Column:
    """06/04/1951 of 1951-06-04; other texts stay as they are."""
    return F.coalesce(F.regexp_replace(c, r"^(\d{4})-(\d{2})-(\d{2})$", "$2/$3/$1"), F.lit(MISSING))


def phone(c: Column) -> Column:
    """(202)-555-0101 of ten digits; other texts stay as they are."""
    return F.coalesce(F.regexp_replace(c, r"^(\d{3})(\d{3})(\d{4})$", "($1)-$2-$3"), F.lit(MISSING))


def any_date(c: Column) -> Column:
    """A date written in one of the usual forms as yyyy-MM-dd; null if in none."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"(?i)(\d)(st|nd|rd|th)\b", "$1"), ",", " "), r"\s+", " "))
    forms = ("MMMM d yyyy", "MMM d yyyy", "M/d/yyyy", "M/d/yy", "M-d-yyyy", "yyyy/M/d", "d MMMM yyyy")
    return F.date_format(F.coalesce(*(F.to_date(F.try_to_timestamp(plain, F.lit(f))) for f in forms)), "yyyy-MM-dd")


def bullets(texts: Column, empty: str = "None noted") -> Column:
    """'- text' lines of a section, or its empty line."""
    return F.when(F.size(texts) > 0, F.array_join(F.transform(texts, lambda t: F.concat(F.lit("- "), t)), "\n")).otherwise(F.lit(f"- {empty}"))
