"""Scores of a judge's answers against expected labels: by rubric, by item, and without defensible edits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnloom.functions import measures as M

#: Edits after which either verdict on completeness can be defended.
DEFENSIBLE = ("wrong_drug", "wrong_number")


def ambiguous(edit_types: Column) -> Column:
    """Whether a summary's edits only change what may or may not count as missing: such an edit and no dropped item."""
    types = F.coalesce(edit_types, F.array().cast("array<string>"))
    return F.arrays_overlap(types, F.array(*map(F.lit, DEFENSIBLE))) & ~F.exists(types, lambda t: t.startswith("drop_"))


def edited_with(rows: DataFrame, edit_types: str, kinds: list[str], every: bool = False) -> DataFrame:
    """Rows that have any (or every) one of some edits."""
    wanted = F.array(*map(F.lit, kinds))
    types = F.coalesce(edit_types, F.array().cast("array<string>"))
    return rows.filter(F.size(F.array_except(wanted, types)) == 0 if every else F.arrays_overlap(types, wanted))


def item_confusion(rows: DataFrame, by: list[str], said: str, truth: str, n: str) -> DataFrame:
    """by, tp, fp, fn, tn: sums over rows of set algebra on two arrays of item numbers out of ``n`` items; null arrays are empty."""
    a, b = (F.array_distinct(F.coalesce(c, F.array().cast("array<int>"))) for c in (said, truth))
    cells = {"tp": F.size(F.array_intersect(a, b)), "fp": F.size(F.array_except(a, b)), "fn": F.size(F.array_except(b, a)), "tn": F.col(n) - F.size(F.array_union(a, b))}
    return rows.groupBy(*by).agg(*(F.sum(c).cast("long").alias(k) for k, c in cells.items()))


def rubric_scores(golden: DataFrame, verdicts: DataFrame, rubrics: tuple[str, ...]) -> DataFrame:
    """rubric, n, agree, kappa, caught, failing, alarms, passing over items (id, expected map) and answers (id, verdicts map).

    An item without an answer on a rubric is left out of it. FAIL means that the summary has the
    problem: ``caught`` of ``failing``, and ``alarms`` of ``passing``.
    """
    pair = F.inline(F.array(*(F.struct(F.lit(r).alias("rubric"), F.try_element_at("expected", F.lit(r)).alias("a"), F.try_element_at("verdicts", F.lit(r)).alias("b")) for r in rubrics)))
    rows = golden.join(verdicts, "id").select(pair).filter("b is not null")
    g = rows.groupBy("rubric").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("a") == F.col("b")).alias("agree"), F.count_if(F.col("a") == "FAIL").alias("failing"), F.count_if(F.col("a") == "PASS").alias("passing"),
        F.count_if((F.col("a") == "FAIL") & (F.col("b") == "FAIL")).alias("caught"), F.count_if((F.col("a") == "PASS") & (F.col("b") == "FAIL")).alias("alarms"),
    )
    said = F.col("caught") + F.col("alarms")
    chance = (F.col("failing") * said + F.col("passing") * (F.col("n") - said)) / (F.col("n") * F.col("n"))
    return g.select("rubric", "n", "agree", M.kappa(F.col("agree") / F.col("n"), chance).alias("kappa"), "caught", "failing", "alarms", "passing")


def salvaged_object(text: Column) -> Column:
    """struct(object, error): a JSON object's text out of a model's answer, else what was wrong with it.

    Taken are the whole answer, what stands in a code fence, and the text from the first brace to the last,
    in this order.
    """
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)\s*```", 1)
    braced = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    is_object = lambda c: F.coalesce(F.startswith(F.schema_of_variant(F.try_parse_json(F.nullif(c, F.lit("")))), F.lit("OBJECT")), F.lit(False))
    found = F.when(is_object(F.trim(text)), F.trim(text)).when(is_object(fenced), fenced).when(is_object(braced), braced)
    error = F.when(F.trim(F.coalesce(text, F.lit(""))) == "", "no output").when(braced == "", "no JSON object in the output").otherwise("the JSON object cannot be read")
    return F.struct(found.alias("object"), F.when(found.isNull(), error).alias("error"))
