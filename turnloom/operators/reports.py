"""Judge decisions, comparisons of systems, and the frames and payloads that reports and exports read."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnloom.functions import text as T


def judge_decisions(verdicts: DataFrame, items: DataFrame) -> DataFrame:
    """id, completeness, decided: a stored model's answers turned into verdicts.

    ``verdicts``: id, is_na, faithfulness, calibration (PASS, FAIL or null). ``items``: id, first,
    second (whether the checklist item is there, at first and after a re-check). All items present
    pass, one that a re-check leaves out fails, one without an answer leaves the call undecided. A
    call that is not applicable, or without items, passes. ``decided`` needs all three verdicts.
    """
    present = F.coalesce(F.col("first") | F.coalesce("second", F.lit(False)), F.lit(False))
    unanswered = F.col("first").isNull() | (~F.col("first") & F.col("second").isNull())
    g = items.groupBy("id").agg(F.bool_or(unanswered).alias("open"), F.bool_and(present).alias("whole"))
    complete = F.when(F.col("is_na") | F.col("whole").isNull(), "PASS").when(F.col("open"), None).when(F.col("whole"), "PASS").otherwise("FAIL")
    rows = verdicts.join(g, "id", "left").withColumn("completeness", complete)
    decided = F.col("completeness").isNotNull() & F.col("faithfulness").isNotNull() & F.col("calibration").isNotNull()
    return rows.select("id", "completeness", decided.alias("decided"))


def joined_outputs(cases: DataFrame, keys: list[str], **outputs: DataFrame) -> DataFrame:
    """``cases`` left joined with each named output on ``keys``; ``has_<name>`` tells which are there."""
    def add(left: DataFrame, named: tuple[str, DataFrame]) -> DataFrame:
        name, right = named
        return left.join(right.withColumn(f"has_{name}", F.lit(True)), keys, "left").fillna(False, [f"has_{name}"])

    return reduce(add, outputs.items(), cases)


def with_fallback(rows: DataFrame, key: str, value: str, other_key: Column) -> DataFrame:
    """``rows`` with ``value`` taken from the row named by ``other_key`` where it is null, and ``from_key`` then naming it."""
    lent = rows.select(F.col(key).alias("from_key"), F.col(value).alias("lent")).filter("lent is not null")
    met = rows.withColumn("wanted", other_key).join(lent, F.col(value).isNull() & (F.col("wanted") == F.col("from_key")), "left")
    return met.withColumn(value, F.coalesce(value, "lent")).drop("wanted", "lent")


def report_json(rows: DataFrame, group: str, order: str) -> DataFrame:
    """``group`` and ``report``: the group's rows as one JSON array in order; a group is one report's rows."""
    columns = [c for c in rows.columns if c != group]
    ordered = F.array_sort(F.collect_list(F.struct(order, *(c for c in columns if c != order))))
    return rows.groupBy(group).agg(F.to_json(ordered).alias("report"))


def split_alignment(calls: DataFrame, id_col: str, bullets: str, nested: str) -> tuple[DataFrame, DataFrame]:
    """``calls`` whose bullets lack the ``nested`` key, and (id, path, value) of what was taken out."""
    bare = calls.withColumn(bullets, F.transform(bullets, lambda b: b.dropFields(nested)))
    taken = calls.select(id_col, F.posexplode(bullets).alias("k", "b"))
    path = F.concat(F.lit(f"{bullets}["), "k", F.lit("]")).alias("path")
    return bare, taken.select(id_col, path, F.explode(f"b.{nested}").alias("value"))


def last_evidence(bridge: DataFrame, item: str, order: list[str], *columns: str) -> DataFrame:
    """One row per item: the columns of its last writer by ``order``."""
    last = F.max_by(F.struct(*columns), F.struct(*order)).alias("last")
    return bridge.groupBy(item).agg(last).select(item, "last.*")


def headline_and_rest(fields: Column, headline: list[str]) -> tuple[Column, Column]:
    """The first of the ``headline`` keys that a map holds, and the other keys as 'k: v; k: v' in order of key."""
    head = F.coalesce(*(F.try_element_at(fields, F.lit(k)) for k in headline), F.lit(""))
    used = reduce(lambda found, k: F.when(F.map_contains_key(fields, F.lit(k)), F.lit(k)).otherwise(found), reversed(headline), F.lit(None).cast("string"))
    left = F.array_sort(F.map_entries(F.map_filter(fields, lambda k, v: v.isNotNull() & ~k.eqNullSafe(used))))
    return head, F.array_join(F.transform(left, lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "; ")


def number_in_passages(number: Column, name: Column, passages: Column) -> Column:
    """Whether a number stands in a passage that names a thing by its first word of four letters; null if it is no number."""
    word = F.get(F.filter(F.split(T.normalize(F.coalesce(name, F.lit(""))), " "), lambda w: F.length(w) >= 4), 0)
    naming = F.filter(passages, lambda p: F.coalesce(F.contains(T.normalize(p), word), F.lit(False)))
    digits = F.lower(F.trim(number))
    written = F.exists(naming, lambda p: F.rlike(p, F.concat(F.lit(r"(?<![\d.])\Q"), digits, F.lit(r"\E(?![\d]|\.\d)"))))
    return F.when(F.rlike(digits, F.lit(r"^\d+(\.\d+)?$")), written)


def readable_date(text: Column) -> Column:
    """An ISO date from any of the usual writings; null where it cannot be read, so that it shows as missing."""
    forms = ("yyyy-MM-dd", "MM/dd/yyyy", "MMMM d, yyyy", "d MMMM yyyy")
    return F.coalesce(*(F.try_to_timestamp(F.trim(text), F.lit(f)) for f in forms)).cast("date").cast("string")


def training_messages(turns: DataFrame, id_col: str, order: str, role: str, text: str, limit: int) -> DataFrame:
    """id, messages (JSON), chars, fits: a conversation's turns as chat messages; overlong ones are marked, not cut."""
    rows = F.array_sort(F.collect_list(F.struct(order, F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("content"))))
    g = turns.groupBy(id_col).agg(rows.alias("m")).withColumn("m", F.transform("m", lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content"))))
    chars = F.aggregate("m", F.lit(0).cast("long"), lambda s, t: s + F.length(t["content"]))
    return g.select(id_col, F.to_json("m").alias("messages"), chars.alias("chars"), (chars <= limit).alias("fits"))


def filled_references(rows: DataFrame, id_col: str, value: str, automatic: str, found: DataFrame) -> DataFrame:
    """``rows`` (id, ord, value) with each ``automatic`` value replaced by the list ``found`` (id, ord, ids) gives, in a new column.

    ``resolved`` is null, and ``refused`` true, for all rows of an id whose number of found lists
    differs from its number of automatic values; sources are not rewritten.
    """
    auto = rows.filter(F.col(value) == automatic)
    wanted, there = (x.groupBy(id_col).agg(F.count(F.lit(1)).alias(n)) for x, n in ((auto, "wanted"), (found, "there")))
    counts = wanted.join(there, id_col, "left").select(id_col, (F.col("wanted") != F.coalesce("there", F.lit(0))).alias("refused"))
    met = rows.join(found, [id_col, "ord"], "left").join(counts, id_col, "left").fillna(False, ["refused"])
    text = F.when(F.col(value) == automatic, F.array_join("ids", ",")).otherwise(F.col(value))
    return met.select(*rows.columns, F.when(~F.col("refused"), text).alias("resolved"), "refused")
