"""A judge set: exact stratified samples, and typed edits of summaries with the labels a judge should give.

The sample is drawn by thresholds on a hash of the id: one pass counts rows by stratum and hash bucket,
quotas follow by largest remainder, and only rows below their stratum's threshold are ranked. The
same seed gives the same sample whatever the partitions. Samples of one call follow each other in the
hash's order and are disjoint by construction. Edits are rewrites of arrays of structs.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnloom.sources.shared import worked_out

#: Hash buckets of a stratum: a hash has 60 bits, a bucket the upper 12.
BUCKET_BITS, HASH_BITS = 12, 60


def draw_order(id_: Column, seed: int) -> Column:
    """The place of an id in the order of drawing: 60 bits of the MD5 of ``seed:id``."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), id_.cast("string"))), 1, HASH_BITS // 4), 16, 10).cast("long")


def quotas(strata: list[str], n: int) -> Column:
    """Rows that each stratum gives to a sample of ``n`` by largest remainder, as a column over (strata, size)."""
    every = Window.partitionBy()
    share = F.col("size") * n / F.sum("size").over(every)
    rest = F.lit(n) - F.sum(F.floor(share)).over(every)
    place = F.row_number().over(Window.orderBy(F.desc(share - F.floor(share)), *strata))
    return F.least(F.floor(share) + (place <= rest).cast("long"), F.col("size"))


def stratified_samples(rows: DataFrame, id_col: str, strata: list[str], sizes: dict[str, int], seed: int) -> DataFrame:
    """The rows of disjoint samples, all columns, with ``sample`` (its name) and ``draw`` (from 1 within sample and stratum).

    A sample of ``n`` takes from each stratum its share by largest remainder (ties by the strata's
    values, null first), so that sizes are exact while the rows last. Ids are distinct and not null.
    """
    u = rows.withColumn("__u", draw_order(F.col(id_col), seed)).withColumn("__bucket", F.shiftright("__u", HASH_BITS - BUCKET_BITS))
    counts = worked_out(u.groupBy(*strata, "__bucket").agg(F.count(F.lit(1)).alias("n")))
    left = counts.groupBy(*strata).agg(F.sum("n").alias("size"))
    ends, last = [], F.lit(0).cast("long")
    for k, (_, n) in enumerate(sizes.items()):
        left = left.withColumn(f"__take{k}", quotas(strata, n)).withColumn("size", F.col("size") - F.col(f"__take{k}"))
        left = left.withColumn(f"__end{k}", last + F.col(f"__take{k}"))
        last = F.col(f"__end{k}")
        ends.append(f"__end{k}")
    same = lambda a, b: [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in strata]
    needed = left.select(*strata, *ends)
    upto = F.sum("n").over(Window.partitionBy(*strata).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1))
    cut = counts.withColumn("upto", F.coalesce(upto, F.lit(0))).alias("c").join(needed.alias("q"), same("c", "q")).filter(F.col("upto") < F.col(ends[-1]))
    cut = cut.groupBy(*(F.col(f"c.{c}").alias(c) for c in strata)).agg(F.max("__bucket").alias("__cut"), *(F.max(e).alias(e) for e in ends))
    few = u.alias("u").join(F.broadcast(cut.alias("t")), [*same("u", "t"), F.col("__bucket") <= F.col("__cut")]).select("u.*", *ends)
    place = F.row_number().over(Window.partitionBy(*strata).orderBy("__u", id_col))
    few = few.withColumn("__place", place).filter(F.col("__place") <= F.col(ends[-1]))
    name, start = F.lit(None).cast("string"), F.lit(0).cast("long")
    for k, sample in reversed(list(enumerate(sizes))):
        inside = F.col("__place") <= F.col(ends[k])
        name = F.when(inside, F.lit(sample)).otherwise(name)
        start = F.when(inside, F.col(ends[k - 1]) if k else F.lit(0)).otherwise(start)
    drawn = few.withColumn("sample", name).withColumn("draw", F.col("__place") - start)
    return drawn.drop("__u", "__bucket", "__place", *ends)


@dataclass(frozen=True)
class Edit:
    """An edit of one bullet: the rubric it breaks, where it fits and what it makes of the bullet (None: removed)."""

    rubric: str
    section: str
    fits: Callable[[Column, Column], Column]  # (bullet, number of bullets in the section)
    rewrite: Callable[[Column, Column], Column] | None = None  # (text, bullet) to the new text
    speaker: str | None = None


RUBRICS = ("faithfulness", "completeness", "calibration")
_HEDGED = r"(?i)[,;]\s[^,;.]*\b(?:unclear|unsure|not sure|uncertain|unknown)\b[^.]*(?=\.)"
_NUMBER = r"(?<![\d.])(?!(?:19|20)\d\d(?!\d))(?:[2-9]|[1-9]\d+)(?![\d.]|:\d)"
# Drugs to put in place of another.
OTHER_DRUGS = ("lisinopril", "warfarin", "prednisone", "furosemide", "sertraline", "amoxicillin")


def _of_type(bullet: Column, *types: str) -> Column:
    return F.filter(F.coalesce(bullet["facts"], F.array().cast("array<struct<type:string,name:string,certainty:string>>")), lambda f: f["type"].isin(*types))


def _named_drug(bullet: Column) -> Column:
    names = F.transform(F.filter(_of_type(bullet, "medication"), lambda f: F.coalesce(f["name"], F.lit("")) != ""), lambda f: f["name"])
    return F.get(F.filter(names, lambda n: F.contains(F.lower(bullet["text"]), F.lower(n))), F.lit(0))


def _changed_number(text: Column, _: Column) -> Column:
    old = F.regexp_extract(text, f"({_NUMBER})", 1)
    after = F.lower(F.substring(F.regexp_extract(text, f"{_NUMBER}(.*)", 1), 1, 12))
    value = old.cast("long")
    new = (
        F.when(after.startswith("/10"), F.when(value >= 5, value - 3).otherwise(value + 3))
        .when(after.startswith(" percent") | after.startswith("%"), value - 10)
        .otherwise(F.when(value < 50, value * 2).otherwise(value + 50))
    )
    before = F.regexp_extract(text, f"(?s)^(.*?){_NUMBER}", 1)
    return F.concat(before, new.cast("string"), F.substring(text, F.length(before) + F.length(old) + 1, F.length(text)))


def _other_drug(text: Column, bullet: Column) -> Column:
    name = _named_drug(bullet)
    at = F.instr(F.lower(text), F.lower(name))
    new = F.get(F.filter(F.array(*map(F.lit, OTHER_DRUGS)), lambda d: ~F.contains(F.lower(text), d)), F.lit(0))
    shown = F.when(at == 1, F.initcap(new)).otherwise(new)
    return F.concat(F.substring(text, F.lit(1), at - 1), shown, F.substring(text, at + F.length(name), F.length(text)))


def _negated(bullet: Column) -> Column:
    return F.get(F.transform(F.filter(_of_type(bullet, "pertinent_negative"), lambda f: F.coalesce(f["name"], F.lit("")) != ""), lambda f: f["name"]), F.lit(0))


#: The kinds of edits in the order in which calls are looked for.
EDITS = {
    "drop_assessment": Edit("completeness", "assessment", lambda b, n: (n >= 3) & (F.size(_of_type(b, "symptom", "medication", "pertinent_negative", "vital")) > 0)),
    "drop_education": Edit("completeness", "education", lambda b, n: n >= 2),
    "drop_response": Edit("completeness", "response", lambda b, n: n >= 2),
    "wrong_number": Edit("faithfulness", "assessment", lambda b, n: b["text"].rlike(_NUMBER), _changed_number),
    "flipped_negative": Edit("faithfulness", "assessment", lambda b, n: _negated(b).isNotNull(), lambda t, b: F.concat(F.upper(F.left(_negated(b), F.lit(1))), F.substring(_negated(b), 2, 1 << 30), F.lit(" was reported."))),
    "wrong_drug": Edit("faithfulness", "assessment", lambda b, n: _named_drug(b).isNotNull(), _other_drug),
    "planned_to_completed": Edit("calibration", "response", lambda b, n: b["text"].startswith("Planned to "), lambda t, b: F.concat(F.lit("Completed: "), F.substring(t, 12, 1 << 30))),
    "speaker_swap": Edit("calibration", "assessment", lambda b, n: b["speaker"] == "Caller", None, "Nurse"),
    "hedge_removed": Edit("calibration", "assessment", lambda b, n: b["text"].rlike(_HEDGED) & F.exists(_of_type(b, "symptom", "medication", "pertinent_negative", "vital", "context", "action"), lambda f: f["certainty"] == "unclear"), lambda t, b: F.regexp_replace(t, _HEDGED, "")),
}


def places(summary: DataFrame, kind: str) -> Column:
    """Where in its section an edit fits: indices from 0."""
    edit, section = EDITS[kind], F.coalesce(F.col(EDITS[kind].section), F.expr(f"slice({EDITS[kind].section}, 1, 0)"))
    found = F.transform(section, lambda b, i: F.when(F.coalesce(edit.fits(b, F.size(section)), F.lit(False)), i))
    return F.coalesce(F.filter(found, lambda i: i.isNotNull()), F.array().cast("array<int>"))


def edited(summaries: DataFrame, id_col: str, kind: Column, seed: int) -> DataFrame:
    """``summaries`` with the edit named by ``kind`` (null: none) made at one of its places, drawn by hash; ``changed`` tells it.

    ``summaries`` hold the sections as arrays of structs (text, speaker, facts (type, name, certainty),
    and any other fields, which stay).
    """
    rows = summaries.withColumn("__kind", kind)
    at, said = F.lit(None).cast("int"), F.lit(None).cast("string")
    for name in EDITS:
        fit = places(rows, name)
        at = F.when(F.col("__kind") == name, F.get(fit, F.pmod(draw_order(F.concat(F.col(id_col).cast("string"), F.lit(f":{name}")), seed), F.nullif(F.size(fit), F.lit(0))).cast("int"))).otherwise(at)
    rows = rows.withColumn("__at", at)
    for section in dict.fromkeys(e.section for e in EDITS.values()):
        mine = {k: e for k, e in EDITS.items() if e.section == section}
        drops = [k for k, e in mine.items() if e.rewrite is None and e.speaker is None]
        here = F.get(section, F.col("__at"))

        def rewritten(b: Column, i: Column) -> Column:
            text, speaker = b["text"], b["speaker"]
            for k, e in mine.items():
                when = (F.col("__kind") == k) & (F.col("__at") == i)
                text = F.when(when, e.rewrite(b["text"], b)).otherwise(text) if e.rewrite else text
                speaker = F.when(when, F.lit(e.speaker)).otherwise(speaker) if e.speaker else speaker
            return b.withField("text", text).withField("speaker", speaker)

        changed = F.transform(section, rewritten)
        kept = F.filter(changed, lambda b, i: ~F.coalesce(F.col("__kind").isin(*drops) & (F.col("__at") == i), F.lit(False))) if drops else changed
        said = F.when(F.col("__kind").isin(*mine) & F.col("__at").isNotNull(), F.concat(F.lit(f"{section}["), F.col("__at"), F.lit("]: "), here["text"])).otherwise(said)
        rows = rows.withColumn(f"__new_{section}", kept)
    rows = rows.withColumn("changed", said)
    for section in dict.fromkeys(e.section for e in EDITS.values()):
        rows = rows.withColumn(section, F.col(f"__new_{section}")).drop(f"__new_{section}")
    return rows.drop("__kind", "__at")


def judge_set(summaries: DataFrame, id_col: str, plan: dict[str, int], seed: int) -> DataFrame:
    """A drawn sample of ``summaries`` with edits: all columns, edit, rubrics_broken, expected (rubric to PASS or FAIL), changed.

    ``plan`` gives how many summaries get each kind of edit, in the plan's order; a kind takes the first
    summaries in the order of drawing that it fits and that no kind before it took. The others stay
    clean and pass everything. ``summaries`` are a sample: they are ranked in one place.
    """
    rows = summaries.withColumn("__u", draw_order(F.col(id_col), seed)).withColumn("edit", F.lit(None).cast("string"))
    for kind, n in plan.items():
        fits = F.col("edit").isNull() & (F.size(places(rows, kind)) > 0)
        rows = rows.withColumn("__fits", fits)
        place = F.row_number().over(Window.partitionBy("__fits").orderBy("__u", id_col))
        rows = rows.withColumn("__place", place).withColumn("edit", F.when(F.col("__fits") & (F.col("__place") <= n), F.lit(kind)).otherwise(F.col("edit"))).drop("__place", "__fits")
    rows = worked_out(rows)
    rubric = F.try_element_at(F.create_map(*(F.lit(x) for k, e in EDITS.items() for x in (k, e.rubric))), F.col("edit"))
    out = edited(rows.drop("__u"), id_col, F.col("edit"), seed).withColumn("rubrics_broken", F.when(F.col("edit").isNull(), F.array().cast("array<string>")).otherwise(F.array(rubric)))
    verdict = lambda r: F.when(F.array_contains("rubrics_broken", r), "FAIL").otherwise("PASS")
    return out.withColumn("expected", F.create_map(*(x for r in RUBRICS for x in (F.lit(r), verdict(r)))))
