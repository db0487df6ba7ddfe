"""Coverage of a call set: named predicates as bits of one number a call.

All predicates of a call are worked out in one projection and kept as a bitmap; ``have`` of a split is
a sum of its bits, what no call of a split has is a bit missing from ``bit_or``. Unknown tags fall to
the same scan.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnloom.operators.relational import small


def _tagged(*tags: str) -> str:
    return f"arrays_overlap(tags, array({', '.join(repr(t) for t in tags)}))"


def _noise(*types: str) -> str:
    return f"arrays_overlap(noise_types, array({', '.join(repr(t) for t in types)}))"


def _item(section: str, condition: str) -> str:
    return f"exists({section}, i -> {condition})"


#: The checklist over the columns of ``call_facts``, in its order: name and SQL predicate.
PREDICATES: dict[str, str] = {
    "medication with dose": _item("assessment", "i['item_type'] = 'medication' AND coalesce(i['dose'], '') <> ''"),
    "ambiguity": _item("assessment", "i['certainty'] = 'unclear'"),
    "self-correction": f"{_tagged('dob_self_corrected', 'self_correction', 'explicit_self_correction')} OR contains(subtype, 'correction')",
    "unresolved conflict": f"contains(subtype, 'unresolved') OR {_tagged('identity_unresolved', 'contradiction')}",
    "scheduled and as needed": f"{_tagged('prn_and_scheduled')} OR contains(subtype, 'prn_and_scheduled')",
    "dose error": f"{_tagged('liquid_concentration', 'wrong_dose', 'extra_dose')} OR contains(subtype, 'dose') OR {_item('assessment', 'i[' + repr('medication_status') + '] = ' + repr('extra_dose'))}",
    "name or number error": f"{_noise('number_garble', 'name_drift')} OR {_tagged('name_drift', 'dob_self_corrected', 'number_garble', 'dob_not_stated')}",
    "hedging": _tagged("hedging"),
    "planned action": _item("response", "i['action_status'] = 'planned'"),
    "completed action": _item("response", "i['action_status'] = 'completed'"),
    "negative finding": _item("assessment", "i['item_type'] = 'pertinent_negative'"),
    "high risk": "category = 'high_risk'",
    "risk flag": "n_flags > 0",
    "not applicable": "category = 'not_applicable'",
    "several issues": _tagged("multi_issue"),
    "long call": "length_bucket = 'long'",
    "recognition noise": "size(noise_types) > 0 OR category = 'asr_error'",
    "garbled drug": _noise("drug_garble"),
    "late or split turns": _tagged("late_answers", "split_turns"),
    "chatter": f"{_tagged('offtopic_chatter')} OR coalesce(chatter, '') NOT IN ('', 'false', '0')",
    "speaker error": f"{_noise('speaker_label')} OR {_tagged('speaker_label_errors', 'crosstalk')}",
    "trap phrasing": _tagged("trap_phrasing", "negated_risk_phrase", "negated_risk"),
    "look-alike drug": _tagged("tall_man_drug", "tall_man"),
    "name spelled out": _tagged("name_spelled"),
    "phone missing": _tagged("phone_not_given", "phone_from_file"),
    "figurative risk": _tagged("figurative_risk_language"),
}


def call_facts(calls: DataFrame) -> DataFrame:
    """What the predicates read, from authored calls (see ``calls_of``): lists are never null."""
    none = lambda c, t: F.coalesce(c, F.array().cast(t))
    setup, maps = F.col("setup"), "array<map<string,string>>"
    tags = F.from_json(setup["secondary_tags"], "array<string>")
    return calls.select(
        "call_id",
        "split",
        F.coalesce(setup["scenario_category"], F.lit("")).alias("category"),
        F.coalesce(setup["length_bucket"], F.lit("")).alias("length_bucket"),
        F.coalesce(setup["subtype"], F.lit("")).alias("subtype"),
        setup["offtopic_chatter"].alias("chatter"),
        none(tags, "array<string>").alias("tags"),
        none(F.col("assessment"), maps).alias("assessment"),
        none(F.col("response"), maps).alias("response"),
        F.coalesce(F.size(F.col("risk_flags")), F.lit(0)).alias("n_flags"),
        F.array_compact(F.transform(none(F.col("noise_events"), maps), lambda e: e["type"])).alias("noise_types"),
    )


def bitmap(predicates: dict[str, str]) -> Column:
    """All predicates of a row as one number, the first as its lowest bit; a null predicate does not hold."""
    if len(predicates) > 63:
        raise ValueError("a bitmap holds at most 63 predicates")
    return reduce(lambda a, b: a.bitwiseOR(b), (F.when(F.expr(p), F.lit(1 << k)).otherwise(F.lit(0)).cast("long") for k, p in enumerate(predicates.values())))


def coverage(rows: DataFrame, split: str, predicates: dict[str, str], need: dict[str, int] | int = 1) -> DataFrame:
    """(split, predicate, have, need, covered): how many rows of each split a predicate holds for, in one exchange of sums."""
    bits = rows.select(split, bitmap(predicates).alias("bits"))
    sums = bits.groupBy(split).agg(F.bit_or("bits").alias("any"), *(F.sum(F.shiftright("bits", k).bitwiseAND(F.lit(1).cast("long"))).alias(f"n{k}") for k in range(len(predicates))))
    wanted = lambda name: need if isinstance(need, int) else need.get(name, 1)
    cells = F.array(*(F.struct(F.lit(name).alias("predicate"), F.col(f"n{k}").alias("have"), F.lit(wanted(name)).cast("long").alias("need")) for k, name in enumerate(predicates)))
    return sums.select(split, F.inline(cells)).withColumn("covered", F.col("have") >= F.col("need"))


def uncovered(rows: DataFrame, split: str, predicates: dict[str, str]) -> DataFrame:
    """(split, missing): the predicates, in their order, that no row of a split has."""
    any_ = rows.groupBy(split).agg(F.bit_or(bitmap(predicates)).alias("any"))
    names = F.array(*(F.when(F.shiftright("any", k).bitwiseAND(F.lit(1).cast("long")) == 0, F.lit(name)) for k, name in enumerate(predicates)))
    return any_.select(split, F.array_compact(names).alias("missing"))


def unknown_tags(rows: DataFrame, tags: str, known: DataFrame, on: str) -> DataFrame:
    """(tag, rows, example): tags of ``rows`` that the vocabulary ``known`` (column ``on``) lacks; counted before the anti-join."""
    used = rows.select(F.explode(F.array_distinct(tags)).alias("tag"), "call_id").groupBy("tag").agg(F.count(F.lit(1)).alias("rows"), F.min("call_id").alias("example"))
    return used.join(small(known.select(F.col(on).alias("tag")).distinct()), "tag", "left_anti")
