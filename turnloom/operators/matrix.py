"""The metrics matrix: a registry of metrics compiled to one scan of conditional sums.

A metric is data: its id, group, name and two SQL expressions over one wide row per system and call,
what it counts as right and out of how much. All metrics and all breakdowns are one aggregate over
grouping sets, so a matrix of any number of metrics has one exchange of sums.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnloom.functions import measures as M

#: What each row has: one per system and call. Counters map a name to (ok, total); a stage that was not run leaves nulls.
WIDE = """system string, call_id string, category string, length string, noise string, parsed boolean, parse_ok boolean, n_error int, n_warn int,
n_error_repaired int, counters map<string,struct<ok:bigint,total:bigint>>, verdicts map<string,string>, judged boolean, items_present int, items int,
reference map<string,struct<ok:bigint,total:bigint>>, latency double, finish_reason string"""


@dataclass(frozen=True)
class Metric:
    id: str
    group: str
    name: str
    source: str  # D rules, J judge, R reference, O operation
    ok: str
    total: str = "1"
    evidence: str = "validated"
    inverse: bool = False


_CLEAN = "(coalesce(parse_ok, false) AND n_error = 0)"
_CLEAN_REPAIRED = "(coalesce(parse_ok, false) AND n_error_repaired = 0)"


def _passed(*rubrics: str) -> str:
    return " AND ".join(f"coalesce(verdicts['{r}'] = 'PASS', false)" for r in rubrics)


def _rule(id_: str, group: str, name: str, counter: str, evidence: str = "validated") -> Metric:
    return Metric(id_, group, name, "D", f"IF(parse_ok, counters['{counter}'].ok, 0)", f"IF(parse_ok, counters['{counter}'].total, 0)", evidence)


def _reference(id_: str, name: str, counter: str, evidence: str = "validated", inverse: bool = False) -> Metric:
    return Metric(id_, "H", name, "R", f"reference['{counter}'].ok", f"reference['{counter}'].total", evidence, inverse)


_JUDGED = "IF(judged, 1, 0)"
_TIMED = "IF(latency IS NOT NULL, 1, 0)"
#: The matrix in its order. Groups: A output, B grounding, C wording, D safety gates, E whole call, F judge, G both, H gold, O operation.
METRICS: tuple[Metric, ...] = (
    Metric("A1", "A", "output is valid JSON", "D", "parsed"),
    Metric("A2", "A", "output matches the schema", "D", "IF(parse_ok, counters['schema_valid'].ok = 1, false)", "IF(parse_ok, 1, 0)"),
    _rule("A3", "A", "cited turns exist", "turns_valid"),
    _rule("A4", "A", "quotes are in the cited turns or near them", "quote_valid"),
    _rule("A5", "A", "quotes are verbatim", "quote_exact"),
    _rule("A6", "A", "quotes have the speaker's label", "speaker_ok"),
    _rule("B1", "B", "numbers were said in the call", "numbers_in_call"),
    _rule("B2", "B", "numbers were said near the cited turns", "numbers_in_window"),
    _rule("B3", "B", "drugs were said in the call", "drugs_in_call"),
    _rule("B4", "B", "clinical terms were said in the call", "clinical_terms_supported"),
    _rule("B5", "B", "identity values were said", "identity_supported"),
    _rule("C1", "C", "planned and completed as the nurse said", "status_consistent"),
    _rule("C2", "C", "negative findings stay negative", "negation_consistent"),
    _rule("C3", "C", "hedges are kept", "hedge_kept", "indicator"),
    _rule("D1", "D", "Not Applicable agrees with the content gate", "na_gate_ok"),
    _rule("D2", "D", "strong rule flags are in the output", "rule_flags_covered_strong"),
    _rule("D2b", "D", "other rule flags are in the output", "rule_flags_covered_loose", "indicator"),
    _rule("D3", "D", "drugs of the call are in the summary", "drug_mentions_covered", "indicator"),
    Metric("E1", "E", "calls without a rule error", "D", _CLEAN),
    Metric("E2", "E", "calls without a rule error or warning", "D", f"{_CLEAN} AND n_warn = 0", evidence="indicator"),
    Metric("E1r", "E", "calls without a rule error after quote repair", "D", _CLEAN_REPAIRED, "IF(n_error_repaired IS NULL, 0, 1)", "indicator"),
    Metric("F1", "F", "judged faithful", "J", _passed("faithfulness"), _JUDGED),
    Metric("F2", "F", "checklist items present", "J", "IF(verdicts IS NOT NULL, items_present, 0)", "IF(verdicts IS NOT NULL, items, 0)", "indicator"),
    Metric("F3", "F", "judged complete", "J", _passed("completeness"), _JUDGED, "indicator"),
    Metric("F4", "F", "judged calibrated", "J", _passed("calibration"), _JUDGED, "indicator"),
    Metric("G1", "G", "no rule error and judged faithful", "DJ", f"{_CLEAN} AND {_passed('faithfulness')}", _JUDGED),
    Metric("G2", "G", "no rule error and every verdict passes", "DJ", f"{_CLEAN} AND {_passed('faithfulness', 'completeness', 'calibration')}", _JUDGED, "indicator"),
    Metric("G1r", "G", "as G1 after quote repair", "DJ", f"{_CLEAN_REPAIRED} AND {_passed('faithfulness')}", "IF(judged AND n_error_repaired IS NOT NULL, 1, 0)", "indicator"),
    _reference("H1", "identity values", "identity_value"),
    _reference("H2", "identity values and certainty", "identity_value_and_certainty"),
    _reference("H3", "medications by name", "medication_name"),
    _reference("H4", "medications by name, dose and unit", "medication_name_dose_unit"),
    _reference("H5", "medication certainty", "medication_certainty"),
    _reference("H6", "symptoms found", "symptom_recall"),
    _reference("H7", "negative findings found", "pertinent_negative_recall"),
    _reference("H8", "vital signs found", "vital_recall"),
    _reference("H9", "actions found by type", "action_type_recall"),
    _reference("H10", "actions by type and status", "action_type_and_status"),
    _reference("H11", "education found by type", "education_type_recall"),
    _reference("H12", "gold flags found", "flag_recall"),
    _reference("H13", "flags that are in gold", "flag_precision"),
    _reference("H14", "Not Applicable decision", "na_label"),
    _reference("H15", "assessment bullets covered", "assessment_bullet_recall"),
    _reference("H16", "response bullets covered", "response_bullet_recall"),
    _reference("H17", "education bullets covered", "education_bullet_recall"),
    _reference("H18", "medications that are in gold", "medication_hallucinated", inverse=True),
    _reference("H19", "critical facts, extra ones count against", "cfa"),
    _reference("H19r", "gold critical facts found", "cfa_crit", "indicator"),
    Metric("O1", "O", "answers under 15 seconds", "O", "latency < 15", _TIMED),
    Metric("O2", "O", "outputs not cut off", "O", "NOT coalesce(finish_reason = 'length', false)"),
)
DIMENSIONS = ("category", "length", "noise")
#: The metrics that are broken down by dimension.
HEADLINES = ("E1", "G1", "H19")


def _sums(metrics: tuple[Metric, ...]) -> list[Column]:
    out = []
    for m in metrics:
        right = F.coalesce(F.expr(f"cast({m.ok} as bigint)"), F.lit(0))
        of = F.coalesce(F.expr(f"cast({m.total} as bigint)"), F.lit(0))
        out += [F.sum(F.when(of > 0, of - right if m.inverse else right).otherwise(0)).alias(f"ok_{m.id}"), F.sum(of).alias(f"of_{m.id}")]
    return out


def matrix(wide: DataFrame, metrics: tuple[Metric, ...] = METRICS, dims: tuple[str, ...] = DIMENSIONS, headlines: tuple[str, ...] = HEADLINES) -> DataFrame:
    """system, dim, value, id, grp, name, source, evidence, num, den, pct, ci_low over ``wide`` rows (see ``WIDE``).

    Rows without a ``dim`` are the matrix: every metric of every system, with null ``num``, ``pct`` and
    ``ci_low`` where nothing counts. Rows with a ``dim`` are the headlines by its values (``null`` for
    none), where a system has at least two of them.
    """
    sets = [["system"], *(["system", d] for d in dims)]
    which = F.grouping_id("system", *dims)
    grouped = wide.groupingSets(sets, "system", *dims).agg(*_sums(metrics), which.alias("gid"))
    # a grouping id has a bit for each dimension that a set leaves out, the first one highest
    every = (1 << len(dims)) - 1
    dim, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for k, d in enumerate(dims):
        mine = F.col("gid") == every - (1 << (len(dims) - 1 - k))
        dim, value = F.when(mine, F.lit(d)).otherwise(dim), F.when(mine, F.coalesce(F.col(d).cast("string"), F.lit("null"))).otherwise(value)
    cells = F.array(
        *(
            F.struct(F.lit(m.id).alias("id"), F.lit(m.group).alias("grp"), F.lit(m.name).alias("name"), F.lit(m.source).alias("source"), F.lit(m.evidence).alias("evidence"), F.col(f"ok_{m.id}").alias("num"), F.col(f"of_{m.id}").alias("den"))
            for m in metrics
        )
    )
    rows = grouped.select("system", dim.alias("dim"), value.alias("value"), F.inline(cells))
    rows = rows.filter(F.col("dim").isNull() | F.col("id").isin(*headlines))
    values = F.size(F.collect_set("value").over(Window.partitionBy("system", "dim")))
    rows = rows.withColumn("__values", F.when(F.col("dim").isNull(), 2).otherwise(values)).filter("__values >= 2").drop("__values")
    num = F.when(F.col("den") > 0, F.col("num"))
    return rows.select("system", "dim", "value", "id", "grp", "name", "source", "evidence", num.alias("num"), "den", M.ratio_pct(num, F.col("den")).alias("pct"), M.wilson_low(num, F.col("den")).alias("ci_low"))


def reaching(rows: DataFrame, threshold: float = 95.0) -> DataFrame:
    """(system, reached, of, ids): how many of a system's metrics reach a threshold, and which, in the matrix's order."""
    order = F.array_position(F.array(*(F.lit(m.id) for m in METRICS)), F.col("id"))
    whole = rows.filter("dim IS NULL AND pct IS NOT NULL")
    high = F.array_sort(F.collect_list(F.when(F.col("pct") >= threshold, F.struct(order.alias("o"), "id"))))
    return whole.groupBy("system").agg(high.alias("h"), F.count(F.lit(1)).alias("of")).select("system", F.size("h").alias("reached"), "of", F.array_join("h.id", ", ").alias("ids"))


def compared(rows: DataFrame, base: str, other: str) -> DataFrame:
    """(id, base, other, delta) of two systems' matrices; delta is null where one has no value."""
    whole = rows.filter(F.col("dim").isNull() & F.col("system").isin(base, other))
    p = whole.groupBy("id").pivot("system", [base, other]).agg(F.max("pct"))
    return p.select("id", F.col(f"`{base}`").alias("base"), F.col(f"`{other}`").alias("other"), (F.col(f"`{other}`") - F.col(f"`{base}`")).alias("delta"))
