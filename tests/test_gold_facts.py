"""First-match joins, fact and tag checks of gold calls, coverage predicates and the metric registry."""

import copy
import json
import random

from pyspark.sql import functions as F

from tests.calls import authored, documents
from turnloom.operators.coverage import PREDICATES, call_facts, coverage, uncovered, unknown_tags
from turnloom.operators.first_match import first_match
from turnloom.operators.gold_facts import fact_findings, tag_findings
from turnloom.operators.matrix import METRICS, WIDE, compared, matrix, reaching
from turnloom.sources.transcripts import calls_of, strict_turns


def greedy(facts, items, once):
    out, free = {}, sorted(items)
    for priority in (0, 1):
        for n, keys in sorted(facts):
            if n in out or not keys[priority]:
                continue
            hit = next((i for i in free if i[1][priority] == keys[priority]), None)
            if hit:
                out[n] = (priority + 1, hit[0])
                if once:
                    free.remove(hit)
    return out


def test_first_match(spark):
    rng = random.Random(2)
    side = lambda n: [(k, (rng.choice(["a", "b", "c", "", None]), rng.choice(["x", "y"]))) for k in rng.sample(range(40), n)]
    sides = {g: (side(12), side(10)) for g in ("g1", "g2", "g3")}
    make = lambda at: spark.createDataFrame([(g, n, *keys) for g, s in sides.items() for n, keys in s[at]], "g string, n int, k1 string, k2 string")
    keys = [(F.col("k1"), F.col("k1")), (F.col("k2"), F.col("k2"))]
    for once in (False, True):
        got = {(r.g, r.n): (r.priority, r.item.n) if r.item else None for r in first_match(make(0), make(1), ["g"], keys, "n", "n", once).collect()}
        assert len(got) == 36
        for g, (facts, items) in sides.items():
            assert {n: v for (h, n), v in got.items() if h == g and v} == greedy(facts, items, once), (g, once)


DRUG = {"type": "medication", "name": "morphine", "dose": "5", "unit": "mg", "certainty": "stated"}
UNSAID = {"value": None, "certainty": "not_stated", "heard_as": [], "turns": []}


def whole(**changes):
    """A call that fits its record, with drug, symptom and action."""
    call = authored("va-001")
    gold = json.loads(call["gold"])
    gold["assessment"].append({"text": "Took 5 mg of morphine.", "speaker": "Caller", "turns": [4], "quote": "She took 5 mg of morphine.", "explanation": "Documents", "facts": [DRUG], "covers": ["A2"]})
    gold["response"][0]["facts"] = [{"type": "action", "action_type": "page", "status": "completed", "certainty": "stated"}]
    call["assessment"] = [{"item_id": "A1", "symptom_name": "fever", "certainty": "unclear"}, {"item_id": "A2", "item_type": "medication", "medication_name_spoken": "Morphine", "dose": "5", "unit": "MG"}]
    call["response"] = [{"item_id": "R1", "action_type": "page", "action_status": "completed"}]
    call["chief_complaint"] = {}
    lines = call["transcript"].replace(" || small_talk", "").split("\n")
    call["transcript"] = "\n".join(x + t for x, t in zip(lines, [" || cc", " || A1", " || R1", " || A2", ""], strict=True))
    for path, value in changes.items():
        at, *keys, last = path.split("__")
        box = call if at == "call" else gold
        for k in keys:
            box = box[int(k) if k.isdigit() else k]
        box[last] = value
    call["gold"] = json.dumps(gold)
    return call


def findings(spark, *calls):
    rows = calls_of(documents(spark, [c | {"call_id": f"c{k}"} for k, c in enumerate(calls)]))
    turns = strict_turns(rows)
    got = {}
    for r in fact_findings(rows, turns).unionByName(tag_findings(rows, turns, ["morphine", "warfarin"])).collect():
        got.setdefault(r.call_id, set()).add((r.code, r.message))
    return [got.get(f"c{k}", set()) for k in range(len(calls))]


def test_gold_facts(spark):
    fact = lambda **c: [{**DRUG, **c}]
    noisy = whole(call__noise_events=[{"turn": 4, "type": "drug_garble", "heard_form": "more fine / morphine"}, {"turn": 2, "type": "x", "heard_form": "absent"}, {"turn": 99, "type": "x"}])
    got = findings(
        spark,
        whole(),
        whole(gold__assessment__1__text="Took 50 mg of morphine."),
        whole(gold__assessment__1__facts=fact(name="warfarin")),
        whole(gold__assessment__1__facts=fact(certainty="unclear", unit="mL")),
        whole(gold__response__0__facts=[{"type": "action", "action_type": "page", "status": "planned"}]),
        whole(gold__response__0__facts=[{"type": "action", "action_type": "send", "status": "completed"}]),
        whole(gold__assessment__0__facts=[{"type": "pertinent_negative", "name": "Fever", "certainty": "unclear"}, {"type": "symptom", "name": "rash", "certainty": "stated"}]),
        whole(call__chief_complaint={"patient_name_spoken": "Ann Lee"}, gold__identity__patient_name=UNSAID | {"value": "Ann Lee", "certainty": "stated", "turns": [1]}),
        whole(call__chief_complaint={"caller_name_spoken": "Lena"}, gold__identity__caller_name=UNSAID | {"value": "Lena", "certainty": "unclear", "turns": [1]}),
        whole(call__transcript=whole()["transcript"].replace("|| A2", "|| A9")),
        noisy,
    )
    assert got[0] == set()
    assert ("G3", "assessment[1]: number 50 is not in the evidence") in got[1]
    assert {c for c, _ in got[2]} == {"G4"} and len(got[2]) == 2
    assert got[3] == {("G4", "assessment[1]: certainty of morphine differs from the record"), ("G5", "assessment[1]: unit of morphine differs from the record")}
    assert got[4] == {("G6", "response[0]: status of action page differs from the record"), ("G6", "response[0]: a planned action without the wording of a plan")}
    assert got[5] == {("G6", "response[0]: action send is no covered item")}
    assert got[6] == {("G5", "assessment[0]: presence of Fever differs from the record"), ("G5", "assessment[0]: symptom rash is no covered item")}
    assert {m for _, m in got[7]} == {"identity.patient_name: a part is not in the cited turns", "identity patient_name has a value but no tagged turn"}
    assert {m for _, m in got[8]} == {"identity.caller_name: certainty differs from the record", "identity caller_name has a value but no tagged turn"}
    assert {c for c, _ in got[9]} == {"G10", "G11"} and ("G10", "turn 4: unknown tag A9") in got[9] and ("G10", "item A2 is tagged on no turn") in got[9]
    assert {m for _, m in got[10]} == {"turn 2 does not have the heard form", "a noise event is on the missing turn 99"}


def test_coverage(spark):
    one = whole(call__setup={"scenario_category": "high_risk", "length_bucket": "long", "secondary_tags": ["hedging", "odd_tag"], "subtype": "dose_question"})
    two = copy.deepcopy(whole()) | {"call_id": "va-002", "split": "train", "noise_events": [{"type": "drug_garble", "turn": 1}]}
    facts = call_facts(calls_of(documents(spark, [one, two])))
    have = {(r.split, r.predicate): r.have for r in coverage(facts, "split", PREDICATES).collect()}
    assert len(have) == 2 * 26
    assert {p for (s, p), n in have.items() if s == "val" and n} == {"ambiguity", "dose error", "hedging", "high risk", "long call", "medication with dose", "completed action"}
    assert {p for (s, p), n in have.items() if s == "train" and n} == {"ambiguity", "recognition noise", "garbled drug", "medication with dose", "completed action"}
    missing = {r.split: r.missing for r in uncovered(facts, "split", PREDICATES).collect()}
    assert len(missing["val"]) == 19 and missing["val"][0] == "self-correction"
    known = spark.createDataFrame([("hedging",)], "t string")
    assert [tuple(r) for r in unknown_tags(facts, "tags", known, "t").collect()] == [("odd_tag", 1, "va-001")]


def test_matrix(spark):
    rng = random.Random(3)
    names = ["turns_valid", "schema_valid", "numbers_in_call"]
    rows = []
    for system in ("a", "b"):
        for k in range(40):
            ok = rng.random() < 0.8
            counters = {n: (rng.randint(0, 3), 3) for n in names} if ok else None
            verdicts = {r: rng.choice(["PASS", "FAIL"]) for r in ("faithfulness", "completeness", "calibration")} if k % 4 and system == "a" else None
            rows.append((system, f"c{k}", f"cat{k % 3}", "short", rng.choice(["x", None]), ok, ok, rng.randint(0, 1) if ok else None, rng.randint(0, 1), None, counters, verdicts, system == "a", 2, 3, {"cfa": (1, 2), "medication_hallucinated": (1, 4)}, rng.choice([3.0, 20.0, None]), rng.choice(["stop", "length"])))
    got = matrix(spark.createDataFrame(rows, WIDE)).collect()
    cell = {(r.system, r.id): (r.num, r.den) for r in got if r.dim is None}
    assert len(METRICS) == len({m.id for m in METRICS}) == 50 and len(cell) == 100
    for s in ("a", "b"):
        mine = [r for r in rows if r[0] == s]
        clean = [r for r in mine if r[6] and r[7] == 0]
        assert cell[s, "A1"] == (sum(r[5] for r in mine), 40) and cell[s, "E1"] == (len(clean), 40)
        assert cell[s, "A3"] == (sum(r[10]["turns_valid"][0] for r in mine if r[10]), sum(3 for r in mine if r[10]))
        assert cell[s, "E2"] == (sum(r[8] == 0 for r in clean), 40) and cell[s, "E1r"] == (None, 0)
        assert cell[s, "H18"] == (120, 160) and cell[s, "H19"] == (40, 80)
        assert cell[s, "O1"] == (sum(r[16] == 3.0 for r in mine), sum(r[16] is not None for r in mine)) and cell[s, "O2"] == (sum(r[17] != "length" for r in mine), 40)
    assert cell["b", "F1"] == (None, 0) and cell["a", "G1"] == (sum(r[6] and r[7] == 0 and bool(r[11]) and r[11]["faithfulness"] == "PASS" for r in rows[:40]), 40)
    parts = {(r.system, r.dim, r.value, r.id): (r.num, r.den) for r in got if r.dim}
    assert {k[1] for k in parts} == {"category", "noise"} and {k[3] for k in parts} == {"E1", "G1", "H19"}  # one length only
    assert sum(parts["a", "category", f"cat{k}", "E1"][0] for k in range(3)) == cell["a", "E1"][0]
    assert parts["b", "noise", "null", "E1"][1] == sum(r[4] is None for r in rows[40:])
    df = matrix(spark.createDataFrame(rows, WIDE))
    assert df._jdf.queryExecution().executedPlan().toString().count("Exchange") <= 3
    top = {r.system: r for r in reaching(df, 50.0).collect()}
    assert "H18" in top["a"].ids.split(", ") and top["a"].reached == len(top["a"].ids.split(", "))
    deltas = {r.id: r.delta for r in compared(df, "a", "b").collect()}
    assert deltas["H19"] == 0.0 and deltas["F1"] is None
