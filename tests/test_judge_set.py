"""Exact samples and typed edits."""

import hashlib
from collections import Counter

from pyspark.sql import functions as F

from turnloom.operators.judge_set import EDITS, judge_set, places, stratified_samples

FACTS = "array<struct<type:string,name:string,certainty:string>>"
BULLETS = f"array<struct<text:string,speaker:string,facts:{FACTS},turns:array<int>>>"


def draw(x, seed):
    return int(hashlib.md5(f"{seed}:{x}".encode()).hexdigest()[:15], 16)


def test_samples_are_exact_and_disjoint(spark):
    rows = [(k, ("a", "b", None)[k % 7 % 3]) for k in range(997)]
    df = spark.createDataFrame(rows, "id int, s string")
    got = stratified_samples(df.repartition(13), "id", ["s"], {"one": 31, "two": 17}, 5).collect()
    assert Counter(r.sample for r in got) == {"one": 31, "two": 17} and len({r.id for r in got}) == 48
    again = stratified_samples(df.coalesce(1), "id", ["s"], {"one": 31, "two": 17}, 5).collect()
    assert {(r.id, r.sample, r.draw) for r in got} == {(r.id, r.sample, r.draw) for r in again}
    for s in ("a", "b", None):
        order = sorted((k for k, x in rows if x == s), key=lambda k: draw(k, 5))
        taken = [r.id for r in sorted((r for r in got if r.s == s), key=lambda r: (r.sample != "one", r.draw))]
        assert taken == order[: len(taken)] and abs(len([r for r in got if r.s == s and r.sample == "one"]) - 31 * len(order) / 997) < 1
    assert stratified_samples(df.limit(0), "id", ["s"], {"one": 3}, 5).count() == 0
    assert stratified_samples(df.filter("id < 5"), "id", ["s"], {"one": 50}, 5).count() == 5


def summaries(spark):
    fact = lambda t, n, c="stated": (t, n, c)
    a = [("Took 5 mg of Morphine at 8:30 in 2019.", "Caller", [fact("medication", "morphine")], [1]), ("Some pain, unclear since when.", "Caller", [fact("symptom", "pain", "unclear")], [2]), ("No cough.", "Nurse", [fact("pertinent_negative", "cough")], [3])]
    r = [("Planned to call the doctor.", "Nurse", [], [4]), ("Sent a nurse.", "Nurse", [], [5])]
    return spark.createDataFrame([(k, a, r, r[:1], "x") for k in range(12)], f"id int, assessment {BULLETS}, response {BULLETS}, education {BULLETS}, own string")


def test_edits(spark):
    plan = {k: 1 for k in EDITS if k != "drop_education"}
    got = {r.edit: r for r in judge_set(summaries(spark), "id", plan, 3).collect() if r.edit}
    assert set(got) == set(plan)
    text = lambda kind, section="assessment": [b.text for b in got[kind][section]]
    assert text("wrong_number")[0] == "Took 10 mg of Morphine at 8:30 in 2019."
    assert text("wrong_drug")[0] == "Took 5 mg of lisinopril at 8:30 in 2019."
    assert text("flipped_negative")[2] == "Cough was reported."
    assert text("hedge_removed")[1] == "Some pain."
    assert text("planned_to_completed", "response")[0] == "Completed: call the doctor."
    assert len(got["drop_assessment"].assessment) == 2 and len(got["drop_response"].response) == 1
    assert Counter(b.speaker for b in got["speaker_swap"].assessment) == {"Nurse": 2, "Caller": 1}
    for kind, r in got.items():
        assert r.rubrics_broken == [EDITS[kind].rubric] and {k for k, v in r.expected.items() if v == "FAIL"} == {EDITS[kind].rubric}
        assert r.changed and r.own == "x" and all(b.turns for b in r.assessment)
    clean = [r for r in judge_set(summaries(spark), "id", plan, 3).collect() if not r.edit]
    assert len(clean) == 4 and all(set(r.expected.values()) == {"PASS"} and r.changed is None and len(r.assessment) == 3 for r in clean)


def test_an_edit_needs_a_place(spark):
    rows = summaries(spark).withColumn("education", F.expr("slice(education, 1, 0)")).select("*", places(summaries(spark), "drop_education").alias("p"))
    assert all(r.p == [] for r in rows.collect())
    got = judge_set(summaries(spark), "id", {"drop_education": 3}, 3).collect()
    assert all(r.edit is None for r in got)
