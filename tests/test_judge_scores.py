"""Rubric scores, ambiguous edits and edit filters."""

from turnloom.operators.judge_scores import ambiguous, edited_with, rubric_scores


def test_edits(spark):
    rows = [(1, ["wrong_drug"]), (2, ["wrong_drug", "drop_education"]), (3, ["speaker_swap"]), (4, []), (5, None), (6, ["wrong_number", "speaker_swap"])]
    df = spark.createDataFrame(rows, "id int, edit_types array<string>")
    assert {r.id for r in df.filter(ambiguous(df["edit_types"])).collect()} == {1, 6}
    assert {r.id for r in edited_with(df, "edit_types", ["speaker_swap", "wrong_drug"]).collect()} == {1, 2, 3, 6}
    assert {r.id for r in edited_with(df, "edit_types", ["speaker_swap", "wrong_number"], every=True).collect()} == {6}


def test_rubrics(spark):
    maps = "id int, {} map<string,string>"
    expected = [(k, {"f": "FAIL" if k < 3 else "PASS", "c": "PASS"}) for k in range(8)]
    verdicts = [(k, {"f": "FAIL" if k in (0, 1, 7) else "PASS", "c": "PASS"}) for k in range(7)] + [(7, {"f": "FAIL"})]
    got = {r.rubric: r for r in rubric_scores(spark.createDataFrame(expected, maps.format("expected")), spark.createDataFrame(verdicts, maps.format("verdicts")), ("f", "c")).collect()}
    f = got["f"]
    assert (f.n, f.agree, f.caught, f.failing, f.alarms, f.passing) == (8, 6, 2, 3, 1, 5)
    assert abs(f.kappa - (6 / 8 - (3 * 3 + 5 * 5) / 64) / (1 - (3 * 3 + 5 * 5) / 64)) < 1e-12
    assert got["c"].n == 7 and got["c"].kappa == 1.0
