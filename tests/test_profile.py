"""The profile of transcripts on a small set."""

import pytest
from pyspark.sql import functions as F

from turnloom.operators.profile import RATES, against_reference, realism


def test_realism(spark):
    rows = [("a", 1, "Caller", "Um, I I need three pills and"), ("a", 2, "Caller", "Yes."), ("a", 3, "Nurse", "Uh okay okay"), ("b", 1, "Nurse", None), ("b", 2, "Caller", "to the.")]
    df = spark.createDataFrame([("x", *r) for r in rows], "s string, call_id string, turn_id int, speaker string, text string")
    got = realism(df, ["s"])
    r = got.first()
    chars = sum(len(x[3] or "") for x in rows)
    assert (r.calls, r.mean_chars, r.mean_turns) == (2, chars / 2, 2.5)
    assert (r.caller_short_turn_rate, r.caller_dangling_fragment_rate, r.same_speaker_consecutive_rate) == (pytest.approx(2 / 3), pytest.approx(2 / 3), pytest.approx(1 / 5))
    tokens = 7 + 1 + 3 + 2
    assert (r.fillers_per_1k, r.immediate_repeats_per_1k, r.number_words_per_1k) == tuple(pytest.approx(1000 * n / tokens) for n in (2, 2, 1))
    reference = got.select(*(F.col(c) * (2.0 if c == "mean_turns" else 0.0 if c == "number_words_per_1k" else 1.1) for c in RATES)).toDF(*RATES)
    off = {x.rate: x.off for x in against_reference(got, reference, ["s"]).collect()}
    assert len(off) == 8 and off["mean_turns"] is True and off["mean_chars"] is False and off["number_words_per_1k"] is None
    assert realism(df.limit(0), ["s"]).collect() == []
