"""Risk scan of transcript turns: rule hits by sentence, with the suppressions that need match positions."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import cache

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnloom.functions import risk_patterns as P
from turnloom.functions import text as T

SUICIDAL, ESCALATION = "suicidal_statement", "escalation_request"
_STATE = ("other_urgent", "uncontrolled_symptom", "breathing_concern")
_HITS = "array<struct<category:string,rule:string,quote:string>>"


@cache
def _rx(pattern: str) -> re.Pattern:
    return re.compile(pattern, re.IGNORECASE | re.DOTALL)


@dataclass(frozen=True)
class Turn:
    speaker: str
    text: str
    recent: str  # the three turns before
    recent_nurse: str  # of those, the nurse's
    medicine: str  # pattern of talk about medicines

    @property
    def precautions(self) -> bool:
        """The nurse has just listed what to call about."""
        return bool(self.recent_nurse and (_rx(P.CONDITIONAL).search(self.recent_nurse) or _rx(r"\bcall\b|\b911\b|nine one one").search(self.recent_nurse)))


def _sentence_can_hit(turn: Turn, sentence: str, category: str) -> bool:
    """What rules out a whole sentence for a category."""
    if sentence.endswith("?") and (category not in (SUICIDAL, ESCALATION) or _rx(P.LATER).search(sentence)):
        return False
    if turn.speaker == "Nurse" and _rx(P.CONTINUES).match(sentence):
        return False
    return not (category in _STATE and _rx(P.HISTORICAL).search(sentence))


def _match_survives(turn: Turn, sentence: str, category: str, negatable: bool, m: re.Match) -> bool:
    """What rules out one match by the words around it."""
    before, after = sentence[: m.start()], sentence[m.end() :]
    return not (
        (sentence.endswith("?") and not _rx(P.PLEA).search(m[0]))
        or (turn.speaker == "Nurse" and _rx(P.RETURN).match(after))
        or (negatable and _rx(P.NEGATED_BEFORE).search(before[-40:]))
        or (category != SUICIDAL and _rx(P.CONDITIONAL).search(before))
    )


def _pain_answer(turn: Turn, sentence: str) -> bool:
    """A short answer with one high number to the question how strong the pain is."""
    numbers = _rx(P.SPOKEN_NUMBER).findall(sentence)
    short = turn.speaker == "Caller" and len(sentence.split()) <= 8 and len(numbers) == 1 and not sentence.endswith("?")
    return bool(
        short and _rx(P.PAIN_ASK).search(turn.recent_nurse) and _rx(rf"\b{P.HIGH_NUMBER}\b{P.NO_UNIT_AFTER}").search(sentence) and not _rx(P.HISTORICAL).search(sentence)
    )


def turn_hits(turn: Turn, sentences: list[str]) -> list[tuple[str, str, str]]:
    """(category, rule, sentence) of a turn; each at most once."""
    medicine = bool(_rx(turn.medicine).search(turn.text) or _rx(turn.medicine).search(turn.recent))
    hits: dict[tuple[str, str, str], None] = {}
    for s in sentences:
        for category, rule, speaker, negatable, about_medicine, pattern in P.RULES:
            if speaker != turn.speaker or (about_medicine and not medicine) or not _sentence_can_hit(turn, s, category):
                continue
            # a caller who reads the nurse's list back reports nothing new
            if speaker == "Caller" and category != SUICIDAL and turn.precautions and _rx(pattern).search(turn.recent_nurse):
                continue
            if any(_match_survives(turn, s, category, negatable, m) for m in _rx(pattern).finditer(s)):
                hits[(category, rule, s)] = None
        if _pain_answer(turn, s):
            hits[("uncontrolled_symptom", "pain_answer", s)] = None
    return list(hits)


def risk_scan(turns: DataFrame, drugs: list[str], id_col: str = "call_id") -> DataFrame:
    """id, category, rule, turn_id, quote of every hit in ``turns`` (id, turn_id, speaker, text)."""
    medicine = "|".join([P.MEDICINE, *(re.escape(d) for d in drugs if len(d) > 3)])

    @F.pandas_udf(_HITS)
    def hits(speaker: pd.Series, text: pd.Series, recent: pd.Series, nurse: pd.Series, sentences: pd.Series) -> pd.Series:
        rows = zip(speaker, text, recent, nurse, sentences, strict=True)
        found = (turn_hits(Turn(w or "", t or "", r or "", n or "", medicine), list(s) if s is not None else []) for w, t, r, n, s in rows)
        return pd.Series([[{"category": c, "rule": k, "quote": q} for c, k, q in h] for h in found])

    before = Window.partitionBy(id_col).orderBy("turn_id").rowsBetween(-3, -1)
    c = turns.withColumn("recent", F.array_join(F.collect_list("text").over(before), " "))
    c = c.withColumn("nurse", F.array_join(F.collect_list(F.when(F.col("speaker") == "Nurse", F.col("text"))).over(before), " "))
    c = c.withColumn("h", F.explode(hits("speaker", "text", "recent", "nurse", T.sentences(F.col("text")))))
    return c.select(id_col, "h.category", "h.rule", "turn_id", "h.quote")


def first_flags(hits: DataFrame, id_col: str = "call_id") -> DataFrame:
    """The first hit of each category: what a summary without that flag gets."""
    first = hits.groupBy(id_col, "category").agg(F.min(F.struct("turn_id", "rule", "quote")).alias("h"))
    return first.select(id_col, "category", "h.turn_id", "h.quote")


def clinical_score(turns: DataFrame, drugs: list[str], id_col: str = "call_id") -> DataFrame:
    """(id, score): how many signal groups a call's text has, and one more for a drug name."""
    names = r"\b(?:" + "|".join(re.escape(d) for d in drugs if len(d) > 3) + r")\b"
    ordered = turns.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("turn_id", "text"))).alias("t"))
    text = F.array_join("t.text", " ")
    score = sum((text.rlike(f"(?i){p}").cast("int") for p in (*P.SIGNALS, names)), F.lit(0))
    return ordered.select(id_col, score.alias("score"))
