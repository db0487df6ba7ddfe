"""The library's text functions and the risk scan by name in SQL."""

from __future__ import annotations

import re
from collections import deque

from pyspark.sql import SparkSession
from pyspark.sql.types import StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

from turnloom.functions import risk_patterns as P
from turnloom.functions.fuzzy import seq_ratio_udf
from turnloom.functions.spoken import number_candidates_udf, spoken_date_udf
from turnloom.operators.risk import Turn, turn_hits

#: Turns before a turn that its rules look at.
BEFORE = 3
_SENTENCE = re.compile(r"(?<=[.?!])\s+")


def risk_hits_class(drugs: list[str]) -> type:
    """The table function ``risk_hits(TABLE(turns))``: category, rule, turn_id, quote of every hit of a call.

    The argument has call_id, turn_id, speaker and text; the function itself asks for one call a group,
    its turns in order, and holds the last turns only.
    """
    medicine = "|".join([P.MEDICINE, *(re.escape(d) for d in drugs if len(d) > 3)])

    class RiskHits:
        def __init__(self) -> None:
            self.before: deque = deque(maxlen=BEFORE)

        @staticmethod
        def analyze(turns: AnalyzeArgument) -> AnalyzeResult:
            if not turns.isTable:
                raise ValueError("risk_hits takes TABLE(turns)")
            field = {f.name: f.dataType for f in turns.dataType.fields}
            if missing := {"call_id", "turn_id", "speaker", "text"} - set(field):
                raise ValueError(f"turns lack {', '.join(sorted(missing))}")
            schema = StructType().add("call_id", field["call_id"]).add("category", StringType()).add("rule", StringType()).add("turn_id", field["turn_id"]).add("quote", StringType())
            return AnalyzeResult(schema=schema, partitionBy=[PartitioningColumn("call_id")], orderBy=[OrderingColumn("turn_id")])

        def eval(self, row):
            text, speaker = row["text"] or "", row["speaker"] or ""
            recent = " ".join(t for _, t in self.before)
            nurse = " ".join(t for s, t in self.before if s == "Nurse")
            sentences = [s.strip() for s in _SENTENCE.split(text) if s.strip()]
            for category, rule, quote in turn_hits(Turn(speaker, text, recent, nurse, medicine), sentences):
                yield row["call_id"], category, rule, row["turn_id"], quote
            if row["text"] is not None:
                self.before.append((speaker, text))

    return RiskHits


def register_functions(spark: SparkSession, drugs: list[str]) -> None:
    """Register ``number_candidates``, ``spoken_date``, ``seq_ratio`` and the table function ``risk_hits`` for SQL."""
    from pyspark.sql.functions import udtf

    spark.udf.register("number_candidates", number_candidates_udf)
    spark.udf.register("spoken_date", spoken_date_udf)
    spark.udf.register("seq_ratio", seq_ratio_udf)
    spark.udtf.register("risk_hits", udtf(risk_hits_class(drugs)))
