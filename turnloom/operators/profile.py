"""Profile of a set of transcripts: how spoken they are, and how far they are from a reference set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnloom.functions import text as T

# Number words, and the words that a cut-off turn ends with.
NUMBER_WORDS = (
    "zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve", "thirteen", "fourteen", "fifteen",
    "sixteen", "seventeen", "eighteen", "nineteen", "twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety", "hundred", "thousand",
)
DANGLING = r"\b(and|to|the|a|of|for|that|but|or|with|my|her|his)\.?\s*$"
SHORT = 3
RATES = ("mean_chars", "mean_turns", "caller_short_turn_rate", "caller_dangling_fragment_rate", "same_speaker_consecutive_rate", "fillers_per_1k", "immediate_repeats_per_1k", "number_words_per_1k")


def _share(part: Column, whole: Column) -> Column:
    return part / F.greatest(whole, F.lit(1))


def realism(turns: DataFrame, by: list[str], id_col: str = "call_id") -> DataFrame:
    """by, calls and the rates of ``turns`` (by, id, turn_id, speaker, text): two exchanges, one of turns for the speaker before.

    Null texts count as empty; a turn counts as a continuation if the turn before in its call has the same
    speaker. Rates of words are per thousand tokens, rates of turns per turn or caller's turn.
    """
    text = F.coalesce("text", F.lit(""))
    words = F.filter(F.regexp_extract_all(F.lower(text), F.lit(r"([a-z']+|\d+)"), 1), lambda w: w != "")
    before = F.lag("speaker").over(Window.partitionBy(*by, id_col).orderBy("turn_id"))
    rows = turns.select(*by, id_col, "turn_id", "speaker", text.alias("text"), words.alias("w"), (before == F.col("speaker")).alias("same"))
    caller = F.coalesce(F.col("speaker") == "Caller", F.lit(False))
    some = lambda words: F.size(F.filter("w", lambda w: w.isin(*words)))
    calls = rows.groupBy(*by, id_col).agg(
        F.count(F.lit(1)).alias("turns"), F.sum(F.length("text")).alias("chars"), F.sum(F.size("w")).alias("tokens"), F.count_if(caller).alias("caller"),
        F.count_if(caller & (F.size("w") <= SHORT)).alias("short"), F.count_if(caller & F.lower("text").rlike(DANGLING)).alias("dangling"), F.count_if("same").alias("same"),
        F.sum(some(T.FILLERS)).alias("fill"), F.sum(T.immediate_repeats(F.col("w"))).alias("repeats"), F.sum(some(NUMBER_WORDS)).alias("numbers"),
    )
    sums = ("turns", "chars", "tokens", "caller", "short", "dangling", "same", "fill", "repeats", "numbers")
    g = calls.groupBy(*by).agg(F.count(F.lit(1)).alias("calls"), *(F.sum(c).alias(c) for c in sums))
    c = F.col
    thousand = F.greatest(c("tokens"), F.lit(1)) / 1000
    return g.select(
        *by, "calls", (c("chars") / c("calls")).alias("mean_chars"), (c("turns") / c("calls")).alias("mean_turns"), _share(c("short"), c("caller")).alias("caller_short_turn_rate"),
        _share(c("dangling"), c("caller")).alias("caller_dangling_fragment_rate"), _share(c("same"), c("turns")).alias("same_speaker_consecutive_rate"),
        (c("fill") / thousand).alias("fillers_per_1k"), (c("repeats") / thousand).alias("immediate_repeats_per_1k"), (c("numbers") / thousand).alias("number_words_per_1k"),
    )


def against_reference(stats: DataFrame, reference: DataFrame, by: list[str], tolerance: float = 0.3) -> DataFrame:
    """by, rate, value, reference, off: every rate beside the one reference row; ``off`` beyond the tolerance, null against zero."""
    cells = lambda name: F.inline(F.array(*(F.struct(F.lit(r).alias("rate"), F.col(r).alias(name)) for r in RATES)))
    ours, theirs = stats.select(*by, cells("value")), reference.select(cells("reference"))
    off = F.abs(F.col("value") - F.col("reference")) / F.nullif(F.col("reference"), F.lit(0.0)) > tolerance
    return ours.join(F.broadcast(theirs), "rate").select(*by, "rate", "value", "reference", off.alias("off"))  # eight rows
