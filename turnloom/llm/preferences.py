"""Preference formatting: the longest common turn prefix once as prompt, two masked completions.

Rows stay turns throughout: a conversation is never gathered into one task, however long it is.
Only DataFrame and SQL functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TRAINED_ROLES = ("assistant",)
#: Turns without a number come last.
NO_TURN = (1 << 63) - 1


def _side(df: DataFrame, pair_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    return df.select(
        F.col(pair_col).alias("pair_id"),
        F.coalesce(F.col(turn_col).cast("long"), F.lit(NO_TURN)).alias("turn"),
        F.coalesce(F.col(role_col), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )


def _slots(side: DataFrame, name: str) -> DataFrame:
    """What stands at each turn number, as a count and a sum of hashes that ignore the rows' order."""
    content = F.struct(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("role", "text").cast("decimal(38,0)")).alias("h"))
    return side.groupBy("pair_id", "turn").agg(content.alias(name))


def rendered_turn(role: Column, text: Column) -> tuple[Column, Column]:
    """(header, body) of a turn in chat markup."""
    return F.concat(F.lit("<|im_start|>"), role, F.lit("\n")), F.concat(text, F.lit("<|im_end|>\n"))


def preference_segments(
    chosen: DataFrame,
    rejected: DataFrame,
    pair_col: str = "pair_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    trained_roles: tuple[str, ...] = TRAINED_ROLES,
) -> DataFrame:
    """One row per rendered turn: pair_id, part, turn, role, segment, loss_from, loss_chars.

    ``part`` is ``prompt`` (the turns before the first turn number at which the two sides differ,
    once), ``chosen`` or ``rejected``. The loss counts from character ``loss_from`` of the segment
    over ``loss_chars`` characters: the body of a completion's turn by a trained role, else nothing.
    Rows of one pair in the order of part, turn, role and segment give the texts (see ``assembled``).

    Null roles and texts count as empty; a null turn comes last; rows repeated at one turn number are
    compared as a whole and all rendered; null pair ids form one pair; a pair with one side only
    has no prompt; equal sides are all prompt. Other columns are ignored; empty tables give no rows.
    """
    a, b = (_side(x, pair_col, turn_col, role_col, text_col) for x in (chosen, rejected))
    x, y = _slots(a, "x").alias("l"), _slots(b, "y").alias("r")
    met = x.join(y, F.col("l.pair_id").eqNullSafe(F.col("r.pair_id")) & (F.col("l.turn") == F.col("r.turn")), "full_outer")
    # the sides of a pair differ here; a turn of one side only has a null on the other
    differ = met.filter(~F.col("x").eqNullSafe(F.col("y"))).select(
        F.coalesce("l.pair_id", "r.pair_id").alias("split_id"), F.coalesce("l.turn", "r.turn").alias("turn")
    )
    splits = differ.groupBy("split_id").agg(F.min("turn").alias("split"))
    both = a.withColumn("part", F.lit("chosen")).unionByName(b.withColumn("part", F.lit("rejected")))
    placed = both.join(splits, F.col("pair_id").eqNullSafe(F.col("split_id")), "left")
    common = F.col("split").isNull() | (F.col("turn") < F.col("split"))
    once = placed.filter(~(common & (F.col("part") == "rejected"))).withColumn("part", F.when(common, F.lit("prompt")).otherwise(F.col("part")))
    header, body = rendered_turn(F.col("role"), F.col("text"))
    trained = (F.col("part") != "prompt") & F.col("role").isin(*trained_roles)
    whole = F.concat(header, body)
    return once.select(
        "pair_id",
        "part",
        "turn",
        "role",
        whole.alias("segment"),
        F.when(trained, F.length(header)).otherwise(F.length(whole)).cast("long").alias("loss_from"),
        F.when(trained, F.length(body)).otherwise(F.lit(0)).cast("long").alias("loss_chars"),
    )


def assembled(segments: DataFrame) -> DataFrame:
    """(pair_id, prompt, chosen, rejected): the texts. Gathers each pair; meant for pairs of bounded length."""
    text = segments.groupBy("pair_id", "part").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "segment"))).alias("s"))
    joined = text.select("pair_id", "part", F.array_join("s.segment", "").alias("t"))
    return joined.groupBy("pair_id").agg(
        *(F.coalesce(F.max(F.when(F.col("part") == p, F.col("t"))), F.lit("")).alias(p) for p in ("prompt", "chosen", "rejected"))
    )
