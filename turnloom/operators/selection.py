"""Exact order statistics of groups of any size, by distributed selection.

Sampled cut points part every group's values into ranges; one pass counts rows by (group, range), the
counts tell in which range a rank falls and how many values come before it, and only those ranges'
rows are sorted, each group and range apart. No task holds a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnloom.operators.relational import small
from turnloom.sources.shared import worked_out

#: Ranges a group is parted into.
RANGES = 64


def order_statistics(rows: DataFrame, group: list[str], value: str, ranks: dict[str, Column], ranges: int = RANGES) -> DataFrame:
    """group columns and one column per name of ``ranks``: the value at that place (from 0) of the group's sorted values.

    ``ranks`` are expressions over ``n``, the group's number of values, clipped to 0..n - 1. Null values are
    left out, a group without values has no row; NaN comes last. Values that fill a range's place many
    times are counted, not sorted.
    """
    keyed = rows.filter(F.col(value).isNotNull()).select(*group, F.col(value).cast("double").alias("__v"))
    cuts = keyed.groupBy(*group).agg(F.percentile_approx("__v", [k / ranges for k in range(1, ranges)], F.lit(10_000)).alias("__cuts"))
    same = lambda a, b: [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in group]
    cuts = worked_out(cuts.withColumn("__cuts", F.array_distinct("__cuts")))
    at = F.size(F.filter("__cuts", lambda c: c < F.col("__v")))
    # equal values are one row with a count, so that a common value is no long run
    counted = keyed.groupBy(*group, "__v").agg(F.count(F.lit(1)).alias("__c"))
    placed = worked_out(counted.alias("a").join(cuts.alias("b"), same("a", "b") or None, "inner" if group else "cross").select(*(f"a.{c}" for c in group), "__v", "__c", at.alias("__r")))
    sizes = placed.groupBy(*group, "__r").agg(F.sum("__c").alias("__s"))
    whole, line = Window.partitionBy(*group), Window.partitionBy(*group).orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("__before", F.coalesce(F.sum("__s").over(line), F.lit(0))).withColumn("n", F.sum("__s").over(whole))
    wanted = F.array(*(F.struct(F.lit(name).alias("name"), F.greatest(F.lit(0), F.least(F.col("n") - 1, rank.cast("long"))).alias("rank")) for name, rank in ranks.items()))
    asked = sizes.withColumn("__w", F.explode(wanted)).filter((F.col("__w.rank") >= F.col("__before")) & (F.col("__w.rank") < F.col("__before") + F.col("__s")))
    asked = asked.select(*group, "__r", F.col("__w.name").alias("__name"), (F.col("__w.rank") - F.col("__before")).alias("__place"))
    held = placed.alias("a").join(small(asked.select(*group, "__r").distinct()).alias("b"), [*same("a", "b"), F.col("a.__r") == F.col("b.__r")], "left_semi")
    upto = F.sum("__c").over(Window.partitionBy(*group, "__r").orderBy("__v"))
    summed = held.withColumn("__upto", upto)
    met = asked.alias("a").join(summed.alias("b"), [*same("a", "b"), F.col("a.__r") == F.col("b.__r"), F.col("__place") < F.col("__upto"), F.col("__place") >= F.col("__upto") - F.col("__c")])
    found = met.select(*(f"a.{c}" for c in group), "__name", "__v")
    return found.groupBy(*group).pivot("__name", list(ranks)).agg(F.max("__v"))


def nearest_rank(p: float) -> Column:
    """The place of sorted[ceil(p n) - 1]; the product is kept from falling just above a whole number."""
    return F.ceil(F.round(F.lit(p) * F.col("n"), 9)) - 1
