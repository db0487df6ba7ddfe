"""Ratios, bounds, agreement and percentiles as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio_pct(ok: Column, total: Column) -> Column:
    """100 ok / total, null on an empty total."""
    return F.lit(100.0) * ok / F.nullif(total, F.lit(0))


def wilson_low(ok: Column, total: Column, z: float = 1.96) -> Column:
    """Lower Wilson bound of ok / total in percent, at least 0; null on an empty total."""
    n = F.nullif(total, F.lit(0)).cast("double")
    p = ok / n
    centre, spread = p + z * z / (2 * n), z * F.sqrt((p * (1 - p) + z * z / (4 * n)) / n)
    return F.lit(100.0) * F.greatest(F.lit(0.0), (centre - spread) / (1 + z * z / n))


def nearest_rank(value: str, p: float) -> Column:
    """sorted[ceil(p n) - 1] as an aggregate."""
    return F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {value})")


def kappa(agree: Column, chance: Column) -> Column:
    """Cohen's kappa of observed and chance agreement; 1 where chance is certain."""
    return F.when(chance == 1, F.lit(1.0)).otherwise((agree - chance) / F.nullif(1 - chance, F.lit(0.0)))


def f1(tp: Column, fp: Column, fn: Column) -> Column:
    return 2.0 * tp / F.nullif(2 * tp + fp + fn, F.lit(0))
