"""Stratified batch schedule: steps of fixed size with length quotas and category caps.

A constraint search over one list of calls, so one task an epoch; epochs run in parallel.
"""

from __future__ import annotations

import random
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STEP, CATEGORY_CAP, NA_CAP, TRIES = 8, 3, 2, 500


def length_quotas(sizes: dict[str, int], step: int = STEP) -> list[dict[str, int]]:
    """Calls of each length per step: every step moves the running totals closest to proportion."""
    total, given, out = sum(sizes.values()), Counter(), []
    for at in range(0, total, step):
        upto, quota = min(total, at + step), Counter()
        for _ in range(upto - at):
            short = {k: sizes[k] * upto / total - given[k] - quota[k] for k in sizes if given[k] + quota[k] < sizes[k]}
            quota[max(short, key=lambda k: (short[k], k))] += 1
        given += quota
        out.append(dict(quota))
    return out


def epoch_steps(calls: list[tuple[str, str, str]], epoch: int, seed: int = 42, step: int = STEP) -> list[list[str]]:
    """Steps of call ids from (call_id, length, category): each call once, caps kept in every step."""
    quotas = length_quotas(dict(Counter(c[1] for c in calls)), step)
    for attempt in range(TRIES):
        rng = random.Random(f"{seed}:{epoch}:{attempt}")
        pool, order = rng.sample(sorted(calls), len(calls)), rng.sample(quotas, len(quotas))
        steps = []
        for quota in order:
            left, seen, chosen = Counter(quota), Counter(), []
            for call in pool:
                cap = NA_CAP if call[2] == "not_applicable" else CATEGORY_CAP
                if left[call[1]] > 0 and seen[call[2]] < cap:
                    left[call[1]] -= 1
                    seen[call[2]] += 1
                    chosen.append(call)
            if left.total():
                break
            taken = set(chosen)
            pool = [c for c in pool if c not in taken]
            steps.append(rng.sample([c[0] for c in chosen], len(chosen)))
        else:
            return steps
    raise ValueError("no schedule keeps the caps")


def batch_schedule(calls: DataFrame, epochs: int = 3, seed: int = 42, step: int = STEP) -> DataFrame:
    """epoch, step, pos, call_id from ``calls`` (call_id, length, category)."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        epoch = int(rows["epoch"].iloc[0])
        steps = epoch_steps(list(rows[["call_id", "length", "category"]].itertuples(index=False, name=None)), epoch, seed, step)
        return pd.DataFrame([(epoch, s, p, c) for s, ids in enumerate(steps) for p, c in enumerate(ids)], columns=["epoch", "step", "pos", "call_id"])

    each = calls.withColumn("epoch", F.explode(F.sequence(F.lit(1), F.lit(epochs))))
    return each.groupBy("epoch").applyInPandas(run, "epoch int, step int, pos int, call_id string")
