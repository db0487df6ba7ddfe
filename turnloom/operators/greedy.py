"""Greedy one-to-one matching, which depends on order: sorted rows are read group by group in Arrow batches.

A group is one call of one system; calls are bounded by their length, not by the number of calls.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnloom.functions.fuzzy import ratio
from turnloom.operators.relational import spread

#: Compared pairs of values that a task remembers.
REMEMBERED = 500_000


def names_match(a: str, b: str, least: float = 0.85) -> bool:
    """Equal, one inside the other, or alike; an empty name matches nothing."""
    return bool(a and b) and (a == b or a in b or b in a or ratio(a, b) >= least)


class _Group:
    """The unused predicted rows of a group, queued by value, and the values that match a gold one."""

    def __init__(self) -> None:
        self.free: dict[str, deque] = {}
        self.alike: dict[str, list[str]] = {}

    def first(self, gold: str, match: Callable[[str, str], bool]):
        """The first unused row that matches, taken out."""
        mine = self.alike.get(gold)
        if mine is None:
            mine = [v for v, rows in self.free.items() if rows and match(gold, v)]
        mine = self.alike[gold] = [v for v in mine if self.free[v]]
        return self.free[min(mine, key=lambda v: self.free[v][0][0])].popleft()[1] if mine else None


def greedy_match(gold: DataFrame, predicted: DataFrame, keys: list[str], order: str, value: str, match: Callable[[str, str], bool] = names_match) -> DataFrame:
    """keys, ``order`` and ``value`` of each gold row with ``match_order``: the first unused predicted
    row of the group, in order, that matches; null if there is none.

    Rows of equal values wait in one queue, and a pair of values is compared once, so a group takes
    time in proportion to its rows and to the pairs of its distinct values. ``match`` tells by the values alone.
    """
    names = [*keys, order, value]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[str, str], bool] = {}

        def alike(a: str, b: str) -> bool:
            if (a, b) not in seen:
                if len(seen) >= REMEMBERED:
                    seen.clear()
                seen[a, b] = match(a, b)
            return seen[a, b]

        now, group, place = None, _Group(), 0
        for batch in batches:
            golden, found = [], []
            columns = [batch.column(c).to_pylist() for c in ("__gold", *names)]
            for is_gold, *row in zip(*columns, strict=True):
                at, key, v = row[:-2], row[-2], row[-1] or ""
                if at != now:
                    now, group, place = at, _Group(), 0
                golden.append(is_gold)
                if is_gold:
                    found.append(group.first(v, alike))
                else:
                    group.free.setdefault(v, deque()).append((place, key))
                    place += 1
            rows = batch.select(names).filter(pa.array(golden, pa.bool_()))
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(found, pa.int64())], [*names, "match_order"])

    types = {f.name: f.dataType.simpleString() for f in gold.schema.fields}
    schema = ", ".join(f"`{c}` {types[c]}" for c in names) + ", match_order long"
    both = gold.select(*names, F.lit(True).alias("__gold")).unionByName(predicted.select(*names, F.lit(False).alias("__gold")))
    # a group's predicted rows stand before its gold ones
    return spread(both, *keys).sortWithinPartitions(*keys, "__gold", order).mapInArrow(run, schema)
