"""First-match joins: each fact takes the first item, by priority of keys and then by the items' order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_match(facts: DataFrame, items: DataFrame, group: list[str], keys: list[tuple[Column, Column]], fact_id: str, item_order: str, once: bool = False) -> DataFrame:
    """``facts`` with ``priority`` (of the key that matched, from 1; null: none) and ``item`` (all columns of the item).

    ``keys`` lists pairs of expressions over facts and items, the best first; a null or empty key matches
    nothing. Both sides become rows of (group, priority, key), so that every priority is one equality join.
    Without ``once`` many facts may take the same item. With ``once`` an item serves one fact of a
    priority: the n-th fact of a key takes its n-th item, and only facts that a better priority left
    over look for items that are left. Group columns and ``fact_id`` within the group are not null.
    """
    def keyed(rows: DataFrame, side: int, payload: Column) -> DataFrame:
        found = F.array(*(F.struct(F.lit(k + 1).alias("priority"), pair[side].cast("string").alias("key")) for k, pair in enumerate(keys)))
        wanted = F.filter(found, lambda x: F.coalesce(x["key"], F.lit("")) != "")
        return rows.select(*group, payload, F.inline(wanted))

    item = F.struct(*(F.col(c) for c in items.columns))
    if not once:
        best = keyed(items, 1, item.alias("item")).groupBy(*group, "priority", "key").agg(F.min_by("item", F.col(f"item.{item_order}")).alias("item"))
        met = keyed(facts, 0, F.col(fact_id)).join(best, [*group, "priority", "key"])
        chosen = met.groupBy(*group, fact_id).agg(F.min_by(F.struct("priority", "item"), "priority").alias("__m"))
        return facts.join(chosen, [*group, fact_id], "left").select(*(F.col(c) for c in facts.columns), F.col("__m.priority").alias("priority"), F.col("__m.item").alias("item"))
    out, left, free = None, facts, items
    for k, (of_fact, of_item) in enumerate(keys):
        line = Window.partitionBy(*group, "__key")
        f = left.withColumn("__key", F.nullif(of_fact.cast("string"), F.lit(""))).withColumn("__n", F.row_number().over(line.orderBy(fact_id)))
        i = free.select(*(F.col(c) for c in group), F.nullif(of_item.cast("string"), F.lit("")).alias("__key"), item.alias("item")).filter("__key is not null")
        i = i.withColumn("__n", F.row_number().over(line.orderBy(F.col(f"item.{item_order}"))))
        met = f.join(i, [*group, "__key", "__n"], "left").drop("__key", "__n")
        last = k == len(keys) - 1
        taken = met if last else met.filter("item is not null")
        named = taken.select(*facts.columns, F.when(F.col("item").isNotNull(), F.lit(k + 1)).alias("priority"), "item")
        out = named if out is None else out.unionByName(named)
        if not last:
            left = met.filter("item is null").select(*facts.columns)
            free = free.join(met.filter("item is not null").select(*group, F.col(f"item.{item_order}").alias(item_order)), [*group, item_order], "left_anti")
    return out


def differing(fact: Column, item: Column, fields: dict[str, str]) -> Column:
    """(field, fact's value, item's value) where an item has a value that the fact lacks or has otherwise, after ``normal``.

    ``fields`` maps a fact's field to the item's; both sides are structs of texts. Values are compared in
    lower case without outer blanks; numbers by value.
    """
    normal = lambda v: F.lower(F.trim(F.coalesce(v.cast("string"), F.lit(""))))
    same = lambda a, b: (normal(a) == normal(b)) | F.coalesce(normal(a).try_cast("double") == normal(b).try_cast("double"), F.lit(False))
    cells = F.array(*(F.struct(F.lit(a).alias("field"), fact[a].cast("string").alias("fact"), item[b].cast("string").alias("item")) for a, b in fields.items()))
    return F.filter(cells, lambda c: c["item"].isNotNull() & ~same(c["fact"], c["item"]))
