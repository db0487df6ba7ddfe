"""Relational operators over conversational records that are more than one built-in call."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnloom.functions.text import char_grams


def turn_windows(turns: DataFrame, keys: list[str], order: str, first: int, last: int, text: str, name: str) -> DataFrame:
    """``name``: the texts of the frame from ``first`` to ``last`` rows around each row, joined by blanks."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(first, last)
    return turns.withColumn(name, F.array_join(F.collect_list(text).over(w), " "))


def id_window(ids: Column, n: Column, radius: int) -> Column:
    """Distinct sorted ids within ``radius`` of any id, clipped to 1..n; no ids for an empty list."""
    around = F.transform(ids, lambda i: F.sequence(F.greatest(F.lit(1), i - radius), F.least(n, i + radius)))
    # an id outside 1..n may give a falling sequence: nothing of it is inside
    inside = F.filter(F.flatten(around), lambda x: (x >= 1) & (x <= n))
    return F.array_sort(F.array_distinct(inside))


def texts_of(ids: Column, texts: Column) -> Column:
    """Texts of 1-based ids in the order of the ids; ids without a text are skipped."""
    known = F.filter(ids, lambda i: (i >= 1) & (i <= F.size(texts)))
    return F.array_join(F.transform(known, lambda i: F.element_at(texts, i)), " ")


def sessions_by_flag(rows: DataFrame, keys: list[str], order: str, flag: Column, name: str = "group_id") -> DataFrame:
    """A running number that grows where ``flag`` holds: continuation rows share their leader's number."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(name, F.sum(flag.cast("long")).over(w))


def multiset_match(a: DataFrame, b: DataFrame, key: list[str], order: str) -> DataFrame:
    """Rows of ``a`` with ``matched``: equal keys of the two sides are used up one for one.

    The n-th row of a key matches where the other side has at least n rows of the key, which is what
    a greedy pass with a pool of unused rows gives.
    """
    w = Window.partitionBy(*key).orderBy(order)
    counts = b.groupBy(*key).agg(F.count(F.lit(1)).alias("__there"))
    ranked = a.withColumn("__rank", F.row_number().over(w)).join(counts, key, "left")
    return ranked.withColumn("matched", F.coalesce(F.col("__rank") <= F.col("__there"), F.lit(False))).drop("__rank", "__there")


def band_join(a: DataFrame, b: DataFrame, key: str, position: str, radius: int) -> DataFrame:
    """Pairs of equal ``key`` whose positions are within ``radius``, as a hash join.

    The right side is repeated for each position within the band, which keeps the condition an
    equality; a condition on the difference would pair all rows of a key first.
    """
    spread = b.withColumn("__at", F.explode(F.sequence(F.col(f"b.{position}") - radius, F.col(f"b.{position}") + radius)))
    return a.join(spread, (F.col(f"a.{key}") == F.col(f"b.{key}")) & (F.col(f"a.{position}") == F.col("__at"))).drop("__at")


def anti_both_ways(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(side, missing): keys of each side that the other lacks, counted."""
    left = a.select(key).distinct().join(b, key, "left_anti").agg(F.count(F.lit(1)).alias("missing")).withColumn("side", F.lit("only_left"))
    right = b.select(key).distinct().join(a, key, "left_anti").agg(F.count(F.lit(1)).alias("missing")).withColumn("side", F.lit("only_right"))
    return left.unionByName(right).select("side", "missing")


#: Rows up to which a side is broadcast; a larger one is exchanged.
BROADCAST_ROWS = 200_000


def small(df: DataFrame) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``BROADCAST_ROWS`` rows, else as it is."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


#: Rows of one task where tables of any size are exchanged.
TASK_ROWS = 250_000


def spread(df: DataFrame, *keys: str, rows: int = 0) -> DataFrame:
    """``df`` dealt by ``keys`` to a fixed number of tasks: those of an exchange, more for a table of many ``rows``.

    A fixed number is not merged by size, so that small rows with much work each keep all cores busy,
    and it grows with the table, so that a task's rows and memory do not. It is one more than that of an
    exchange: a union of parts dealt alike, of which only some are merged by size, would pass for dealt by key.
    """
    n = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // TASK_ROWS))
    return df.repartition(n + 1, *keys)


def gram_jaccard(a: DataFrame, b: DataFrame, a_id: str, b_id: str, grams: str, threshold: float) -> DataFrame:
    """(a_id, b_id, jaccard) of pairs at or above ``threshold``: an inverted index over distinct grams with a size filter.

    Sets whose sizes differ by more than the factor ``threshold`` cannot reach it: rows of ``b`` that fit
    no row of ``a`` are left out before their grams are made rows, other pairs before they are counted.
    The sets' sizes and the number of shared grams give the exact value. Rows without grams meet nothing.
    """
    distinct = F.explode(F.array(F.array_distinct(grams))).alias("g")  # a generator, so that filters do not repeat the expression
    x = a.select(F.col(a_id).alias("i"), distinct).withColumn("na", F.size("g"))
    y = b.select(F.col(b_id).alias("j"), distinct).withColumn("nb", F.size("g"))
    if threshold > 0:
        longest = x.agg(F.max("na")).first()[0] or 0
        y = y.filter(F.col("nb") * threshold <= longest + 1e-9)
    own = small(x.select("i", "na", F.explode("g").alias("gram")))
    met = y.select("j", "nb", F.explode("g").alias("gram")).join(own, "gram")
    fits = (F.col("nb") * threshold <= F.col("na") + 1e-9) & (F.col("na") * threshold <= F.col("nb") + 1e-9)
    shared = met.filter(fits).groupBy("i", "j", "na", "nb").agg(F.count(F.lit(1)).alias("m"))
    jaccard = F.col("m") / (F.col("na") + F.col("nb") - F.col("m"))
    return shared.select(F.col("i").alias(a_id), F.col("j").alias(b_id), jaccard.alias("jaccard")).filter(F.col("jaccard") >= threshold)


def containing(docs: DataFrame, items: DataFrame, doc_id: str, item_id: str, text: str) -> DataFrame:
    """(doc_id, item_id) of the items whose text stands in a document's text, by equal keys and a whole check.

    Between two blanks an item's words are words of the document too: the longest run of three of
    them is its key, met by the runs of three of each document. Items without three such words (few)
    are met by their first characters, 24 or as many as they have, at each position of a document.
    Null texts hold and match nothing, an empty text stands in every document; ids are distinct.
    """
    def runs(words: Column) -> Column:  # a generator binds the words for the lambda
        return F.transform(words, lambda w, k: F.concat_ws(" ", w, F.get(words, k + 1), F.get(words, k + 2)))

    words = F.explode(F.array(F.split(text, " ", -1))).alias("w")
    x = items.filter(F.col(text).isNotNull()).select(item_id, F.col(text).alias("item"), words)
    inner = F.slice(runs(F.col("w")), F.lit(2), F.size("w") - 4)
    longest = F.array_max(F.transform(inner, lambda r: F.struct(F.length(r).alias("n"), r.alias("key"))))
    keyed = x.filter("size(w) >= 5").select(item_id, longest["key"].alias("key"))
    known = docs.select(doc_id, words).filter("size(w) >= 3").select(doc_id, F.explode(F.array_distinct(runs(F.col("w")))).alias("key"))
    found = known.join(small(keyed), "key").select(doc_id, item_id)
    rest = x.filter("size(w) < 5").select(item_id, F.left("item", F.lit(24)).alias("key")).withColumn("n", F.length("key"))
    for (n,) in rest.select("n").distinct().collect():  # at most 25 lengths
        at = docs.select(doc_id, F.explode(F.array_distinct(char_grams(F.col(text), n))).alias("key"))
        found = found.unionByName(at.join(small(rest.filter(F.col("n") == n)), "key").select(doc_id, item_id))
    whole = docs.join(found.distinct(), doc_id).join(small(x.select(item_id, "item")), item_id)
    return whole.filter(F.col(text).contains(F.col("item"))).select(doc_id, item_id)


def counter_rollup(counters: DataFrame, keys: list[str]) -> DataFrame:
    """Sums of (ok, total) per key: partial sums before the exchange."""
    return counters.groupBy(*keys).agg(F.sum("ok").cast("long").alias("ok"), F.sum("total").cast("long").alias("total"))


def breakdown(rows: DataFrame, dims: dict[str, str], ok: Column, least_groups: int = 2) -> DataFrame:
    """(dim, value, ok, total) over each dimension apart; one with fewer groups is dropped.

    One pass: the dimensions are unpivoted and grouped together.
    """
    cells = F.array(*(F.struct(F.lit(n).alias("dim"), F.col(c).cast("string").alias("value")) for n, c in dims.items()))
    long = rows.select(ok.cast("long").alias("ok"), F.explode(cells).alias("cell")).select("ok", "cell.dim", "cell.value")
    groups = long.groupBy("dim", "value").agg(F.sum("ok").alias("ok"), F.count(F.lit(1)).alias("total"))
    return groups.withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy("dim"))).filter(F.col("__n") >= least_groups).drop("__n")


def even_sample(rows: DataFrame, order: str, k: int) -> DataFrame:
    """Every (n // k)-th row in order, k rows at most.

    The row number is the rows of earlier ranges plus the number inside the range, so no task holds all rows.
    """
    ranked = with_row_number(rows, order)
    n = rows.agg(F.count(F.lit(1)).alias("__n"))
    step = F.greatest(F.lit(1), F.floor(F.col("__n") / k))
    placed = ranked.join(F.broadcast(n))
    return placed.filter((F.col("row_number") % step == 0) & (F.col("row_number") / step < k)).drop("row_number", "__n")


def with_row_number(rows: DataFrame, order: str, buckets: int = 64) -> DataFrame:
    """``row_number`` from 0 by a unique order column, without one task over all rows.

    The column's quantiles cut the rows into ranges; a number is the rows of lower ranges plus the rank inside.
    """
    probs = [i / buckets for i in range(1, buckets)]
    cuts = [c for c in (rows.approxQuantile(order, probs, 1 / (4 * buckets)) if rows.schema[order].dataType.typeName() != "string" else [])]
    cut = F.array(*(F.lit(float(c)) for c in sorted(set(cuts)))) if cuts else F.array().cast("array<double>")
    ranged = rows.withColumn("__range", F.size(F.filter(cut, lambda c: c < F.col(order))))
    sizes = ranged.groupBy("__range").agg(F.count(F.lit(1)).alias("__size"))
    # at most `buckets` rows
    base = sizes.withColumn("__base", F.sum("__size").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))).drop("__size")
    inner = F.row_number().over(Window.partitionBy("__range").orderBy(order)) - 1
    numbered = ranged.withColumn("__inner", inner).join(F.broadcast(base), "__range")
    return numbered.withColumn("row_number", F.coalesce("__base", F.lit(0)) + F.col("__inner")).drop("__range", "__inner", "__base")
