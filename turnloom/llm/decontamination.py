"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact check.

A document holds an item if some window as long as the item (in words) has a weighted Jaccard
similarity of ``similarity`` or more with it, over five-word shingles weighted by their number.

1. Windows that cannot reach the similarity are not fingerprinted: an item of n shingles needs at
   least ``ceil(2 n s / (1 + s))`` of a window's shingles to occur in items of its length, and a
   window may begin at its first such shingle without losing any. This loses no match.
2. Each remaining window gets a 64-bit SimHash and meets the items of its length in one of
   ``radius + 1`` blocks; by the pigeonhole principle no fingerprint within the radius is missed.
3. Pairs within the radius are verified by the exact similarity.

Only DataFrame and SQL functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, lane_sums, majority_bits, private_names

SHINGLE = 5
SIMILARITY = 0.8
RADIUS = 20
#: Rows of the item tables up to which they are sent to all executors; more are joined by exchange.
BROADCAST_ROWS = 200_000


def _shingles(text: str, size: str | int, most: int = SHINGLE) -> Column:
    """Hashes of a text's runs of ``size`` words (at most ``most``), in order; empty if it has fewer words.

    The lambda variable keeps the word hashes from being worked out again for every run: the
    optimiser copies an expression, but not a variable, to where it is used.
    """
    words = rf"transform(array_remove(split(lower(coalesce({text}, '')), '\\s+'), ''), v -> xxhash64(v))"
    runs = {k: f"transform(sequence(0, size(w) - {k}), i -> xxhash64({', '.join(f'get(w, i + {d})' for d in range(k))}))" for k in range(1, most + 1)}
    cases = " ".join(f"WHEN {size} = {k} AND size(w) >= {k} THEN {run}" for k, run in runs.items())
    body = cases if isinstance(size, str) else f"WHEN size(w) >= {size} THEN {runs[size]}"
    return F.expr(f"element_at(transform(array({words}), w -> CASE {body} ELSE array() END), 1)").cast("array<bigint>")


def _n_words(text: str) -> Column:
    return F.expr(rf"size(array_remove(split(lower(coalesce({text}, '')), '\\s+'), ''))")


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def _benchmark_items(benchmark: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """(item_id, n_words, shingle size, shingles) of the items with a word."""
    rows = benchmark.select(F.col(item_col).alias("item_id"), F.col(text_col).alias("item_text")).withColumn("n_words", _n_words("item_text"))
    sized = rows.filter("n_words > 0").withColumn("k", F.least(F.lit(SHINGLE), F.col("n_words")))
    return sized.select("item_id", "n_words", "k", _shingles("item_text", "k").alias("item"))


def _document_hashes(docs: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    """(id, digest, h): shingle hashes of ``k`` words; rows of the same id and text are one document."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("digest"), _shingles(f"`{text_col}`", k).alias("h"))


def _windows(docs: DataFrame, items: DataFrame, rows: int, similarity: float, k: int, id_col: str, text_col: str) -> DataFrame:
    """(id, digest, n_words, start, before, window): windows that may hold an item.

    ``window`` is its shingle hashes, ``before`` as many or fewer ahead of it.
    """
    hashes = _document_hashes(docs, id_col, text_col, k)
    known = items.select("n_words", F.explode("item").alias("g")).distinct()
    anchors = hashes.select("id", "digest", F.size("h").alias("n"), F.posexplode_outer("h").alias("pos", "g")).join(_small(known, rows), "g")
    # the positions of one document that occur in items of one length
    per = anchors.groupBy("id", "digest", "n", "n_words").agg(F.array_sort(F.collect_set("pos")).alias("p"))
    per = per.withColumn("size", F.col("n_words") - k + 1)
    need = F.ceil(F.col("size") * (2 * similarity / (1 + similarity)) - 1e-9).cast("int")
    per = per.withColumn("need", need)
    # a document shorter than the item is one window; it must then hold the similarity's share of the item
    short = F.expr(f"n < size AND n >= size * {similarity} - 1e-9 AND size(p) >= size * {similarity} - 1e-9")
    dense = F.expr(
        "CASE WHEN n < size OR size(p) < need THEN array() ELSE array_distinct(transform("
        "filter(sequence(1, size(p) - need + 1), r -> get(p, r + need - 2) - get(p, r - 1) < size),"
        " r -> least(get(p, r - 1), n - size))) END"
    ).cast("array<int>")
    starts = per.select("id", "digest", "n_words", "size", F.explode(F.when(short, F.array(F.lit(0))).otherwise(dense)).alias("start"))
    starts = checkpointed(starts)
    wanted = starts.select("id", "digest").distinct().select(F.col("id").alias("w_id"), F.col("digest").alias("w_digest"))
    of_doc = F.col("id").eqNullSafe(F.col("w_id")) & (F.col("digest") == F.col("w_digest"))
    # the text is hashed again for the few documents left, after the join
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("digest"), F.col(text_col).alias("text"))
    found = texts.join(wanted, of_doc, "left_semi").dropDuplicates(["id", "digest"])
    found = found.select(F.col("id").alias("w_id"), F.col("digest").alias("w_digest"), _shingles("text", k).alias("h"))
    return starts.join(found, of_doc).select("id", "digest", "n_words", "start", F.expr("slice(h, greatest(start - size + 1, 0) + 1, least(start, size - 1))").alias("before"), F.expr("slice(h, start + 1, size)").alias("window"))


def _fingerprint(rows: DataFrame, keys: list[str], array: str) -> DataFrame:
    """``keys`` and ``fp``, the SimHash of an array of hashes."""
    lanes = rows.select(*keys, F.explode(array).alias("h")).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *lane_sums(F.col("h")))
    return lanes.select(*keys, majority_bits(F.col("n")).alias("fp"))


def _blocks(radius: int) -> Column:
    """One (block, bits) for each of radius + 1 blocks of a 64-bit fingerprint."""
    cuts = [64 * b // (radius + 1) for b in range(radius + 2)]
    parts = []
    for b, (low, high) in enumerate(zip(cuts, cuts[1:], strict=False)):
        bits = F.shiftrightunsigned("fp", low).bitwiseAND(F.lit((1 << (high - low)) - 1).cast("long"))
        parts.append(F.struct(F.lit(b).alias("block"), bits.alias("bits")))
    return F.explode(F.array(*parts))


def _shared_weight(a: str, b: str) -> str:
    """The weighted overlap of two hash arrays: the sum of the lesser counts."""
    counted = f"aggregate(array_intersect({a}, {b}), 0, (s, g) -> s + least(size(filter({a}, x -> x = g)), size(filter({b}, x -> x = g))))"
    plain = f"size(array_distinct({a})) = size({a}) OR size(array_distinct({b})) = size({b})"
    return f"CASE WHEN {plain} THEN size(array_intersect({a}, {b})) ELSE {counted} END"


def benchmark_matches(
    docs: DataFrame,
    benchmark: DataFrame,
    similarity: float = SIMILARITY,
    radius: int = RADIUS,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """(doc_id, digest, item_id, start, n_words, similarity): the best window of each document and item.

    ``digest`` is the hash of the document's text and tells rows of the same id apart; ``start``
    counts words from 0; of equal windows the first is given. Words are split at white space and
    lower-cased. An item of fewer than five words is one shingle and matches where its words occur
    in a row. Items or documents that are null or without words match nothing. Repeated rows of a
    document or item give one row. A radius of 20 of 64 bits is over three standard deviations above
    the distance expected at the similarity of 0.8.
    """
    items = checkpointed(_benchmark_items(benchmark, item_col, item_text_col).dropDuplicates(["item_id", "item"]))
    sizes = {r.k: r.n for r in items.groupBy("k").agg(F.sum(F.size("item")).alias("n")).collect()}  # at most five rows
    out = None
    for k, rows in sorted(sizes.items()):
        # worked out, without a filter: over a filtered scan Spark makes runtime filters for the joins below, whose megabytes
        # go into the closures of all later stages, copied in the driver each time
        mine = checkpointed(items.filter(F.col("k") == k))
        windows = checkpointed(_windows(docs, mine, rows, similarity, k, id_col, text_col))
        keys = ["id", "digest", "n_words", "start"]
        prints = _fingerprint(windows, keys, "window")
        item_prints = _fingerprint(mine.withColumn("hash", F.xxhash64("item")), ["item_id", "hash", "n_words"], "item").select(
            "item_id", "hash", "n_words", F.col("fp").alias("item_fp"), _blocks(radius).alias("cell")
        )
        item_prints = checkpointed(item_prints)
        cells = prints.select(*keys, "fp", _blocks(radius).alias("cell"))
        near = cells.join(_small(item_prints, rows * (radius + 1)), ["n_words", "cell"]).withColumn("distance", F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))))
        near = near.filter(F.col("distance") <= radius).select(*keys, "item_id", "hash").distinct()
        pairs = near.alias("n").join(
            windows.alias("w"),
            F.col("n.id").eqNullSafe(F.col("w.id"))
            & (F.col("n.digest") == F.col("w.digest"))
            & (F.col("n.n_words") == F.col("w.n_words"))
            & (F.col("n.start") == F.col("w.start")),
        )
        known = _small(mine.select(F.col("item_id").alias("i"), F.xxhash64("item").alias("i_hash"), "item"), rows)
        pairs = pairs.join(known, F.col("n.item_id").eqNullSafe(F.col("i")) & (F.col("n.hash") == F.col("i_hash")))
        scored = pairs.select("n.id", "n.digest", "n.item_id", "n.start", "n.n_words", "before", "window", "item").withColumn("m", F.expr(_shared_weight("window", "item")))
        scored = scored.withColumn("similarity", F.col("m") / (F.size("window") + F.size("item") - F.col("m"))).filter(F.col("similarity") >= similarity - 1e-12)
        best = scored.groupBy("id", "digest", "item_id").agg(F.min(F.struct((-F.col("similarity")).alias("s"), "start", "n_words", "m", "before", "window", "item")).alias("b"))
        # windows are only begun where a shingle is known; an earlier one may be as similar
        moved = _shared_weight("slice(x, size(x) - size(b.window) - d + 1, size(b.window))", "b.item")
        back = F.expr(f"element_at(transform(array(concat(b.before, b.window)), x -> array_max(filter(sequence(0, size(b.before)), d -> {moved} = b.m))), 1)")
        part = best.select(F.col("id").alias("doc_id"), "digest", "item_id", (F.col("b.start") - back).alias("start"), "b.n_words", (-F.col("b.s")).alias("similarity"))
        out = part if out is None else out.unionByName(part)
    if out is None:
        schema = "doc_id long, digest long, item_id long, start int, n_words int, similarity double"
        return docs.sparkSession.createDataFrame([], schema)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, all columns whatever their names, whose text holds no item of ``benchmark``.

    Null and empty texts hold none and stay; repeated rows go or stay together; whole texts are
    searched. Without items all rows stay.
    """
    own_id, own_digest = private_names(docs, "id", "digest")
    found = checkpointed(benchmark_matches(docs, benchmark, id_col=id_col, text_col=text_col, **options).select("doc_id", "digest").distinct())
    found = found.select(F.col("doc_id").alias(own_id), F.col("digest").alias(own_digest))
    same = F.col(f"`{id_col}`").cast("long").eqNullSafe(F.col(own_id)) & (F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))) == F.col(own_digest))
    return docs.join(found, same, "left_anti")
