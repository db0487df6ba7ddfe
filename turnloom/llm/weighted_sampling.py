"""Document fingerprints by consistent weighted sampling.

A text's terms are its lower-cased words, weighted by their number. Sample ``d`` of a term ``k`` of
weight ``S`` draws, from hashes of (k, d) alone, ``r`` and ``c`` by Gamma(2, 1) and ``b`` evenly from
(0, 1); with ``t = floor(ln S / r + b)`` the term's rank is ``ln c - r (t - b + 1)``, and the term
of least rank is the sample (k, t). Two texts agree in a sample with a probability equal to the
generalised Jaccard similarity of their weights, the sum of lesser over the sum of greater weights.

The draws do not depend on the weight; a word of one weight in a document and in its edited form is drawn once. Terms are rows,
a row makes a few samples at a time, and a sample is one long: the rank in fixed point above 32 bits
of the hash of (k, t), so that plain ``min`` aggregates in generated code find it. Documents are dealt
to ranges of ids once; every later step keeps that partitioning. Only DataFrame and SQL functions
are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import tasks

SAMPLES = 36
#: Samples made by one row of the term table; more would make methods too long for the JVM's compiler.
LANES = 3
_HEX = 4  # hexadecimal digits of a sample in a fingerprint


def _bits(h: Column, at: int, n: int) -> Column:
    return F.shiftrightunsigned(h, at).bitwiseAND(F.lit((1 << n) - 1).cast("long"))


def _unit(h: Column, at: int, n: int) -> Column:
    """``n`` bits of a hash as a number above 0 and below 1."""
    return (_bits(h, at, n) + F.lit(0.5)) * F.lit(1.0 / (1 << n))


def _draws(a: Column, b: Column) -> list[Column]:
    """``r``, ``ln c`` and ``b`` of a sample from two hashes of its term and number."""
    return [-F.log(_unit(a, 0, 32) * _unit(a, 32, 32)), F.log(-F.log(_unit(b, 0, 20) * _unit(b, 20, 20))), _unit(b, 40, 24)]


def _sample(hash_: Column, t: Column, r: Column, log_c: Column, beta: Column) -> Column:
    """The sample as one long: its rank in fixed point above 32 bits that tell (k, t)."""
    rank = ((log_c - r * (t - beta + 1.0) + 128.0) * float(1 << 22)).cast("long")
    return F.shiftleft(rank, 32).bitwiseOR((hash_ + t * F.lit(0x9E3779B1).cast("long")).bitwiseAND(F.lit(0xFFFFFFFF).cast("long")))


def likeness(a: Column, b: Column) -> Column:
    """The share of equal samples of two sample arrays; of two texts without terms 1, of one 0."""
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda v: v))
    return F.when(F.size(a) != F.size(b), 0.0).when(F.size(a) == 0, 1.0).otherwise(same / F.size(a))


def fingerprint_text(samples: Column) -> Column:
    """A fingerprint as hexadecimal text, ``_HEX`` digits a sample; empty without terms."""
    return F.array_join(F.transform(samples, lambda v: F.lower(F.lpad(F.hex(v), _HEX, "0"))), "")


def _bounds(docs: DataFrame, id_col: str, parts: int) -> list[int]:
    """Ids that part the rows into about ``parts`` ranges; at most ``parts`` numbers, from a scan of the ids."""
    cuts = [k / parts for k in range(1, parts)]
    found = docs.select(F.percentile_approx(F.col(f"`{id_col}`").cast("long"), cuts, F.lit(max(10_000, 20 * parts))).alias("q")).first().q
    return sorted(set(found or []))


def _range_of(id_: Column, bounds: list[int]) -> Column:
    """The number of ``bounds`` at or below an id, by halving; 0 for a null id."""
    if not bounds:
        return F.lit(0)
    steps = [1 << k for k in range(len(bounds).bit_length() - 1, -1, -1)]
    known = F.lit(bounds)
    found = F.aggregate(F.lit(steps), F.lit(0), lambda low, s: F.when((low + s <= len(bounds)) & (F.get(known, low + s - 1) <= id_), low + s).otherwise(low))
    return F.coalesce(found, F.lit(0))


def _beside_next(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(part, place, guest, id, text, after): rows in ranges of ids, each with the next row's text.

    A range's first row is also a guest at the end of the range before it, the first row of all at
    the end of the last. The ranges' first ids are gathered: one number a range.
    """
    parts = 4 * tasks(docs.sparkSession)
    bounds = _bounds(docs, id_col, parts)
    id_ = F.col(f"`{id_col}`").cast("long")
    part = _range_of(id_, bounds)
    first = F.min(F.struct(F.col("id").isNotNull(), "id")).alias("h")
    heads = {r.part: r.id for r in docs.select(part.alias("part"), id_.alias("id")).groupBy("part").agg(first).select("part", "h.id").collect()}
    order = sorted(heads)
    host = {p: order[k - 1] for k, p in enumerate(order)}  # the first range's head goes to the last
    every = range(len(bounds) + 1)
    head, home = F.array(*(F.lit(heads.get(p)).cast("long") for p in every)), F.array(*(F.lit(host.get(p, 0)) for p in every))
    rows = docs.select(part.alias("own"), id_.alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    seats = F.array(F.struct(F.col("own").alias("part"), F.lit(0).alias("guest")))
    also = F.array(F.struct(F.get(home, "own").alias("part"), F.lit(1).alias("guest")))
    dealt = rows.select(F.inline(F.when(F.get(head, "own").eqNullSafe(F.col("id")), F.concat(seats, also)).otherwise(seats)), "id", "text")
    placed = dealt.repartition("part")
    line = Window.partitionBy("part").orderBy("guest", "id", "text")
    return placed.select("part", F.row_number().over(line).alias("place"), "guest", "id", "text", F.lead("text").over(line).alias("after"))


def _longs(sha: Column) -> list[Column]:
    """A hexadecimal SHA-256 as four longs."""
    return [F.conv(F.substring(sha, 16 * k + 1, 16), 16, -10).cast("long") for k in range(4)]


def weighted_fingerprints(docs: DataFrame, samples: int = SAMPLES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text is the text with its last ``floor(n_chars / 2)`` code points replaced by the
    first as many (or all) of the next document's, ascending id; the last row's next is the first.
    Null ids come first; rows of equal id follow each other by text. ``near_edited`` and ``near_next``
    are the likeness of the text's samples to the edited text's and to the next text's. A null text
    counts as empty; a text without words has an empty fingerprint, which is like an empty one (1)
    and unlike any other (0). Texts with the same words in the same numbers have equal fingerprints.
    Repeated rows stay; other columns are ignored; an empty table gives an empty result. ``samples``
    is a multiple of 3; rows of one id are one range.
    """
    if samples % LANES:
        raise ValueError(f"samples must be a multiple of {LANES}")
    rows = _beside_next(docs, id_col, text_col)
    edited = F.concat(F.expr("left(text, length(text) - int(length(text) div 2))"), F.expr("left(coalesce(after, ''), int(length(text) div 2))"))
    rows = rows.withColumn("edited", F.when(F.col("guest") == 0, edited))

    # word rows (kind 0) of both forms; a document's own values travel as rows of other kinds, so that all columns are longs
    own = F.concat(F.array("id", "guest", F.length("text")), F.array(*_longs(F.sha2("edited", 256)))).cast("array<bigint>")
    forms = F.array(F.struct(F.lit(0).alias("form"), F.col("text").alias("of")), F.struct(F.lit(1).alias("form"), F.col("edited").alias("of")))
    split = rows.select("part", "place", own.alias("own"), F.inline(forms))
    words = r"array_remove(split(lower(coalesce(of, '')), '\\s+'), '')"
    entries = F.expr(f"concat(transform({words}, w -> struct(0L AS kind, xxhash64(w) AS term)), IF(form = 0, transform(own, (v, k) -> struct(k + 1L AS kind, v AS term)), array()))")
    flat = split.select("part", "place", "form", F.inline(entries))
    weighed = flat.groupBy("part", "place", "kind", "term").agg(F.sum(1 - F.col("form")).alias("weight"), F.sum("form").alias("edited_weight"))

    # side 2: a word of the same weight in both forms, drawn once; 0 and 1: of one form or of this weight in one
    sides = weighed.select("*", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("side"))
    equal, of_side = F.col("weight") == F.col("edited_weight"), F.when(F.col("side") == 1, F.col("edited_weight")).otherwise(F.col("weight"))
    sides = sides.filter((equal == (F.col("side") == 2)) & (of_side > 0)).withColumn("log_weight", F.log(of_side.cast("double")))
    lanes_of = F.when(F.col("kind") == 0, F.sequence(F.lit(0), F.lit(samples // LANES - 1))).otherwise(F.array(F.lit(0)))
    rows = sides.select("part", "place", "side", "kind", "term", "log_weight", F.explode(lanes_of).alias("lane"))
    named, each = ["part", "place", "side", "lane", "kind", "term"], range(LANES)
    number = [F.col("lane") * (2 * LANES) + k for k in range(2 * LANES)]
    rows = rows.select(*named, "log_weight", *(F.xxhash64("term", number[2 * k + i]).alias(f"{x}{k}") for k in each for i, x in enumerate("gh")))
    draws = [d.alias(f"{x}{k}") for k in each for d, x in zip(_draws(F.col(f"g{k}"), F.col(f"h{k}")), "rcu", strict=True)]
    rows = rows.select(*named, "log_weight", *(f"g{k}" for k in each), *draws)
    turns = [F.floor(F.col("log_weight") / F.col(f"r{k}") + F.col(f"u{k}")).alias(f"t{k}") for k in each]
    rows = rows.select(*named, *(f"{x}{k}" for k in each for x in "grcu"), *turns)
    rows = rows.select(*named, *(F.when(F.col("kind") == 0, _sample(*(F.col(f"{x}{k}") for x in "gtrcu"))).alias(f"s{k}") for k in each))
    # a document's own values are rows of their own kinds, without samples
    lanes = rows.groupBy("part", "place", "side", "lane").agg(*(F.min(f"s{k}").alias(f"s{k}") for k in each), *(F.max(F.when(F.col("kind") == k + 1, F.col("term"))).alias(f"v{k}") for k in range(7)))

    def least(side: int, k: int) -> Column:
        found = F.min(F.when(F.col("side").isin(side, 2), F.col(f"s{k}")))
        return found.bitwiseAND(F.lit((1 << 4 * _HEX) - 1).cast("long")).cast("int")

    both = lanes.groupBy("part", "place", "lane").agg(F.array(*(least(0, k) for k in each)).alias("a"), F.array(*(least(1, k) for k in each)).alias("b"), *(F.max(f"v{k}").alias(f"v{k}") for k in range(7)))
    whole = both.groupBy("part", "place").agg(F.array_sort(F.collect_list(F.struct("lane", "a", "b"))).alias("s"), *(F.max(f"v{k}").alias(f"v{k}") for k in range(7)))
    one = whole.select("part", "place", *(f"v{k}" for k in range(7)), *(F.expr(f"filter(flatten(s.{c}), x -> x IS NOT NULL)").alias(c) for c in "ab"))
    line = Window.partitionBy("part").orderBy("place")
    met = one.withColumn("next", F.lead("a").over(line)).filter("v1 = 0")
    sha = F.concat(*(F.lower(F.lpad(F.hex(f"v{k}"), 16, "0")) for k in range(3, 7)))
    return met.select(
        F.col("v0").alias("doc_id"),
        F.col("v2").alias("n_chars"),
        sha.alias("edited_sha256"),
        fingerprint_text(F.col("a")).alias("fingerprint"),
        fingerprint_text(F.col("b")).alias("edited_fingerprint"),
        likeness(F.col("a"), F.col("b")).alias("near_edited"),
        likeness(F.col("a"), F.coalesce("next", F.array().cast("array<int>"))).alias("near_next"),
    )
