"""SimHash near-duplicates through a byte-position inverted index with count filtering.

A fingerprint of ``8 * words`` bytes is indexed by its positional bytes. A posting of one byte
holds a 256th of all fingerprints, so pairs drawn from such lists grow with the square of the
input; the index therefore keys several positional bytes at once (a table). The equal positional
bytes of a pair met in any table are then tallied, pairs below the guaranteed minimum go, and the
rest are verified.

Two profiles:

* ``EXACT``: 64 bits, radius 2. Two bits touch at most two bytes, so at least six of eight bytes
  agree and, of four two-byte blocks, at least two: the six block pairs find every pair.
* ``SIMILAR``: 256 bits and 32 tables of three bytes, for five-word shingles at Jaccard 0.8 or
  more. SimHash distances spread, so no radius that can be indexed holds every pair at 0.8. What
  this index leaves apart is therefore searched once more without loss (``_completed``): two sets
  of similarity 0.8 share a shingle among the first fifth of each in any common order.

A posting above the profile's limit of members is never paired: see ``_crowded_exact`` and ``_star_pairs``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import combinations
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import HEAVY_ROWS, PARTS, checkpointed, private_names, spread_join
from .graph import connected_components

BLOCK_WORDS = 1 << 16
#: Counters of the shingle sketch: a fixed size, whatever the input.
SKETCH = 1 << 19
SKETCH_SLICES = 64
_PARITY = ("p0", "p1", "p2", "p3")
#: Rows of a key list (at most 40 bytes each) up to which it is broadcast; more are joined by exchange.
BROADCAST_ROWS = 500_000


@dataclass(frozen=True)
class Profile:
    shingle: int
    words: int  # 64-bit words of a fingerprint
    tables: tuple[tuple[int, ...], ...]  # byte positions keyed together
    radius: int  # differing bits of a link (EXACT) or of a pair worth verifying (SIMILAR)
    similarity: float | None  # Jaccard of distinct shingles that a link needs, None: the radius decides
    posting: int = 32  # members up to which a posting is paired

    @property
    def guaranteed(self) -> int:
        """Positional bytes that a pair within the radius, or met in a table, shares at least."""
        return max(8 * self.words - self.radius, min(map(len, self.tables)))


def _cyclic_triples(size: int, differences: tuple[tuple[int, int], ...]) -> tuple[tuple[int, ...], ...]:
    """Triples (i, i + a, i + a + b) modulo size for each i and each (a, b)."""
    return tuple(tuple(sorted((i, (i + a) % size, (i + a + b) % size))) for a, b in differences for i in range(size))


#: The differences between the bytes of a table each occur once: two bytes stand together in at most
#: one table, which makes the tables' misses as independent as they can be.
DIFFERENCES = ((1, 2),)
EXACT = Profile(3, 1, tuple((2 * a, 2 * a + 1, 2 * b, 2 * b + 1) for a, b in combinations(range(4), 2)), 2, None)
SIMILAR = Profile(5, 4, _cyclic_triples(32, DIFFERENCES), 56, 0.8, posting=8)


def shingle_hashes(text: bytes | None, size: int) -> list[int]:
    """Unsigned XXH64 (seed 42) of the word shingles, repeats included; A-Z lower-cased."""
    from xxhash import xxh64_intdigest

    words = (text or b"").lower().split()
    if not words:
        return []
    if len(words) <= size:
        return [xxh64_intdigest(b" ".join(words), 42)]
    runs = zip(*(words[k:] for k in range(size)), strict=False)
    return [xxh64_intdigest(x, 42) for x in map(b" ".join, runs)]


def fingerprint(hashes: Any, words: int) -> list[int]:
    """Signed 64-bit words; bit k is set if set in over half the hashes. No hash: zeros."""
    import numpy as np

    counts = np.zeros((words, 64), dtype=np.int64)
    for at in range(0, len(hashes), BLOCK_WORDS):
        h = np.array(hashes[at : at + BLOCK_WORDS], dtype=np.uint64)
        for k in range(words):
            if k:  # further words: the splitmix64 finaliser of the hash and the word's number
                h = h + np.uint64(0x9E3779B97F4A7C15)
                x = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
                x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
                x = x ^ (x >> np.uint64(31))
            else:
                x = h
            bits = np.unpackbits(x.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            counts[k] += bits.sum(axis=0, dtype=np.int64)
    packed = np.packbits((counts * 2 > len(hashes)).astype(np.uint8), axis=1, bitorder="little")
    return packed.view("<i8").ravel().tolist()


def fingerprints(docs: DataFrame, profile: Profile, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, key, f0, f1, ..., slice, sketch) of every row, without an exchange.

    ``key`` is shared by documents that need no comparison: those of equal fingerprints where the
    radius alone decides, else of equal texts (their MD5). Where a similarity decides, each task adds
    rows with ``slice`` and ``sketch``, its counts of shingles by the low bits of their hash.
    """
    similar = profile.similarity is not None
    names = ["doc_id", "key", *_words(profile), "slice", "sketch"]
    types = [pa.int64(), pa.binary(), *[pa.int64()] * profile.words, pa.int32(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import zstandard as z

        counts = np.zeros(SKETCH, dtype=np.int64) if similar else None
        for b in batches:
            prints = []
            for t in b.column(2):  # a batch's hashes would take many times its texts
                h = np.array(shingle_hashes(t.as_py(), profile.shingle), dtype=np.uint64)
                if similar:  # of the sets that the verification compares
                    h = np.unique(h)
                    np.add.at(counts, h & np.uint64(SKETCH - 1), 1)
                prints.append(fingerprint(h, profile.words))
            words = [pa.array([p[k] for p in prints], pa.int64()) for k in range(profile.words)]
            none = [pa.nulls(b.num_rows, t) for t in types[-2:]]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *words, *none], names)
        if similar and counts.any():
            parts = [z.compress(p.tobytes(), 1) for p in np.split(counts, SKETCH_SLICES)]
            blank = [pa.nulls(SKETCH_SLICES, t) for t in types[:-2]]
            yield pa.RecordBatch.from_arrays([*blank, pa.array(range(SKETCH_SLICES), pa.int32()), pa.array(parts)], names)

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), _text_key(text_col, similar), _text(text_col).alias("text"))
    out = rows.mapInArrow(run, "doc_id long, key binary, " + ", ".join(f"f{k} long" for k in range(profile.words)) + ", slice int, sketch binary")
    return out if similar else out.withColumn("key", F.unhex(F.lpad(F.hex("f0"), 16, "0")))


def _text(text_col: str) -> Column:
    return F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary")


def _text_key(text_col: str, similar: bool = True) -> Column:
    return (F.unhex(F.md5(_text(text_col))) if similar else F.lit(None).cast("binary")).alias("key")


def _byte(position: int, prefix: str = "") -> Column:
    return F.shiftrightunsigned(F.col(f"{prefix}f{position // 8}"), 8 * (position % 8)).bitwiseAND(F.lit(255).cast("long"))


def _long_enough(profile: Profile, nodes: int) -> tuple[tuple[int, ...], ...]:
    """The profile's tables, with further bytes until fewer than one other node shares a key by chance.

    Only where a similarity decides, as ``_completed`` finds what longer keys miss.
    """
    tables = profile.tables
    while profile.similarity is not None and len(tables[0]) < 7 and 256 ** len(tables[0]) < nodes:
        free = [[p % (8 * profile.words) for p in range(t[-1] + 7, t[-1] + 7 + 8 * profile.words) if p % (8 * profile.words) not in t] for t in tables]
        tables = tuple((*t, f[0]) for t, f in zip(tables, free, strict=True))
    return tables


def _postings(nodes: DataFrame, profile: Profile) -> DataFrame:
    """One row per node and table, with the number of nodes under its key, of keys with several nodes."""
    keys = []
    for k, positions in enumerate(_long_enough(profile, nodes.count())):
        key = F.lit(k).cast("long")
        for p in positions:
            key = F.shiftleft(key, 8).bitwiseOR(_byte(p))
        keys.append(key)
    rows = nodes.select("node", *_words(profile), F.explode(F.array(*keys)).alias("key"))
    # bare keys are counted first, so that the fingerprints of lone nodes are not exchanged
    shared = checkpointed(nodes.select(F.explode(F.array(*keys)).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("members")).filter("members > 1"))
    return rows.join(_small(shared), "key")


def _small(keys: DataFrame) -> DataFrame:
    """Marked for a broadcast if the checkpointed rows are few."""
    return F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys


def _words(profile: Profile, prefix: str = "") -> list[str]:
    return [f"{prefix}f{k}" for k in range(profile.words)]


def _shared_bytes(profile: Profile) -> Column:
    return reduce(lambda x, y: x + y, ((_byte(p, "a_") == _byte(p, "b_")).cast("int") for p in range(8 * profile.words)))


def _distance(profile: Profile) -> Column:
    return reduce(lambda x, y: x + y, (F.bit_count(F.col(f"a_f{k}").bitwiseXOR(F.col(f"b_f{k}"))) for k in range(profile.words)))


def _near(profile: Profile) -> Column:
    """The count filter and the radius."""
    return (_shared_bytes(profile) >= profile.guaranteed) & (_distance(profile) <= profile.radius)


def _side(rows: DataFrame, prefix: str, profile: Profile) -> DataFrame:
    return rows.select("key", *(F.col(c).alias(prefix + c) for c in ("node", *_words(profile))))


def _crowded_exact(crowded: DataFrame) -> DataFrame:
    """Links between members of crowded postings at radius 2, none lost and no pairs drawn.

    Two fingerprints differ in at most two bits exactly if some value is within one bit of both.
    Under each such value stand at most 65 fingerprints, all within two bits of each other: each
    is linked to the least of them.
    """
    members = crowded.select("node", "f0").distinct()
    near = F.expr("concat(array(f0), transform(sequence(0, 63), b -> f0 ^ shiftleft(1L, b)))")
    meets = members.select("node", F.explode(near).alias("value"))
    least = meets.groupBy("value").agg(F.min("node").alias("b"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    return meets.join(least, "value").filter("node <> b").select(F.col("node").alias("a"), "b")


def _star_pairs(crowded: DataFrame, profile: Profile) -> DataFrame:
    """Each member of a crowded posting with the posting's least member (its hub)."""
    hubs = crowded.groupBy("key").agg(F.min(F.struct("node", *_words(profile))).alias("hub"))
    hubs = hubs.select("key", F.col("hub.node").alias("b_node"), *(F.col(f"hub.f{k}").alias(f"b_f{k}") for k in range(profile.words)))
    return _near_pairs(spread_join(_side(crowded, "a_", profile), hubs, "key"), profile)


def _near_pairs(met: DataFrame, profile: Profile) -> DataFrame:
    """(a, b) of a join of two sides, by the count filter and the radius."""
    near = met.filter((F.col("a_node") != F.col("b_node")) & _near(profile))
    return near.select(F.least("a_node", "b_node").alias("a"), F.greatest("a_node", "b_node").alias("b"))


def _shingle_sets(docs: DataFrame, wanted: DataFrame, profile: Profile, text_col: str, id_col: str) -> DataFrame:
    """(node, shingles) of the ``wanted`` nodes (key, node, first_id), from one text of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for b in batches:
            sets = []
            for t in b.column(1):
                h = np.unique(np.array(shingle_hashes(t.as_py(), profile.shingle), dtype=np.uint64))
                sets.append(h.view(np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.list_(pa.int64()))], ["node", "shingles"])

    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), _text_key(text_col), _text(text_col).alias("text"))
    # few of the texts are wanted: a short list goes to them, a long one makes them travel
    asked = _small(checkpointed(wanted.select(F.col("key").alias("asked"), "first_id", "node")))
    found = texts.join(asked, (F.col("key") == F.col("asked")) & F.col("doc_id").eqNullSafe(F.col("first_id")))
    return checkpointed(found.select("node", "text").mapInArrow(run, "node long, shingles array<long>").dropDuplicates(["node"]))


def _verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, profile: Profile, text_col: str, id_col: str) -> DataFrame:
    """The pairs (a, b) whose distinct shingles have the profile's Jaccard similarity."""
    pairs = checkpointed(pairs.distinct())
    met = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    sets = _shingle_sets(docs, nodes.select("key", "node", "first_id").join(met, "node", "left_semi"), profile, text_col, id_col)
    both = spread_join(pairs, sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), "a")
    # the heavy keys of the second side are found in the pairs, not in the rows that carry sets
    both = spread_join(both, sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb")), "b", keys=pairs)
    shared = F.size(F.array_intersect("sa", "sb"))
    # no word at all: equal to each other
    union = F.greatest(F.size("sa") + F.size("sb") - shared, F.lit(1))
    alike = ((F.size("sa") == 0) & (F.size("sb") == 0)) | (shared / union >= profile.similarity - 1e-12)
    return checkpointed(both.filter(alike).select("a", "b"))


def _sketch(table: DataFrame) -> Any:
    """The summed shingle counts of all tasks: ``SKETCH`` numbers, added up slice by slice in tasks."""
    import numpy as np

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import zstandard as z

        sums: dict[int, Any] = {}
        for b in batches:
            for k, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
                part = np.frombuffer(z.decompress(data), dtype=np.int64)
                sums[k] = sums[k] + part if k in sums else part
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([v.tobytes() for v in sums.values()])], ["slice", "sketch"])

    parts = table.filter("slice is not null").select("slice", "sketch").repartition("slice").mapInArrow(add, "slice int, sketch binary").collect()
    counts = np.zeros((SKETCH_SLICES, SKETCH // SKETCH_SLICES), dtype=np.int64)
    for p in parts:
        counts[p.slice] = np.frombuffer(p.sketch, dtype=np.int64)
    return np.minimum(counts.ravel(), 2**32 - 1).astype(np.uint32)


def _prefixes(docs: DataFrame, counts: Any, profile: Profile, text_col: str) -> DataFrame:
    """(key, size, prefix, p0..p3): the shingles of each text that any similar text must share one of.

    Shingles are ordered by their count in the sketch, the rarest first, then by hash. Any order that
    all texts share loses no pair, so the sketch's errors cost time only. Of equal texts a task gives
    one. A text without words has the one shingle 0. ``p0``.. are the parities of the shingles' counts
    in 256 cells: two texts differ in at most as many cells as there are shingles in one of them only.
    """
    shared = docs.sparkSession.sparkContext.broadcast(counts)  # SKETCH numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from math import ceil

        import numpy as np

        counts, seen = shared.value, set()
        for b in batches:
            out: list[tuple] = []
            for key, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if key in seen:
                    continue
                seen.add(key)
                h = np.unique(np.array(shingle_hashes(text.as_py(), profile.shingle), dtype=np.uint64))
                prefix = h[np.lexsort((h, counts[h & np.uint64(SKETCH - 1)]))][: len(h) - ceil(len(h) * profile.similarity - 1e-9) + 1]
                cells = np.bincount((h >> np.uint64(40) & np.uint64(255)).astype(np.int64), minlength=256) & 1
                parity = np.packbits(cells.astype(np.uint8), bitorder="little").view("<i8").tolist()
                out.append((key, len(h), prefix.copy().view(np.int64) if len(h) else np.zeros(1, dtype=np.int64), *parity))
            columns = list(zip(*out, strict=True)) or [[]] * 7
            types = (pa.binary(), pa.int32(), pa.list_(pa.int64()), *[pa.int64()] * 4)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["key", "size", "prefix", *_PARITY])

    return docs.select(_text_key(text_col), _text(text_col).alias("text")).mapInArrow(run, "key binary, size int, prefix array<long>, " + ", ".join(f"{p} long" for p in _PARITY))


def _completed(
    links: DataFrame, marked: DataFrame, nodes: DataFrame, docs: DataFrame, profile: Profile, text_col: str, id_col: str
) -> DataFrame:
    """(node, component) by ``links`` and those between their components, none of the similarity lost.

    Nodes of several components that share a prefix shingle are candidates. A posting of few such
    nodes is paired; a crowded one is first compared with its least node, and only what is then still
    in several components is paired.
    """
    comps = checkpointed(connected_components(links))
    least = F.coalesce("component", "node").alias("comp")
    placed = nodes.select("key", "node").join(comps, "node", "left").select("key", "node", least)
    texts = _prefixes(docs, _sketch(marked), profile, text_col).dropDuplicates(["key"]).join(placed, "key")
    texts = checkpointed(texts.select("node", "comp", "size", "prefix", *_PARITY))
    rows = texts.select("node", "comp", F.posexplode("prefix").alias("pos", "h"))
    # one exchange of counts, one of bare places; what a comparison needs joins only the places left
    longs = (F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min("node").alias("hub"), F.count(F.lit(1)).alias("members"))
    shared = checkpointed(rows.groupBy("h").agg(*longs).filter("lo < hi").select("h", "hub", "members"))
    n_rows = texts.agg(F.sum(F.size("prefix"))).first()[0] or 0
    heavy = [r.h for r in shared.filter((F.col("members") > HEAVY_ROWS) & (F.col("members") > n_rows / 10_000)).select("h").collect()]  # at most 10,000
    places = rows.select("h", "node", "pos")
    n_shared = shared.count()
    met = places.join(F.broadcast(shared), "h") if n_shared <= BROADCAST_ROWS else spread_join(places, shared, "h", heavy=heavy)
    members = checkpointed(met)
    facts = texts.select("node", "comp", "size", *_PARITY)
    own = ("comp", "node", "size", "pos", *_PARITY)
    few = checkpointed(members.filter(F.col("members") <= profile.posting).select("h", "node", "pos").join(facts, "node"))
    crowded = checkpointed(members.filter(F.col("members") > profile.posting).select("h", "node", "pos", "hub").join(facts, "node"))
    share = profile.similarity / (1 + profile.similarity)

    def side(rows: DataFrame, prefix: str, on: list[str]) -> DataFrame:
        return rows.select(*on, *(F.col(c).alias(f"{prefix}_{c}") for c in own))

    def comparable(met: DataFrame) -> DataFrame:
        """Pairs of two sides that no component joins and that can be similar as far as sizes,
        places in the order and parities tell; no similar pair fails all the shingles that it shares."""
        both = F.col("a_size") + F.col("b_size")
        apart = reduce(lambda x, y: x + y, (F.bit_count(F.col(f"a_{p}").bitwiseXOR(F.col(f"b_{p}"))) for p in _PARITY))
        fits = (
            (F.col("a_comp") != F.col("b_comp"))
            & (F.least(F.col("a_size") - F.col("a_pos"), F.col("b_size") - F.col("b_pos")) >= both * share - 1e-9)
            & (apart <= both * (1 - 2 * share) + 1e-9)
        )
        return met.filter(fits).select(F.least("a_node", "b_node").alias("a"), F.greatest("a_node", "b_node").alias("b"))

    paired = comparable(side(few, "a", ["h"]).join(side(few, "b", ["h"]), "h"))
    hubs = crowded.filter("node = hub")  # one row a posting
    tried = checkpointed(paired.unionByName(comparable(spread_join(side(crowded, "a", ["h"]), side(hubs, "b", ["h"]), "h", heavy=heavy))).distinct())
    stars = comps.select(F.col("node").alias("a"), F.col("component").alias("b"))
    comps = checkpointed(connected_components(stars.unionByName(_verified(tried, nodes, docs, profile, text_col, id_col))))
    if crowded.isEmpty():
        return comps
    again = crowded.select("h", *own[1:]).join(comps, "node", "left").select("h", least, *own[1:])
    apart = checkpointed(again.groupBy("h").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select("h"))
    loose = checkpointed(again.join(_small(apart), "h"))
    # each posting is dealt to several tasks
    parts = F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1)))
    dealt, every = loose.withColumn("part", F.pmod(F.xxhash64("node"), F.lit(PARTS)).cast("int")), loose.withColumn("part", parts)
    rest = comparable(side(dealt, "a", ["h", "part"]).join(side(every, "b", ["h", "part"]), ["h", "part"]))
    rest = rest.distinct().join(tried, ["a", "b"], "left_anti")
    stars = comps.select(F.col("node").alias("a"), F.col("component").alias("b"))
    return checkpointed(connected_components(stars.unionByName(_verified(rest, nodes, docs, profile, text_col, id_col))))


def near_duplicate_classes(
    docs: DataFrame, profile: Profile = EXACT, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per input row: doc_id, f0.. (signed fingerprint words), key, component_id.

    ``component_id`` is the smallest id reachable over links. Null texts count as empty; documents
    without words have the zero fingerprint and link like any other (where a similarity decides, to
    each other); rows with null ids are classed like others, and a class of null ids alone has a null
    ``component_id``. Repeated rows are in one class. Whole texts count, however long. Other columns
    are ignored; an empty table gives an empty result.
    """
    marked = checkpointed(fingerprints(docs, profile, id_col, text_col).withColumn("row", F.monotonically_increasing_id()))
    table = marked.filter("slice is null").drop("slice", "sketch")
    firsts = (F.first(c).alias(c) for c in _words(profile))
    nodes = checkpointed(table.groupBy("key").agg(F.min("row").alias("node"), F.min("doc_id").alias("first_id"), *firsts))
    postings = checkpointed(_postings(nodes, profile))
    few, crowded = postings.filter(F.col("members") <= profile.posting), postings.filter(F.col("members") > profile.posting)
    pairs = _near_pairs(_side(few, "a_", profile).join(_side(few, "b_", profile), "key"), profile)
    if profile.similarity is None:
        comps = checkpointed(connected_components(pairs.unionByName(_crowded_exact(crowded))))
    else:
        links = _verified(pairs.unionByName(_star_pairs(crowded, profile)), nodes, docs, profile, text_col, id_col)
        comps = _completed(links, marked, nodes, docs, profile, text_col, id_col)
    least = comps.join(nodes.select("node", "first_id"), "node").groupBy("component").agg(F.min("first_id").alias("component_id"))
    named = spread_join(comps, least, "component").select("node", "component_id")
    of_key = nodes.select("key", "node", "first_id").join(named, "node", "left").select("key", F.coalesce("component_id", "first_id").alias("component_id"))
    return spread_join(table, of_key, "key").select("doc_id", *_words(profile), "key", "component_id")


def drop_near_duplicates(docs: DataFrame, profile: Profile = SIMILAR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns whatever their names, of which one of each class stays: its least id.

    Of repeated rows with that id one stays. A class whose ids are all null keeps one row. Null texts
    count as empty; documents without words are one class.
    """
    text_key, kept_id, kept_key = private_names(docs, "key", "kept_id", "kept_key")
    classes = checkpointed(near_duplicate_classes(docs, profile, id_col, text_col))
    # the key tells texts of one id apart; a class of null ids alone is named by none, so its keys are
    named = classes.filter("doc_id is not null").groupBy("component_id").agg(F.min(F.struct("doc_id", "key")).alias("k"))
    kept = named.select(F.col("k.doc_id").alias(kept_id), F.col("k.key").alias(kept_key))
    nulls = classes.filter("component_id is null").select(F.col("doc_id").alias(kept_id), F.col("key").alias(kept_key)).distinct()
    kept = checkpointed(kept.unionByName(nulls))
    own_id = F.col(f"`{id_col}`").cast("long")
    keyed = docs.withColumn(text_key, F.unhex(F.md5(_text(text_col))))

    def of(rows: DataFrame) -> Column:
        return (F.col(text_key) == rows[kept_key]) & own_id.eqNullSafe(rows[kept_id])

    stay = keyed.join(kept, of(kept), "left_semi")
    times = classes.groupBy(F.col("doc_id").alias(kept_id), F.col("key").alias(kept_key)).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    again = checkpointed(times)
    once = stay.join(again, of(again), "left_anti")
    repeated = stay.join(again, of(again), "left_semi").dropDuplicates([id_col, text_key])
    return once.unionByName(repeated).drop(text_key)
