"""Packing, SimHash and exact deduplication against brute force."""

import zlib
from collections import Counter, defaultdict
from dataclasses import replace

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from tests.llm.fixtures import docs, intact, rows
from turnloom.llm.exact_dedup import content_sort_dedup
from turnloom.llm.packing import TextEncoder, best_fit_decreasing, pack_documents
from turnloom.llm.simhash import EXACT, SIMILAR, Profile, drop_near_duplicates, near_duplicate_classes

PATH = public_tokenizers.path("byte_bpe_50k.json")


def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


@pytest.mark.parametrize(
    "text",
    ["", " ", "a  b", "a   b", "a \n \n b", "\n\n x", "x \t\x1c y", "don't  it's 　z", "a<|endoftext|> b <|endoftext|>", "é​ ñ 12 3!!", "tail  \n "],
)
def test_ids_are_the_tokenizers(text, monkeypatch):
    ids = tokenizer().encode(text, add_special_tokens=False).ids
    assert np.frombuffer(TextEncoder(PATH)(text), "<u4").tolist() == ids
    monkeypatch.setattr("turnloom.llm.packing.BLOCK_CHARS", 3)
    assert np.frombuffer(TextEncoder(PATH)(text), "<u4").tolist() == ids


def test_ids_of_all_documents(spark):
    """The ids of every text of a whole table are those of the tokenizer's own file."""
    t, encode = tokenizer(), TextEncoder(PATH)
    texts = [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    assert len(texts) > 900
    for text, own in zip(texts, t.encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(encode(text), "<u4").tolist() == own.ids


def test_packing_round_trip(spark):
    given = rows()
    out = pack_documents(docs(spark), PATH, capacity=64).collect()
    t, want = tokenizer(), defaultdict(list)
    for r in given:
        ids = np.array([*t.encode(r[1] or "", add_special_tokens=False).ids, 0], "<u4")
        want[r[0]].append(ids)
    got = Counter()
    for p in out:
        ids = next(x for x in want[p.doc_id] if len(x) == p.doc_tokens)
        assert zlib.crc32(ids[p.start : p.start + p.length].tobytes()) == p.ids_crc32
        got[p.doc_id] += p.length
    assert got == {k: sum(map(len, v)) for k, v in want.items()}
    sequences = defaultdict(list)
    for p in out:
        sequences[p.sequence_id].append((p.offset, p.length))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 64


def test_best_fit_takes_the_tightest_window():
    lengths = [60, 50, 40, 30, 20, 14, 10, 4]
    used, want = [], {}
    for k in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        fit = min((w for w in range(len(used)) if 64 - used[w] >= lengths[k]), key=lambda w: 64 - used[w], default=None)
        if fit is None:
            fit = len(used)
            used.append(0)
        want[k] = used[fit]
        used[fit] += lengths[k]
    placed = best_fit_decreasing(lengths, 64)
    assert {k: offset for k, (_, offset) in enumerate(placed)} == want  # equally tight windows are interchangeable


def brute_fingerprint(text, k=3):
    words = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()).split()
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + k]), 42) for i in range(max(1, len(words) - k + 1))] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_classes(prints):
    """prints: (doc_id, value); links at two bits."""
    values = sorted({v for _, v in prints})
    parent = {v: v for v in values}

    def find(v):
        while parent[v] != v:
            parent[v] = parent[parent[v]]
            v = parent[v]
        return v

    for i, a in enumerate(values):
        for b in values[i + 1 :]:
            if (a ^ b).bit_count() <= 2:
                parent[find(a)] = find(b)
    least = defaultdict(list)
    for d, v in prints:
        if d is not None:
            least[find(v)].append(d)
    return {(d, v): min(least[find(v)], default=None) for d, v in prints}


def test_simhash_classes(spark):
    given = rows()
    want = brute_classes([(r[0], brute_fingerprint(r[1])) for r in given])
    got = near_duplicate_classes(docs(spark), EXACT).collect()
    assert len(got) == len(given)
    for r in got:
        assert want[(r.doc_id, r.f0 % (1 << 64))] == r.component_id


def test_crowded_postings_lose_no_link(spark):
    """Hundreds of fingerprints close to each other: chains over one and two bits."""
    import turnloom.llm.simhash as s

    rng = np.random.default_rng(3)
    base = 0x0123456789ABCDEF
    values = {base}
    for _ in range(300):
        v = sorted(values)[int(rng.integers(len(values)))]
        for b in rng.choice(64, int(rng.integers(1, 4)), replace=False):
            v ^= 1 << int(b)
        values.add(v)
    prints = list(enumerate(sorted(values)))
    signed = [(i, v - (1 << 64) if v >> 63 else v) for i, v in prints]
    nodes = spark.createDataFrame(signed, "node long, f0 long")
    from turnloom.llm.graph import connected_components

    links = s._crowded_exact(s._postings(nodes, EXACT))
    comps = {r.node: r.component for r in connected_components(links).collect()}
    want = brute_classes(prints)
    groups = defaultdict(set)
    for i, v in prints:
        groups[want[(i, v)]].add(comps.get(i, i))
    assert all(len(g) == 1 for g in groups.values())
    assert len(set().union(*groups.values())) == len(groups)


def similar_rows(seed, n):
    """Texts cut and edited from each other, many of them close to a similarity of 0.8."""
    rng = np.random.default_rng(seed)
    word = lambda k: [f"v{x}" for x in rng.integers(0, 3000, k)]
    texts, licence = [], word(40)
    for _ in range(n):
        base = word(int(rng.integers(0, 90)))
        texts.append(base)
        for _ in range(int(rng.integers(0, 4))):
            base = list(base if rng.random() < 0.5 else texts[int(rng.integers(len(texts)))])
            for _ in range(int(rng.integers(0, 3))):
                at = int(rng.integers(0, len(base) + 1))
                base[at : at + int(rng.integers(0, 3))] = word(int(rng.integers(0, 3)))
            texts.append(base + (licence if rng.random() < 0.2 else []))
    return [(k, " ".join(t), *[None] * 6) for k, t in enumerate(texts)]


def brute_similar(given, at=0.8):
    sets = {}
    for r in given:
        w = bytes(c + 32 if 65 <= c <= 90 else c for c in (r[1] or "").encode()).split()
        sets[r[0]] = frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()
    parent = {i: i for i in sets}

    def find(v):
        while parent[v] != v:
            parent[v] = parent[parent[v]]
            v = parent[v]
        return v

    links = 0
    for a in sets:
        for b in sets:
            if a < b and (sets[a] == sets[b] or len(sets[a] & sets[b]) >= at * len(sets[a] | sets[b]) - 1e-9):
                links += 1
                parent[max(find(a), find(b))] = min(find(a), find(b))
    return {i: find(i) for i in sets}, links


def test_similar_classes_lose_no_link(spark, posting=1):
    given = similar_rows(posting, 150)
    want, links = brute_similar(given)
    assert links > 100
    got = {r.doc_id: r.component_id for r in near_duplicate_classes(docs(spark, given), replace(SIMILAR, posting=posting)).collect()}
    assert got == want


def test_completion_alone_loses_no_link(spark):
    """With a radius of zero the fingerprint index finds next to nothing."""
    given = similar_rows(5, 150)
    got = {r.doc_id: r.component_id for r in near_duplicate_classes(docs(spark, given), replace(SIMILAR, radius=0, posting=2)).collect()}
    assert got == brute_similar(given)[0]


def test_heavy_keys_are_dealt_out(spark, monkeypatch):
    from turnloom.llm import common

    monkeypatch.setattr(common, "HEAVY_ROWS", 5)
    rows = spark.createDataFrame([(k % 3 if k < 90 else k, k) for k in range(100)], "key long, v long").checkpoint()
    keyed = spark.createDataFrame([(k, f"n{k}") for k in range(200)], "key long, name string")
    got = Counter((r.key, r.v, r.name) for r in common.spread_join(rows, keyed, "key").collect())
    assert got == Counter((k, v, f"n{k}") for k, v in ((k % 3 if k < 90 else k, k) for k in range(100)))
    given = [*rows_of_copies(), *similar_rows(5, 40)]
    got = {r.doc_id: r.component_id for r in near_duplicate_classes(docs(spark, given), SIMILAR).collect()}
    assert got == brute_similar(given)[0]


def rows_of_copies():
    return [(10_000 + k, "one text of many copies that are all alike", *[None] * 6) for k in range(60)]


def test_near_copies_keep_one(spark):
    kept = drop_near_duplicates(docs(spark), SIMILAR).collect()
    ids = [r.doc_id for r in kept]
    near, copies = range(8 + 60 + 13, 8 + 60 + 13 + 20), range(8 + 60, 8 + 60 + 13)
    assert not set(copies) & set(ids)
    assert len(ids) == len(set(ids)) and set(range(3, 68)) - set(near) <= set(ids)
    words = {r[0]: (r[1] or "").split() for r in rows() if r[0] is not None}

    def jaccard(a, b):
        x, y = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (words[a], words[b]))
        return len(x & y) / len(x | y)

    for k, i in enumerate(near):
        assert (i in ids) == (jaccard(8 + k, i) < 0.8)
    assert kept[0].asDict().keys() == docs(spark).first().asDict().keys()
    assert intact(drop_near_duplicates(docs(spark), SIMILAR))


def test_repeated_phrases_do_not_part_near_copies(spark):
    """The same distinct shingles, a phrase of one line repeated more often in one of two documents."""
    rng = np.random.default_rng(8)
    given = []
    for k in range(10):
        words = " ".join(f"w{x}" for x in rng.integers(0, 100_000, 300))
        phrase = " ".join(f"p{x}" for x in rng.integers(0, 100_000, 5))
        given += [(2 * k + j, " ".join([words, *[phrase] * n]), *[None] * 6) for j, n in enumerate((40, 5))]
    kept = sorted(r.doc_id for r in drop_near_duplicates(docs(spark, given), SIMILAR).collect())
    assert kept == list(range(0, 20, 2))


def test_exact_dedup(spark):
    given = rows() + [(5000 + k, "hot text", "en", "s", 8, "", "", "") for k in range(400)]
    got = content_sort_dedup(docs(spark, given)).collect()
    groups = defaultdict(list)
    for r in given:
        groups[r[1] or ""].append(r[0])
    assert len(got) == len(given)
    import hashlib

    by_sha = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    kept = Counter()
    for r in got:
        ids = by_sha[r.text_sha256]
        assert r.group_size == len(ids)
        assert r.keep_id == max((i for i in ids if i is not None), default=None)
        assert not r.kept or r.doc_id == r.keep_id
        kept[r.text_sha256] += r.kept
    assert set(kept.values()) == {1} and len(kept) == len(by_sha)


def test_empty_tables(spark):
    none = docs(spark, [])
    assert pack_documents(none, PATH).count() == 0
    assert near_duplicate_classes(none, EXACT).count() == 0
    assert drop_near_duplicates(none, SIMILAR).count() == 0
    assert content_sort_dedup(none).count() == 0


def test_profiles():
    assert EXACT.guaranteed == 6 and isinstance(SIMILAR, Profile)


def test_null_heavy_table(spark):
    given = [(None, None, *[None] * 6)] * 5
    assert near_duplicate_classes(docs(spark, given)).filter(F.col("component_id").isNotNull()).count() == 0
    assert drop_near_duplicates(docs(spark, given), SIMILAR).count() == 1
    assert content_sort_dedup(docs(spark, given)).filter("kept").count() == 1
