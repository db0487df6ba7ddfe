"""The gram index against brute force, and that no gram becomes a row."""

import random

import pytest

from turnloom.operators import gram_index as G
from turnloom.plans.catalogue import QUERIES


@pytest.mark.parametrize("threshold", [0.0, 0.2, 0.5])
@pytest.mark.parametrize("most", [4096, 3])
def test_text_jaccard(spark, monkeypatch, threshold, most):
    """By the index and, beyond its limit, by the join; characters that no item has, short, empty and null texts."""
    monkeypatch.setattr(G, "INDEX_TEXTS", most)
    rng = random.Random(6)
    items = ["".join(rng.choices("abc ", k=rng.randint(0, 40))) for _ in range(25)] + [None, "ab", "字abc"]
    texts = ["".join(rng.choices("abc ", k=rng.randint(0, 40))) for _ in range(25)] + ["".join(rng.choices("abcdeé字", weights=[9, 9, 9, 1, 1, 1, 1], k=60)) for _ in range(20)] + [None, "", "abc" * 4000] + [t and t + "ab" for t in items[:8]]
    a = spark.createDataFrame([(f"i{k}", t) for k, t in enumerate(items)], "i string, t string")
    b = spark.createDataFrame(list(enumerate(texts)), "j long, t string")
    got = {(r.i, r.j): r.jaccard for r in G.text_jaccard(a, b, "i", "j", "t", threshold, 3).collect()}
    grams = [{t[k : k + 3] for k in range(len(t) - 2)} if t else set() for t in (*items, *texts)]
    x, y = grams[: len(items)], grams[len(items) :]
    want = {(f"i{i}", j): len(p & q) / len(p | q) for i, p in enumerate(x) for j, q in enumerate(y) if p & q and len(p & q) / len(p | q) >= threshold}
    assert got == want and len(want) > 3


def test_no_grams_are_exchanged(spark):
    """The grams of every document once became rows that met all items with the gram."""
    plan = QUERIES["near_dup_jaccard"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Generate" not in plan


def test_large_alphabets_are_joined():
    assert G.GramIndex.of(["".join(map(chr, range(0x4E00, 0x4E00 + 9000)))], 5) is None
    assert G.GramIndex.of([], 5).similar("some text", 0.2)[0].size == 0
