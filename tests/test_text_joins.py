"""Containment and gram joins against brute force."""

import random

import pytest

from turnloom.functions import text as T
from turnloom.operators.relational import containing, gram_jaccard


def test_containing(spark):
    rng = random.Random(4)
    texts = [" ".join(rng.choices(["a", "bb", "ccc", "", "d\n"], k=rng.randint(0, 14))) for _ in range(60)] + ["", None, "x" * 60, "y" * 30 + "x" * 40]
    items = [(k, t[: rng.randint(0, 30)][rng.randint(0, 3) :]) for k, t in enumerate(texts) if t is not None] + [(900, None), (901, "bb"), (902, "x" * 40), (903, "a bb ccc a bb")]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = containing(docs, spark.createDataFrame(items, "item_id long, text string"), "doc_id", "item_id", "text").collect()
    want = [(d, i) for d, t in enumerate(texts) for i, s in items if t is not None and s is not None and s in t]
    assert sorted(map(tuple, found)) == sorted(want) and len(want) > 100


@pytest.mark.parametrize("threshold", [0.0, 0.2, 0.5])
def test_gram_jaccard(spark, threshold):
    rng = random.Random(5)
    texts = ["".join(rng.choices("abc ", k=rng.randint(0, 40))) for _ in range(40)] + [None]
    grams = [{t[k : k + 3] for k in range(len(t) - 2)} if t else set() for t in texts]
    df = spark.createDataFrame(list(enumerate(texts)), "a long, text string").withColumn("g", T.char_grams(T.F.col("text"), 3))
    found = gram_jaccard(df, df.withColumnRenamed("a", "b"), "a", "b", "g", threshold).collect()
    want = {(i, j): len(x & y) / len(x | y) for i, x in enumerate(grams) for j, y in enumerate(grams) if x & y and len(x & y) / len(x | y) >= threshold}
    assert {(r.a, r.b): pytest.approx(r.jaccard) for r in found} == want
