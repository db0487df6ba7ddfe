"""The pipeline's stages over a small dataset folder with every awkward case."""

import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

import corpus_pipeline as p
from tests.llm.fixtures import DDL, WORDS, docs, intact, rows
from tests.llm.test_basic_ops import brute_similar
from tests.llm.test_more_ops import best_windows, repeated_lines
from turnloom.llm.quality import fit_quality, score_quality


def dataset(spark, folder, given):
    docs(spark, given).write.parquet(f"{folder}/documents.parquet")
    labels = [(r[0], int(r[0] % 5 > 0), 0) for r in given if r[0] is not None]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    item = next((r[1] for r in given if r[0] == 20), "")
    spark.createDataFrame([(1, " ".join(item.split()[:25])), (2, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


def test_stages(spark, tmp_path):
    folder = f"file://{tmp_path}/data"
    dataset(spark, folder, rows())
    df = docs(spark)
    for name, stage in p.STAGES[:-1]:
        out = stage(spark, df, folder)
        assert out.columns == df.columns, name
        assert intact(out), name
        kept = {r.doc_id for r in out.collect()}
        assert kept <= {r[0] for r in rows()} and kept
        if name == "decontamination":
            assert 20 not in kept
    assert p.run(spark, folder).count() > 0


def test_empty(spark, tmp_path):
    folder = f"file://{tmp_path}/data"
    dataset(spark, folder, [])
    assert p.run(spark, folder).count() == 0


def mixed_rows():
    """Texts for which every stage decides something: shared passages, near copies, items, junk."""
    rng = random.Random(12)
    words = [a + b for a in WORDS for b in WORDS]
    line = lambda n: " ".join(rng.choices(words, k=n))
    passage = [line(20) for _ in range(4)]
    item = line(30)
    texts = []
    for k in range(70):
        lines = [line(rng.randint(5, 25)) for _ in range(rng.randint(1, 6))]
        if k % 7 == 1:
            lines[1:1] = passage
        if k % 9 == 2:
            lines.append(item)
        texts.append("\n".join(lines))
        if k % 6 == 3:
            copy = texts[-1].split(" ")
            copy[rng.randrange(len(copy))] = "other"
            texts.append(" ".join(copy))
        if k % 10 == 4:
            texts.append(texts[-1])
    texts += [None, "", "one", "x" * 3000]
    return [(k, t, "en", "s", len(t or ""), "a", "b", "c") for k, t in enumerate(texts)], item


def test_stages_against_brute_force(spark, tmp_path):
    """Each stage on what its predecessor kept, against a plain version; the run gives what the stages give."""
    given, item = mixed_rows()
    folder = f"file://{tmp_path}/data"
    df = spark.createDataFrame(given, DDL)
    df.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(r[0], int(r[0] % 6 > 0), 0) for r in given if len(r[1] or "") > 9], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    rows_of = lambda d: [tuple(r) for r in d.collect()]

    first = p.quality(spark, df, folder)
    model = fit_quality(df, spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "quality"), F.lit(True))
    scores = {r.doc_id: r.score for r in score_quality(df, model).collect()}
    kept = rows_of(first)
    assert sorted(kept) == sorted(r for r in given if scores[r[0]] >= model.threshold) and len(kept) > 40

    second = rows_of(p.line_dedup(spark, spark.createDataFrame(kept, DDL), folder))
    gone = {r[0]: lines for r, lines in repeated_lines(kept).values()}
    assert sum(map(bool, gone.values())) > 3
    for r in second:
        before = next(x for x in kept if x[0] == r[0])
        text = None if before[1] is None else "\n".join(x for i, x in enumerate(before[1].split("\n")) if i not in gone[r[0]])
        assert r[1] == text and r[4] == (None if text is None else len(text))
    assert len(second) == len(kept)

    third = rows_of(p.near_dedup(spark, spark.createDataFrame(second, DDL), folder))
    classes, _ = brute_similar(second)
    assert {r[0] for r in third} == set(classes.values()) and len(third) < len(second)

    fourth = rows_of(p.decontamination(spark, spark.createDataFrame(third, DDL), folder))
    clean = {r[0] for r in third if not ((b := best_windows(r[1], item)) and b[0] >= 0.8 - 1e-12)}
    assert {r[0] for r in fourth} == clean and len(clean) < len(third)
    assert {r[0]: r for r in fourth} == {r[0]: r for r in third if r[0] in clean}

    pieces = p.packing(spark, spark.createDataFrame(fourth, DDL), folder).collect()
    whole, sequences = defaultdict(list), defaultdict(list)
    for x in pieces:
        whole[x.doc_id].append((x.start, x.length, x.doc_tokens))
        sequences[x.sequence_id].append((x.offset, x.length))
    assert set(whole) == clean
    for parts in whole.values():
        at = 0
        for start, length, _ in sorted(parts):
            assert start == at
            at += length
        assert {n for _, _, n in parts} == {at}
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    ran = Counter((r.doc_id, r.start, r.length, r.ids_crc32) for r in p.run(spark, folder).collect())
    tokens = lambda counts: {i: sum(k[2] * n for k, n in counts.items() if k[0] == i) for i in clean}
    assert {k[0] for k in ran} == clean and tokens(ran) == tokens(Counter((r.doc_id, r.start, r.length, r.ids_crc32) for r in pieces))
