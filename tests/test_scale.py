"""Work of matching and joining queries in proportion to their rows."""

import random
from difflib import SequenceMatcher

from turnloom.functions.fuzzy import closest_spans
from turnloom.operators import greedy
from turnloom.operators.relational import TASK_ROWS, spread
from turnloom.plans.catalogue import QUERIES


def test_seq_ratio_classes(spark, tmp_path):
    """Equal names are members of a class, not pairs, and no link between different names is lost."""
    names = ["red bolts", "red bolt", "blue ring", "", None]
    parts = [(k, names[k % 5], "b", 1) for k in range(400)]
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_brand string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    got = {(r.a_key, r.b_key): r.ratio for r in QUERIES["seq_ratio"](spark, str(tmp_path)).collect()}
    assert len(got) == 3 * 79 + 2
    rep = {b: a for (a, b), r in got.items() if r == 1.0} | {0: 0, 1: 1, 2: 2}
    for a, x, *_ in parts:
        for b, y, *_ in parts[a + 1 :: 7]:
            want = SequenceMatcher(None, x, y).ratio() if x and y else 0.0
            linked = 1.0 if a in rep and rep[a] == rep.get(b) else got.get((rep.get(a), rep.get(b)), 0.0)
            assert linked == (want if want >= 0.85 else 0.0)


def test_closest_spans_compares_few(monkeypatch):
    rnd = random.Random(3)
    words = ["fever", "pain", "dose", "night", "morning", "nurse", "called", "tablet", "two", "was"]
    spans = [" ".join(rnd.choices(words, k=rnd.randint(1, 60))) for _ in range(60)] + ["", "fever"]
    quotes = [s[: max(1, len(s) - 6)] for s in spans] + [None, "zzz"]
    calls = []
    real = SequenceMatcher.ratio
    monkeypatch.setattr(SequenceMatcher, "ratio", lambda m: calls.append(1) or real(m))
    got = closest_spans(quotes, spans, spans, 0.6)
    assert len(calls) < len(quotes) * len(spans) / 4
    for q, found in zip(quotes, got, strict=True):
        scores = [0.0 if q is None else real(SequenceMatcher(None, q, s)) for s in spans]
        assert found == (spans[scores.index(max(scores))] if max(scores) >= 0.6 else None)


def test_greedy_group_compares_values_once():
    """Rows of equal values wait in one queue."""
    group, calls = greedy._Group(), []
    match = lambda a, b: calls.append((a, b)) or a[0] == b[0]
    rows = [(k, f"{'ab'[k % 2]}{k % 3}") for k in range(3000)]
    for place, (k, v) in enumerate(rows):
        group.free.setdefault(v, greedy.deque()).append((place, k))
    free = list(rows)
    for k in range(3200):
        v = f"{'ba'[k % 2]}x"
        hit = next((x for x in free if x[1][0] == v[0]), None)
        if hit:
            free.remove(hit)
        assert group.first(v, match) == (hit and hit[0])
    assert len(calls) == 2 * 6


def test_tasks_grow_with_rows(spark):
    df = spark.range(10)
    assert spread(df, "id", rows=40 * TASK_ROWS).rdd.getNumPartitions() == 41 and spread(df, "id").rdd.getNumPartitions() == 9


def test_equal_summaries_are_walked_once(spark):
    """The walk stands above the grouping of equal texts in the plan, and copies count."""
    from turnloom.operators.schema_check import key_order

    text = '{"identity": {}, "not_applicable": {"reason": null, "is_na": false}}'
    found = key_order(spark.createDataFrame([(text,)] * 30 + [("no object",), (None,)], "raw string"))
    assert {r.kind: (r.violating, r.total) for r in found.collect()} == {"top": (30, 30), "identity": (0, 30), "not_applicable": (30, 30)}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" in plan[plan.index("Generate") :]


def test_scorecard_sends_no_side_to_the_driver(spark, tmp_path):
    """Rows exploded from a table under the broadcast threshold are exchanged."""
    rows = [(c, k, ["user", "assistant"][k % 2], f"I have a fever since day {k % 3}. My dose was low.") for c in range(3) for k in range(6)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    found = QUERIES["grounding_scorecard"](spark, str(tmp_path))
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert {(r.role, r.name): (r.ok, r.total) for r in found.collect()} == {(x, y): (18, 18) for x in ("user", "assistant") for y in ("exact_in_cited", "found_elsewhere")}
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
