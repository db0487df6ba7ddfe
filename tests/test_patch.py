"""Patches against plain recursion."""

import copy
import json
import random

from turnloom.operators.patch import apply_patches


def plain(doc, patches):
    out = copy.deepcopy(doc)
    fresh = {}
    for path, after, value in patches:
        at = out
        try:
            for key in path[:-1]:
                at = at[int(key)] if isinstance(at, list) else at[key]
        except (KeyError, IndexError, ValueError, TypeError):
            continue
        last = path[-1]
        if isinstance(at, list):
            if last == "-":
                at.append(value)
            elif last.isdigit() and int(last) < len(at):
                at[int(last)] = value
        elif isinstance(at, dict):
            if last in at or after not in at:
                at[last] = value
            else:
                items, done = list(at.items()), fresh.setdefault((id(at), after), [])
                place = [k for k, _ in items].index(after) + 1 + len(done)
                items.insert(place, (last, value))
                done.append(last)
                at.clear()
                at.update(items)
    return out


def test_patches(spark):
    doc = {"b": {"z": 1, "a": "x \"q\" ü", "n": None}, "list": [{"name": "m", "k": 2.5, "deep": [1, 2, {"y": True}]}, "text", 7], "a": "", "e": {}, "l": []}
    cases = [
        [(["b", "a"], None, "new"), (["list", "0", "dose"], "name", "5"), (["list", "0", "unit"], "name", "mg"), (["list", "1"], None, None)],
        [(["list", "0", "deep", "2", "y"], None, False), (["list", "-"], None, {"n": [1]}), (["l", "-"], None, 1), (["l", "-"], None, 2)],
        [(["e", "k"], "none", "v"), (["zz"], None, {"o": 1}), (["list", "9", "x"], None, 1), (["nope", "x"], None, 1), (["list", "9"], None, 1)],
        [(["a"], None, 1), (["a"], None, 2)],
        [],
    ]
    docs = [(k, json.dumps(doc, ensure_ascii=False)) for k in range(len(cases))] + [(90, "not json"), (91, None), (92, "[1]")]
    rows = [(k, i, p, a, json.dumps(v, ensure_ascii=False)) for k, c in enumerate(cases) for i, (p, a, v) in enumerate(c)] + [(k, 0, ["a"], None, "1") for k in (90, 91, 92)]
    d = spark.createDataFrame(docs, "id int, js string")
    p = spark.createDataFrame(rows, "id int, ord int, path array<string>, after string, value string")
    got = {r.id: (r.js, r.patches) for r in apply_patches(d, p, ["id"], "js").collect()}
    for k, c in enumerate(cases):
        want = plain(doc, c)
        assert json.dumps(json.loads(got[k][0])) == json.dumps(want), k  # with the order of keys
        assert got[k][1] == len(c)
    assert got[4][0] == docs[4][1] and got[90][0] == "not json" and got[91][0] is None and got[92][0] == "[1]"


def test_random_replacements(spark):
    rng = random.Random(4)

    def value(depth):
        kind = rng.random()
        if depth and kind < 0.35:
            return {f"k{i}": value(depth - 1) for i in rng.sample(range(9), rng.randint(0, 4))}
        if depth and kind < 0.6:
            return [value(depth - 1) for _ in range(rng.randint(0, 3))]
        return rng.choice([1, -3, "t", "a\\b\n", None, True, 0.25, ""])

    def paths(v, at=()):
        items = v.items() if isinstance(v, dict) else enumerate(v) if isinstance(v, list) else ()
        for k, x in items:
            yield (*at, str(k))
            yield from paths(x, (*at, str(k)))

    docs, rows, want = [], [], {}
    for n in range(60):
        doc = {"top": value(4)}
        every = list(paths(doc))
        some = rng.sample(every, min(len(every), 2))
        some = [p for p in some if not any(q != p and p[: len(q)] == q for q in some)]
        patches = [(list(p), None, rng.choice([5, "new", {"o": []}])) for p in some]
        docs.append((n, json.dumps(doc)))
        rows += [(n, i, p, a, json.dumps(v)) for i, (p, a, v) in enumerate(patches)]
        want[n] = json.dumps(plain(doc, patches))
    p = spark.createDataFrame(rows, "id int, ord int, path array<string>, after string, value string")
    got = apply_patches(spark.createDataFrame(docs, "id int, js string"), p, ["id"], "js").collect()
    assert {r.id: json.dumps(json.loads(r.js)) for r in got} == want
