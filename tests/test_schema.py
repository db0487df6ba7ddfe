"""The closed schema and the order of keys, against a plain recursive version."""

import copy
import json
import random

from turnloom.operators import schema_check as S
from turnloom.operators.validation import validate

from .test_validation import TURNS, summary

NAMES = {dict: "object", list: "array", str: "string", bool: "boolean", int: "integer", float: "number", type(None): "null"}


def errors(v, kind="top", path="$"):
    got, allowed = NAMES[type(v)], S._ALLOWED[kind]
    if got not in allowed and not (got == "integer" and "number" in allowed):
        return {path}
    if kind in S.VALUES and v not in S.VALUES[kind]:
        return {path}
    if kind in S.ARRAYS:
        return set().union(*(errors(x, S.ARRAYS[kind], f"{path}[{k}]") for k, x in enumerate(v)))
    if kind not in S.OBJECTS:
        return set()
    out = {path} if set(S.REQUIRED[kind]) - set(v) or set(v) - set(S.OBJECTS[kind]) else set()
    return out.union(*(errors(x, S.OBJECTS[kind][k], f"{path}.{k}") for k, x in v.items() if k in S.OBJECTS[kind]))


def disorder(v, kind="top", out=None):
    out = {} if out is None else out
    if isinstance(v, dict) and kind in S.OBJECTS:
        name = "field" if kind == "plain field" else kind
        bad, n = out.get(name, (0, 0))
        wanted = [k for k in S.OBJECTS[name] if k in v]
        out[name] = (bad + (wanted != list(v)), n + 1)
        for k, x in v.items():
            disorder(x, S.OBJECTS[kind].get(k), out)
    elif isinstance(v, list) and kind in S.ARRAYS:
        for x in v:
            disorder(x, S.ARRAYS[kind], out)
    return out


def places(v, at=()):
    yield at
    for k, x in v.items() if isinstance(v, dict) else enumerate(v) if isinstance(v, list) else ():
        yield from places(x, (*at, k))


def damaged(rng):
    v = copy.deepcopy(summary())
    v["risk_flags"] = [{"category": "other_urgent", "turns": [1], "quote": "x"}]
    v["assessment"][0]["facts"][0] |= {"heard_as": ["a"], "dose": 5, "prn": True}
    for _ in range(rng.randint(0, 3)):
        path = rng.choice(list(places(v)))
        if not path:
            continue
        owner = v
        for k in path[:-1]:
            owner = owner[k]
        how = rng.randrange(4)
        if how == 0:
            owner[path[-1]] = rng.choice([None, 3, 1.5, "{}", "[]", True, [], {}, "stated"])
        elif how == 1:
            del owner[path[-1]]
        elif isinstance(owner, dict) and how == 2:
            owner["odd"] = {"value": 1}
        elif isinstance(owner, dict):
            moved = owner.pop(path[-1])
            owner[path[-1]] = moved
    return v


def test_against_recursion(spark):
    rng = random.Random(4)
    given = [damaged(rng) for _ in range(300)]
    texts = [*map(json.dumps, given), None, "", "[1]", "not json", '"{}"', "{}"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, raw string")
    found = S.summary_nodes(rows).select("id", S.schema_errors(S.F.col("nodes")).alias("e")).collect()
    got = {r.id: {e.path for e in r.e} for r in found}
    assert len(found) == len(texts)
    for k, v in enumerate(given):
        assert got[k] == errors(v), texts[k]
    assert sum(map(bool, got.values())) > 100 and [got[300 + k] for k in range(6)] == [set()] * 5 + [{"$"}]
    want = {}
    for v in [*given, {}]:
        for k, (bad, n) in disorder(v).items():
            want[k] = (want.get(k, (0, 0))[0] + bad, want.get(k, (0, 0))[1] + n)
    assert {r.kind: (r.violating, r.total) for r in S.key_order(rows).collect()} == want and want["bullet"][0] > 0


def test_inside_the_validator(spark):
    two = [{"type": "action", "status": s, "certainty": "stated"} for s in ("completed", "planned")]
    odd, double = summary(assessment__turns=[9]), summary(response__facts=two)
    odd["risk_flags"] = [{"category": "none such", "turns": [1], "quote": "x"}]
    s = spark.createDataFrame([("m", "c0", json.dumps(odd)), ("m", "c1", json.dumps(double))], "system string, call_id string, summary string")
    turns = spark.createDataFrame([(c, *t) for c in ("c0", "c1") for t in TURNS], "call_id string, turn_id int, speaker string, text string")
    findings, counters = validate(s, turns)
    said = {(r.call_id, r.rule, r.path) for r in findings.filter("severity = 'ERROR'").collect()}
    assert said >= {("c0", "V1", "$.risk_flags[0].category"), ("c0", "V3", "assessment[0].turns")}
    assert {r for c, r, _ in said if c == "c0"} == {"V1", "V3"}
    assert {p for c, r, p in said if c == "c1" and r == "V10"} <= {"response[0].facts[1].status", "response[0].text"}
    sums = {(r.call_id, r.name): (r.ok, r.total) for r in counters.collect()}
    assert sums["c0", "schema_valid"] == (0, 1) and ("c0", "quote_valid") not in sums
    assert sums["c1", "status_consistent"] == (1, 2)
