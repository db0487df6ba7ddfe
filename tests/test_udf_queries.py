"""The queries without SQL against plain Python over whole small tables."""

import re
from collections import defaultdict
from difflib import SequenceMatcher

from turnloom.functions.spoken import number_candidates
from turnloom.operators.greedy import names_match
from turnloom.plans.catalogue import QUERIES
from turnloom.sources.tables import table

SF = "/root/testdata/sf0.001"


def rows(spark, name, *columns):
    return [tuple(r) for r in table(spark, SF, name, *columns).collect()]


def test_number_candidates(spark):
    by = defaultdict(list)
    for c, t, x in rows(spark, "conversations", "conv_id", "turn", "text"):
        by[c].append((t, x))
    want = {}
    for c, turns in by.items():
        turns.sort()
        for k, (t, text) in enumerate(turns):
            cands = number_candidates(" ".join(x for _, x in turns[max(0, k - 2) : k + 3]))
            want[c, t] = len(cands)
    got = {(r.conv_id, r.turn): r for r in QUERIES["number_candidates"](spark, SF).collect()}
    assert {k: r.candidates for k, r in got.items()} == want
    assert all(0 <= r.ok <= r.total for r in got.values()) and not any(r.ok < r.total and not re.search(r"\d", "".join(x for _, x in by[r.conv_id])) for r in got.values())


def test_seq_ratio(spark):
    parts = sorted(rows(spark, "part", "p_partkey", "p_name", "p_brand", "p_size"))
    want = {}
    for k, a in enumerate(parts):
        for b in parts[k + 1 :]:
            if a[2:] == b[2:] and (r := SequenceMatcher(None, a[1], b[1]).ratio()) >= 0.85:
                want[a[0], b[0]] = round(r, 9)
    assert {(r.a_key, r.b_key): round(r.ratio, 9) for r in QUERIES["seq_ratio"](spark, SF).collect()} == want


def test_greedy_match(spark):
    groups = defaultdict(lambda: ([], []))
    for brand, size, key, name in rows(spark, "part", "p_brand", "p_size", "p_partkey", "p_name"):
        groups[brand, size][key % 2].append((key, name))
    want = {}
    for even, odd in groups.values():
        free = sorted(odd)
        for key, name in sorted(even):
            hit = next((x for x in free if names_match(name, x[1])), None)
            if hit:
                free.remove(hit)
            want[key] = hit[0] if hit else None
    assert {r.p_partkey: r.match_order for r in QUERIES["greedy_fuzzy_match"](spark, SF).collect()} == want


def plain(text):
    text = re.sub("[^a-z0-9]+", " ", text.lower().replace("'", "")).strip()
    return re.sub(r"\b(\w+)( \1\b)+", r"\1", text)


def joined(text):
    for m in re.findall(r"\b((?:[A-Za-z](?:\s*[,\-.]\s*|\s+)){2,}[A-Za-z])\b", text):
        text = text.replace(m, re.sub("[^A-Za-z]", "", m))
    return text


def test_quote_repair(spark):
    want = {}
    for c, t, text in rows(spark, "conversations", "conv_id", "turn", "text"):
        parts = [x.strip() for x in re.split(r"(?<=[.?!])\s+", text) if x.strip()]
        spans = [s for k, p in enumerate(parts) for s in ([p] if k + 1 == len(parts) else [p, f"{p} {parts[k + 1]}"])]
        for k, p in enumerate(parts):
            quote = p[: max(len(p) - 6, 1)]
            q = plain(joined(quote))
            best, ratio = quote, 0.0
            if q and f" {q} " not in f" {plain(joined(text))} ":
                for s in spans:
                    r = SequenceMatcher(None, q, plain(joined(s))).ratio()
                    if r > ratio:
                        best, ratio = s, r
            want[c, t, k] = best if ratio >= 0.6 else quote
    got = {(r.conv_id, r.turn, r.place): r.repaired for r in QUERIES["quote_repair"](spark, SF).collect()}
    assert set(got) == set(want)
    ascii_only = [k for k in want if want[k].isascii() and got[k].isascii()]
    assert len(ascii_only) > 50 and {k: got[k] for k in ascii_only} == {k: want[k] for k in ascii_only}
