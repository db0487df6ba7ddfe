"""The Merkle manifest, weighted fingerprints and conversation repair against plain versions."""

import hashlib
import heapq
import math
import random
from collections import Counter, defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from tests.llm.fixtures import docs, rows
from turnloom.llm.merkle import folded, merkle_manifest, path_text
from turnloom.llm.queries import damaged_turns
from turnloom.llm.repair import repair_conversations, repaired_turns
from turnloom.llm.weighted_sampling import SAMPLES, weighted_fingerprints

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree(nodes):
    """The root and each leaf's siblings, level by level."""
    proofs, owners = [[] for _ in nodes], [[k] for k in range(len(nodes))]
    while len(nodes) > 1:
        up, up_owners = [], []
        for k in range(0, len(nodes), 2):
            pair = nodes[k : k + 2]
            for side, own in enumerate(owners[k : k + 2]):
                for leaf in own:
                    proofs[leaf].append("".join(pair[:side] + pair[side + 1 :]))
            up.append(h(*pair))
            up_owners.append([x for own in owners[k : k + 2] for x in own])
        nodes, owners = up, up_owners
    return (nodes or [None])[0], proofs


def manifest(given):
    by = defaultdict(list)
    for r in given:
        leaf = h(field(r[0]), field(r[3]), field(r[2]), field(r[4]), field(r[1]))
        by[r[2]].append((r[0] is not None, r[0] or 0, leaf))
    groups = sorted(by, key=lambda g: (g is not None, (g or "").encode()))
    trees = [tree([x[2] for x in sorted(by[g])]) for g in groups]
    root, above = tree([t[0] for t in trees])
    out = Counter()
    for g, (sub, proofs), top in zip(groups, trees, above, strict=True):
        for leaf, proof in zip(sorted(by[g]), proofs, strict=True):
            out[leaf[1] if leaf[0] else None, leaf[2], sub, root, h("".join(proof + top))] += 1
    return out


@pytest.mark.parametrize("levels", [1, 3, 10])
def test_manifest(spark, levels):
    rng = random.Random(levels)
    given = [(*r[:2], rng.choice(["en", "de", "é", "z", None, ""]) if k % 3 else "en", *r[3:]) for k, r in enumerate(rows())]
    given = given[:40] if levels == 1 else given
    got = merkle_manifest(docs(spark, given), levels=levels, carry={"own": F.col("id")})
    assert set(got.columns) == {"doc_id", "leaf", "path", "subroot", "root", "own"}
    found = got.select("*", folded(F.col("leaf"), F.col("path")).alias("up"), F.sha2(path_text(F.col("path")), 256).alias("proof")).collect()
    assert all(r.up == r.root and r.own == (None if r.doc_id is None else f"id{r.doc_id}") for r in found)
    assert Counter((r.doc_id, r.leaf, r.subroot, r.root, r.proof) for r in found) == manifest(given)


def test_manifest_of_few(spark):
    assert merkle_manifest(docs(spark, [])).collect() == []
    given = rows()[:1]
    (only,) = merkle_manifest(docs(spark, given)).collect()
    assert only.path == [] and only.leaf == only.subroot == only.root
    changed = docs(spark, rows()[:9]).withColumn("n_chars", F.col("n_chars") + (F.col("doc_id") == 3).cast("int"))
    roots = [merkle_manifest(d).first().root for d in (docs(spark, rows()[:9]), changed)]
    assert roots[0] != roots[1]


def signed(x):
    return x - (1 << 64) * (x >> 63)


def words(text):
    return Counter(w for w in __import__("re").split(r"\s+", (text or "").lower()) if w)


def drawn(text, n=SAMPLES):
    """The samples of a text, as 16-bit marks."""
    out = []
    terms = {signed(xxhash.xxh64_intdigest(w.encode(), 42)): k for w, k in words(text).items()}
    chain = lambda term, number: xxhash.xxh64_intdigest(number.to_bytes(4, "little") + bytes(0), xxhash.xxh64_intdigest((term % (1 << 64)).to_bytes(8, "little"), 42))
    for d in range(n):
        best = None
        for term, weight in terms.items():
            lane, k = divmod(d, 3)
            a, b = (chain(term, lane * 6 + 2 * k + i) for i in range(2))
            unit = lambda v, at, bits: ((v >> at & (1 << bits) - 1) + 0.5) / (1 << bits)
            r = -math.log(unit(a, 0, 32) * unit(a, 32, 32))
            c, beta = math.log(-math.log(unit(b, 0, 20) * unit(b, 20, 20))), unit(b, 40, 24)
            t = math.floor(math.log(weight) / r + beta)
            rank = int((c - r * (t - beta + 1) + 128) * (1 << 22))
            best = min(x for x in (best, (rank, a + t * 0x9E3779B1 & 0xFFFFFFFF)) if x is not None)
        if best:
            out.append(best[1] & 0xFFFF)
    return out


def like(a, b):
    return 0.0 if len(a) != len(b) else sum(x == y for x, y in zip(a, b, strict=True)) / len(a) if a else 1.0


def test_fingerprints_against_brute_force(spark):
    given = [(*r[:1], r[1] if r[1] is None or len(r[1]) < 9999 else r[1][:9999], *r[2:]) for r in rows()]
    order = sorted(given, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    wanted = Counter()
    for k, r in enumerate(order):
        text, after = r[1] or "", order[(k + 1) % len(order)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        a, b, c = drawn(text), drawn(edited), drawn(after)
        marks = ["".join(f"{v:04x}" for v in x) for x in (a, b)]
        wanted[r[0], len(text), h(edited), *marks, round(like(a, b), 9), round(like(a, c), 9)] += 1
    got = weighted_fingerprints(docs(spark, given)).collect()
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9)) for r in got) == wanted


def test_fingerprints_estimate_weighted_jaccard(spark):
    rng = random.Random(9)
    texts = [" ".join(rng.choices([f"w{k}" for k in range(300)], weights=[1 / (k + 1) for k in range(300)], k=rng.randint(50, 400))) for _ in range(80)]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.near_next for r in weighted_fingerprints(df, samples=180).collect()}
    errors = []
    for k, t in enumerate(texts):
        a, b = words(t), words(texts[(k + 1) % len(texts)])
        errors.append(got[k] - sum((a & b).values()) / sum((a | b).values()))
    assert abs(sum(errors) / len(errors)) < 0.015
    assert max(abs(e) for e in errors) < 0.16  # four standard deviations


def test_fingerprints_of_few(spark):
    assert weighted_fingerprints(docs(spark, [])).collect() == []
    (one,) = weighted_fingerprints(docs(spark, rows()[12:13])).collect()
    assert one.near_next == 1.0 and one.edited_sha256 == h(rows()[12][1][: len(rows()[12][1]) - len(rows()[12][1]) // 2] + rows()[12][1][: len(rows()[12][1]) // 2])


def plain_repair(turns):
    """One conversation: the report by a search over (cost, edits)."""
    turns = sorted(turns, key=lambda t: (t[0] is not None, t[0] or 0, t[1], t[2]))
    seen, faults = set(), []
    for _, role, text in turns:
        stripped = text.rstrip(" \t\n\v\f\r")
        faults.append("blank" if not stripped else "duplicate" if (role, text) in seen else "truncated" if stripped[-1] not in ".!?" else "")
        seen.add((role, text))
    step = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
    heap, done = [(0, "", 0, 0, ())], set()
    while True:
        cost, audit, i, q, lines = heapq.heappop(heap)
        if i == len(turns) and q in (0, 3):
            break
        if (i, q) in done:
            continue
        done.add((i, q))
        for role in ("user", "assistant"):
            if (q, role[0]) in step:
                heapq.heappush(heap, (cost + 3, audit + "I", i, step[q, role[0]], (*lines, f"{role}:")))
        if i < len(turns):
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, q, lines))
            _, role, text = turns[i]
            if faults[i] not in ("blank", "duplicate"):
                more = 3 * (faults[i] == "truncated")
                if (q, role[:1]) in step:
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, step[q, role[:1]], (*lines, f"{role}:{text}")))
                for new in ("user", "assistant"):
                    if (q, new[0]) in step:
                        heapq.heappush(heap, (cost + 3 + more, audit + "R", i + 1, step[q, new[0]], (*lines, f"{new}:{text}")))
    known = [t[0] for t in turns if t[0] is not None]
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    pairs = zip(turns, turns[1:], strict=False)
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in pairs)
    counts = Counter(faults)
    return (gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()), list(lines)


def conversations(seed):
    rng = random.Random(seed)
    out = []
    for conv in [*range(60), None]:
        n = rng.choice([1, 2, 3, 5, 8, 13, 30])
        for k in range(n):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            text = rng.choice(["Yes.", "No", "Hm?", "", "  \n", None, f"Number {k}!", f"cut {k}", "Äö.\t", "x" * 3000])
            out.append((conv, rng.choice([k, k, k, k + 2, None]), role, text, "clash"))
    return out


@pytest.mark.parametrize(("block", "fan"), [(128, 256), (3, 2), (1, 3)])
def test_repair_against_search(spark, block, fan):
    given = conversations(block)
    df = spark.createDataFrame(given, "conv_id long, turn long, role string, text string, g string")
    wanted = defaultdict(list)
    for conv, turn, role, text, _ in given:
        wanted[conv].append((turn, " " if role is None else role, " " if text is None else text))
    # rows of one turn go by role and text, here told apart by their first 32 characters
    found = {r.conv_id: tuple(r)[1:] for r in repair_conversations(df, block=block, fan=fan).collect()}
    assert found == {conv: plain_repair(turns)[0] for conv, turns in wanted.items()}
    lines = defaultdict(list)
    for r in repaired_turns(df, block=block, fan=fan).orderBy("conv_id", "block", "place").collect():
        lines[r.conv_id].append(f"{r.role}:{r.text}")
    assert {c: lines[c] for c in wanted} == {conv: plain_repair(turns)[1] for conv, turns in wanted.items()}


def test_damage(spark):
    df = spark.createDataFrame(conversations(7), "conv_id long, turn long, role string, text string, g string")
    crc = lambda r: __import__("zlib").crc32(f"{' ' if r[0] is None else r[0]}:{' ' if r[1] is None else r[1]}".encode()) % 20
    wanted = Counter()
    for r in conversations(7):
        role, text, c = " " if r[2] is None else r[2], " " if r[3] is None else r[3], crc(r)
        text = "" if c == 1 else "".join(x for x in text if x not in ".!?") if c == 2 else text
        wanted[r[0], r[1], "user" if c == 4 else role, text] += 0 if c == 0 else 2 if c == 3 else 1
    assert Counter(tuple(r) for r in damaged_turns(df).collect()) == +wanted


def test_repair_of_nothing(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert repair_conversations(df).collect() == []
