"""Line deduplication, decontamination, preferences, revisits and the models."""

import math
import random
from collections import Counter, defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from tests.llm.fixtures import WORDS, docs, intact, rows
from turnloom.llm.decontamination import benchmark_matches, drop_contaminated
from turnloom.llm.line_dedup import drop_repeated_lines
from turnloom.llm.lm_score import fit_ngrams, score_documents
from turnloom.llm.preferences import assembled, preference_segments
from turnloom.llm.warc import canonical_url, resolve_revisits

SF = "/root/testdata/sf0.01"


def sentence(rng, n):
    return " ".join(rng.choices(WORDS, k=n))


def line_rows():
    rng = random.Random(5)
    shared = [sentence(rng, n) for n in (60, 9, 9, 9, 9, 9, 9, 30, 25, 12, 20)]
    out = []
    for k in range(40):
        lines = [sentence(rng, rng.randint(1, 30)) for _ in range(rng.randint(0, 8))]
        at = rng.randint(0, len(lines))
        a, b = sorted((rng.randint(0, len(shared)), rng.randint(0, len(shared))))
        lines[at:at] = [f"  {x} " if rng.random() < 0.3 else x for x in shared[a:b]]
        out.append((k, "\n".join(lines) + "\n" * (k % 3), "en", "s", 0, "x", "y", "z"))
    out += [out[3], (None, out[5][1], *[None] * 6), (90, None, *[None] * 6), (91, "\n\n", *[None] * 6)]
    line = sentence(rng, 12)
    return out + [(92, "\n".join([line] * 30), *[None] * 6)]


def repeated_lines(given):
    """The line numbers of each document that stand in a run of 50 words with an earlier place."""
    signed = lambda t: (v := xxhash.xxh64_intdigest(t.encode(), 42)) - (1 << 64) * (v >> 63)
    whole = {}
    for r in given:
        text = r[1] or ""
        lines = [(i, x.strip()) for i, x in enumerate(text.split("\n")) if x.strip()]
        whole[(r[0] is not None, r[0] or 0, signed(text))] = (r, lines)
    keys = sorted(whole)
    must = defaultdict(set)
    for b in keys:
        lb = whole[b][1]
        for a in keys[: keys.index(b) + 1]:
            la = whole[a][1]
            for shift in range(-len(lb), len(la)):
                if a == b and shift >= 0:
                    continue
                run = []
                for p in range(len(lb) + 1):
                    if p < len(lb) and 0 <= p + shift < len(la) and lb[p][1] == la[p + shift][1]:
                        run.append(p)
                        continue
                    if sum(len(lb[q][1].split()) for q in run) >= 50:
                        must[b].update(lb[q][0] for q in run)
                    run = []
    return {k: (r, must[k]) for k, (r, _) in whole.items()}


def assert_lines(got, wanted):
    for r, gone in wanted.values():
        out = got[(r[0], r[4])]
        assert out.removed == len(gone)
        left = None if r[1] is None else "\n".join(x for i, x in enumerate(r[1].split("\n")) if i not in gone)
        assert out.text == left


def test_line_dedup_against_brute_force(spark):
    given = line_rows()
    got = {(r.doc_id, r.n_chars): r for r in drop_repeated_lines(docs(spark, given), removed_col="removed").collect()}
    assert intact(drop_repeated_lines(docs(spark, given)))
    assert len(drop_repeated_lines(docs(spark, given)).collect()) == len(given)
    wanted = repeated_lines(given)
    assert sum(len(gone) for _, gone in wanted.values()) > 30
    assert_lines(got, wanted)


def test_a_run_repeated_from_a_second_place_goes_whole(spark):
    """A holds four shared lines of ten words, B and C all five: C keeps none of them."""
    rng = random.Random(11)
    vocabulary = [f"w{k}" for k in range(5000)]
    given = []
    for g in range(30):
        shared = [" ".join(rng.choices(vocabulary, k=10)) for _ in range(5)]
        for k, part in enumerate((shared[:4], shared, shared)):
            own = [" ".join(rng.choices(vocabulary, k=7)) for _ in range(2)]
            given.append((3 * g + k, "\n".join([own[0], *part, own[1]]), *[None] * 6))
    out = {r.doc_id: r for r in drop_repeated_lines(docs(spark, given), removed_col="removed").collect()}
    assert [out[k].removed for k in range(90)] == [0, 0, 5] * 30


def test_line_dedup_is_linear_in_a_document(spark):
    import time

    rng = random.Random(3)
    took = []
    for n in (4000, 8000):
        lines = [" ".join(f"w{rng.randrange(9999)}" for _ in range(10)) for _ in range(n)]
        other = [x if k % 100 else "changed here" for k, x in enumerate(lines)]
        df = docs(spark, [(1, "\n".join(lines), *[None] * 6), (2, "\n".join(other), *[None] * 6)])
        start = time.perf_counter()
        out = {r.doc_id: r.removed for r in drop_repeated_lines(df, removed_col="removed").collect()}
        took.append(time.perf_counter() - start)
        assert out == {1: 0, 2: n - n // 100}
    assert took[1] < 2.5 * took[0] + 2


def test_long_passages_go_from_later_documents(spark):
    rng = random.Random(9)
    passage = [sentence(rng, 17) for _ in range(4)]
    given = [(k, "\n".join([sentence(rng, 8), *passage, sentence(rng, 8)]), *[None] * 6) for k in range(300)]
    out = drop_repeated_lines(docs(spark, given)).collect()
    for r in out:
        assert (passage[1] in r.text) == (r.doc_id == 0)
        assert len(r.text.split("\n")) == (6 if r.doc_id == 0 else 2)


def best_windows(text, item, k=5):
    w, v = (text or "").lower().split(), (item or "").lower().split()
    if not w or not v:
        return None
    k = min(k, len(v))
    grams = lambda x: Counter(tuple(x[i : i + k]) for i in range(len(x) - k + 1))
    g, best = grams(v), None
    for s in range(max(1, len(w) - len(v) + 1)):
        h = grams(w[s : s + len(v)])
        m = sum((g & h).values())
        j = m / (sum(g.values()) + sum(h.values()) - m) if h else 0
        if best is None or j > best[0] + 1e-12:
            best = (j, s)
    return best


def test_decontamination_against_brute_force(spark):
    rng = random.Random(2)
    vocabulary = [a + b for a in WORDS for b in WORDS]
    items = [(k, " ".join(rng.choices(vocabulary, k=n))) for k, n in enumerate([15, 20, 20, 33, 47, 59, 59, 3])]
    items += [(20, "ab ab ab ab ab ab ab ab ab ab ab ab ab ab ab ab ab ab ab ab"), (21, None), (22, " "), items[0]]
    texts = [None, "", "ab " * 40, "ab " * 18 + "xx ab"]
    for k in range(120):
        words = rng.choices(vocabulary, k=rng.randint(0, 80))
        part = items[k % 8][1].split()
        for _ in range(k % 4):
            part[rng.randrange(len(part))] = "changed"
        if k % 5 == 4:
            part = part[: int(len(part) * 0.87)]
            words = []
        at = rng.randint(0, len(words))
        texts.append(" ".join(words[:at] + part + words[at:]).replace(" ", "\n", 3).upper())
    given = [(k, t, *[None] * 6) for k, t in enumerate(texts)]
    given += [given[7], (None, given[8][1], *[None] * 6)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = {(r.doc_id, r.item_id): r for r in benchmark_matches(docs(spark, given), bench).collect()}
    want = {}
    for r in given:
        for i, t in items:
            if (b := best_windows(r[1], t)) and b[0] >= 0.8 - 1e-12:
                want[(r[0], i)] = b
    assert found.keys() == want.keys() and len(want) > 40
    for k, (j, s) in want.items():
        assert found[k].similarity == pytest.approx(j)
        assert found[k].start == s
    assert intact(drop_contaminated(docs(spark, given), bench))
    left = drop_contaminated(docs(spark, given), bench).collect()
    assert Counter(r.doc_id for r in left) == Counter(r[0] for r in given if not any((r[0], i) in want for i, _ in items))


def test_empty_tables(spark):
    none = docs(spark, [])
    bench = spark.createDataFrame([], "item_id long, text string")
    assert drop_repeated_lines(none).count() == 0
    assert benchmark_matches(none, bench).count() == 0
    assert drop_contaminated(docs(spark), bench).count() == len(rows())
    assert drop_contaminated(none, spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")).count() == 0


def test_preferences(spark):
    ddl = "pair_id long, turn int, role string, text string, part string, split string"
    x = lambda *r: tuple((*t, "clash", "clash") for t in r)
    chosen = x((1, 0, "system", "be kind"), (1, 1, "user", "hi"), (1, 2, "assistant", "good"), (1, 3, "user", "more"), (2, 0, "user", "a"), (3, 0, "user", "same"), (3, 1, "assistant", None), (None, None, None, "n"))
    rejected = x((1, 0, "system", "be kind"), (1, 1, "user", "hi"), (1, 2, "assistant", "bad"), (3, 0, "user", "same"), (3, 1, "assistant", ""), (4, 0, "assistant", "lone"))
    segments = preference_segments(spark.createDataFrame(chosen, ddl), spark.createDataFrame(rejected, ddl))
    texts = {r.pair_id: r for r in assembled(segments).collect()}
    turn = lambda role, text: f"<|im_start|>{role}\n{text}<|im_end|>\n"
    assert texts[1].prompt == turn("system", "be kind") + turn("user", "hi")
    assert texts[1].chosen == turn("assistant", "good") + turn("user", "more")
    assert texts[1].rejected == turn("assistant", "bad")
    assert (texts[2].prompt, texts[2].chosen, texts[2].rejected) == ("", turn("user", "a"), "")
    assert (texts[3].prompt, texts[3].chosen) == (turn("user", "same") + turn("assistant", ""), "")
    assert texts[4].rejected == turn("assistant", "lone") and texts[None].chosen == turn("", "n")
    for r in segments.collect():
        body = r.segment[r.loss_from : r.loss_from + r.loss_chars]
        trained = r.part != "prompt" and r.role == "assistant"
        assert body == (r.segment.split("\n", 1)[1] if trained else "")
    none = spark.createDataFrame([], ddl)
    assert preference_segments(none, none).count() == 0


def test_canonical_urls(spark):
    given = {
        "HTTPS://www.A.com:443/x/?b=2&utm_source=z&a=1#top": "a.com/x?a=1&b=2",
        "http://a.com/x?ref=q": "a.com/x",
        "a.com": "a.com",
        "": "",
    }
    got = spark.createDataFrame([(u,) for u in given], "url string").select("url", canonical_url(F.col("url")).alias("c")).collect()
    assert {r.url: r.c for r in got} == given


@pytest.mark.parametrize("bucket", [1, 7, 10**6])
def test_revisits(spark, bucket):
    ddl = "record_id long, url string, at long, kind string, http_status int, headers array<struct<name:string,value:string>>, payload_digest string, payload_bytes long, response string"
    rng = random.Random(4)
    given = []
    for k in range(400):
        url = rng.choice(["http://h.com/hot"] * 5 + [f"http://h.com/{rng.randint(0, 20)}", None])
        at = rng.choice([rng.randint(0, 100), rng.randint(0, 100), rng.randint(0, 100), None])
        tag = rng.choice([None, '"a"', 'W/"a"', '"b"'])
        changed = rng.choice([None, "mon", "tue"])
        headers = [(n, v) for n, v in (("ETag", tag), ("Last-Modified", changed), ("X-Own", str(k)), ("Cache-Control", f"max-age={k}")) if v is not None]
        kind = rng.choice(["response", "revisit"])
        given.append((k, url, at, kind, rng.choice([200, 200, 404]) if kind == "response" else 304, rng.choice([headers, headers, None]), f"d{k}", k, "clash"))
    got = {r.record_id: r for r in resolve_revisits(spark.createDataFrame(given, ddl), bucket).collect()}
    get = lambda r, n: next((v for k, v in r[5] or [] if k == n), None)
    assert len(got) == sum(r[3] == "revisit" for r in given)
    for r in given:
        if r[3] != "revisit":
            continue
        o = got[r[0]]
        earlier = [x for x in given if x[3] == "response" and x[4] == 200 and None not in (x[1], x[2], r[1], r[2]) and x[1] == r[1] and x[2] < r[2]]
        if not earlier:
            assert o.status == "missing" and o.response_id is None
            continue
        f = max(earlier, key=lambda x: (x[2], x[0]))
        assert o.response_id == f[0]
        weak = lambda t: t and t.removeprefix("W/")
        if get(r, "ETag"):
            want = "resolved" if weak(get(r, "ETag")) == weak(get(f, "ETag")) else "mismatch"
        elif get(r, "Last-Modified"):
            want = "resolved" if get(r, "Last-Modified") == get(f, "Last-Modified") else "mismatch"
        else:
            want = "unverified"
        assert o.status == want
        if want == "mismatch":
            assert o.headers is None and o.payload_digest is None
            continue
        merged = {k.lower(): v for k, v in f[5] or []} | {k.lower(): v for k, v in r[5] or [] if k != "X-Own"}
        assert o.headers == "\n".join(sorted(f"{k}: {v}" for k, v in merged.items()))
        assert (o.payload_digest, o.payload_bytes) == (f[6], f[7])


def ngram_losses(given, target, loo, models, scored=None):
    """(id, target loss, background loss) of each row, by plain counting."""
    marks = lambda t: ["<s>", *(t or "").lower().split(), "</s>"]
    held = {True: (Counter(), Counter()), False: (Counter(), Counter())}
    for r in given:
        w = marks(r[1])
        held[r[0] in target][0].update(w)
        held[r[0] in target][1].update(zip(w, w[1:], strict=False))
    vocabulary = models.vocabulary
    assert vocabulary == pytest.approx(len({w for words, _ in held.values() for w in words} - {"<s>"}), rel=0.03)
    out = []
    for r in given if scored is None else scored:
        w, losses = marks(r[1]), []
        for side in (True, False):
            words, pairs = (Counter(c) for c in held[side])
            if loo and (r[0] in target) == side:
                words.subtract(w)
                pairs.subtract(zip(w, w[1:], strict=False))
            n, loss = sum(v for k, v in words.items() if k != "<s>"), 0.0
            for a, b in zip(w, w[1:], strict=False):
                p = 0.9 * words[b] / n + 0.1 / vocabulary if n > 0 else 1 / vocabulary
                p = 0.7 * pairs[a, b] / words[a] + 0.3 * p if words[a] > 0 else p
                loss -= math.log(p)
            losses.append(loss / (len(w) - 1) if len(w) > 2 else 0.0)
        out.append((-1 if r[0] is None else r[0], *losses))
    return sorted(out)


@pytest.mark.parametrize("chunk", [64, 1 << 20])
def test_ngram_losses_against_brute_force(spark, monkeypatch, chunk):
    """Proper, matched models without a document's own counts; target ids mark like a column."""
    from turnloom.llm import lm_score

    monkeypatch.setattr(lm_score, "CHUNK_WORDS", chunk)
    rng = random.Random(4)
    names = [f"w{k}" for k in range(300)]
    texts = [" ".join(rng.choices(names, k=rng.randint(0, 90))) for _ in range(90)]
    given = [(k, t, *[None] * 6) for k, t in enumerate(texts)] + [(3, texts[3], *[None] * 6), (None, texts[7], *[None] * 6), (200, None, *[None] * 6), (201, "W1 w1\tw1", *[None] * 6)]
    target = set(range(0, 90, 3))
    df = docs(spark, given)
    by_column = fit_ngrams(df, F.col("doc_id") % 3 == 0 if chunk == 64 else F.col("doc_id").isin(sorted(target)))
    target = target if chunk > 64 else target | {201}
    ids = spark.createDataFrame([(k,) for k in [*sorted(target), 3, None, 999]], "doc_id long")
    by_id = fit_ngrams(df, F.lit(False), target_ids=ids)
    other = [(k, r[1], *[None] * 6) for k, r in enumerate(given[:20])] + [(50, "unseen words only", *[None] * 6)]
    cases = [(lm_score.score_counted(m), ngram_losses(given, target, True, m)) for m in (by_column, by_id)]
    cases.append((score_documents(docs(spark, other), by_id), ngram_losses(given, target, False, by_id, other)))
    for out, want in cases:
        got = sorted((-1 if r.doc_id is None else r.doc_id, r.target_loss, r.background_loss) for r in out.collect())
        assert len(got) == len(want)
        for a, b in zip(got, want, strict=True):
            assert a == pytest.approx(b, rel=1e-6, abs=1e-9)


def test_held_out_accuracy(spark):
    from turnloom.llm.queries import op4_quality, op7_language

    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    scored = [r for r in op4_quality(spark, SF).collect() if r.held_out and r.doc_id in labels]
    assert sum(r.predicted == labels[r.doc_id] for r in scored) / len(scored) > 0.93
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    named = [r for r in op7_language(spark, SF).collect() if r.held_out]
    assert sum(r.lang_pred == langs[r.doc_id] for r in named) / len(named) > 0.97


def test_language_against_brute_force(spark):
    """Counts and posteriors of a plain naive Bayes over the same buckets, held-out rows included."""
    from turnloom.llm.language import fit_language, gram_buckets, predict_language

    rng = random.Random(6)
    alphabets = {"aa": "abcde fgh", "bb": "defgh ij.", "cc": "äöüßab cd"}
    given = []
    for k in range(120):
        lang = rng.choice(sorted(alphabets))
        text = "".join(rng.choices(alphabets[lang], k=rng.choice([0, 1, 5, 40, 3000])))
        given.append((k, text, lang if k % 7 else None, *[None] * 5))
    given += [given[8], (500, None, "aa", *[None] * 5), (501, "12 34", "aa", *[None] * 5)]
    used = [r for r in given if r[1] is not None and r[2] is not None and r[0] % 3]
    buckets, counts, priors = 1 << 10, defaultdict(Counter), Counter()
    grams = lambda t: [int(x) for b in gram_buckets(t, buckets) for x in b]
    for r in used:
        priors[r[2]] += 1
        counts[r[2]].update(grams(r[1]))
    df = docs(spark, given)
    model = fit_language(df, F.col("doc_id") % 3 != 0, buckets=buckets)
    assert model.languages == tuple(sorted(priors))
    got = Counter((r.doc_id, r.lang_pred, round(r.score, 4)) for r in predict_language(df, model).collect())
    want = Counter()
    for r in given:
        if not any(c.isalpha() for c in r[1] or ""):
            want[(r[0], "und", 0.0)] += 1
            continue
        logs = {}
        for lang in sorted(priors):
            total = sum(counts[lang].values()) + 0.5 * buckets
            logs[lang] = math.log(priors[lang] / len(used)) + sum(math.log((counts[lang][g] + 0.5) / total) for g in grams(r[1]))
        best = max(sorted(logs), key=logs.get)
        want[(r[0], best, round(1 / sum(math.exp(v - logs[best]) for v in logs.values()), 4))] += 1
    assert got == want


@pytest.mark.parametrize("block", [1, 2, 7, 100])
def test_blocks_give_the_same_grams(block, monkeypatch):
    import numpy as np

    from turnloom.llm import language

    text = "Ab  12 cΣ dΣ, é..x" * 60 + "   "
    whole = np.concatenate(list(language.gram_buckets(text, 1 << 16)))
    monkeypatch.setattr(language, "BLOCK_CHARS", block)
    cut = np.concatenate(list(language.gram_buckets(text, 1 << 16)))
    assert Counter(cut.tolist()) == Counter(whole.tolist()) and len(whole) > 1000


def test_quality_against_brute_force(spark):
    """The whole fit and every score again, in plain Python."""
    import struct

    import zstandard as z

    from turnloom.llm import quality

    rng = random.Random(12)
    good, bad = [[w + x for w in WORDS] for x in ("ly", "zz")]
    given = [(k, " ".join(rng.choices(good if k % 2 else bad, k=rng.choice([3, 40, 40, 900]))), *[None] * 6) for k in range(240)]
    given += [(300, None, *[None] * 6), (301, "", *[None] * 6), given[4]]
    labels = {k: k % 2 for k in range(0, 240) if k % 5}
    ddl = "doc_id long, quality int, toxic int"
    df, marks = docs(spark, given), spark.createDataFrame([(k, q, 0) for k, q in labels.items()], ddl)
    limits = {"rows_per_class": 60, "chars_per_class": 60_000}
    model = quality.fit_quality(df, marks, F.col("doc_id") % 3 != 1, **limits)
    signed = lambda i: (v := xxhash.xxh64_intdigest(struct.pack("<q", i), 42)) - (1 << 64) * (v >> 63)
    texts, sample = {r[0]: r[1] for r in given}, {}
    for q in (0, 1):
        ids, held, sample[q] = sorted((i for i, v in labels.items() if v == q and i % 3 != 1), key=signed)[:60], 0, []
        for i in ids:
            if held + len(texts[i]) <= 60_000:
                held += len(texts[i])
                sample[q].append(texts[i].encode())
        assert 0 < len(sample[q]) < len(ids)
    dicts = {q: quality._dictionary(sample[q][::2], 112_640) for q in (0, 1)}

    def sizes(text):
        flags = {"level": 3, "write_content_size": False, "write_dict_id": False, "write_checksum": False}
        plain, of_good, of_bad = (len(z.ZstdCompressor(dict_data=d, **flags).compress(text)) for d in (None, z.ZstdCompressionDict(dicts[1]), z.ZstdCompressionDict(dicts[0])))
        d, ratio = (of_bad - of_good) / max(plain, 1), math.log((plain + 16) / (len(text) + 16))
        return (1.0, d, d * math.log1p(len(text)) / 8, ratio, max(0.0, -1.2 - ratio), math.log1p(len(text)) / 8)

    x, y = [sizes(t) for q in (0, 1) for t in sample[q][1::2]], [q for q in (0, 1) for _ in sample[q][1::2]]
    probability = lambda f: 1 / (1 + math.exp(-sum(a * b for a, b in zip(model.weights, f, strict=True))))
    for k in range(6):  # at the optimum of the penalised likelihood its gradient is zero
        gradient = sum((t - probability(f)) * f[k] for f, t in zip(x, y, strict=True)) - 1e-3 * model.weights[k]
        assert abs(gradient) < 1e-6
    got = Counter((r.doc_id, round(r.score, 6)) for r in quality.score_quality(df, model).collect())
    assert got == Counter((r[0], round(probability(sizes((r[1] or "").encode())), 6)) for r in given)


def test_models_on_awkward_rows(spark):
    from turnloom.llm.language import fit_language, predict_language
    from turnloom.llm.quality import fit_quality, score_quality

    df = docs(spark)
    labels = spark.createDataFrame([(r[0], r[0] % 2, 0) for r in rows() if r[0] is not None] + [(None, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int")
    for given in (df, docs(spark, [])):
        model = fit_quality(given, labels, F.lit(True))
        out = score_quality(df, model).collect()
        assert len(out) == len(rows()) and all(0 <= float(r.score) <= 1 for r in out)
        assert intact(score_quality(df, model))
        langs = fit_language(given, F.lit(True))
        out = predict_language(df, langs).collect()
        assert len(out) == len(rows()) and all(0 <= r.score <= 1 for r in out)
        assert all(r.lang_pred == "und" for r in out if r.doc_id in (0, 1, 2))
    assert score_quality(docs(spark, []), model).count() == predict_language(docs(spark, []), langs).count() == 0
    ngrams = fit_ngrams(docs(spark, []), F.lit(True))
    assert score_documents(df, ngrams).count() == len(rows())


def test_a_text_without_a_letter_is_undetermined(spark):
    from turnloom.llm.language import fit_language, predict_language

    train = spark.createDataFrame([(1, "the cat sat", "en"), (2, "der Hund lief", "de")], "doc_id long, text string, lang string")
    model = fit_language(train, F.lit(True))
    odd = spark.createDataFrame([(k, t) for k, t in enumerate(["²", "½ 3", "①", "12_", "", None, "a", "ä", "語"])], "doc_id long, text string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in predict_language(odd, model).collect()}
    assert all(got[k] == ("und", 0.0) for k in range(6)) and all(got[k][0] in ("en", "de") for k in (6, 7, 8))


def test_decontamination_finds_pairs_near_the_threshold(spark):
    """Planted windows with a similarity of 0.80 to 0.85, where fingerprints differ most: none may be lost."""
    rng = random.Random(17)
    vocabulary = [a + b for a in WORDS for b in WORDS]
    items, texts, near = [], [], []
    for k in range(300):
        item = rng.choices(vocabulary, k=rng.randint(40, 110))
        planted = list(item)
        while (best_windows(" ".join(planted), " ".join(item)) or (0, 0))[0] > 0.85:
            planted[rng.randrange(len(planted))] = f"changed{rng.randrange(10**6)}"
        items.append((k, " ".join(item)))
        texts.append((k, " ".join(rng.choices(vocabulary, k=30) + planted + rng.choices(vocabulary, k=30)), *[None] * 6))
        if best_windows(texts[-1][1], items[-1][1])[0] >= 0.8:
            near.append((k, k))
    found = {(r.doc_id, r.item_id) for r in benchmark_matches(docs(spark, texts), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert len(near) > 60 and found == set(near), (len(near), len(found & set(near)))


def test_decontamination_makes_no_runtime_filters(spark, tmp_path):
    """However large Spark takes the documents to be, no Bloom filter over items is carried in the plan."""
    rng = random.Random(2)
    words = [f"w{i}" for i in range(200)]
    text = " ".join(rng.choices(words, k=60))
    spark.createDataFrame([(1, text), (2, "other " * 30)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents")
    spark.createDataFrame([(7, " ".join(text.split()[10:40]))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark")
    d, b = (spark.read.parquet(f"{tmp_path}/{name}") for name in ("documents", "benchmark"))
    large = {"spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "0", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    for key, value in large.items():
        spark.conf.set(key, value)
    try:
        found = benchmark_matches(d, b)
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert [(r.doc_id, r.item_id, r.start) for r in found.collect()] == [(1, 7, 10)]
    finally:
        for key in large:
            spark.conf.unset(key)
    assert "might_contain" not in plan
