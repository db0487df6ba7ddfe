"""Language identification: multinomial naive Bayes over hashed character n-grams.

All labelled texts train the model: tasks count n-grams by language, the counts are summed in slices
of the bucket range, and one matrix of buckets by languages is broadcast. Texts are scored in sparse
batches: the n-grams of many texts are looked up and summed at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNKNOWN = "und"
BLOCK_CHARS = 1 << 18
#: N-grams scored at once.
BATCH_GRAMS = 1 << 20
SLICES = 16


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    log_prior: Any  # (languages,)
    log_prob: Any  # (buckets, languages), float32


def gram_buckets(text: str, buckets: int) -> Iterator[Any]:
    """Hashed buckets of the 1-, 2- and 3-grams of a lower-cased text's letters and blanks, in blocks.

    Runs of ASCII signs, digits and blanks are one separator. A block gives the n-grams that end in
    it, so the blocks' n-grams together are those of the whole text.
    """
    import numpy as np

    lowered, mix = text.lower(), np.uint64(0x9E3779B97F4A7C15)
    tail = np.zeros(0, dtype=np.uint64)  # the last two codes before the block
    for at in range(0, len(lowered), BLOCK_CHARS):
        codes = np.frombuffer(lowered[at : at + BLOCK_CHARS].encode("utf-32-le", "replace"), "<u4").astype(np.uint64)
        sign = (codes < 0x41) | ((codes > 0x5A) & (codes < 0x61)) | ((codes > 0x7A) & (codes < 0xAA))
        codes = np.where(sign, np.uint64(32), codes)
        last = np.concatenate([tail[-1:] if len(tail) else np.zeros(1, dtype=np.uint64), codes[:-1]])
        codes = codes[(codes != 32) | (last != 32)]
        joined = np.concatenate([tail, codes])
        out, h = [], np.zeros(len(joined), dtype=np.uint64)
        for n in (1, 2, 3):
            if len(joined) < n:
                break
            h = (h[: len(joined) - n + 1] + np.uint64(1)) * mix ^ joined[n - 1 :]
            x = h[max(0, len(tail) - n + 1) :] * mix
            out.append((x ^ (x >> np.uint64(32))) % np.uint64(buckets))
        tail = joined[-2:]
        yield np.concatenate(out).astype(np.int64) if out else np.zeros(0, dtype=np.int64)


def fit_language(
    docs: DataFrame,
    allowed: Column,
    buckets: int = 1 << 16,
    smoothing: float = 0.5,
    text_col: str = "text",
    lang_col: str = "lang",
) -> LanguageModel:
    """Fit on every whole text with a language for which ``allowed`` holds.

    Rows with a null text, language or condition are not used; empty texts count for the priors;
    repeated rows count each time; other columns are ignored. Without such rows the model knows no
    language. A task sends its counts, compressed, by language and slice of the buckets; the driver
    receives the sums, ``buckets`` numbers a language.
    """
    import numpy as np

    known = docs.filter(F.col(f"`{lang_col}`").isNotNull() & F.col(f"`{text_col}`").isNotNull() & allowed)
    rows = known.select(F.col(f"`{lang_col}`").cast("string").alias("lang"), F.col(f"`{text_col}`").alias("text"))
    names = ["lang", "slice", "n", "counts"]
    schema = "lang string, slice int, n long, counts binary"

    def packed(sums: dict[str, Any], n: dict[str, int]) -> pa.RecordBatch:
        import zstandard as z

        cells = [(lang, k, n[lang] if k == 0 else 0, z.compress(part.tobytes(), 1)) for lang, v in sums.items() for k, part in enumerate(np.array_split(v, SLICES))]
        types = (pa.string(), pa.int32(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*cells, strict=True), types, strict=True)], names)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, Any] = {}
        n: dict[str, int] = {}
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                mine = sums.setdefault(lang, np.zeros(buckets, dtype=np.int64))
                n[lang] = n.get(lang, 0) + 1
                for g in gram_buckets(text.as_py(), buckets):
                    mine += np.bincount(g, minlength=buckets)
        if sums:
            yield packed(sums, n)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard as z

        sums: dict[tuple[str, int], Any] = {}
        n: dict[tuple[str, int], int] = {}
        for b in batches:
            for lang, k, rows, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
                part = np.frombuffer(z.decompress(data), dtype=np.int64)
                sums[lang, k] = sums[lang, k] + part if (lang, k) in sums else part
                n[lang, k] = n.get((lang, k), 0) + rows
        if sums:
            cells = [(lang, k, n[lang, k], v.tobytes()) for (lang, k), v in sums.items()]
            types = (pa.string(), pa.int32(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*cells, strict=True), types, strict=True)], names)

    parts = rows.mapInArrow(count, schema).repartition("lang", "slice").mapInArrow(add, schema).collect()
    languages = tuple(sorted({p.lang for p in parts}))
    texts = np.zeros(len(languages))
    slices: dict[tuple[str, int], Any] = {}
    for p in parts:
        slices[p.lang, p.slice] = np.frombuffer(p.counts, dtype=np.int64)
        texts[languages.index(p.lang)] += p.n
    counts = np.array([np.concatenate([slices[lang, k] for k in range(SLICES)]) for lang in languages], dtype=float).reshape(len(languages), buckets)
    log_prob = np.log((counts + smoothing) / (counts.sum(axis=1, keepdims=True) + smoothing * buckets))
    return LanguageModel(languages, np.log(texts / max(1.0, texts.sum())), np.ascontiguousarray(log_prob.T, dtype=np.float32))


def predict_language(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) of every row and whole text, without an exchange.

    ``und`` with score 0 where the text is null or has no letter, or the model knows no language;
    else the likeliest language (of equal ones the first by name) with its posterior probability.
    Repeated rows are scored alike, an empty table gives an empty result, other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.log_prior, model.log_prob))  # buckets x languages numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        languages, log_prior, log_prob = shared.value
        buckets = len(log_prob)
        for b in batches:
            totals = np.tile(log_prior.astype(np.float64), (b.num_rows, 1))
            known = np.zeros(b.num_rows, dtype=bool)
            cells, owners, held = [], [], 0

            def flush() -> None:
                if cells:
                    g, row = np.concatenate(cells), np.repeat(owners, [len(c) for c in cells])
                    for k in range(len(languages)):
                        totals[:, k] += np.bincount(row, weights=log_prob[g, k], minlength=len(totals))

            for row, text in enumerate(b.column(1)):
                t = text.as_py()
                if not t or not languages or not any(c.isalpha() for c in t):  # Unicode categories L
                    continue
                known[row] = True
                for g in gram_buckets(t, buckets):
                    cells.append(g)
                    owners.append(row)
                    held += len(g)
                    if held >= BATCH_GRAMS:
                        flush()
                        cells, owners, held = [], [], 0
            flush()
            names = np.full(b.num_rows, UNKNOWN, dtype=object)
            scores = np.zeros(b.num_rows)
            if known.any():
                some = totals[known]
                p = np.exp(some - some.max(axis=1, keepdims=True))
                names[known] = np.array(languages, dtype=object)[p.argmax(axis=1)]
                scores[known] = p.max(axis=1) / p.sum(axis=1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double")
