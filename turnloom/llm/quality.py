"""Quality by compression: zstandard dictionaries built from good and from bad labelled text.

A text that resembles the good sample is smaller under the good dictionary than under the bad one.
The difference of the two sizes over the plain size, with the text's length, goes through a
logistic calibration fitted on labelled rows that built neither dictionary.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import listed


@dataclass(frozen=True)
class QualityModel:
    good: bytes
    bad: bytes
    weights: tuple[float, ...]
    threshold: float = 0.5


def _features(plain: int, good: int, bad: int, size: int) -> tuple[float, ...]:
    """A constant, the normalised difference alone and by length, and how far the text repeats itself."""
    from math import log, log1p

    d, ratio = (bad - good) / max(plain, 1), log((plain + 16) / (size + 16))
    return 1.0, d, d * log1p(size) / 8, ratio, max(0.0, -1.2 - ratio), log1p(size) / 8


class _Sizes:
    """Compressed sizes of a text: plain, under the good and under the bad dictionary."""

    def __init__(self, good: bytes, bad: bytes, level: int = 3):
        import zstandard as z

        flags = {"write_content_size": False, "write_dict_id": False, "write_checksum": False}
        self.plain = z.ZstdCompressor(level=level, **flags)
        self.dicts = []
        for content in (good, bad):
            d = z.ZstdCompressionDict(content)
            d.precompute_compress(level=level)
            self.dicts.append(z.ZstdCompressor(level=level, dict_data=d, **flags))

    def __call__(self, text: bytes) -> tuple[float, ...]:
        sizes = [len(c.compress(text)) for c in (self.plain, *self.dicts)]
        return _features(*sizes, len(text))


def _dictionary(samples: list[bytes], size: int) -> bytes:
    """A trained dictionary, or the samples themselves where there are too few to train on."""
    import zstandard as z

    try:
        return z.train_dictionary(size, samples).as_bytes()
    except z.ZstdError:
        return b"\n".join(samples)[-size:] or b"\n"


def _logistic(x: list[tuple[float, ...]], y: list[int]) -> tuple[float, ...]:
    """Newton steps on the ridge-penalised log-likelihood."""
    import numpy as np

    a, t = np.array(x), np.array(y, dtype=float)
    w, ridge = np.zeros(a.shape[1]), np.diag([1e-3] * a.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + ridge, a.T @ (t - p) - ridge @ w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in w)


def fit_quality(
    docs: DataFrame,
    labels: DataFrame,
    allowed: Column,
    rows_per_class: int = 1600,
    chars_per_class: int = 1600 << 12,
    dict_bytes: int = 112_640,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> QualityModel:
    """Fit on a bounded sample of labelled rows.

    Of each label, ``rows_per_class`` documents in the order of their ids' hash, whatever their
    length, among those for which ``allowed`` holds; from where they exceed ``chars_per_class``
    characters together, those are passed over that do not fit. So the task that fits holds at most
    ``2 * chars_per_class`` characters, and the driver their ids. Every other document of the sample builds the dictionaries,
    the rest calibrates. Rows with a null id, text or label are not used, and of repeated rows one;
    an id with both labels stands in both samples; other columns are ignored. Without rows of both
    labels every score is 0.5 or the share of good rows.
    """
    text = F.col(f"`{text_col}`")
    known = docs.filter(allowed & text.isNotNull()).select(F.col(f"`{id_col}`").alias("id"), F.length(text).alias("n"))
    marked = labels.filter("doc_id is not null and quality in (0, 1)").select(F.col("doc_id").alias("id"), F.col("quality").cast("int").alias("quality"))
    usable = known.join(marked.distinct(), "id").groupBy("id", "quality").agg(F.max("n").alias("n"))
    picked: dict[int, list[int]] = {}
    for q in (0, 1):
        first = usable.filter(F.col("quality") == q).orderBy(F.xxhash64("id"), "id").limit(rows_per_class).collect()  # bounded by the limit
        picked[q], held = [], 0
        for r in first:
            if held + r.n <= chars_per_class:
                picked[q].append(r.id)
                held += r.n
    ids = sorted({*picked[0], *picked[1]})
    wanted = listed(docs.sparkSession, StructType().add("id", "long"), id=ids)
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), text.alias("text"), allowed.alias("allowed")).filter("allowed and text is not null")
    found = rows.join(F.broadcast(wanted), "id", "left_semi").groupBy("id").agg(F.min("text").alias("text"))
    return _fitted(found, picked, dict_bytes)


def _fitted(found: DataFrame, picked: dict[int, list[int]], dict_bytes: int) -> QualityModel:
    """The model of the sample's texts (``id``, ``text``), built in one task: the sample is bounded, and the driver gets the model alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_id: dict[int, bytes] = {}
        for b in batches:
            by_id.update(zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), strict=True))
        texts = {q: [by_id[i] for i in picked[q]] for q in (0, 1)}
        dicts = {q: _dictionary(texts[q][::2], dict_bytes) for q in (0, 1)}
        sizes = _Sizes(dicts[1], dicts[0])
        y = [q for q in (0, 1) for _ in texts[q][1::2]]
        x = [sizes(t) for q in (0, 1) for t in texts[q][1::2]]
        weights = _logistic(x, y) if len(set(y)) == 2 else (0.0,) * 6
        yield pa.RecordBatch.from_arrays([pa.array([dicts[1]]), pa.array([dicts[0]]), pa.array([weights], pa.list_(pa.float64()))], ["good", "bad", "weights"])

    model = found.repartition(1).mapInArrow(run, "good binary, bad binary, weights array<double>").first()
    if model is None:  # no rows, so no task
        return QualityModel(b"\n", b"\n", (0.0,) * 6)
    return QualityModel(bytes(model.good), bytes(model.bad), tuple(model.weights))


def score_quality(docs: DataFrame, model: QualityModel, text_col: str = "text") -> DataFrame:
    """``docs`` with ``score`` (0 to 1, higher: good likelier) added or replaced, without an exchange.

    Whole texts are scored; a null text counts as empty; repeated rows are scored alike; an empty
    table gives an empty result. All other columns stay, a column of ``docs`` named ``score`` is replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.good, model.bad, model.weights))  # two dictionaries and six numbers
    rows = docs.drop("score")
    schema = rows.schema
    at = schema.fieldNames().index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from math import exp

        good, bad, weights = shared.value
        sizes = _Sizes(good, bad)
        for b in batches:
            scores = []
            for t in b.column(at).cast(pa.binary()):
                v = sum(w * f for w, f in zip(weights, sizes(t.as_py() or b""), strict=True))
                scores.append(1 / (1 + exp(-max(-40.0, min(40.0, v)))))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(scores, pa.float64())], [*b.schema.names, "score"])

    return rows.mapInArrow(run, type(schema)([*schema.fields]).add("score", "double"))
