"""Jaccard similarity of texts' character n-grams against an index of few texts, which every task holds.

A gram is one number in the base of the index's alphabet, so a text's grams, their distinct number and
those that it shares with each indexed text are array operations. The alphabet has one more place, for
characters that no indexed text has: grams with it meet nothing, and only their number counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from turnloom.functions.text import char_grams
from turnloom.operators.relational import gram_jaccard

#: Texts and their characters up to which an index is held by the tasks; larger tables are joined.
INDEX_TEXTS, INDEX_CHARS = 4096, 4_000_000


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")


@dataclass
class GramIndex:
    """Distinct grams of the texts in order, and for each the texts that have it."""

    n: int
    alphabet: np.ndarray
    places: np.ndarray  # of each character in the alphabet, one past it for any other
    grams: np.ndarray
    starts: np.ndarray
    members: np.ndarray
    sizes: np.ndarray

    @classmethod
    def of(cls, texts: list[str], n: int) -> GramIndex | None:
        """None if the alphabet has too many characters for a gram to be one number."""
        alphabet = np.unique(np.concatenate([_codes(t) for t in texts] or [np.empty(0, "<u4")]))
        if (len(alphabet) + 1) ** n >= 2**63:
            return None
        # short numbers, where they do, are sorted in half the time
        kind = np.int32 if (len(alphabet) + 1) ** n < 2**31 else np.int64
        places = np.full(int(alphabet[-1]) + 2 if len(alphabet) else 1, len(alphabet), dtype=kind)
        places[alphabet] = np.arange(len(alphabet))
        empty = np.empty(0, dtype=kind)
        index = cls(n, alphabet, places, empty, empty, empty, empty)
        own = [index.of_text(t)[0] for t in texts]
        grams, members = np.concatenate([empty, *own]), np.repeat(np.arange(len(own)), [len(g) for g in own])
        order = np.argsort(grams, kind="stable")
        index.grams, first = np.unique(grams[order], return_index=True)
        index.starts, index.members = np.append(first, len(grams)), members[order]
        index.sizes = np.array([len(g) for g in own], dtype=np.int64)
        return index

    def of_text(self, text: str) -> tuple[np.ndarray, int]:
        """The distinct grams made of the alphabet alone, and the number of all distinct ones."""
        codes, base = _codes(text), len(self.alphabet) + 1
        if len(codes) < self.n or base == 1:
            return np.empty(0, dtype=self.places.dtype), len({text[k : k + self.n] for k in range(len(text) - self.n + 1)})
        place = self.places[np.minimum(codes, len(self.places) - 1)]
        known = place < base - 1
        many = len(codes) - self.n + 1
        key = np.zeros(many, dtype=self.places.dtype)
        for k in range(self.n):
            key = key * base + place[k : k + many]
        if known.all():
            key = np.unique(key)
            return key, len(key)
        whole = np.lib.stride_tricks.sliding_window_view(known, self.n).all(axis=1)
        return np.unique(key[whole]), len({text[k : k + self.n] for k in range(many)})

    def similar(self, text: str, threshold: float) -> tuple[np.ndarray, np.ndarray]:
        """The places of texts that share a gram and reach ``threshold``, and their similarity."""
        grams, size = self.of_text(text)
        if not len(grams) or not len(self.grams) or size * threshold > self.sizes.max() + 1e-9:
            return np.empty(0, dtype=np.int64), np.empty(0)
        at = np.minimum(np.searchsorted(self.grams, grams), len(self.grams) - 1)
        at = at[self.grams[at] == grams]
        lengths = self.starts[at + 1] - self.starts[at]
        ends = np.cumsum(lengths)
        met = self.members[np.arange(lengths.sum()) + np.repeat(self.starts[at] - (ends - lengths), lengths)]
        shared = np.bincount(met, minlength=len(self.sizes))
        jaccard = shared / np.maximum(self.sizes + size - shared, 1)
        found = np.flatnonzero((shared > 0) & (jaccard >= threshold))
        return found, jaccard[found]


def text_jaccard(a: DataFrame, b: DataFrame, a_id: str, b_id: str, text: str, threshold: float, n: int = 5) -> DataFrame:
    """(a_id, b_id, jaccard) of pairs at or above ``threshold`` by distinct n-grams of ``text``; no row of ``b`` is exchanged.

    Every row of ``b`` meets the index of ``a``, of any length of text; pairs without a shared gram, and null
    texts, are no pairs. More than ``INDEX_TEXTS`` rows or ``INDEX_CHARS`` characters of ``a``, or too large an
    alphabet, are joined by gram (``gram_jaccard``), with the same rows (for characters of one UTF-16 unit).
    """
    held = a.select(a_id, text).filter(F.col(text).isNotNull())
    rows, chars = held.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length(text)), F.lit(0))).first()
    index = None
    if rows <= INDEX_TEXTS and chars <= INDEX_CHARS:
        own = held.toArrow()
        index = GramIndex.of(own.column(1).to_pylist(), n)
    if index is None:
        x, y = (df.select(i, char_grams(F.col(text), n).alias("grams")) for df, i in ((a, a_id), (b, b_id)))
        return gram_jaccard(x, y, a_id, b_id, "grams", threshold)
    shared = a.sparkSession.sparkContext.broadcast((index, own.column(0).combine_chunks()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, ids = shared.value
        for batch in batches:
            found = [index.similar(t, threshold) if t else (np.empty(0, dtype=np.int64), np.empty(0)) for t in batch.column(1).to_pylist()]
            places = np.concatenate([np.empty(0, dtype=np.int64), *(p for p, _ in found)])
            rows = np.repeat(np.arange(len(found)), [len(p) for p, _ in found])
            values = np.concatenate([np.empty(0), *(j for _, j in found)])
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(places)), batch.column(0).take(pa.array(rows)), pa.array(values)], [a_id, b_id, "jaccard"])

    schema = StructType([StructField(a_id, a.schema[a_id].dataType), StructField(b_id, b.schema[b_id].dataType), StructField("jaccard", DoubleType())])
    return b.select(b_id, text).mapInArrow(run, schema)
