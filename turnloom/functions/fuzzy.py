"""Ratcliff-Obershelp similarity, which has no built-in function: Arrow UDFs behind a native bound."""

from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType

from turnloom.functions import text as T


def ratio(a, b) -> float:
    return SequenceMatcher(None, a, b).ratio()


def best_window_ratio(quote: list[str], words: list[str]) -> float:
    """The best ratio of a word list with windows of its length, one less and one more."""
    if not quote or not words:
        return 0.0
    sizes = {max(1, len(quote) + d) for d in (-1, 0, 1)}
    windows = (words[i : i + n] for n in sizes for i in range(max(1, len(words) - n + 1)))
    return max(ratio(quote, w) for w in windows)


#: Characters are counted in this many bins.
_BINS = 64


def _counts(texts: list[str]) -> np.ndarray:
    """How often the characters of each bin stand in each text."""
    return np.array([np.bincount(np.frombuffer(t.encode("utf-32-le", "surrogatepass"), dtype="<u4") % _BINS, minlength=_BINS) for t in texts], dtype="int64").reshape(len(texts), _BINS)


def closest_spans(quotes: list[str | None], spans: list[str], normal: list[str], least: float) -> list[str | None]:
    """For each normalised quote the first span with the best ratio to it, if that reaches ``least``; null for null.

    Characters that two texts share, wherever they stand, bound the ratio. Spans are compared by falling
    bounds until none that is left can be as good as the best one.
    """
    if not spans or all(q is None for q in quotes):
        return [None] * len(quotes)
    counts, lengths = _counts(normal), np.array([len(n) for n in normal])
    matchers: dict[int, SequenceMatcher] = {}
    found: list[str | None] = []
    for q in quotes:
        if q is None:
            found.append(None)
            continue
        both = lengths + len(q)
        bounds = np.where(both > 0, 2.0 * np.minimum(counts, _counts([q])).sum(axis=1) / np.maximum(both, 1), 1.0)
        best, at = 0.0, None
        for k in np.argsort(-bounds, kind="stable").tolist():
            if bounds[k] < max(best, least):
                break
            if k not in matchers:
                matchers[k] = SequenceMatcher(None, "", normal[k])
            matchers[k].set_seq1(q)
            r = matchers[k].ratio()
            if at is None or r > best or (r == best and k < at):
                best, at = r, k
        found.append(spans[at] if at is not None and best >= least else None)
    return found


@F.pandas_udf(DoubleType())
def seq_ratio_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else ratio(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


@F.pandas_udf(DoubleType())
def best_ratio_udf(name: pd.Series, words: pd.Series) -> pd.Series:
    """The best ratio of a name with one of some words; 0 without any."""
    return pd.Series([max((ratio(n or "", w) for w in set(ws)), default=0.0) for n, ws in zip(name, words, strict=True)], dtype="float64")


@F.pandas_udf(DoubleType())
def window_ratio_udf(quote: pd.Series, text: pd.Series) -> pd.Series:
    return pd.Series([best_window_ratio((q or "").split(), (t or "").split()) for q, t in zip(quote, text, strict=True)], dtype="float64")


@F.pandas_udf(ArrayType(StringType()))
def closest_spans_udf(quotes: pd.Series, plain: pd.Series, exact: pd.Series, spans: pd.Series, normal: pd.Series, least: pd.Series) -> pd.Series:
    """The quotes; those that are not ``exact`` as the closest spans to their normalised form, if there are some."""

    def repaired(q, p, e, s, n, t: float) -> list[str | None] | None:
        if q is None or p is None or e is None or s is None:
            return q
        asked = [x if there is not None and not there else None for x, there in zip(p, e, strict=True)]
        return [old if new is None else new for old, new in zip(q, closest_spans(asked, list(s), list(n), t), strict=True)]

    return pd.Series([repaired(*x) for x in zip(quotes, plain, exact, spans, normal, least, strict=True)], dtype="object")


def may_reach(a: Column, b: Column, least: float) -> Column:
    """No pair below this bound can reach the ratio: matched characters are at most the shorter text."""
    return 2.0 * F.least(F.length(a), F.length(b)) / F.nullif(F.length(a) + F.length(b), F.lit(0)) >= least


def with_repaired_quotes(rows: DataFrame, name: str, quotes: Column, cited: Column, least: float = 0.6) -> DataFrame:
    """``rows`` with ``name``: quotes (an array) that are not in their cited text become the closest spans
    of one or two sentences, if close enough; else they stay.

    A text's sentences are split and normalised once, not for each quote. Lambda variables bind what
    lambdas use, and a generator binds the function's arguments.
    """
    plain = lambda c: T.normalize(T.collapse_spelled(c))
    # the last sentence has none to follow and stands there twice, of which the first one counts
    pair = lambda parts, s, i: F.array(s, F.concat_ws(" ", s, F.get(parts, i + 1)))
    spans = F.flatten(F.flatten(F.transform(F.array(T.sentences(cited)), lambda parts: F.transform(parts, lambda s, i: pair(parts, s, i)))))
    bind = lambda df, column: df.select("*", F.explode(F.array(column)).alias("__x"))
    parted = bind(rows, F.struct(quotes.alias("quotes"), F.transform(quotes, plain).alias("words"), plain(cited).alias("text"), spans.alias("spans")))
    exact = F.transform(F.array("__b"), lambda b: F.transform(b["words"], lambda q: (q == "") | T.padded_contains(b["text"], q)))
    whole = bind(parted.withColumnRenamed("__x", "__b"), F.struct(F.get(exact, F.lit(0)).alias("exact"), F.transform("__b.spans", plain).alias("normal")))
    done = whole.withColumn(name, closest_spans_udf("__b.quotes", "__b.words", "__x.exact", "__b.spans", "__x.normal", F.lit(least)))
    return done.drop("__b", "__x")
