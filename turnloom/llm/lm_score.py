"""Cross-entropy difference of matched target and background n-gram models.

Words are lower-cased; a document is its words between a start and an end mark. Target and background
share no document: every document is counted, with all its words, in exactly one of the two. Both are
bigram models interpolated with unigrams and a uniform share over one vocabulary, of the same
weights, which do not depend on how much was counted; both sum to one within a hundredth,
as the vocabulary's size is an estimate. A document's own
counts are left out of the model that holds it. Its score is the mean over its words and its end of
the target model's loss less the background model's: lower is more like the target.

Words and pairs are counted exactly, each under its own 55-bit hash; the table grows with the input.
Documents are packed into chunks of about ``CHUNK_WORDS`` words. A chunk sends each of its distinct
keys once, with its counts, to the bucket of the key's first bits; a bucket adds up what all chunks
sent and answers each chunk with what the others counted, which is nothing for most keys and packs
well. A hot word is one key of each chunk like any other.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import groupby
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, private_names, tasks

CHUNK_WORDS = 1 << 20
#: Target ids up to which they are broadcast; more meet the documents by exchange.
BROADCAST_ROWS = 200_000
KEY_BITS = 56
#: Keys of the marks before and after a document.
START, END = 4, 2

CHUNKS = "chunk long, ids array<long>, data binary"
SENT = "bucket int, chunk long, keys binary, background binary, target binary"
SUMS = "bucket int, chunk long, background binary, target binary"


@dataclass(frozen=True)
class NgramModels:
    """The counted chunks, from which buckets sum the models' counts."""

    chunks: DataFrame
    sent: DataFrame  # the counts of each chunk by bucket
    bits: int  # of a bucket's number
    vocabulary: int  # distinct words and the end mark, within about a hundredth
    background_words: int  # with an end mark for each document
    target_words: int
    weight: float  # of the bigram estimate
    uniform: float  # share of the uniform distribution in the unigram estimate


def _pack(values: Any) -> bytes:
    """Integers as compressed planes of bytes."""
    import numpy as np
    import zstandard as z

    v = np.ascontiguousarray(values, dtype="<u8")
    return z.compress(v.view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def _unpack(data: bytes) -> Any:
    import numpy as np
    import zstandard as z

    planes = np.frombuffer(z.decompress(data), dtype=np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<u8").ravel()


def _chunks(docs: DataFrame, is_target: Column, id_col: str, text_col: str) -> DataFrame:
    """Chunks of whole documents; ``data`` holds targets, word numbers and word keys (even)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pickle

        import numpy as np
        import zstandard as z
        from pyspark import TaskContext
        from xxhash import xxh3_64_intdigest

        first = TaskContext.get().partitionId() << 32
        schema = pa.schema([("chunk", pa.int64()), ("ids", pa.list_(pa.int64())), ("data", pa.binary())])

        def packed(ids: list, targets: list, words: list, number: int) -> pa.RecordBatch:
            lengths = np.array([len(w) for w in words], dtype=np.int64)
            keys, at = np.unique(np.concatenate(words), return_inverse=True)
            common = np.argsort(-np.bincount(at, minlength=len(keys)), kind="stable")  # small numbers for common words
            rank = np.empty(len(keys), dtype=np.int64)
            rank[common] = np.arange(len(keys))
            data = z.compress(pickle.dumps((np.array(targets, dtype=bool), lengths, _pack(rank[at]), keys[common])), 1)
            return pa.RecordBatch.from_arrays([pa.array([first + number]), pa.array([ids], pa.list_(pa.int64())), pa.array([data])], schema=schema)

        ids, targets, words, size, number = [], [], [], 0, 0
        for b in batches:
            for i, target, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                w = (text.as_py() or "").lower().encode("utf-8", "replace").split()
                ids.append(i)
                targets.append(target)
                words.append(np.fromiter(map(xxh3_64_intdigest, w), dtype=np.uint64, count=len(w)) >> np.uint64(8) & np.uint64(2**64 - 2))
                size += len(w)
                if size >= CHUNK_WORDS or len(ids) >= CHUNK_WORDS:
                    yield packed(ids, targets, words, number)
                    ids, targets, words, size, number = [], [], [], 0, number + 1
        if ids:
            yield packed(ids, targets, words, number)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(is_target, F.lit(False)).alias("t"), F.col(text_col).alias("text"))
    return checkpointed(rows.mapInArrow(run, CHUNKS))


def _ngrams(data: bytes) -> tuple[Any, ...]:
    """A chunk's targets, lengths, keys, and each event's document and places among the keys.

    An event is a word or an end; its places are those of the word before it (or the start), of
    itself and of the pair. The keys are distinct and in order: words are even, pairs odd.
    """
    import pickle

    import numpy as np
    import zstandard as z

    targets, lengths, packed, words = pickle.loads(z.decompress(data))
    at = _unpack(packed).astype(np.int64)
    words = np.concatenate([words, np.array([START, END], dtype=np.uint64)])
    starts = np.cumsum(lengths + 2) - lengths - 2
    ends = starts + lengths + 1
    marked = np.empty(len(at) + 2 * len(lengths), dtype=np.int64)
    inner = np.ones(len(marked), dtype=bool)
    inner[starts] = inner[ends] = False
    marked[starts], marked[ends], marked[inner] = len(words) - 2, len(words) - 1, at
    before, after = np.delete(marked, ends), np.delete(marked, starts)
    mixed = words[before] * np.uint64(0x9E3779B97F4A7C15) ^ words[after]
    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    pairs, pair_at = np.unique(mixed >> np.uint64(64 - KEY_BITS) | np.uint64(1), return_inverse=True)
    keys = np.concatenate([words, pairs])
    order = np.argsort(keys)
    place = np.empty(len(keys), dtype=np.int64)
    place[order] = np.arange(len(keys))
    doc = np.repeat(np.arange(len(lengths)), lengths + 1)
    return targets, lengths, keys[order], doc, place[before], place[after], place[len(words) :][pair_at]


def _counted(keys: Any, chosen: Any, before: Any, after: Any, pair: Any) -> Any:
    """How often each key occurs in the chosen events; the start mark as often as a document begins."""
    import numpy as np

    starts = before[chosen & (keys[before] == START)]
    return np.bincount(np.concatenate([after[chosen], pair[chosen], starts]), minlength=len(keys))


def _by_bucket(chunks: DataFrame, bits: int, counted: bool) -> DataFrame:
    """One row per chunk and bucket that it has keys of; zero counts unless ``counted``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for b in batches:
            for row in range(b.num_rows):
                chunk, data = b.column(0)[row], b.column(1)[row]
                targets, _, keys, doc, *places = _ngrams(data.as_py())
                of_target = targets[doc]
                background, target = (_counted(keys, chosen & counted, *places) for chosen in (~of_target, of_target))
                bucket = (keys >> np.uint64(KEY_BITS - bits)).astype(np.int64)
                cuts = np.flatnonzero(np.diff(bucket, prepend=-1, append=1 << bits))
                out = []
                for start, stop in zip(cuts[:-1], cuts[1:], strict=True):
                    steps = np.diff(keys[start:stop], prepend=np.uint64(0))
                    out.append((int(bucket[start]), chunk.as_py(), _pack(steps), _pack(background[start:stop]), _pack(target[start:stop])))
                types = (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
                columns = list(zip(*out, strict=True)) or [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["bucket", "chunk", "keys", "background", "target"])

    return chunks.select("chunk", "data").mapInArrow(run, SENT)


def _summed(sent: DataFrame) -> DataFrame:
    """For each chunk named what the others counted of its keys."""

    def sums(bucket: int, rows: Iterable[tuple]) -> pa.RecordBatch:
        import numpy as np

        chunks, steps, background, target = zip(*(r[1:] for r in rows), strict=True)
        keys = [np.cumsum(_unpack(s), dtype=np.uint64) for s in steps]
        ends = np.cumsum([len(k) for k in keys])
        keys, at = np.unique(np.concatenate(keys), return_inverse=True)
        own = [np.concatenate([_unpack(p) for p in column]).astype(np.int64) for column in (background, target)]
        totals = [np.bincount(at, weights=c, minlength=len(keys)).astype(np.int64) for c in own]
        out: list[tuple] = []
        start = 0
        for chunk, end in zip(chunks, ends, strict=True):
            if chunk is not None:
                out.append((bucket, chunk, *(_pack(t[at[start:end]] - c[start:end]) for t, c in zip(totals, own, strict=True))))
            start = end
        types = (pa.int32(), pa.int64(), pa.binary(), pa.binary())
        columns = list(zip(*out, strict=True)) or [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["bucket", "chunk", "background", "target"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        for bucket, of_bucket in groupby(rows, key=lambda r: r[0]):
            yield sums(bucket, of_bucket)

    dealt = sent.repartition(tasks(sent.sparkSession), "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(run, SUMS)


def _totals(chunks: DataFrame) -> tuple[int, int, int]:
    """The vocabulary, and the events of the background and of the target."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pickle

        import numpy as np
        import zstandard as z

        for b in batches:
            for data in b.column(0):
                targets, lengths, _, words = pickle.loads(z.decompress(data.as_py()))
                events = [int((lengths + 1)[chosen].sum()) for chosen in (~targets, targets)]
                # each distinct word of the chunk on a row, the first of them with the events
                rest = np.zeros(max(len(words), 1) - 1, dtype=np.int64)
                columns = [pa.array(np.append(n, rest)) for n in events]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(words.view(np.int64) if len(words) else [None], pa.int64())], ["background", "target", "word"])

    rows = chunks.select("data").mapInArrow(run, "background long, target long, word long")
    found = rows.agg(F.approx_count_distinct("word", 0.01), F.sum("background"), F.sum("target")).first()
    return found[0] + 1, found[1] or 0, found[2] or 0


def fit_ngrams(
    docs: DataFrame,
    is_target: Column,
    weight: float = 0.7,
    uniform: float = 0.1,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_ids: DataFrame | None = None,
) -> NgramModels:
    """Count each document in the target model, if ``is_target`` holds or ``target_ids`` has its id, else in the background.

    Null texts count as empty, a null condition as false; repeated rows count each time. There are
    at least 1,024 buckets and eight for each shuffle partition; a task holds the keys of one bucket.
    """
    if target_ids is not None:
        own_id, own_mark = private_names(docs, "id", "mark")
        ids = checkpointed(target_ids.toDF(own_id).distinct()).withColumn(own_mark, F.lit(True))
        ids = F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids
        docs = docs.join(ids, F.col(f"`{id_col}`") == F.col(own_id), "left")
        is_target = F.coalesce(is_target, F.lit(False)) | F.coalesce(F.col(own_mark), F.lit(False))
    chunks = _chunks(docs, is_target, id_col, text_col)
    bits = max(10, (8 * tasks(docs.sparkSession) - 1).bit_length())
    return NgramModels(chunks, _by_bucket(chunks, bits, True), bits, *_totals(chunks), weight, uniform)


def _scored(chunks: DataFrame, sums: DataFrame, models: NgramModels, counted: bool) -> DataFrame:
    vocabulary, weight, uniform = models.vocabulary, models.weight, models.uniform
    background_words, target_words = models.background_words, models.target_words
    names = ["doc_id", "n_words", "target_loss", "background_loss", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for b in batches:
            for row in range(b.num_rows):
                ids, data, sums = (b.column(k)[row] for k in range(3))
                targets, lengths, keys, doc, before, after, pair = _ngrams(data.as_py())
                parts, mean = sums.as_py() or [], []
                # a document's own occurrences of each event's word before, word and pair
                own = [_occurrences(doc, x, len(keys)) for x in (before, after, pair)] if counted else [0, 0, 0]
                for column, total, mine in (("target", target_words, targets), ("background", background_words, ~targets)):
                    counts = np.concatenate([np.zeros(0), *(_unpack(p[column]) for p in parts)])
                    mine = mine & counted
                    counts = counts + _counted(keys, mine[doc], before, after, pair)
                    history, word, both = (counts[x] - mine[doc] * n for x, n in zip((before, after, pair), own, strict=True))
                    events = np.maximum(total - mine * (lengths + 1), 0)[doc]
                    p = np.where(events > 0, (1 - uniform) * word / np.maximum(events, 1) + uniform / vocabulary, 1 / vocabulary)
                    p = np.where(history > 0, weight * both / np.maximum(history, 1) + (1 - weight) * p, p)
                    loss = np.bincount(doc, weights=-np.log(p), minlength=len(lengths))
                    mean.append(np.where(lengths > 0, loss / (lengths + 1), 0.0))
                yield pa.RecordBatch.from_arrays([ids.values, *map(pa.array, (lengths, *mean, mean[0] - mean[1]))], names)

    asked = sums.groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("bucket", "background", "target"))).alias("sums"))
    rows = chunks.join(asked.hint("merge"), "chunk", "left").select("ids", "data", "sums")
    return rows.mapInArrow(run, "doc_id long, n_words long, target_loss double, background_loss double, score double")


def _occurrences(doc: Any, at: Any, keys: int) -> Any:
    """For each event how often its key stands at such a place of its document."""
    import numpy as np

    _, inverse, counts = np.unique(doc * keys + at, return_inverse=True, return_counts=True)
    return counts[inverse]


def score_counted(models: NgramModels) -> DataFrame:
    """``score_documents`` of the documents that ``models`` counted, each without its own counts."""
    return _scored(models.chunks, _summed(models.sent), models, True)


def score_documents(docs: DataFrame, models: NgramModels, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, target_loss, background_loss, score) of every row and whole text, which the models did not count.

    Losses are natural-log means per word and end; a text without words (or a null one) has 0 words,
    zero losses and score 0. A model that counted nothing is uniform. Repeated rows score alike, an
    empty table gives an empty result; other columns are ignored.
    """
    chunks = _chunks(docs, F.lit(False), id_col, text_col)
    counted = models.sent.withColumn("chunk", F.lit(None).cast("long"))
    return _scored(chunks, _summed(counted.unionByName(_by_bucket(chunks, models.bits, False))), models, False)
