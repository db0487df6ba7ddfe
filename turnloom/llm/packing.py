"""Packing of documents into training sequences by best-fit decreasing.

Tokenising and cutting need no exchange; only the small piece rows are rebalanced before packing,
so that a packing task sees many pieces. Ids come from the public tokenizer file named by a
parameter.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: White space as the tokenizer's own pattern understands it (Unicode White_Space).
_WS = "\t-\r \x85\xa0  -     　"
#: Where a run of white space begins the tokenizer always breaks, and its rules look no further back.
_BREAK = re.compile(f"(?<![{_WS}])[{_WS}]")
BLOCK_CHARS = 1 << 20
_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
_PACKED = _PIECES + ", sequence_id long, offset long"


class TextEncoder:
    """Token ids of whole texts as little-endian 32-bit bytes.

    ``path`` is a tokenizer's JSON file. Where the same vocabulary lies beside it as ranks (same
    name, ``.tiktoken``), the faster library that reads those is used; the ids are equal.
    """

    def __init__(self, path: str):
        import json
        import os

        ranks = os.path.splitext(path)[0] + ".tiktoken"
        if not os.path.exists(ranks):
            import numpy as np
            from tokenizers import Tokenizer

            os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
            tokenizer = Tokenizer.from_file(path)
            self.encode = lambda text: np.array(tokenizer.encode(text, add_special_tokens=False).ids)
            return
        import base64

        import public_tokenizers
        import tiktoken

        with open(path) as f:
            special = {t["content"]: t["id"] for t in json.load(f).get("added_tokens", [])}
        with open(ranks, "rb") as f:
            merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens=special)
        self.encode = lambda text: fast.encode_to_numpy(text, allowed_special="all")

    def __call__(self, text: str) -> bytes:
        if len(text) <= BLOCK_CHARS:
            return self.encode(text).astype("<u4").tobytes()
        out, at = [], 0
        while at < len(text):
            end = m.start() if (m := _BREAK.search(text, at + BLOCK_CHARS)) else len(text)
            out.append(self.encode(text[at:end]).astype("<u4").tobytes())
            at = end
        return b"".join(out)


class OpenWindows:
    """A segment tree over remaining capacities; leaf r counts the open windows with r tokens left."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.windows: list[list[int]] = [[] for _ in range(capacity + 1)]

    def add(self, left: int, window: int) -> None:
        self.windows[left].append(window)
        node = left + self.leaves
        while node:
            self.count[node] += 1
            node >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """The tightest open window with at least ``need`` left, removed: (left, window)."""
        count, node = self.count, need + self.leaves
        if not count[node]:
            while node > 1 and (node & 1 or not count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if count[2 * node] else 2 * node + 1
        left = node - self.leaves
        while node:
            count[node] -= 1
            node >>= 1
        return left, self.windows[left].pop()


def best_fit_decreasing(lengths: list[int], capacity: int) -> list[tuple[int, int]]:
    """(window, offset) of each piece, pieces taken from long to short, ties in the given order."""
    tree, placed, windows = OpenWindows(capacity), [(0, 0)] * len(lengths), 0
    for k in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        n = lengths[k]
        found = tree.take(n)
        if found is None:
            found, windows = (capacity, windows), windows + 1
        left, window = found
        placed[k] = (window, capacity - left)
        if left > n:
            tree.add(left - n, window)
    return placed


def _rows(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names = [x.split()[0] for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names)


def cut_documents(docs: DataFrame, tokenizer_path: str, capacity: int, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """Pieces of all documents: full windows first, then the rest; no exchange."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from zlib import crc32

        encode, step, end = TextEncoder(tokenizer_path), 4 * capacity, end_id.to_bytes(4, "little")
        for b in batches:
            out = []
            for i, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = encode(t.as_py() or "") + end
                for at in range(0, len(ids), step):
                    piece = ids[at : at + step]
                    out.append((i, at // 4, len(piece) // 4, crc32(piece), len(ids) // 4))
                if len(out) >= 20_000:
                    yield _rows(out, _PIECES)
                    out = []
            if out:
                yield _rows(out, _PIECES)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(cut, _PIECES)


def pack_documents(
    docs: DataFrame,
    tokenizer_path: str,
    capacity: int = 1024,
    end_id: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Pack documents into sequences of at most ``capacity`` ids; one row per piece.

    A document is its text's ids followed by ``end_id``; a null text counts as empty, so that every
    document has at least one piece. Overlong documents are cut into full windows and a rest; the
    rests are packed by best-fit decreasing. ``start`` counts the document's ids before the piece,
    ``offset`` the ids before it in its sequence, gapless from 0. Repeated rows are packed each on
    their own; other columns are ignored; an empty table gives an empty result. Sequence ids are
    unique, not consecutive: the packing task's number and a running number.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 36
        rows = [r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
        rows.sort(key=lambda r: (r[2], r[0] is not None, r[0] or 0, r[1]))
        places = best_fit_decreasing([r[2] for r in rows], capacity)
        out = [(*r, base + window, offset) for r, (window, offset) in zip(rows, places, strict=True)]
        for k in range(0, len(out), 50_000):
            yield _rows(out[k : k + 50_000], _PACKED)

    pieces = cut_documents(docs, tokenizer_path, capacity, end_id, id_col, text_col)
    return pieces.hint("rebalance").mapInArrow(pack, _PACKED)
