"""Exact deduplication by content sort.

Sampled splitters range-partition the texts, Spark's external sort places equal texts next to
each other, and one streaming pass compares full neighbouring texts. The splitters are taken over
(first characters, content hash, id): the sample that Spark gathers on the driver is small whatever
the texts' length, and a text that fills a third of the table is spread over many ranges. A run of
equal texts that crosses a range border is joined by comparing the full texts at the border.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, tasks

PREFIX_CHARS = 32
_SCAN = "id long, pid int, run long, size long, top long, last boolean, edge_text string, sha string"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of equal texts in a sorted partition; only ids of the current run are held."""
    import hashlib

    from pyspark import TaskContext

    pid = TaskContext.get().partitionId()
    text: bytes | None = None
    ids: list[int | None] = []
    run, out = 0, []

    def flush(edge: bool) -> None:
        sha = hashlib.sha256(text).hexdigest()
        known = [i for i in ids if i is not None]
        top, size = max(known) if known else None, len(ids)
        for k, i in enumerate(ids):
            last = k == size - 1
            out.append((i, pid, run, size, top, last, text.decode() if edge and last else None, sha))

    def batch() -> pa.RecordBatch:
        columns = list(zip(*out, strict=True))
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    names = [x.split()[0] for x in _SCAN.split(", ")]
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.string(), pa.string()]
    for b in batches:
        keys = b.column("id").to_pylist()
        for i, t in zip(keys, b.column("text").cast(pa.binary()), strict=True):
            t = t.as_py()
            if t != text:
                if text is not None:
                    flush(run == 0)
                    run += 1
                text, ids = t, []
            ids.append(i)
        if len(out) >= 10_000:
            yield batch()
    if text is not None:
        flush(True)
    if out:
        yield batch()


def content_sort_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    normalize: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their normalised forms (``normalize``; none by default) are byte-equal;
    a null text counts as empty. The row with the largest id stays; null ids come first, and of
    rows with the same id and text exactly one stays. Other columns of ``docs`` are ignored. An
    empty table gives an empty result.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), (normalize(text) if normalize else text).alias("text"))
    keyed = rows.select("id", "text", F.substring("text", 1, PREFIX_CHARS).alias("head"), F.xxhash64("text").alias("digest"))
    ordered = keyed.repartitionByRange(tasks(spark), "head", "digest", "id").sortWithinPartitions("head", "digest", "text", "id")
    runs = checkpointed(ordered.select("id", "text").mapInArrow(_scan, _SCAN))

    # At most two runs of a partition touch a border: their number is bounded by the partitions.
    edges = runs.filter(F.col("edge_text").isNotNull())
    order = Window.orderBy("pid", "run")
    chain = edges.select("pid", "run", "size", "top", F.lag("pid").over(order).alias("ppid"), F.lag("run").over(order).alias("prun"))
    texts = edges.select("pid", "run", "edge_text")
    before = texts.select(F.col("pid").alias("ppid"), F.col("run").alias("prun"), F.col("edge_text").alias("before_text"))
    linked = chain.join(texts, ["pid", "run"]).join(before, ["ppid", "prun"], "left").select(
        "pid", "run", "size", "top", F.coalesce(F.col("edge_text") == F.col("before_text"), F.lit(False)).alias("same")
    )
    island = linked.select("pid", "run", "size", "top", "same", F.sum((~F.col("same")).cast("int")).over(order).alias("island"))
    whole = Window.partitionBy("island")
    fixed = island.select(
        "pid",
        "run",
        F.sum("size").over(whole).alias("all_size"),
        F.max("top").over(whole).alias("all_top"),
        (F.row_number().over(whole.orderBy(F.desc("pid"), F.desc("run"))) > 1).alias("continued"),
    )
    return runs.join(F.broadcast(fixed), ["pid", "run"], "left").select(
        F.col("id").alias("doc_id"),
        F.when(F.col("all_size").isNull(), F.col("top")).otherwise(F.col("all_top")).alias("keep_id"),
        F.coalesce("all_size", "size").alias("group_size"),
        (F.col("last") & ~F.coalesce("continued", F.lit(False))).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )
