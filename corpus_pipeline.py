"""The corpus pipeline: quality, line deduplication, near-duplicates, decontamination, packing."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnloom.llm.common import private_names, remove_folder, shared_folder, table
from turnloom.llm.decontamination import drop_contaminated
from turnloom.llm.line_dedup import drop_repeated_lines
from turnloom.llm.packing import pack_documents
from turnloom.llm.quality import fit_quality, score_quality
from turnloom.llm.queries import tokenizer_path
from turnloom.llm.simhash import SIMILAR, drop_near_duplicates


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier does not reject, all columns.

    Null and empty texts are scored like any other, whole texts however long; repeated rows stay or
    go together; columns of any name keep their values; an empty table stays empty.
    """
    model = fit_quality(docs, table(spark, sf_dir, "labels", "doc_id", "quality"), F.lit(True))
    (held,) = private_names(docs, "score")
    own = {c: held for c in docs.columns if c.lower() == "score"}  # a column of the operator's name
    scored = score_quality(docs.withColumnsRenamed(own), model).filter(F.col("score") >= model.threshold).drop("score")
    return scored.withColumnsRenamed({v: k for k, v in own.items()}).select(*(f"`{c}`" for c in docs.columns))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the later places of repeated runs of 50 words; ``n_chars`` follows the text.

    Null texts stay null, a text may become empty; of equal places the first by id stays; repeated
    rows change alike; columns of any name keep their values; an empty table stays empty.
    """
    edited = drop_repeated_lines(docs)
    return edited.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else edited


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates (five-word shingles, similarity 0.8): the least id.

    Null texts count as empty, and documents without words are one class; of repeated rows one stays;
    whole texts count; columns of any name keep their values; an empty table stays empty.
    """
    return drop_near_duplicates(docs, SIMILAR)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.

    Null and empty texts hold none and stay; whole texts are searched; repeated rows stay or go
    together; columns of any name keep their values; without items, or without documents, nothing changes.
    """
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark", "item_id", "text"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences of 1024 tokens.

    Null texts count as empty: one piece with the end id alone. Overlong texts are cut into full
    windows; repeated rows are packed each time; other columns are left out; an empty table gives no piece.
    """
    return pack_documents(docs, tokenizer_path(), capacity=1024, end_id=0)


STAGES = [
    ("quality", quality),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: Compression, winnowing by hash, SimHash and tokenisation have no SQL form; tests/llm holds brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is a table in the shared folder, read by the next.

    A stage's table is removed once the next one's is written; the last is read by the result.
    """
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{name}")
            docs = spark.read.parquet(f"{folder}/{name}")
            if k:
                remove_folder(spark, f"{folder}/{STAGES[k - 1][0]}")
    return docs
