"""Transcripts and authored calls."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

TURN = r"^(Nurse|Caller) -> (.*?)(?:\s*\|\|\s*(.*))?$"


def _lines(calls: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = calls.select(id_col, F.posexplode(F.split(text_col, r"\r?\n")).alias("pos", "line"))
    return rows.withColumn("line", F.trim("line")).filter("line <> ''")


def strict_turns(calls: DataFrame, id_col: str = "call_id", text_col: str = "transcript") -> DataFrame:
    """id, turn_id from 1, speaker, text, tags, label_error of 'Speaker -> text || tags' lines; a bad line is an error."""
    rows = _lines(calls, id_col, text_col)
    good = F.when(F.col("line").rlike(TURN), F.col("line")).otherwise(F.raise_error(F.concat(F.lit("not a turn: "), "line")))
    rows = rows.withColumn("line", good).withColumn("turn_id", F.row_number().over(Window.partitionBy(id_col).orderBy("pos")))
    tags = F.filter(F.transform(F.split(F.regexp_extract("line", TURN, 3), ","), lambda x: F.trim(x)), lambda t: t != "")
    parsed = rows.select(id_col, "turn_id", F.regexp_extract("line", TURN, 1).alias("speaker"), F.trim(F.regexp_extract("line", TURN, 2)).alias("text"), tags.alias("tags"))
    return parsed.withColumn("label_error", F.array_contains("tags", "label_error")).withColumn("tags", F.filter("tags", lambda t: t != "label_error"))


def lenient_turns(calls: DataFrame, id_col: str = "call_id", text_col: str = "transcript") -> DataFrame:
    """id, turn_id, speaker, text: a line that is no turn continues the turn before; a first one is the caller's."""
    simple = r"^(Nurse|Caller)\s*->\s*(.*)$"
    rows = _lines(calls, id_col, text_col).withColumn("starts", F.col("line").rlike(simple))
    w = Window.partitionBy(id_col).orderBy("pos")
    first = F.row_number().over(w) == 1
    rows = rows.withColumn("leads", F.col("starts") | first)
    rows = rows.withColumn("turn_id", F.sum(F.col("leads").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    said = F.when(F.col("starts"), F.trim(F.regexp_extract("line", simple, 2))).otherwise(F.col("line"))
    who = F.when(F.col("starts"), F.regexp_extract("line", simple, 1)).otherwise(F.lit("Caller"))
    turns = rows.groupBy(id_col, "turn_id").agg(F.array_sort(F.collect_list(F.struct("pos", said.alias("t"), who.alias("s")))).alias("l"))
    return turns.select(id_col, "turn_id", F.get("l", F.lit(0))["s"].alias("speaker"), F.array_join("l.t", " ").alias("text"))


@F.pandas_udf(StringType())
def yaml_to_json(texts: pd.Series) -> pd.Series:
    """YAML documents as JSON text; a document that cannot be read becomes an object with its error."""
    import yaml

    def one(text: str) -> str:
        try:
            return json.dumps(yaml.load(text, Loader=getattr(yaml, "CSafeLoader", yaml.SafeLoader)), default=str, ensure_ascii=False)
        except yaml.YAMLError as e:
            return json.dumps({"_error": str(e)})

    return texts.map(one)


def target_summary(gold: Column) -> Column:
    """An authored gold summary as JSON text without the ``covers`` lists of its bullets, all else as it was.

    Quotes inside JSON strings are escaped, so that the pattern meets keys alone.
    """
    covers = r'"covers"\s*:\s*(?:null|\[(?:\s*"(?:[^"\\]|\\.)*"\s*,?)*\s*\])'
    return F.regexp_replace(F.regexp_replace(gold, rf",\s*{covers}", ""), rf"(?<=\{{)\s*{covers}\s*,?\s*", "")


CALL = """call_id string, split string, setup map<string,string>, chief_complaint map<string,string>,
assessment array<map<string,string>>, response array<map<string,string>>, education array<map<string,string>>,
risk_flags array<map<string,string>>, transcript string, noise_events array<map<string,string>>, gold string, _error string"""


def whole_texts(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, value): one row per file, its whole text; for prompts, documents and notes alike."""
    files = spark.read.text(path, wholetext=True, pathGlobFilter=glob, recursiveFileLookup=True)
    return files.select(F.col("_metadata.file_path").alias("path"), "value")


def calls_of(documents: DataFrame, json_col: str = "raw") -> DataFrame:
    """One row per call of a column of JSON documents: nested, all scalars as text.

    Keys that the schema does not name stay in ``raw``, the whole document.
    """
    return documents.select(F.from_json(json_col, CALL).alias("c"), F.col(json_col).alias("raw")).select("c.*", "raw")


def authored_calls(spark: SparkSession, folder: str, split: str | None = None) -> DataFrame:
    """The calls of a folder (or of its ``split`` subfolder), one file each, as YAML or as JSON."""
    path = f"{folder}/{split}" if split else folder
    files = whole_texts(spark, path).withColumn("kind", F.lower(F.regexp_extract("path", r"\.([A-Za-z]+)$", 1)))
    documents = files.filter("kind = 'json'").select(F.col("value").alias("raw"))
    yaml_files = files.filter("kind IN ('yaml', 'yml')")
    return calls_of(documents.unionByName(yaml_files.select(yaml_to_json("value").alias("raw"))))


def listed_calls(documents: DataFrame, key: str = "examples", json_col: str = "raw") -> DataFrame:
    """The calls of documents that hold a list of them under ``key``, in the list's order (``place`` from 0)."""
    elements = F.from_json(F.get_json_object(json_col, f"$.{key}"), "array<string>")
    rows = documents.select(F.posexplode(elements).alias("place", "raw"))
    return rows.select("place", F.from_json("raw", CALL).alias("c"), "raw").select("place", "c.*", "raw")


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSONL table with a fixed schema; blank lines are no rows."""
    return spark.read.schema(schema).json(path)


def lexicon(spark: SparkSession, path: str) -> DataFrame:
    """(term) of a word list file; lines that begin with # are comments."""
    return spark.read.text(path).select(F.trim("value").alias("term")).filter((F.col("term") != "") & ~F.col("term").startswith("#"))


def optional(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, bool]:
    """A JSONL table and whether it exists: a stage that was not run is not one without rows."""
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    there = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)
    return (json_lines(spark, path, schema) if there else spark.createDataFrame([], schema)), there
