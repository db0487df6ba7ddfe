"""Sinks: JSON lines, gated and fanned-out writes, checksum manifests, Markdown tables."""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def write_json_lines(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    """One compact JSON object a line; an earlier result at the path is replaced."""
    df.write.mode("overwrite").partitionBy(*partition_by).json(path)


def gated(findings: DataFrame, level: str = "ERROR") -> None:
    """Stop before a write if there is any finding of a level; one row is read at most."""
    if first := findings.filter(F.col("level") == level).head():
        raise ValueError(f"refused: {first.asDict()}")


def fan_out(df: DataFrame, folder: str, shapes: dict[str, list[Column]], partition_by: tuple[str, ...] = ()) -> None:
    """One table per shape (name: columns) from one pass over ``df``."""
    kept = df.persist()
    try:
        for name, columns in shapes.items():
            write_json_lines(kept.select(*columns, *partition_by), f"{folder}/{name}", partition_by)
    finally:
        kept.unpersist()


def checksums(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """(path, sha256) of the files below a folder, in order of path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(folder)
    return files.select("path", F.sha2("content", 256).alias("sha256")).orderBy("path")


def markdown(df: DataFrame, most: int = 1000) -> str:
    """A report table as Markdown. A table of over ``most`` rows is no report and is refused."""
    taken = df.limit(most + 1).collect()
    if len(taken) > most:
        raise ValueError(f"the table has over {most} rows")
    rows = [df.columns, ["---"] * len(df.columns), *taken]
    return "\n".join("| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows)


MANIFEST = "manifest.jsonl"


def _files(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark._jsc.hadoopConfiguration())


def _read_manifest(spark: SparkSession, folder: str) -> list[dict]:
    """What is published: one entry a system and table, so few."""
    target, fs = _files(spark, f"{folder}/{MANIFEST}")
    return [json.loads(r.value) for r in spark.read.text(f"{folder}/{MANIFEST}").collect()] if fs.exists(target) else []


def publish(spark: SparkSession, folder: str, system: str, tables: dict[str, DataFrame]) -> list[str]:
    """Replace all that is published of a system by ``tables``; the paths of what became stale are returned.

    New tables are written beside the old ones under a run of their own; then one rename swaps the
    manifest, so that a reader sees all of the old run or all of the new one; last, runs of this system
    that the manifest does not name any more are removed. A table that this run does not have (counters
    without a gold, say) is gone with it; other systems are not touched. One writer a folder at a time.
    """
    run = uuid.uuid4().hex
    kept = [e for e in _read_manifest(spark, folder) if e["system"] != system]
    for name, df in tables.items():
        path = f"{name}/system={system}/run={run}"
        df.write.mode("errorifexists").json(f"{folder}/{path}")
        kept.append({"system": system, "table": name, "path": path})
    new, fs = _files(spark, f"{folder}/{MANIFEST}.{run}")
    out = fs.create(new, True)
    out.write("".join(json.dumps(e) + "\n" for e in sorted(kept, key=lambda e: (e["table"], e["system"]))).encode())
    out.close()
    jvm = spark._jvm
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(new.toUri(), spark._jsc.hadoopConfiguration()).rename(new, _files(spark, f"{folder}/{MANIFEST}")[0], options)
    named, stale = {e["path"] for e in kept}, []
    for status in fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{folder}/*/system={system}/run=*")) or []:
        path = "/".join(str(status.getPath()).split("/")[-3:])
        if path not in named:
            fs.delete(status.getPath(), True)
            stale.append(path)
    return sorted(stale)


def published(spark: SparkSession, folder: str, table: str, schema: str) -> DataFrame:
    """A published table of all systems, with the column ``system``; without any entry an empty one."""
    paths = {e["system"]: f"{folder}/{e['path']}" for e in _read_manifest(spark, folder) if e["table"] == table}
    parts = [spark.read.schema(schema).json(p).withColumn("system", F.lit(s)) for s, p in sorted(paths.items())]
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], f"{schema}, system string")
