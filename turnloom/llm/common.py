"""Shared helpers of the training-data operators."""

from __future__ import annotations

import tempfile
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named columns (all when none are named) of one Parquet table of a dataset folder."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, which driver and executors share.

    A machine-local folder is made only where the session names none and runs in local mode.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="turnloom-checkpoint-"))
    return sc.getCheckpointDir()


def remove_folder(spark: SparkSession, path: str) -> None:
    """Remove a folder of the shared file system, if it is there."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


#: Shuffle files of a query go when it ends, not when the driver next happens to collect its garbage.
FILE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage through the shared folder; the shuffle files that led to it are not needed again and go at once."""
    spark = df.sparkSession
    shared_folder(spark)
    before = spark.conf.get(FILE_CLEANUP)
    spark.conf.set(FILE_CLEANUP, "true")
    try:
        return df.select("*").checkpoint()  # a plan of its own, as the setting is read when a plan is made
    finally:
        spark.conf.set(FILE_CLEANUP, before)


def tasks(spark: SparkSession) -> int:
    """Partitions for an explicit exchange: what the session asks of its own shuffles."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def private_names(df: DataFrame, *names: str) -> list[str]:
    """Column names made from ``names`` that no column of ``df`` bears, whatever its case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        own = f"__{name}"
        while own.lower() in taken:
            own += "_"
        taken.add(own.lower())
        out.append(own)
    return out


def listed(spark: SparkSession, schema: StructType, **columns: list) -> DataFrame:
    """A short list as rows of the plan itself; a list of tuples would start Python workers on the executors to turn it into rows."""
    return spark.createDataFrame(pa.table(columns, to_arrow_schema(schema)), schema)


#: Parts that the rows of a heavy key are dealt to.
PARTS = 32
#: A key is heavy above this many rows and above a ten-thousandth of all rows, so at most 10,000 keys are heavy.
HEAVY_ROWS = 1000


def heavy_keys(rows: DataFrame, key: str, total: int | None = None) -> list:
    """The heavy values of ``key``, at most 10,000, by the definition above."""
    total = rows.count() if total is None else total
    if total <= HEAVY_ROWS:
        return []
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return [r[0] for r in counts.filter((F.col("n") > HEAVY_ROWS) & (F.col("n") > total / 10_000)).select(key).collect()]


def spread_join(
    rows: DataFrame, keyed: DataFrame, key: str, how: str = "inner", keys: DataFrame | None = None, total: int | None = None, heavy: list | None = None
) -> DataFrame:
    """``rows`` joined with ``keyed``, which has one row per ``key``; a heavy key's rows are dealt to ``PARTS`` tasks.

    The list of heavy keys is bounded by its definition and broadcast; only their rows of ``keyed``
    are repeated. ``rows``, or ``keys`` if they hold the same keys, are read several times and should
    be checkpointed; ``total`` is their number, and ``heavy`` the list, where they are known.
    """
    heavy = heavy if heavy is not None else heavy_keys(rows if keys is None else keys, key, total)
    if not heavy:
        return rows.join(keyed, key, how)
    schema = keyed.select(key).withColumn("heavy", F.lit(True)).schema
    mark = F.broadcast(listed(rows.sparkSession, schema, **{key: heavy, "heavy": [True] * len(heavy)}))
    dealt = rows.join(mark, key, "left").withColumn("part", F.when(F.col("heavy"), F.pmod(F.xxhash64(*rows.columns), F.lit(PARTS))).otherwise(0).cast("int"))
    copies = F.when(F.col("heavy"), F.sequence(F.lit(0), F.lit(PARTS - 1))).otherwise(F.array(F.lit(0)))
    repeated = keyed.join(mark, key, "left").withColumn("part", F.explode(copies)).drop("heavy")
    return dealt.drop("heavy").join(repeated, [key, "part"], how).drop("part")


#: Rows of a small table up to which it is sent to all executors; more are joined by exchange.
SMALL_ROWS = 4096


def small_or_exchanged(df: DataFrame, rows: int, most: int = SMALL_ROWS) -> DataFrame:
    """``df`` with a broadcast hint where its counted ``rows`` are at most ``most``."""
    return F.broadcast(df) if rows <= most else df


def ranked(rows: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """``rows`` with ``rank``, the place from 0 in the group by ``order``, and ``members``, the group's size.

    Rows are range-partitioned by (group, order), so that a group may be of any size; a group's
    part in a partition begins where its parts before end. ``group`` columns hold no nulls, nulls in
    ``order`` come first; rows equal in all of these take any order among themselves. ``rows`` are
    read twice (for the ranges and for the rows): give a table or a checkpoint.
    """
    keys = [*group, *order]
    ranged = rows.repartitionByRange(tasks(rows.sparkSession), *keys).sortWithinPartitions(*keys)
    placed = checkpointed(ranged.withColumn("slot", F.monotonically_increasing_id()))  # partition number << 33, then the row's
    placed = placed.withColumn("part", F.shiftrightunsigned("slot", 33))
    counts = placed.groupBy("part", *group).agg(F.min("slot").alias("first_slot"), F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy(*group)
    before = F.sum("n").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = checkpointed(counts.select("part", *group, "first_slot", F.coalesce(before, F.lit(0)).alias("before"), F.sum("n").over(whole).alias("members")))
    joined = placed.join(small_or_exchanged(starts, starts.count()), ["part", *group])
    return joined.withColumn("rank", F.col("before") + F.col("slot") - F.col("first_slot")).drop("part", "slot", "first_slot", "before")


def group_key(column: Column) -> Column:
    """A value as text that is never null and sorts like it: null first, then by UTF-8 bytes."""
    return F.coalesce(F.concat(F.lit("="), column.cast("string")), F.lit(""))


def crc32_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id's decimal text modulo n; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def lane_sums(h: Column) -> list[Column]:
    """32 sums of a 64-bit hash column, each holding the set-bit counts of bits b and b + 32.

    A lane is 32 bits wide, so a group may hold up to 4 billion hashes.
    """
    mask = F.lit(0x0000000100000001).cast("long")
    return [F.sum(F.shiftrightunsigned(h, b).bitwiseAND(mask)).alias(f"lane{b}") for b in range(32)]


def majority_bits(n: Column) -> Column:
    """The SimHash of ``lane_sums`` columns: bit b is set if set in over half of n hashes."""
    low = F.lit(0xFFFFFFFF).cast("long")
    bits = []
    for b in range(32):
        lane = F.col(f"lane{b}")
        for bit, count in ((b, lane.bitwiseAND(low)), (b + 32, F.shiftrightunsigned(lane, 32))):
            value = (1 << bit) if bit < 63 else -(1 << 63)
            bits.append(F.when(count * 2 > n, F.lit(value).cast("long")).otherwise(F.lit(0).cast("long")))
    return reduce(lambda a, b: a.bitwiseOR(b), bits)
