"""Merkle manifest of a dataset: higher-order SQL blocks, then a recursion over block roots.

Every row is a leaf; the rows of one group form a binary tree in the order of their ids, and the
groups' roots form the tree above. Leaves are ranked by distributed ranges and gathered into ordered
arrays of ``2 ** levels`` leaves; inside an array ``aggregate``, ``sequence``, ``transform`` and
``slice`` collapse all levels at once. The block roots are the leaves of the next round, so that a
group of N rows takes ``log(N) / levels`` rounds and no task holds more than a block. On the way
down each round hands its blocks' paths to the round below.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, group_key, ranked, small_or_exchanged

#: Levels of one block: 1024 leaves.
LEVELS = 10
_PATH = "array<struct<left:string,right:string>>"


def digest(*values: Column) -> Column:
    """SHA-256 of the values' texts one after another, as lower-case hex."""
    return F.sha2(F.concat(*values), 256)


def leaf_field(value: Column) -> Column:
    """A value's text in a leaf: ``-`` if null, else its UTF-8 byte count, ``:`` and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path lead to. Where a level's run has no sibling, the node alone is hashed."""
    return F.aggregate(path, leaf, lambda node, s: digest(F.coalesce(s["left"], F.lit("")), node, F.coalesce(s["right"], F.lit(""))))


def path_text(path: Column) -> Column:
    """The siblings of a path one after another, level by level."""
    return F.array_join(F.transform(path, lambda s: F.concat(F.coalesce(s["left"], F.lit("")), F.coalesce(s["right"], F.lit("")))), "")


def _collapsed(levels: int) -> str:
    """SQL: all levels of a block, from its nodes up; of a group of one block up to its root."""
    depth = f"IF(n > {1 << levels}, {levels}, IF(n > 1, length(bin(n - 1)), 0))"
    above = "transform(sequence(0, int((size(element_at(a, -1)) - 1) div 2)), j -> sha2(array_join(slice(element_at(a, -1), 2 * j + 1, 2), ''), 256))"
    nodes = "cast(array(transform(nodes, x -> x.node)) as array<array<string>>)"
    return f"aggregate(IF({depth} > 0, sequence(1, int({depth})), cast(array() as array<int>)), {nodes}, (a, k) -> concat(a, array({above})))"


def _with_paths(blocks: DataFrame, above: DataFrame, rows: int, levels: int) -> DataFrame:
    """The nodes of the blocks, one a row, with their whole paths and what ``above`` carries.

    A lambda variable binds the levels: the optimiser copies expressions, but not variables, into lambdas.
    """
    sibling = "get(get(v, l), {at})"
    step = (
        "struct(IF(shiftright(p, l) & 1 = 1, " + sibling.format(at="shiftright(p, l) - 1") + ", NULL) AS left, "
        "IF(shiftright(p, l) & 1 = 0, " + sibling.format(at="shiftright(p, l) + 1") + ", NULL) AS right)"
    )
    own = f"IF(size(v) > 1, transform(sequence(0, size(v) - 2), l -> {step}), cast(array() as {_PATH}))"
    each = f"transform(nodes, (x, p) -> struct(x AS x, {own} AS own))"
    members = f"element_at(transform(array({_collapsed(levels)}), v -> {each}), 1)"
    joined = blocks.join(small_or_exchanged(above, rows), ["g", "b"])
    spread = joined.select("g", "path", "subroot", "root", F.expr(f"inline({members})"))
    return spread.select("g", "x.*", F.concat("own", "path").alias("path"), "subroot", "root")


def _grown(leaves: DataFrame, carried: list[str], levels: int) -> tuple[list[tuple[DataFrame, int]], DataFrame]:
    """The rounds of blocks, each with its number of rows, and the root of each group.

    ``leaves`` has ``g``, ``rank``, ``n`` (the group's size), ``node`` and the carried columns.
    """
    rounds: list[tuple[DataFrame, int]] = []
    rows, extra = leaves, carried
    while True:
        keyed = rows.withColumn("b", F.shiftrightunsigned("rank", levels))
        nodes = F.array_sort(F.collect_list(F.struct("rank", "node", *extra))).alias("nodes")
        blocks = checkpointed(keyed.groupBy("g", "b").agg(F.max("n").alias("n"), nodes))
        count, most = blocks.agg(F.count(F.lit(1)), F.max("n")).first()
        rounds.append((blocks, count))
        root = F.expr(f"element_at(element_at({_collapsed(levels)}, -1), 1)").alias("node")
        rows = blocks.select("g", F.col("b").alias("rank"), F.ceil(F.col("n") / (1 << levels)).cast("long").alias("n"), root)
        if (most or 0) <= 1 << levels:
            return rounds, rows.select("g", "node")
        extra = []


def _lowered(rounds: list[tuple[DataFrame, int]], above: DataFrame, levels: int) -> DataFrame:
    """The leaves of the rounds with their paths, where ``above`` has one row (g, path, subroot, root) a group."""
    above = above.withColumn("b", F.lit(0).cast("long"))
    for k, (blocks, count) in reversed(list(enumerate(rounds))):
        nodes = _with_paths(blocks, above, count, levels)
        if k == 0:
            return nodes.drop("rank")
        above = nodes.select("g", F.col("rank").alias("b"), "path", "subroot", "root")
    raise AssertionError("a tree has a round")


def merkle_manifest(
    docs: DataFrame,
    id_col: str = "doc_id",
    group_col: str = "lang",
    field_cols: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"),
    carry: dict[str, Column] | None = None,
    levels: int = LEVELS,
) -> DataFrame:
    """One row per row of ``docs``: id, leaf, path, subroot, root, and the columns of ``carry``.

    ``leaf`` hashes ``field_cols`` in their order; ``path`` lists, level by level from the leaf over the
    group's root (``subroot``) to ``root``, the siblings before and after (``left``, ``right``; both null
    where a node is alone in its run). ``folded(leaf, path)`` equals ``root``. Groups ascend by the
    UTF-8 bytes of ``group_col``, a null group comes first; leaves ascend by id, null ids first, equal
    ids by leaf; repeated rows are leaves each. Null and empty values have different leaves; whole
    texts are hashed; other columns are ignored, whatever their names. An empty table gives an empty
    result. ``carry`` expressions over ``docs`` may not be named like a result column.
    """
    carry = carry or {}
    fields = [leaf_field(F.col(f"`{c}`")) for c in field_cols]
    leaves = docs.select(group_key(F.col(f"`{group_col}`")).alias("g"), F.col(f"`{id_col}`").alias("id"), digest(*fields).alias("node"), *(v.alias(k) for k, v in carry.items()))
    placed = ranked(checkpointed(leaves), ["g"], ["id", "node"]).withColumnRenamed("members", "n")
    rounds, subroots = _grown(placed, ["id", *carry], levels)
    tops = checkpointed(subroots.select(F.lit("").alias("g"), F.col("g").alias("name"), "node"))
    top_rounds, root = _grown(ranked(tops, ["g"], ["name"]).withColumnRenamed("members", "n"), ["name"], levels)
    start = root.select("g", F.expr(f"cast(array() as {_PATH})").alias("path"), F.lit(None).cast("string").alias("subroot"), F.col("node").alias("root"))
    above = _lowered(top_rounds, start, levels).select(F.col("name").alias("g"), "path", F.col("node").alias("subroot"), "root")
    return _lowered(rounds, above, levels).select(F.col("id").alias(id_col), F.col("node").alias("leaf"), "path", "subroot", "root", *carry)


def changed_leaf(field_cols: tuple[str, ...], changes: dict[str, Column], when: Column) -> Column:
    """The leaf of a row with some fields changed; null where ``when`` does not hold."""
    fields = [leaf_field(changes.get(c, F.col(f"`{c}`"))) for c in field_cols]
    return F.when(when, digest(*fields))
