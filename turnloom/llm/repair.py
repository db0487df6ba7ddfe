"""Repair of conversation structure by a bidirectional tight-arc DAG.

A node is a place between two rows and a state of the grammar ``(s?(ua)+)?`` of role initials; keep,
rerole and delete lead over a row, insert stays at its place. With the least costs from the start
(forward) and to the end (backward) an arc is *tight*, part of a cheapest repair, exactly if forward
cost, own cost and backward cost add up to the optimum. The repair follows the tight arcs from a
frontier of nodes and takes the least edit letter at each step; from one state a letter leads to one
state, so the frontier's next node is unique.

A conversation may be of any length: its rows are ranked by distributed ranges and dealt to blocks of
``block`` rows. A block is a 4 x 4 matrix of least costs; the costs at a block's borders are running
products of matrices, and the state in which the repair enters it a running composition of maps of
states, both made over a tree of blocks (``_running``). Conversations of one block, nearly all, take
one exchange.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, group_key, ranked, small_or_exchanged, spread_join

#: Rows of a block, and blocks (or groups of blocks) that one task takes in order.
BLOCK, FAN = 128, 256
KEEP_COST, ROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 0, 3, 4, 3, 3
#: What counts as blank: the space and the characters from tab to carriage return.
BLANK = " \t\n\v\f\r"
SENTENCE_END = ".!?"

#: The grammar: states are start, after s, after u, after ua; (state, initial) leads to a state.
NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
FINAL = (0, 3)
STATES = range(4)
INITIALS = "sua"
_FAR = 1 << 50
_START = (0, _FAR, _FAR, _FAR)

# A row's code is one letter: 3 x (place of its initial in INITIALS, or 3) + 0 fine, 1 truncated, 2 to be deleted.
_INSERTS = [(q, to, role) for (q, role), to in NEXT.items() if role != "s"]


def _arcs_over(code: str) -> tuple[tuple[str, int, int, int, str], ...]:
    """The arcs (letter, from, to, cost, new role's initial) over a row."""
    initial, fault = (INITIALS + "x")[(ord(code) - 97) // 3], (ord(code) - 97) % 3
    arcs = [("D", q, q, DELETE_COST, ".") for q in STATES]
    if fault < 2:
        more = TRUNCATED_COST * fault
        arcs += [("K", q, to, KEEP_COST + more, ".") for (q, role), to in NEXT.items() if role == initial]
        arcs += [("R", q, to, ROLE_COST + more, role) for q, to, role in _INSERTS if role != initial]
    return tuple(arcs)


_ARCS = {chr(97 + k): _arcs_over(chr(97 + k)) for k in range(12)}


def _relaxed(costs: list[int], backward: bool = False) -> list[int]:
    """Costs after any inserts at one place."""
    for _ in STATES:
        for q, to, _role in _INSERTS:
            a, b = (to, q) if backward else (q, to)
            costs[b] = min(costs[b], costs[a] + INSERT_COST)
    return costs


def _forward(codes: str, start) -> list[list[int]]:
    layers = [_relaxed(list(start))]
    for code in codes:
        costs = [_FAR] * 4
        for _letter, q, to, cost, _role in _ARCS[code]:
            costs[to] = min(costs[to], layers[-1][q] + cost)
        layers.append(_relaxed(costs))
    return layers


def _backward(codes: str, end) -> list[list[int]]:
    layers = [_relaxed(list(end), True)]
    for code in reversed(codes):
        costs = [_FAR] * 4
        for _letter, q, to, cost, _role in _ARCS[code]:
            costs[q] = min(costs[q], layers[-1][to] + cost)
        layers.append(_relaxed(costs, True))
    return layers[::-1]


def _end_costs() -> list[int]:
    return _relaxed([0 if q in FINAL else _FAR for q in STATES], True)


def _followed(codes: str, last: bool, ahead: list[list[int]], back: list[list[int]], entry: int) -> tuple[list[tuple[str, str, int, int]], int]:
    """The tight arcs of least letters from ``entry``: (letter, role, row, cost) each, and the state at the end."""
    best = min(a + b for a, b in zip(ahead[0], back[0], strict=True))
    taken, frontier, i = [], {entry}, 0
    while True:
        if i == len(codes) and (not last or any(q in FINAL and back[i][q] == 0 for q in frontier)):
            return taken, min(frontier)
        options = {}
        for q, to, role in _INSERTS:
            if q in frontier and ahead[i][q] + INSERT_COST + back[i][to] == best:
                options.setdefault("I", set()).add((to, role, INSERT_COST))
        for letter, q, to, cost, role in _ARCS[codes[i]] if i < len(codes) else ():
            if q in frontier and ahead[i][q] + cost + back[i + 1][to] == best:
                options.setdefault(letter, set()).add((to, role, cost))
        letter = min(options)
        (only,) = options[letter]
        taken.append((letter, only[1], i, only[2]))
        frontier, i = {only[0]}, i + (letter != "I")


def _edits(codes: str, last: bool, entry: int, before: tuple[int, ...], after: tuple[int, ...]) -> tuple[int, tuple[str, ...]]:
    """A block's cost and edits, each as letter, new role's initial and row."""
    taken, _ = _followed(codes, last, _forward(codes, before), _backward(codes, after), entry)
    return sum(t[3] for t in taken), tuple(f"{t[0]}{t[1]}{t[2]}" for t in taken)


def _matrix(codes: str) -> list[int]:
    """Least costs from each state before a block to each state after it."""
    return [c for q in STATES for c in _forward(codes, [0 if p == q else _FAR for p in STATES])[-1]]


def _map(codes: str, last: bool, before, after) -> list[int]:
    """Where the repair leaves a block for each state in which it may enter; -1 elsewhere."""
    ahead, back = _forward(codes, before), _backward(codes, after)
    best = min(a + b for a, b in zip(ahead[0], back[0], strict=True))
    return [_followed(codes, last, ahead, back, q)[1] if ahead[0][q] + back[0][q] == best else -1 for q in STATES]


def _through(state: list[int], matrix: list[int]) -> list[int]:
    return [min(min(state[q] + matrix[4 * q + to] for q in STATES), _FAR) for to in STATES]


def _through_back(state: list[int], matrix: list[int]) -> list[int]:
    return [min(min(matrix[4 * q + to] + state[to] for to in STATES), _FAR) for q in STATES]


def _product(a: list[int], b: list[int]) -> list[int]:
    return [c for q in STATES for c in _through(a[4 * q : 4 * q + 4], b)]


def _mapped(state: list[int], step: list[int]) -> list[int]:
    return [step[q] if q >= 0 else -1 for q in state]


def _running(
    blocks: DataFrame,
    start: list[int],
    apply: Callable[[list[int], list[int]], list[int]],
    combine: Callable[[list[int], list[int]], list[int]],
    fan: int,
    backward: bool = False,
) -> DataFrame:
    """(g, b, state): what ``start`` becomes through the values ``v`` of the blocks before (after) each one.

    ``combine`` is associative and agrees with ``apply``. No task takes more than ``fan`` blocks in a row:
    groups of them are combined first, a group's state comes from the same work over the groups.
    """
    schema = "g string, b long, state array<long>"

    def walk(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("b", ascending=not backward)
        state = [int(x) for x in rows["above"].iloc[0]] if "above" in rows else list(start)
        out = []
        for v in rows["v"]:
            out.append(state)
            state = apply(state, [int(x) for x in v])
        return pd.DataFrame({"g": rows["g"], "b": rows["b"], "state": out})

    def total(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        whole = None
        for v in rows.sort_values("b")["v"]:
            whole = [int(x) for x in v] if whole is None else combine(whole, [int(x) for x in v])
        return pd.DataFrame({"g": [key[0]], "b": [key[1]], "v": [whole]})

    most = blocks.agg(F.max("b")).first()[0] or 0
    if most < fan:
        return checkpointed(blocks.groupBy("g").applyInPandas(walk, schema))
    dealt = blocks.withColumn("group", F.floor(F.col("b") / fan).cast("long"))
    totals = checkpointed(dealt.groupBy("g", "group").applyInPandas(total, "g string, b long, v array<long>"))
    above = _running(totals, start, apply, combine, fan, backward).select("g", F.col("b").alias("group"), F.col("state").alias("above"))
    return checkpointed(dealt.join(above, ["g", "group"]).groupBy("g", "group").applyInPandas(walk, schema))


def _classified(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(g, conv, turn, role, text, head, digest, initial, fault); nulls in role and text are one space."""
    role, text = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" ")) for c in (role_col, text_col))
    rows = turns.select(group_key(F.col(f"`{conv_col}`")).alias("g"), F.col(f"`{conv_col}`").alias("conv"), F.col(f"`{turn_col}`").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    end = F.right(F.rtrim("text", F.lit(BLANK)), F.lit(1))
    initial = F.substring("role", 1, 1)
    number = F.lit(3)
    for k, c in enumerate(INITIALS):
        number = F.when(initial == c, k).otherwise(number)
    fault = F.when(end == "", 2).when(~end.isin(*SENTENCE_END), 1).otherwise(0)
    return rows.select("*", F.substring("text", 1, 32).alias("head"), F.xxhash64("text").alias("digest"), number.alias("initial"), fault.alias("fault"))


_ORDER = ["turn", "role", "head", "digest"]
_MEMBER = ["rank", "turn", "role", "text", "initial", "fault"]


def _blocks(rows: DataFrame, block: int) -> DataFrame:
    """(g, b, last, conv, members, again, before): ``again`` ranks the repeats, ``before`` is the row before the block."""
    member = F.struct(*_MEMBER)
    sizes = rows.groupBy("g").count()
    big = checkpointed(sizes.filter(F.col("count") > block).select("g"))
    n_big = big.count()
    few = small_or_exchanged(big, n_big)
    small = rows.join(few, "g", "left_anti") if n_big else rows
    small = small.repartition("g").withColumn("rank", F.row_number().over(Window.partitionBy("g").orderBy(*_ORDER)).cast("long") - 1)
    small = small.withColumn("repeat", F.row_number().over(Window.partitionBy("g", "role", "text").orderBy("rank")) > 1)
    nothing = F.lit(None).cast("struct<turn:long,initial:int>")
    one = small.groupBy("g").agg(F.max("conv").alias("conv"), F.array_sort(F.collect_list(member)).alias("members"), F.collect_list(F.when(F.col("repeat"), F.col("rank"))).alias("again"))
    one = one.select("g", F.lit(0).cast("long").alias("b"), F.lit(True).alias("last"), F.lit(False).alias("many"), "conv", "members", "again", nothing.alias("before"))
    if not n_big:
        return one
    placed = ranked(checkpointed(rows.join(few, "g", "left_semi")), ["g"], _ORDER)
    at = F.floor(F.col("rank") / block).cast("long")
    sized = [F.concat(F.octet_length(c).cast("string"), F.lit(":"), c) for c in ("g", "role", "text")]
    keyed = placed.select("g", "rank", F.sha2(F.concat(*sized), 256).alias("key"))
    keyed = checkpointed(keyed)
    firsts = keyed.groupBy("key").agg(F.min("rank").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("key", "first")
    repeats = spread_join(keyed, firsts, "key").filter("rank > first").select("g", at.alias("b"), F.col("rank").alias("repeat"))
    edges = placed.filter((F.col("rank") + 1) % block == 0).filter("rank + 1 < members").select("g", (at + 1).alias("b"), F.struct("turn", "initial").alias("edge"))
    own = placed.select("g", at.alias("b"), "conv", "members", member.alias("m"))
    every = own.unionByName(repeats, allowMissingColumns=True).unionByName(edges, allowMissingColumns=True)
    whole = every.groupBy("g", "b").agg(
        F.max("members").alias("n"), F.max("conv").alias("conv"), F.array_sort(F.collect_list("m")).alias("members"), F.collect_list("repeat").alias("again"), F.max("edge").alias("before")
    )
    last = (F.col("b") + 1) * block >= F.col("n")
    return one.unionByName(whole.select("g", "b", last.alias("last"), F.lit(True).alias("many"), "conv", "members", "again", F.col("before").cast("struct<turn:long,initial:int>").alias("before")))


def repaired_blocks(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", block: int = BLOCK, fan: int = FAN
) -> DataFrame:
    """The blocks of the conversations with their cheapest edits: (g, b, many, conv, members, again, before, cost, edits)."""
    blocks = checkpointed(_blocks(_classified(turns, conv_col, turn_col, role_col, text_col), block))
    code = "char(97 + 3 * x.initial + IF(array_contains(again, x.rank), 2, x.fault))"
    blocks = blocks.withColumn("codes", F.expr(f"array_join(transform(members, x -> {code}), '')"))
    end = _end_costs()
    many = blocks.filter("many").select("g", "b", "last", "codes")
    if many.isEmpty():
        entered = blocks.select("*", *(F.lit(None).cast(t).alias(c) for c, t in (("ahead", "array<long>"), ("back", "array<long>"), ("entry", "int"))))
    else:
        matrix = F.pandas_udf(lambda codes: codes.map(_matrix), "array<long>")
        steps = checkpointed(many.select("g", "b", "last", "codes", matrix("codes").alias("v")))
        values = steps.select("g", "b", "v")
        ahead = _running(values, list(_START), _through, _product, fan)
        back = _running(values, end, _through_back, _product, fan, backward=True)
        bordered = steps.drop("v").join(ahead.withColumnRenamed("state", "ahead"), ["g", "b"]).join(back.withColumnRenamed("state", "back"), ["g", "b"])
        mapped = F.pandas_udf(lambda codes, last, a, z: pd.Series([_map(c, bool(k), [int(i) for i in x], [int(i) for i in y]) for c, k, x, y in zip(codes, last, a, z, strict=True)]), "array<long>")
        bordered = checkpointed(bordered.withColumn("v", mapped("codes", "last", "ahead", "back")))
        entry = _running(bordered.select("g", "b", "v"), [0], _mapped, _mapped, fan).select("g", "b", F.get("state", F.lit(0)).cast("int").alias("entry"))
        borders = checkpointed(bordered.select("g", "b", "ahead", "back").join(entry, ["g", "b"]))
        entered = blocks.join(small_or_exchanged(borders, borders.count()), ["g", "b"], "left")

    @F.pandas_udf("struct<cost:long,edits:array<string>>")
    def edited(codes: pd.Series, last: pd.Series, entry: pd.Series, ahead: pd.Series, back: pd.Series) -> pd.DataFrame:
        known: dict[str, tuple[int, tuple[str, ...]]] = {}  # short conversations are much alike
        out = []
        for c, k, q, a, z in zip(codes, last, entry, ahead, back, strict=True):
            if a is None:
                out.append(known[c] if c in known else known.setdefault(c, _edits(c, True, 0, _START, tuple(end))))
            else:
                out.append(_edits(c, bool(k), int(q), tuple(map(int, a)), tuple(map(int, z))))
        return pd.DataFrame({"cost": [o[0] for o in out], "edits": [list(o[1]) for o in out]})

    solved = entered.withColumn("r", edited("codes", "last", "entry", "ahead", "back"))
    return solved.select("g", "b", "many", "conv", "members", "again", "before", "r.cost", "r.edits")


#: The role that an edit leaves (null where the row goes) and the text, in terms of the edit ``e`` and the block's ``members``.
_ROLE = "CASE WHEN left(e, 1) = 'D' THEN NULL WHEN substr(e, 2, 1) = 'u' THEN 'user' WHEN substr(e, 2, 1) = 'a' THEN 'assistant' ELSE get(members, int(substr(e, 3))).role END"
_TEXT = "CASE WHEN left(e, 1) = 'I' THEN '' ELSE get(members, int(substr(e, 3))).text END"


def repaired_turns(turns: DataFrame, conv_col: str = "conv_id", **options) -> DataFrame:
    """The turns after the repair, in order of (conversation, block, place): conv_col, block, place, edit, role, text.

    Deleted rows are left out; ``edit`` is K (kept), R (another role) or I (inserted, empty text). Awkward
    rows are treated as ``repair_conversations`` says.
    """
    blocks = repaired_blocks(turns, conv_col, **options)
    rows = blocks.select("conv", "b", "members", F.posexplode("edits").alias("place", "e"))
    out = rows.select(F.col("conv").alias(conv_col), F.col("b").alias("block"), "place", F.expr("left(e, 1)").alias("edit"), F.expr(_ROLE).alias("role"), F.expr(_TEXT).alias("text"))
    return out.filter("edit <> 'D'")


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One SHA-256 a conversation over its pieces in order; only the running hash is held."""
    import hashlib

    at, running, out = None, None, []
    for batch in batches:
        for g, piece in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if g != at:
                if at is not None:
                    out.append((at, running.hexdigest()))
                at, running = g, hashlib.sha256()
            else:
                running.update(b"\n")
            running.update(piece.as_py().encode())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*out, strict=True)], ["g", "sha"])
            out = []
    if at is not None:
        yield pa.RecordBatch.from_arrays([pa.array([at]), pa.array([running.hexdigest()])], ["g", "sha"])


def repair_conversations(turns: DataFrame, conv_col: str = "conv_id", **options) -> DataFrame:
    """One row per conversation: conv_col, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Rows go by turn (null first), role, the text's first characters and hash; equal rows follow each
    other. A null conversation id is one conversation; null role and text are one space. A row's first
    fault counts: blank, duplicate (role and text seen before in the conversation), truncated (the last
    character that is not blank ends no sentence). ``illegal`` counts neighbours whose role initials are
    not su, ua or au; ``gaps`` the turn numbers missing between least and greatest. ``cost`` and
    ``audit`` are those of the cheapest edits, of equal ones the least by ASCII; ``repaired_sha256`` is
    of the repaired ``role:text`` lines. Other columns are ignored; an empty table gives an empty result.
    The hash of a conversation is one pass over its text by nature: its blocks arrive as one piece each.
    """
    solved = repaired_blocks(turns, conv_col, **options)
    repeated = "array_contains(again, x.rank)"
    starts = "concat(IF(before IS NULL, '', string(before.initial)), array_join(transform(members, x -> string(x.initial)), ''))"
    turns_of = "filter(transform(members, x -> x.turn), t -> t IS NOT NULL)"
    piece = f"IF(exists(edits, e -> left(e, 1) <> 'D'), array_join(transform(edits, e -> concat({_ROLE}, ':', {_TEXT})), '\\n'), NULL)"
    counted = solved.select(
        "g",
        "b",
        "many",
        "conv",
        "cost",
        F.expr("size(filter(members, x -> x.fault = 2))").cast("long").alias("blank"),
        F.expr(f"size(filter(members, x -> x.fault <> 2 AND {repeated}))").cast("long").alias("duplicate"),
        F.expr(f"size(filter(members, x -> x.fault = 1 AND NOT {repeated}))").cast("long").alias("truncated"),
        F.expr(f"element_at(transform(array({starts}), s -> IF(length(s) < 2, 0, size(filter(sequence(1, length(s) - 1), k -> NOT substr(s, k, 2) IN ('01', '12', '21'))))), 1)").cast("long").alias("illegal"),
        F.expr(f"array_min({turns_of})").alias("low"),
        F.expr(f"array_max({turns_of})").alias("high"),
        F.expr(f"size(array_distinct({turns_of})) - IF(coalesce(array_contains({turns_of}, before.turn), false), 1, 0)").cast("long").alias("turns"),
        F.expr("array_join(transform(edits, e -> left(e, 1)), '')").alias("audit"),
        F.expr(piece).alias("piece"),
    )
    sums = ["blank", "duplicate", "truncated", "illegal", "turns", "cost"]
    columns = ["g", "conv", "low", "high", *sums, "audit"]
    empty = F.sha2(F.lit("").cast("binary"), 256)
    counted = checkpointed(counted)
    one = counted.filter("not many").select(*columns, F.coalesce(F.sha2("piece", 256), empty).alias("sha"))
    several = counted.filter("many")
    audit = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b", "audit"))), lambda x: x["audit"]), "")
    joined = several.groupBy("g").agg(F.max("conv").alias("conv"), F.min("low").alias("low"), F.max("high").alias("high"), *(F.sum(c).alias(c) for c in sums), audit.alias("audit"))
    pieces = several.filter("piece is not null").repartition("g").sortWithinPartitions("g", "b").select("g", "piece")
    hashes = pieces.mapInArrow(_hashed, "g string, sha string")
    many = joined.join(hashes, "g", "left").select(*columns, F.coalesce("sha", empty).alias("sha"))
    gaps: Column = F.when(F.col("high").isNull(), F.lit(0)).otherwise(F.col("high") - F.col("low") + 1 - F.col("turns")).cast("long")
    named = ["blank", "duplicate", "truncated", "illegal", "cost", "audit"]
    return one.unionByName(many).select(F.col("conv").alias(conv_col), gaps.alias("gaps"), *named, F.col("sha").alias("repaired_sha256"))
