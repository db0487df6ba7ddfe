"""Patches by path: rows (id, path, value) applied to JSON documents in one pass.

A document's patches are gathered (a document has few) and joined to it. Its text is read once, in an Arrow
UDF: containers on the way to a patch are opened, all else is skipped and keeps its text and its order of
keys. Native functions parse and write each level anew, which took ten times as long. The depth is
bounded by ``DEPTH``, a patch that goes deeper fails.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from json.decoder import scanstring

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

DEPTH = 5
#: Where an array's new last member goes.
APPEND = "-"
_PATCHES = "array<struct<path:array<string>,after:string,value:string>>"
_SPACE = re.compile(r"[ \t\n\r]*")

Patch = tuple[list[str], str | None, str | None]  # path, after, value
Scan = Callable[[str, int], tuple[object, int]]


def _skip(text: str, at: int) -> int:
    return _SPACE.match(text, at).end()


def _below(patches: list[Patch]) -> dict[str, list[Patch]]:
    """The patches below each key, without it."""
    out: dict[str, list[Patch]] = {}
    for (key, *path), after, value in patches:
        out.setdefault(key, []).append((path, after, value))
    return out


def _patched(scan: Scan, text: str, at: int, patches: list[Patch], depth: int = DEPTH) -> tuple[str | None, int]:
    """The JSON text of the value that begins at ``at`` after the patches on it and below, and where it ends."""
    whole = [p for p in patches if not p[0]]
    if patches and not whole:
        if depth == 0:
            raise ValueError(f"a patch goes deeper than {DEPTH} levels")
        if text[at] in "{[":
            return (_object if text[at] == "{" else _array)(scan, text, at, patches, depth)
    end = scan(text, at)[1]
    return whole[-1][2] if whole else text[at:end], end


def _object(scan: Scan, text: str, at: int, patches: list[Patch], depth: int) -> tuple[str, int]:
    mine, members = _below(patches), []
    at = _skip(text, at + 1)
    while text[at] != "}":
        start = at
        key, at = scanstring(text, at + 1, False)
        name = text[start:at]
        value, at = _patched(scan, text, _skip(text, _skip(text, at) + 1), mine.get(key, []), depth - 1)
        members.append((key, None if value is None else f"{name}:{value}"))
        at = _skip(text, at)
        at = _skip(text, at + 1) if text[at] == "," else at
    known = {k for k, _ in members}
    new = {path[0]: (after, value) for path, after, value in patches if len(path) == 1 and path[0] not in known}
    behind: dict[str | None, list[str | None]] = {}
    for key, (after, value) in new.items():
        # a new key follows the key that it names, or the new key before it, which follows one
        anchor = after if after in known else new.get(after, (None,))[0]
        behind.setdefault(anchor if anchor in known else None, []).append(None if value is None else f"{json.dumps(key, ensure_ascii=False)}:{value}")
    parts = [x for key, member in members for x in (member, *behind.get(key, []))] + behind.get(None, [])
    return "{" + ",".join(x for x in parts if x is not None) + "}", at + 1


def _array(scan: Scan, text: str, at: int, patches: list[Patch], depth: int) -> tuple[str, int]:
    mine, parts = _below(patches), []
    at = _skip(text, at + 1)
    while text[at] != "]":
        value, at = _patched(scan, text, at, mine.get(str(len(parts)), []), depth - 1)
        parts.append(value)
        at = _skip(text, at)
        at = _skip(text, at + 1) if text[at] == "," else at
    parts += [value for path, _, value in patches if path == [APPEND]]
    return "[" + ",".join(x for x in parts if x is not None) + "]", at + 1


def patched_texts(texts: list[str | None], patches: list[list[Patch] | None]) -> list[str | None]:
    """Each text of a JSON value after its patches; null for null."""
    # only ends of values are asked for: numbers stay text, of any length
    scan = json.JSONDecoder(parse_int=str, parse_float=str, parse_constant=str, strict=False).scan_once
    return [None if t is None else _patched(scan, t, _skip(t, 0), p)[0] for t, p in zip(texts, patches, strict=True)]


@F.arrow_udf(StringType())
def _patched_udf(texts: pa.Array, patches: pa.Array) -> pa.Array:
    rows = [ps and [(p["path"], p.get("after"), p.get("value")) for p in json.loads(ps)] for ps in patches.to_pylist()]
    return pa.array(patched_texts(texts.to_pylist(), rows), pa.string())


def apply_patches(documents: DataFrame, patches: DataFrame, ids: list[str], json_col: str) -> DataFrame:
    """``documents`` with the patched text in ``json_col``, and ``patches`` (their number) added.

    ``patches``: ids, ``ord`` (their order), path (array of keys and indices; ``-`` appends to an array),
    value (JSON text), after (the key behind which a new key goes; null: at the end). A path's last
    patch wins; a patch of a missing parent or index, or below a plain value, changes nothing. Documents without patches, null
    ones and texts that are no objects stay byte for byte. Ids are not null.
    """
    entry = F.struct("ord", "path", "after", "value")
    gathered = patches.groupBy(*ids).agg(F.array_sort(F.collect_list(entry)).alias("__p"))
    plain = F.transform("__p", lambda p: F.struct(p["path"].alias("path"), p["after"].alias("after"), p["value"].alias("value")))
    rows = documents.join(gathered.select(*ids, plain.cast(_PATCHES).alias("__p")), ids, "left")
    is_object = F.col("__p").isNotNull() & F.rlike(json_col, F.lit(r"^[ \t\r\n]*\{")) & F.try_parse_json(json_col).isNotNull()
    rows = rows.withColumn("__t", F.when(is_object, F.col(json_col)))
    text = F.when(F.col("__t").isNotNull(), _patched_udf("__t", F.to_json("__p"))).otherwise(F.col(json_col))
    return rows.withColumn(json_col, text).withColumn("patches", F.coalesce(F.size("__p"), F.lit(0))).drop("__p", "__t")
