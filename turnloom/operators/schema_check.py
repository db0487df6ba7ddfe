"""Closed-schema check of JSON summaries, and the order of their keys.

A summary is walked level by level inside its row: every node is a struct of its kind, path, type,
variant and raw text, and the next level is the array of all children. Nothing is shuffled and no
Python runs; the depth is that of the schema. Raw text keeps the order of keys, variants keep types.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnloom.operators.relational import spread

# The keys of a summary in their order, with the kind of each value.
OBJECTS = {
    "top": {
        "not_applicable": "not_applicable", "identity": "identity", "chief_complaint": "chief",
        "assessment": "bullets", "response": "bullets", "education": "bullets", "risk_flags": "flags",
    },
    "not_applicable": {"is_na": "boolean", "reason": "text or null"},
    "identity": {
        "patient_name": "field", "patient_dob": "field", "caller_name": "field",
        "relationship": "plain field", "callback_phone": "field", "patient_pronoun": "text or null",
    },
    "field": {"value": "text or null", "certainty": "certainty", "heard_as": "texts", "turns": "integers"},
    "plain field": {"value": "text or null", "certainty": "certainty", "turns": "integers"},
    "chief": {"reason": "text", "speaker": "speaker", "turns": "integers", "quote": "text", "explanation": "text"},
    "bullet": {"text": "text", "speaker": "speaker", "turns": "integers", "quote": "text", "explanation": "text", "facts": "facts"},
    "fact": {
        "type": "fact type", "name": "any", "value": "any", "strength": "any", "action_type": "any", "dose": "any",
        "item": "any", "unit": "any", "education_type": "any", "text": "any", "route": "any", "present": "any",
        "frequency": "any", "prn": "any", "severity": "any", "location": "any", "onset": "any", "status": "any",
        "med_name": "any", "duration": "any", "last_dose": "any", "supply": "any", "medication": "any",
        "timeframe": "any", "target": "any", "med_status": "any", "heard_as": "texts", "certainty": "fact certainty",
    },
    "flag": {"category": "category", "turns": "integers", "quote": "text"},
}
# Required keys, members of arrays, allowed values and JSON types.
REQUIRED = {
    "top": ("not_applicable", "identity", "assessment", "response", "education", "risk_flags"),
    "not_applicable": ("is_na", "reason"),
    "identity": ("patient_name", "patient_dob", "caller_name", "relationship", "callback_phone"),
    "field": ("value", "certainty", "turns"),
    "plain field": ("value", "certainty", "turns"),
    "chief": ("reason", "speaker", "turns", "quote", "explanation"),
    "bullet": ("text", "speaker", "turns", "quote", "explanation", "facts"),
    "fact": ("type", "certainty"),
    "flag": ("category", "turns", "quote"),
}
ARRAYS = {"bullets": "bullet", "facts": "fact", "flags": "flag", "texts": "text", "integers": "integer"}
VALUES = {
    "certainty": ("stated", "unclear", "not_stated"),
    "fact certainty": ("stated", "unclear"),
    "speaker": ("Caller", "Nurse"),
    "category": ("uncontrolled_symptom", "medication_concern", "suicidal_statement", "breathing_concern", "escalation_request", "other_urgent"),
    "fact type": ("symptom", "pertinent_negative", "medication", "vital", "action", "education", "context", "supply"),
}
TYPES = {
    "text": ("string",),
    "text or null": ("string", "null"),
    "boolean": ("boolean",),
    "integer": ("integer",),
    "any": ("string", "integer", "number", "boolean", "null"),
}

#: Nodes of one kind for the order of keys: both kinds of identity fields count as one.
ORDER_KINDS = {"plain field": "field"}
DEPTH = 6


def _literal_map(entries: dict[str, Column]) -> Column:
    return F.create_map(*chain.from_iterable((F.lit(k), v) for k, v in entries.items()))


def _texts(values: tuple[str, ...]) -> Column:
    return F.array(*map(F.lit, values))


_ALLOWED = {**TYPES, **dict.fromkeys(VALUES, ("string",)), **dict.fromkeys(ARRAYS, ("array",)), **dict.fromkeys(OBJECTS, ("object",))}


def _type_of(v: Column) -> Column:
    """The JSON type of a variant; an integer is a number written without a fraction."""
    name = F.schema_of_variant(v)
    whole = name.isin("BIGINT", "INT", "SMALLINT", "TINYINT") | name.rlike(r"^DECIMAL\(\d+,0\)$")
    return (
        F.when(name.startswith("OBJECT"), "object").when(name.startswith("ARRAY"), "array").when(name == "STRING", "string")
        .when(name == "BOOLEAN", "boolean").when(name == "VOID", "null").when(whole, "integer").otherwise("number")
    )


def _node(kind: Column, owner: Column, path: Column, key: Column, v: Column, t: Column) -> Column:
    return F.struct(kind.alias("kind"), owner.alias("owner"), path.alias("path"), key.alias("key"), _type_of(v).alias("type"), v.alias("v"), t.alias("t"))


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _children(n: Column) -> Column:
    """The values of an object's keys, in the order of the text, or the members of an array."""
    kinds = _literal_map({f"{kind}.{k}": F.lit(v) for kind, keys in OBJECTS.items() for k, v in keys.items()})
    members = _literal_map({k: F.lit(v) for k, v in ARRAYS.items()})
    of_key = lambda e, o: _node(F.try_element_at(kinds, F.concat(n["kind"], F.lit("."), e["key"])), n["path"], F.concat(n["path"], F.lit("."), e["key"]), e["key"], F.try_element_at(o, e["key"]), e["value"])
    keyed = _bound(F.try_variant_get(n["v"], "$", "map<string,variant>"), lambda o: F.transform(F.map_entries(F.from_json(n["t"], "map<string,string>")), lambda e: of_key(e, o)))
    member = lambda v, i, t: _node(F.try_element_at(members, n["kind"]), n["path"], F.concat(n["path"], F.lit("["), i, F.lit("]")), F.lit(None).cast("string"), v, F.get(t, i))
    listed = _bound(F.from_json(n["t"], "array<string>"), lambda t: F.transform(F.try_variant_get(n["v"], "$", "array<variant>"), lambda v, i: member(v, i, t)))
    none = F.filter(F.array(n), lambda x: F.lit(False))
    is_object = n["kind"].isin(*OBJECTS) & (n["type"] == "object")
    return F.when(is_object, keyed).when(n["kind"].isin(*ARRAYS) & (n["type"] == "array"), listed).otherwise(none)


def summary_nodes(summaries: DataFrame, raw: str = "raw") -> DataFrame:
    """``summaries`` with ``nodes``: all nodes of a JSON object, level by level; no nodes for other texts."""
    v = F.try_parse_json(raw)
    top = _node(F.lit("top"), F.lit("$"), F.lit("$"), F.lit(None).cast("string"), F.col("__v"), F.col(raw))
    rows = summaries.withColumn("__v", v).withColumn("__0", F.when(F.startswith(F.schema_of_variant("__v"), F.lit("OBJECT")), F.array(top)))
    for k in range(DEPTH):
        rows = rows.withColumn(f"__{k + 1}", F.flatten(F.transform(f"__{k}", _children)))
    levels = [f"__{k}" for k in range(DEPTH + 1)]
    return rows.withColumn("nodes", F.coalesce(F.concat(*levels), F.slice(F.array(top), 1, 0))).drop("__v", *levels)


def _keys(n: Column) -> Column:
    return F.map_keys(F.from_json(n["t"], "map<string,string>"))


def schema_errors(nodes: Column) -> Column:
    """Every violation of the closed schema as (path, message); an empty array for a valid summary.

    An object with unknown keys is named by its own path, like one that lacks keys; below a value of
    a wrong type nothing more is said. A finding is given for each place, without a limit.
    """
    allowed = _literal_map({k: _texts(v) for k, v in _ALLOWED.items()})
    values = _literal_map({k: _texts(v) for k, v in VALUES.items()})
    required = _literal_map({k: _texts(v) for k, v in REQUIRED.items()})

    def of_node(n: Column) -> Column:
        say = lambda path, *message: F.array(F.struct(path.alias("path"), F.concat(*message).alias("message")))
        types, known = F.try_element_at(allowed, n["kind"]), F.try_element_at(values, n["kind"])
        wrong = ~F.array_contains(types, n["type"]) & ~((n["type"] == "integer") & F.array_contains(types, F.lit("number")))
        lacking = F.array_except(F.try_element_at(required, n["kind"]), _keys(n))
        none = F.array().cast("array<struct<path:string,message:string>>")
        return (
            F.when(n["kind"].isNull(), say(n["owner"], F.lit("unexpected key '"), n["key"], F.lit("'")))
            .when(wrong, say(n["path"], F.lit("expected "), F.array_join(types, " or "), F.lit(", got "), n["type"]))
            .when(n["kind"].isin(*VALUES) & ~F.array_contains(known, n["t"]), say(n["path"], n["t"], F.lit(" is none of "), F.array_join(known, ", ")))
            .when(n["kind"].isin(*OBJECTS), F.transform(lacking, lambda k: F.struct(n["path"].alias("path"), F.concat(F.lit("missing required key '"), k, F.lit("'")).alias("message"))))
            .otherwise(none)
        )

    return F.flatten(F.transform(nodes, of_node))


def key_order(summaries: DataFrame, raw: str = "raw") -> DataFrame:
    """kind, violating, total: objects whose keys do not stand in the schema's order, by kind, over all rows.

    An object with a key that the schema does not have violates the order too. Texts that are no
    JSON objects count nowhere; a kind that occurs nowhere has no row. Equal texts are walked once.
    """
    orders = _literal_map({k: _texts(tuple(v)) for k, v in (OBJECTS | {"plain field": OBJECTS["field"]}).items()})
    objects = F.filter("nodes", lambda n: n["kind"].isin(*OBJECTS) & (n["type"] == "object"))
    seen = F.transform(objects, lambda n: F.struct(n["kind"].alias("kind"), _keys(n).alias("keys")))
    texts = summaries.groupBy(F.col(raw).alias("raw")).agg(F.count(F.lit(1)).alias("copies"))
    rows = summary_nodes(spread(texts, "raw")).select("copies", F.explode(seen).alias("n")).select("copies", "n.*")
    wanted = F.filter(F.try_element_at(orders, F.col("kind")), lambda k: F.array_contains("keys", k))
    kind = F.coalesce(F.try_element_at(_literal_map({k: F.lit(v) for k, v in ORDER_KINDS.items()}), F.col("kind")), F.col("kind"))
    return rows.groupBy(kind.alias("kind")).agg(F.sum(F.when(wanted != F.col("keys"), F.col("copies")).otherwise(0)).alias("violating"), F.sum("copies").alias("total"))
