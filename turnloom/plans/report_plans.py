"""Queries on judge decisions, comparisons, export frames and payloads over the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnloom.operators import reports as P
from turnloom.operators.identity import PATIENT_WORDS, RELATIONSHIP_WORDS, relationship_said
from turnloom.operators.relational import spread
from turnloom.operators.rendering import checklist_sentence, identity_sentence
from turnloom.operators.schema_check import key_order, schema_errors, summary_nodes
from turnloom.plans.registry import query
from turnloom.sources.tables import table


@query("""WITH v AS (SELECT o_orderkey AS id, o_orderpriority = '5-LOW' AS is_na, CASE o_orderstatus WHEN 'O' THEN 'PASS' WHEN 'F' THEN 'FAIL' END AS f FROM orders),
i AS (SELECT l_orderkey AS id, CASE WHEN l_returnflag = 'R' THEN false WHEN l_linenumber < 6 THEN true END AS first, CASE WHEN l_linenumber % 3 > 0 THEN l_linenumber % 3 = 1 END AS second FROM lineitem),
g AS (SELECT id, bool_or(first IS NULL OR (NOT first AND second IS NULL)) AS open, bool_and(coalesce(first OR coalesce(second, false), false)) AS whole FROM i GROUP BY id),
c AS (SELECT v.id, f, CASE WHEN is_na OR whole IS NULL THEN 'PASS' WHEN open THEN NULL WHEN whole THEN 'PASS' ELSE 'FAIL' END AS completeness FROM v LEFT JOIN g ON v.id = g.id)
SELECT id, completeness, completeness IS NOT NULL AND f IS NOT NULL AS decided FROM c""")
def judge_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as judged calls, their lines as checklist items."""
    status = F.when(F.col("o_orderstatus") == "O", "PASS").when(F.col("o_orderstatus") == "F", "FAIL")
    v = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderpriority") == "5-LOW").alias("is_na"), status.alias("faithfulness"), F.lit("PASS").alias("calibration"))
    first = F.when(F.col("l_returnflag") == "R", False).when(F.col("l_linenumber") < 6, True)
    second = F.when(F.col("l_linenumber") % 3 > 0, F.col("l_linenumber") % 3 == 1)
    return P.judge_decisions(v, table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), first.alias("first"), second.alias("second")))


@query("""SELECT d.doc_id, quality, l.doc_id IS NOT NULL AS has_labels, dim, e.doc_id IS NOT NULL AS has_vectors, copies, c.doc_id IS NOT NULL AS has_copies
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
LEFT JOIN (SELECT doc_id, 1 AS dim FROM documents WHERE lang = 'en') e ON d.doc_id = e.doc_id
LEFT JOIN (SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY sha256(text)) c ON d.doc_id = c.doc_id""")
def joined_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents left joined with their labels, a mark of English ones and the size of the group that they lead."""
    d = table(spark, sf_dir, "documents", "doc_id", "lang", "text")
    copies = d.groupBy(F.sha2("text", 256).alias("h")).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies")).drop("h")
    return P.joined_outputs(d.select("doc_id"), ["doc_id"], labels=table(spark, sf_dir, "labels", "doc_id", "quality"), vectors=d.filter("lang = 'en'").select("doc_id", F.lit(1).alias("dim")), copies=copies)


@query("""WITH p AS (SELECT p_partkey, CASE WHEN p_size % 3 > 0 THEN p_size END AS p50 FROM part)
SELECT a.p_partkey, coalesce(a.p50, b.p50) AS p50, CASE WHEN a.p50 IS NULL AND b.p50 IS NOT NULL THEN b.p_partkey END AS from_key
FROM p a LEFT JOIN p b ON b.p_partkey = a.p_partkey - 1""")
def fallback_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A part without a measure borrows the one of the part before it."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_size") % 3 > 0, F.col("p_size")).alias("p50"))
    return P.with_fallback(p, "p_partkey", "p50", F.col("p_partkey") - 1)


@query("""SELECT n_regionkey, CAST(to_json(list({'n_nationkey': n_nationkey, 'n_name': n_name} ORDER BY n_nationkey)) AS VARCHAR) AS report FROM nation GROUP BY 1""")
def json_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.report_json(table(spark, sf_dir, "nation", "n_regionkey", "n_nationkey", "n_name"), "n_regionkey", "n_nationkey")


@query("""SELECT o AS l_orderkey, 'bullets[' || (row_number() OVER (PARTITION BY o ORDER BY n, p, s) - 1) || ']' AS path, v AS value
FROM (SELECT l_orderkey AS o, l_linenumber AS n, l_partkey AS p, l_suppkey AS s, unnest([l_partkey]) AS v FROM lineitem)""")
def covered_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each line of an order covers, as a side table by path."""
    bullet = F.struct("l_linenumber", "l_partkey", "l_suppkey", F.array("l_partkey").alias("covers"))
    calls = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(bullet)).alias("bullets"))
    return P.split_alignment(calls, "l_orderkey", "bullets", "covers")[1]


@query("""SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY 1""")
def last_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.last_evidence(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "event_type", "value")


@query("""SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_name ELSE p_brand END AS headline,
CASE WHEN p_size % 2 = 0 THEN 'brand: ' || p_brand || '; size: ' || p_size ELSE 'size: ' || p_size END AS rest FROM part""")
def headline_and_rest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A part's name, or its brand where it has no name, and its other fields."""
    fields = F.create_map(F.lit("size"), F.col("p_size").cast("string"), F.lit("brand"), F.col("p_brand"), F.lit("name"), F.col("p_name"))
    named = F.map_filter(fields, lambda k, v: (k != "name") | (F.col("p_size") % 2 == 0))
    head, rest = P.headline_and_rest(named, ["name", "brand"])
    return table(spark, sf_dir, "part").select("p_partkey", head.alias("headline"), rest.alias("rest"))


@query("""WITH t AS (SELECT p_partkey, p_size, list_filter(string_split(lower(p_name), ' '), lambda w: length(w) >= 4)[1] AS w FROM part)
SELECT p_partkey, CASE WHEN p_size % 7 > 0 THEN w IS NOT NULL AND p_size % 5 > 0 END AS written FROM t""")
def number_in_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a part's size stands where its name does; every fifth only has it times ten, every seventh is no number."""
    said = F.when(F.col("p_size") % 5 > 0, F.col("p_size")).otherwise(F.col("p_size") * 10 + 1).cast("string")
    passages = F.array(F.concat(F.col("p_name"), F.lit(" of "), said, F.lit(" mg")), F.concat(F.lit("0 "), F.col("p_size").cast("string")))
    number = F.when(F.col("p_size") % 7 > 0, F.col("p_size").cast("string")).otherwise("half a tablet")
    return table(spark, sf_dir, "part").select("p_partkey", P.number_in_passages(number, F.col("p_name"), passages).alias("written"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 4 < 3 THEN strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d') END AS shown FROM orders""")
def readable_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order dates in three writings and one that cannot be read."""
    day = F.col("o_orderdate").cast("date")
    k = F.col("o_orderkey") % 4
    text = F.when(k == 0, F.date_format(day, "yyyy-MM-dd")).when(k == 1, F.date_format(day, "MM/dd/yyyy")).when(k == 2, F.date_format(day, "MMMM d, yyyy")).otherwise("some day")
    return table(spark, sf_dir, "orders").select("o_orderkey", P.readable_date(text).alias("shown"))


@query("""SELECT conv_id, to_json(list({'role': coalesce(role, ''), 'content': coalesce(text, '')} ORDER BY turn, role, text))::VARCHAR AS messages, sum(length(coalesce(text, ''))) AS chars, sum(length(coalesce(text, ''))) <= 2000 AS fits FROM conversations GROUP BY 1""")
def training_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = P.training_messages(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text", 2000)
    return m.select("conv_id", "messages", "chars", "fits")


_LINES = "(SELECT l_orderkey AS id, l_linenumber AS ord, min(CASE WHEN l_linenumber % 2 = 0 THEN 'auto' ELSE l_returnflag END) AS turns, min(l_suppkey) AS s FROM lineitem GROUP BY ALL)"


@query(f"""WITH r AS {_LINES}, bad AS (SELECT DISTINCT id FROM r WHERE id % 5 = 0 AND ord = 2)
SELECT r.id, ord, turns, CASE WHEN bad.id IS NULL THEN CASE WHEN turns = 'auto' THEN s || ',7' ELSE turns END END AS resolved, bad.id IS NOT NULL AS refused
FROM r LEFT JOIN bad ON r.id = bad.id""")
def filled_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even lines of an order are filled in; orders that lack a found list are refused."""
    value = F.when(F.col("l_linenumber") % 2 == 0, "auto").otherwise(F.col("l_returnflag"))
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("ord")).agg(F.min(value).alias("turns"), F.min("l_suppkey").alias("s"))
    found = lines.filter("ord % 2 = 0 and not (id % 5 = 0 and ord = 2)").select("id", "ord", F.array(F.col("s").cast("string"), F.lit("7")).alias("ids"))
    return P.filled_references(lines.select("id", "ord", "turns"), "id", "turns", "auto", found)


def _sql_words(*parts: str) -> str:
    words = [w for p in parts for w in (*RELATIONSHIP_WORDS.get(p, [p]), *PATIENT_WORDS.get(p, []))]
    return r"\b(" + "|".join(words) + r")\b"


@query(f"""SELECT conv_id, turn, CASE conv_id % 4 WHEN 0 THEN regexp_matches(lower(text), '{_sql_words("staff")}') WHEN 1 THEN regexp_matches(lower(text), '{_sql_words("paid friend", "friend")}')
WHEN 2 THEN regexp_matches(lower(text), '{_sql_words("partner")}') ELSE true END AS said FROM conversations WHERE text IS NOT NULL AND conv_id IS NOT NULL""")
def relationship_said_in_turn(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("conv_id") % 4
    relationship = F.when(k == 0, "Staff").when(k == 1, "paid friend").when(k == 2, "partner").otherwise("self")
    c = table(spark, sf_dir, "conversations").filter("text is not null and conv_id is not null")
    return c.select("conv_id", "turn", relationship_said(relationship, F.col("text")).alias("said"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'Patient name not provided' ELSE 'Patient ' || c_name END || ', DOB not provided'
|| CASE c_custkey % 4 WHEN 0 THEN ', calling on own behalf' WHEN 1 THEN '. Patient''s ' || lower(c_mktsegment) || ' (unclear), ' || c_name || ', calling on her behalf'
ELSE '. Caller name not provided, relationship not provided, calling on her behalf' END || ', callback number not provided.' AS sentence FROM customer""")
def identity_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as patients who call themselves, through a relation or through an unknown caller."""
    k = F.col("c_custkey") % 4
    field = lambda value, certainty="stated": F.struct(value.cast("string").alias("value"), F.lit(certainty).alias("certainty"), F.array().cast("array<string>").alias("heard_as"))
    relation = F.when(k == 0, "self").when(k == 1, F.lower("c_mktsegment"))
    people = {
        "patient_name": field(F.when(F.col("c_custkey") % 3 != 0, F.col("c_name"))), "patient_dob": field(F.lit(None)), "caller_name": field(F.when(k == 1, F.col("c_name"))),
        "relationship": field(relation, "unclear"), "callback_phone": field(F.lit("")), "patient_pronoun": F.lit("her"),
    }
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.struct(*(v.alias(n) for n, v in people.items())).alias("identity"))
    return rows.select("c_custkey", identity_sentence(F.col("identity")).alias("sentence"))


@query("""SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'Medication: ' || p_name || ', ' || p_size || ' mg, status: ran out'
WHEN 1 THEN 'Supply: ' || p_name || ', none remaining (' || lower(p_brand) || ')' ELSE 'Nurse action (planned): order parts, because ' || p_name END AS fact FROM part""")
def checklist_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as medications, supplies and actions of a fact record."""
    k, p = F.col("p_size") % 3, F.col("p_name")
    of = lambda **texts: F.create_map(*(x for n, v in texts.items() for x in (F.lit(n), v if not isinstance(v, str) else F.lit(v))))
    medication = of(item_type="medication", medication_name_true=p, dose=F.col("p_size").cast("string"), unit="mg", medication_status="ran", route="")
    supply = of(item_type="supply", supply_item=p, supply_remaining="None", supply_unit=F.lower("p_brand"))
    action = of(action_type="order_parts", action_status="planned", reason_or_trigger=p)
    section = F.when(k < 2, "assessment").otherwise("response")
    return table(spark, sf_dir, "part").select("p_partkey", checklist_sentence(section, F.when(k == 0, medication).when(k == 1, supply).otherwise(action)).alias("fact"))


def _order_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order as a summary whose lines are risk flags; every third quote is a number, every return an unknown key."""
    flag = F.concat(
        F.lit('{"category": "other_urgent", "turns": ['), F.col("l_linenumber"), F.lit('], "quote": '), F.when(F.col("l_linenumber") % 3 == 0, "1").otherwise('"x"'),
        F.when(F.col("l_returnflag") == "R", ', "odd": null').otherwise(""), F.lit("}"),
    )
    unsaid = '{"value": null, "certainty": "not_stated", "turns": []}'
    people = ", ".join(f'"{k}": {unsaid}' for k in ("patient_name", "patient_dob", "caller_name", "relationship", "callback_phone"))
    head = f'{{"identity": {{{people}}}, "not_applicable": {{"is_na": false, "reason": null}}, "assessment": [], "response": [], "education": [], "risk_flags": ['
    g = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(flag)).alias("flags"))
    return g.select("l_orderkey", F.concat(F.lit(head), F.array_join("flags", ", "), F.lit("]}")).alias("raw"))


@query("""SELECT l_orderkey, count(*) FILTER (l_linenumber % 3 = 0) AS wrong_type, count(*) FILTER (l_returnflag = 'R') AS unexpected FROM lineitem GROUP BY 1""")
def schema_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Violations of two kinds in every order's summary; equal summaries are checked once."""
    orders = _order_summaries(spark, sf_dir)
    texts = spread(orders.select("raw").distinct(), "raw")
    rows = summary_nodes(texts).select(F.sha2("raw", 256).alias("h"), schema_errors(F.col("nodes")).alias("e"))
    said = lambda start: F.size(F.filter("e", lambda x: F.startswith(x["message"], F.lit(start)))).cast("long")
    checked = rows.select("h", said("expected string").alias("wrong_type"), said("unexpected key").alias("unexpected"))
    return orders.select("l_orderkey", F.sha2("raw", 256).alias("h")).join(checked, "h").select("l_orderkey", "wrong_type", "unexpected")


@query("""WITH o AS (SELECT count(DISTINCT l_orderkey) AS n, count(*) AS f, count(*) FILTER (l_returnflag = 'R') AS r FROM lineitem)
SELECT 'top' AS kind, n AS violating, n AS total FROM o UNION ALL SELECT 'not_applicable', 0, n FROM o UNION ALL SELECT 'identity', 0, n FROM o
UNION ALL SELECT 'field', 0, 5 * n FROM o UNION ALL SELECT 'flag', r, f FROM o""")
def key_order_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return key_order(_order_summaries(spark, sf_dir))
