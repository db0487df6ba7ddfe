"""Queries of the judge set, patches, predicates, first-match joins and the metric registry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnloom.functions import text as T
from turnloom.operators.coverage import coverage
from turnloom.operators.exports import final_flags, statuses
from turnloom.operators.first_match import first_match
from turnloom.operators.judge_scores import item_confusion, salvaged_object
from turnloom.operators.judge_set import stratified_samples
from turnloom.operators.matrix import METRICS, matrix
from turnloom.operators.med_errors import error_table, medication_errors
from turnloom.operators.patch import apply_patches
from turnloom.operators.profile import NUMBER_WORDS, RATES, realism
from turnloom.operators.top_pairs import top_pairs
from turnloom.plans.registry import query
from turnloom.sources.tables import table, turns

_DRAW = "('0x' || substr(md5('{seed}:' || {id}), 1, 15))::BIGINT"


@query(f"""WITH u AS (SELECT doc_id, lang, source, {_DRAW.format(seed=23, id='doc_id')} AS u FROM documents),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY u, doc_id) AS place FROM u),
sizes AS (SELECT lang, source, count(*) AS size FROM documents GROUP BY ALL),
one AS (SELECT *, floor(size * 60 / sum(size) OVER ()) AS base, size * 60 / sum(size) OVER () AS share FROM sizes),
first_take AS (SELECT lang, source, size, least(size, base + (row_number() OVER (ORDER BY share - base DESC, lang NULLS FIRST, source NULLS FIRST) <= 60 - sum(base) OVER ())::INT) AS a FROM one),
two AS (SELECT *, size - a AS rest, floor((size - a) * 40 / sum(size - a) OVER ()) AS base, (size - a) * 40 / sum(size - a) OVER () AS share FROM first_take),
takes AS (SELECT lang, source, a, least(rest, base + (row_number() OVER (ORDER BY share - base DESC, lang NULLS FIRST, source NULLS FIRST) <= 40 - sum(base) OVER ())::INT) AS b FROM two)
SELECT doc_id, r.lang, r.source, CASE WHEN place <= a THEN 'first' ELSE 'confirmation' END AS sample, (CASE WHEN place <= a THEN place ELSE place - a END)::BIGINT AS draw
FROM ranked r JOIN takes t ON r.lang IS NOT DISTINCT FROM t.lang AND r.source IS NOT DISTINCT FROM t.source WHERE place <= a + b""")
def judge_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two disjoint samples of exact sizes over all documents, in proportion to language and source."""
    docs = table(spark, sf_dir, "documents", "doc_id", "lang", "source")
    return stratified_samples(docs, "doc_id", ["lang", "source"], {"first": 60, "confirmation": 40}, 23)


@query("""WITH i AS (SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_returnflag, l_linestatus, l_quantity >= 45) AS k, l_quantity, l_returnflag, l_linestatus,
       l_quantity >= 45 AS heavy FROM lineitem)
SELECT o_orderkey, '{"status":"' || o_orderstatus || '","items":[' || string_agg('{"line":' || l_linenumber || CASE WHEN heavy THEN ',"heavy":true' ELSE '' END || ',"flag":"' || CASE WHEN l_returnflag = 'R' THEN 'returned' ELSE l_returnflag END || '","mode":"' || l_linestatus || '"}', ',' ORDER BY k)
       || CASE WHEN o_orderstatus = 'P' THEN ',{"line":0}' ELSE '' END || ']}' AS doc,
       (count(*) FILTER (WHERE heavy) + count(*) FILTER (WHERE l_returnflag = 'R') + CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END)::INT AS patches
FROM orders JOIN i ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_orderstatus""")
def patched_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as nested JSON; heavy lines get a key behind their number, returned ones another flag, open orders one more line."""
    i = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_quantity", "l_returnflag", "l_linestatus")
    o = table(spark, sf_dir, "orders", "o_orderkey", "o_orderstatus")
    line = F.struct(F.col("l_linenumber").alias("line"), F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("mode"), (F.col("l_quantity") >= 45).alias("heavy"))
    items = i.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(line)).alias("all"))
    j = o.join(items, o.o_orderkey == items.l_orderkey)
    docs = j.select("o_orderkey", F.to_json(F.struct(F.col("o_orderstatus").alias("status"), F.transform("all", lambda x: x.dropFields("heavy")).alias("items"))).alias("doc"))
    at = j.select("o_orderkey", F.posexplode("all").alias("k", "x"))
    none, path = F.lit(None).cast("string"), lambda *p: F.array(F.lit("items"), *p)
    heavy = at.filter("x.heavy").select("o_orderkey", F.lit(0).alias("ord"), path(F.col("k").cast("string"), F.lit("heavy")).alias("path"), F.lit("line").alias("after"), F.lit("true").alias("value"))
    back = at.filter("x.flag = 'R'").select("o_orderkey", F.lit(1).alias("ord"), path(F.col("k").cast("string"), F.lit("flag")).alias("path"), none.alias("after"), F.lit('"returned"').alias("value"))
    more = j.filter("o_orderstatus = 'P'").select("o_orderkey", F.lit(2).alias("ord"), path(F.lit("-")).alias("path"), none.alias("after"), F.lit('{"line":0}').alias("value"))
    return apply_patches(docs, heavy.unionByName(back).unionByName(more), ["o_orderkey"], "doc")


_WORDS = {"has digits": "regexp_matches(text, '[0-9]')", "has a question": "contains(text, '?')", "long": "length(text) > 500", "lines": "contains(text, chr(10))", "shouts": "regexp_matches(text, '[A-Z]{4}')"}


@query("SELECT role, unnest(['has digits', 'has a question', 'long', 'lines', 'shouts']) AS predicate, unnest([" + ", ".join(f"count(*) FILTER (WHERE {p})" for p in _WORDS.values()) + "]) AS have, 100::BIGINT AS need, unnest([" + ", ".join(f"count(*) FILTER (WHERE {p}) >= 100" for p in _WORDS.values()) + "]) AS covered FROM conversations GROUP BY role")
def coverage_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five predicates of every turn as one bitmap, summed by role."""
    c = table(spark, sf_dir, "conversations", "role", "text")
    return coverage(c, "role", {k: v.replace("regexp_matches", "rlike").replace("chr(10)", "'\\n'") for k, v in _WORDS.items()}, 100)


@query("""WITH f AS (SELECT l_orderkey AS g, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS n, l_returnflag AS a, l_linestatus AS b, l_quantity AS q FROM lineitem),
facts AS (SELECT * FROM f WHERE n % 2 = 0), items AS (SELECT * FROM f WHERE n % 2 = 1),
met AS (SELECT f.g, f.n, CASE WHEN f.a = i.a AND f.b = i.b THEN 1 WHEN f.a = i.a THEN 2 ELSE 3 END AS priority, i.n AS item, i.q AS iq, f.q AS fq
        FROM facts f JOIN items i ON f.g = i.g AND (f.a = i.a OR f.b = i.b)),
best AS (SELECT g, n, priority, item, fq = iq AS same FROM met QUALIFY row_number() OVER (PARTITION BY g, n ORDER BY priority, item) = 1)
SELECT coalesce(priority, 0) AS priority, count(*) AS facts, sum(item)::BIGINT AS places, count(*) FILTER (WHERE same) AS same_quantity FROM facts LEFT JOIN best USING (g, n) GROUP BY 1""")
def first_match_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even lines of an order take its first odd line of equal flag and status, else of equal flag, else of equal status."""
    i = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_returnflag", "l_linestatus")
    n = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"))
    f = i.select(F.col("l_orderkey").alias("g"), n.alias("n"), F.col("l_returnflag").alias("a"), F.col("l_linestatus").alias("b"), F.col("l_quantity").alias("q"))
    both = F.concat_ws("|", "a", "b")
    met = first_match(f.filter("n % 2 = 0"), f.filter("n % 2 = 1"), ["g"], [(both, both), (F.col("a"), F.col("a")), (F.col("b"), F.col("b"))], "n", "n")
    return met.groupBy(F.coalesce("priority", F.lit(0)).alias("priority")).agg(F.count(F.lit(1)).alias("facts"), F.sum("item.n").cast("long").alias("places"), F.count_if(F.col("q") == F.col("item.q")).alias("same_quantity"))


_USERS = """WITH c AS (SELECT user_id, event_type, count(*) FILTER (WHERE value <= 100) AS ok, count(*) AS total FROM events GROUP BY ALL),
w AS (SELECT user_id, CASE WHEN user_id % 2 = 0 THEN 'base' ELSE 'tuned' END AS system, 'c' || user_id % 3 AS category, 'l' || user_id % 5 AS length,
  sum(ok) FILTER (WHERE event_type = 'view') AS view_ok, sum(total) FILTER (WHERE event_type = 'view') AS view_n,
  sum(ok) FILTER (WHERE event_type = 'click') AS click_ok, sum(total) FILTER (WHERE event_type = 'click') AS click_n,
  sum(ok) FILTER (WHERE event_type = 'purchase') AS buy_ok, sum(total) FILTER (WHERE event_type = 'purchase') AS buy_n,
  coalesce(sum(total - ok) FILTER (WHERE event_type = 'error'), 0) AS n_error FROM c GROUP BY user_id),
cells AS (
  SELECT system, category, length, 'A3' AS id, view_ok AS ok, view_n AS n FROM w UNION ALL SELECT system, category, length, 'B1', click_ok, click_n FROM w
  UNION ALL SELECT system, category, length, 'E1', (n_error = 0)::INT, 1 FROM w UNION ALL SELECT system, category, length, 'H18', buy_n - buy_ok, buy_n FROM w
  UNION ALL SELECT system, category, length, 'H19', buy_ok, buy_n FROM w),
sums AS (
  SELECT system, CASE WHEN grouping(category) = 0 THEN 'category' WHEN grouping(length) = 0 THEN 'length' END AS dim, coalesce(category, length) AS value, id, coalesce(sum(ok), 0)::BIGINT AS num, coalesce(sum(n), 0)::BIGINT AS den
  FROM cells GROUP BY GROUPING SETS ((system, id), (system, category, id), (system, length, id)))
SELECT system, dim, value, id, num, den, round(100.0 * num / den, 6) AS pct FROM sums WHERE dim IS NULL OR id IN ('E1', 'H19')"""


@query(_USERS)
def metric_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registered metrics with breakdowns over users as calls: one aggregate over grouping sets."""
    e = table(spark, sf_dir, "events", "user_id", "event_type", "value")
    cell = F.struct((F.col("value") <= 100).cast("long").alias("ok"), F.lit(1).cast("long").alias("total"))
    counts = e.select("user_id", "event_type", cell.alias("c")).groupBy("user_id", "event_type").agg(F.sum("c.ok").alias("ok"), F.sum("c.total").alias("total"))
    pairs = F.map_from_entries(F.collect_list(F.struct("event_type", F.struct("ok", "total"))))
    users = counts.groupBy("user_id").agg(pairs.alias("m"))
    u, named = F.col("user_id"), lambda **names: F.create_map(*(x for k, v in names.items() for x in (F.lit(k), F.try_element_at("m", F.lit(v)))))
    wide = users.select(
        F.when(u % 2 == 0, "base").otherwise("tuned").alias("system"), F.concat(F.lit("c"), (u % 3).cast("string")).alias("category"), F.concat(F.lit("l"), (u % 5).cast("string")).alias("length"),
        F.lit(True).alias("parse_ok"), F.coalesce(F.expr("m['error'].total - m['error'].ok"), F.lit(0)).cast("int").alias("n_error"),
        named(turns_valid="view", numbers_in_call="click").alias("counters"), named(medication_hallucinated="purchase", cfa="purchase").alias("reference"),
    )
    chosen = tuple(m for m in METRICS if m.id in ("A3", "B1", "E1", "H18", "H19"))
    return matrix(wide, chosen, ("category", "length")).select("system", "dim", "value", "id", "num", "den", F.round("pct", 6).alias("pct"))


_PAIRS = """WITH s AS (SELECT doc_id AS id, list_distinct(list_filter(string_split_regex(lower(text), '\\s+'), lambda x: x <> '')) AS g FROM documents WHERE text IS NOT NULL),
w AS (SELECT id, len(g) AS n, unnest(g) AS word FROM s),
m AS (SELECT a.id AS a_id, b.id AS b_id, a.n AS an, b.n AS bn, count(*) AS c FROM w a JOIN w b ON a.word = b.word AND a.id < b.id GROUP BY ALL)
SELECT a_id, b_id, round(c / (an + bn - c), 9) AS jaccard FROM m ORDER BY c / (an + bn - c) DESC, a_id DESC, b_id DESC LIMIT 50"""


@query(_PAIRS)
def top50_document_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifty most similar pairs of all documents by their words."""
    words = F.array_remove(F.split(F.lower("text"), r"\s+"), "")
    docs = table(spark, sf_dir, "documents", "doc_id", "text").filter("text is not null")
    pairs, _ = top_pairs(docs.select("doc_id", words.alias("w")), "doc_id", "w", 50)
    return pairs.select("a_id", "b_id", F.round("jaccard", 9).alias("jaccard"))


_MENTIONS = """WITH m AS (SELECT user_id, event_id, event_type AS name, event_id % 2 = 0 AS gold, floor(value)::BIGINT % 4 AS d, CASE event_id % 3 WHEN 0 THEN 'mL' ELSE 'mg' END AS unit FROM events),
g AS (SELECT *, row_number() OVER (PARTITION BY user_id, name ORDER BY event_id) AS k FROM m WHERE gold),
p AS (SELECT *, row_number() OVER (PARTITION BY user_id, name ORDER BY event_id) AS k FROM m WHERE NOT gold),
j AS (SELECT coalesce(g.name, p.name) AS name, CASE WHEN p.user_id IS NULL THEN 'not_found' WHEN g.user_id IS NULL THEN 'extra' WHEN p.d = 3 THEN CASE WHEN g.d = 3 THEN 'dose_wrong_or_ok' ELSE 'dose_missing' END
   WHEN g.d = p.d AND g.unit = p.unit THEN 'ok' WHEN g.d = p.d THEN 'unit_wrong' ELSE 'dose_wrong' END AS kind, g.d AS gd
   FROM g FULL JOIN p ON g.user_id = p.user_id AND g.name = p.name AND g.k = p.k),
c AS (SELECT name, CASE WHEN kind = 'dose_wrong_or_ok' THEN 'dose_missing' ELSE kind END AS kind FROM j)
SELECT name, """ + ", ".join(f"count(*) FILTER (WHERE kind = '{k}') AS {k}" for k in ("ok", "dose_missing", "unit_wrong", "dose_wrong", "not_found", "extra")) + " FROM c GROUP BY name"


@query(_MENTIONS)
def medication_error_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six classes of errors over events as mentions: even ones are gold, odd ones the model's, a dose of 3 is none for the model."""
    e = table(spark, sf_dir, "events", "user_id", "event_id", "event_type", "value")
    dose = F.floor("value") % 4
    unit = F.when(F.col("event_id") % 3 == 0, "mL").otherwise("mg")
    m = e.select("user_id", F.col("event_id").alias("ord"), F.col("event_type").alias("name"), dose.alias("d"), unit.alias("unit"))
    gold = m.filter("ord % 2 = 0").select("user_id", "ord", "name", F.col("d").cast("string").alias("dose"), "unit")
    model = m.filter("ord % 2 = 1").select("user_id", "ord", "name", F.when(F.col("d") != 3, F.col("d").cast("string")).alias("dose"), "unit")
    return error_table(medication_errors(gold, model, ["user_id"]), ["name"])


@query("""WITH u AS (SELECT user_id, max(value) < 300 AS ok, count(*) FILTER (WHERE value > 120) AS raw, count(*) FILTER (WHERE value > 180) AS errors, list_sort(list(DISTINCT event_type) FILTER (WHERE value < 0.6)) AS absent FROM events GROUP BY user_id)
SELECT user_id, CASE WHEN NOT ok THEN 'FAILED' WHEN errors > 0 OR len(coalesce(absent, [])) > 0 THEN 'REVIEW' ELSE 'PASS' END AS status,
CASE WHEN NOT ok THEN 'the output is not valid JSON' WHEN errors > 0 THEN errors || ' rule errors are left after quote repair'
  WHEN len(coalesce(absent, [])) > 0 THEN 'the caller named ' || array_to_string(absent, ', ') || ', the summary does not (' || CASE WHEN raw > 0 THEN raw - errors || ' quotes were repaired; no rule error is left' ELSE 'no rule error' END || ')'
  WHEN raw > 0 THEN raw - errors || ' quotes were repaired; no rule error is left' ELSE 'no rule error' END AS why FROM u""")
def status_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gate's order of decisions over users as calls: validity, errors after repair, omissions, repairs."""
    e = table(spark, sf_dir, "events", "user_id", "event_type", "value")
    u = e.groupBy("user_id").agg(
        (F.max("value") < 300).alias("parse_ok"), F.count_if(F.col("value") > 120).alias("raw_errors"), F.count_if(F.col("value") > 180).alias("errors"),
        F.array_sort(F.collect_set(F.when(F.col("value") < 0.6, F.col("event_type")))).alias("absent"),
    )
    return statuses(u.withColumn("repaired", F.col("raw_errors") - F.col("errors"))).select("user_id", "status", "why")


@query("""WITH m AS (SELECT DISTINCT user_id, event_type AS category FROM events WHERE value > 150), r AS (SELECT DISTINCT user_id, event_type AS category FROM events WHERE value > 90)
SELECT user_id, category, 'model' AS source FROM m UNION ALL SELECT user_id, category, 'rule' FROM r ANTI JOIN m USING (user_id, category) WHERE user_id % 7 <> 0""")
def merged_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flags of the model and those of the rules that it lacks; a seventh of the users are not applicable."""
    e = table(spark, sf_dir, "events", "user_id", "event_type", "value")
    none = (F.lit(None).cast("array<int>").alias("turns"), F.lit(None).cast("string").alias("quote"))
    over = lambda least: e.filter(F.col("value") > least).select("user_id", F.col("event_type").alias("category")).distinct().select("*", *none)
    calls = e.select("user_id", (F.col("user_id") % 7 == 0).alias("is_na")).distinct()
    return final_flags(over(150), over(90), calls, ["user_id"]).select("user_id", "category", "source")


@query("""WITH u AS (SELECT user_id, coalesce(list(DISTINCT event_type) FILTER (WHERE event_id % 2 = 0 AND value > 60), []) AS said, coalesce(list(DISTINCT event_type) FILTER (WHERE event_id % 2 = 1 AND value > 60), []) AS truth FROM events GROUP BY user_id)
SELECT user_id % 3 AS grp, sum(len(list_intersect(said, truth)))::BIGINT AS tp, sum(len(list_filter(said, lambda x: NOT list_contains(truth, x))))::BIGINT AS fp,
  sum(len(list_filter(truth, lambda x: NOT list_contains(said, x))))::BIGINT AS fn, sum(5 - len(list_distinct(list_concat(said, truth))))::BIGINT AS tn FROM u GROUP BY 1""")
def item_confusion_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's five event types as items: those of even events over 60 are said, those of odd ones true."""
    e = table(spark, sf_dir, "events", "user_id", "event_id", "event_type", "value").filter("value > 60")
    number = F.array_position(F.array(*map(F.lit, ("click", "error", "purchase", "signup", "view"))), F.col("event_type")).cast("int")
    of = lambda odd: F.collect_set(F.when(F.col("event_id") % 2 == odd, number))
    sides = e.groupBy("user_id").agg(of(0).alias("said"), of(1).alias("truth"))
    users = table(spark, sf_dir, "events", "user_id").distinct().join(sides, "user_id", "left")
    return item_confusion(users.select((F.col("user_id") % 3).alias("grp"), "said", "truth", F.lit(5).alias("n")), ["grp"], "said", "truth", "n")


@query("""SELECT event_id, CASE WHEN event_id % 5 < 3 THEN props END AS object, CASE event_id % 5 WHEN 3 THEN 'no JSON object in the output' WHEN 4 THEN 'the JSON object cannot be read' END AS error FROM events""")
def salvaged_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event's object out of five kinds of answers: bare, fenced, with words around, absent, broken."""
    e = table(spark, sf_dir, "events", "event_id", "props")
    k, props = F.col("event_id") % 5, F.col("props")
    answer = (
        F.when(k == 0, props).when(k == 1, F.concat(F.lit("Here:\n```json\n"), props, F.lit("\n```\ndone"))).when(k == 2, F.concat(F.lit("It is "), props, F.lit(" as asked.")))
        .when(k == 3, F.lit("I cannot.")).otherwise(F.concat(F.lit("{"), props, F.lit("}")))
    )
    return e.select("event_id", salvaged_object(answer).alias("s")).select("event_id", "s.object", "s.error")


_IN = lambda words: "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + ")"
_REALISM = f"""WITH t AS (SELECT conv_id % 3 AS grp, conv_id, turn, CASE role WHEN 'user' THEN 'Caller' WHEN 'assistant' THEN 'Nurse' ELSE role END AS speaker, text,
  list_filter(regexp_extract_all(lower(text), '([a-z'']+|[0-9]+)', 1), lambda x: x <> '') AS w FROM conversations),
p AS (SELECT *, lag(speaker) OVER (PARTITION BY conv_id ORDER BY turn) = speaker AS same,
  len(list_filter(range(1, len(w)), lambda i: w[i] = w[i + 1])) AS rep, len(list_filter(w, lambda x: x IN {_IN(T.FILLERS)})) AS fill, len(list_filter(w, lambda x: x IN {_IN(NUMBER_WORDS)})) AS num,
  regexp_matches(lower(text), '\\b(and|to|the|a|of|for|that|but|or|with|my|her|his)\\.?\\s*$') AS dangles FROM t),
s AS (SELECT grp, count(DISTINCT conv_id) AS calls, count(*) AS turns, sum(length(text)) AS chars, sum(len(w)) AS toks, count(*) FILTER (speaker = 'Caller') AS caller,
  count(*) FILTER (speaker = 'Caller' AND len(w) <= 3) AS short, count(*) FILTER (speaker = 'Caller' AND dangles) AS dangling, count(*) FILTER (same) AS same, sum(fill) AS fill, sum(rep) AS rep, sum(num) AS num FROM p GROUP BY grp)
SELECT grp, calls, round(chars / calls, 6) AS mean_chars, round(turns / calls, 6) AS mean_turns, round(short / greatest(caller, 1), 6) AS caller_short_turn_rate, round(dangling / greatest(caller, 1), 6) AS caller_dangling_fragment_rate,
  round(same / turns, 6) AS same_speaker_consecutive_rate, round(1000.0 * fill / greatest(toks, 1), 6) AS fillers_per_1k, round(1000.0 * rep / greatest(toks, 1), 6) AS immediate_repeats_per_1k, round(1000.0 * num / greatest(toks, 1), 6) AS number_words_per_1k FROM s"""


@query(_REALISM)
def realism_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The profile of all conversations in three groups."""
    t = turns(spark, sf_dir).withColumn("grp", F.col("conv_id") % 3)
    return realism(t, ["grp"], "conv_id").select("grp", "calls", *(F.round(r, 6).alias(r) for r in RATES))
