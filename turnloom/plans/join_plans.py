"""Join, set and matching queries over the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnloom.functions import text as T
from turnloom.operators import relational as R
from turnloom.operators.gram_index import text_jaccard
from turnloom.operators.top_pairs import top_pairs
from turnloom.plans.registry import query
from turnloom.plans.text_plans import sql_normalize
from turnloom.sources.tables import table


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels", "doc_id", "quality", "toxic")


@query("SELECT doc_id, lang, source, quality, toxic FROM documents JOIN labels USING (doc_id)")
def case_inner_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents", "doc_id", "lang", "source").join(_labels(spark, sf_dir), "doc_id")


@query("SELECT d.doc_id, coalesce(quality, -1) AS quality, CASE WHEN l.doc_id IS NULL THEN 'no label' ELSE 'ok' END AS state FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def left_default_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = _labels(spark, sf_dir).select(F.col("doc_id").alias("id"), "quality")  # noqa: E741
    d = table(spark, sf_dir, "documents", "doc_id").join(l, F.col("doc_id") == F.col("id"), "left")
    return d.select("doc_id", F.coalesce("quality", F.lit(-1)).alias("quality"), F.when(F.col("id").isNull(), "no label").otherwise("ok").alias("state"))


@query("SELECT doc_id, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def semi_labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents", "doc_id", "n_chars").join(_labels(spark, sf_dir), "doc_id", "left_semi")


@query("SELECT doc_id, n_chars FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def anti_unlabelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents", "doc_id", "n_chars").join(_labels(spark, sf_dir), "doc_id", "left_anti")


@query("SELECT 'only_left' AS side, count(*) AS missing FROM (SELECT DISTINCT o_orderkey AS k FROM orders) WHERE k NOT IN (SELECT l_orderkey FROM lineitem) "
       "UNION ALL SELECT 'only_right', count(*) FROM (SELECT DISTINCT l_orderkey AS k FROM lineitem) WHERE k NOT IN (SELECT o_orderkey FROM orders)")
def coverage_both_ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"))
    return R.anti_both_ways(o, table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k")), "k")


@query("SELECT event_type, count(*) AS new_findings FROM events e WHERE event_id % 2 = 1 AND NOT EXISTS (SELECT 1 FROM events b WHERE b.event_id % 2 = 0 AND b.user_id = e.user_id AND b.event_type = e.event_type AND b.props = e.props) GROUP BY event_type")
def new_vs_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of odd events that the even ones (the baseline) lack, by a composite key."""
    e = table(spark, sf_dir, "events", "event_id", "user_id", "event_type", "props")
    new = e.filter("event_id % 2 = 1").join(e.filter("event_id % 2 = 0"), ["user_id", "event_type", "props"], "left_anti")
    return new.groupBy("event_type").agg(F.count(F.lit(1)).alias("new_findings"))


@query("SELECT c_mktsegment, p_brand, count(*) AS items, count(DISTINCT o_orderkey) AS orders FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey GROUP BY ALL")
def bridge_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines and distinct orders by segment and brand; tasks grow in number with the tables, not in size."""
    c = table(spark, sf_dir, "customer", "c_custkey", "c_mktsegment")
    o = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey")
    i = table(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey")
    p = table(spark, sf_dir, "part", "p_partkey", "p_brand")
    lines, heads = i.count(), o.count()
    lines_of = lambda df, key: R.spread(df, key, rows=lines)
    branded = lines_of(i, "l_partkey").join(lines_of(p, "p_partkey"), F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "p_brand")
    sold = R.spread(o, "o_custkey", rows=heads).join(R.spread(c, "c_custkey", rows=heads), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_mktsegment")
    joined = lines_of(branded, "l_orderkey").join(lines_of(sold, "o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    # an order's lines stand together already, so its cells are counted where they are joined
    cells = joined.groupBy("l_orderkey", "c_mktsegment", "p_brand").agg(F.count(F.lit(1)).alias("n"))
    return cells.groupBy("c_mktsegment", "p_brand").agg(F.sum("n").alias("items"), F.count(F.lit(1)).alias("orders"))


@query("SELECT p_brand, count(*) AS total, count(*) FILTER (WHERE l_quantity = p_size) AS same_size, count(*) FILTER (WHERE l_extendedprice > p_retailprice) AS above FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand")
def attribute_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, p = table(spark, sf_dir, "lineitem", "l_partkey", "l_quantity", "l_extendedprice"), table(spark, sf_dir, "part", "p_partkey", "p_brand", "p_size", "p_retailprice")
    j = i.join(p, i.l_partkey == p.p_partkey).groupBy("p_brand")
    return j.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("l_quantity") == F.col("p_size")).alias("same_size"), F.count_if(F.col("l_extendedprice") > F.col("p_retailprice")).alias("above"))


@query("SELECT a.conv_id, a.turn AS user_turn, b.turn AS other_turn FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND abs(a.turn - b.turn) <= 1 WHERE a.role = 'user' AND b.role = 'assistant'")
def band_join_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations", "conv_id", "turn", "role")
    pairs = R.band_join(c.filter("role = 'user'").alias("a"), c.filter("role = 'assistant'").alias("b"), "conv_id", "turn", 1)
    return pairs.select("a.conv_id", F.col("a.turn").alias("user_turn"), F.col("b.turn").alias("other_turn"))


@query("SELECT doc_id, item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)")
def containment_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark text."""
    return R.containing(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"), "doc_id", "item_id", "text")


_DICT = ("the", "and", "of", "que", "die", "der", "la", "le", "in", "on", "er", "en", "th", "re", "with", "for", "von", "des", "del", "un")


@query(
    f"WITH n AS (SELECT conv_id, turn, role, string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' ') AS w FROM conversations), "
    f"h AS (SELECT DISTINCT conv_id, turn, role, word FROM (SELECT conv_id, turn, role, unnest(w) AS word FROM n) WHERE word IN ({', '.join(f"'{w}'" for w in _DICT)})) "
    "SELECT conv_id, word, count(*) AS turns, min(turn) AS first_turn, bool_or(role = 'user') AS by_caller FROM h GROUP BY ALL"
)
def dictionary_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms of a fixed list found in turns, per conversation: number, first turn, said by the caller."""
    c = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    words = F.array_distinct(F.split(F.trim(F.regexp_replace(F.lower("text"), "[^a-z0-9]+", " ")), " "))
    hits = c.select("conv_id", "turn", "role", F.explode_outer(F.array_intersect(words, F.array(*map(F.lit, _DICT)))).alias("word")).filter("word is not null")
    return hits.distinct().groupBy("conv_id", "word").agg(F.count(F.lit(1)).alias("turns"), F.min("turn").alias("first_turn"), F.bool_or(F.col("role") == "user").alias("by_caller"))


def _gram_sql(table_name: str, key: str) -> str:
    return (
        f"(SELECT DISTINCT {key}, unnest(list_transform(range(1, length(t) - 3), lambda i: substr(t, i, 5))) AS g "
        f"FROM (SELECT {key}, {sql_normalize('text')} AS t FROM {table_name}) WHERE length(t) >= 5)"
    )


_JACCARD = """WITH a AS {a}, b AS {b}, na AS (SELECT {x} AS i, count(*) AS n FROM a GROUP BY 1), nb AS (SELECT {y} AS j, count(*) AS n FROM b GROUP BY 1),
s AS (SELECT a.{x} AS i, b.{y} AS j, count(*) AS m FROM a JOIN b ON a.g = b.g GROUP BY ALL)
SELECT s.i AS {p}, s.j AS {q}, round(m / (na.n + nb.n - m), 9) AS jaccard FROM s JOIN na ON na.i = s.i JOIN nb ON nb.j = s.j WHERE {w}"""


@query(_JACCARD.format(a=_gram_sql("benchmark", "item_id"), b=_gram_sql("documents", "doc_id"), x="item_id", y="doc_id", p="item_id", q="doc_id", w="m / (na.n + nb.n - m) >= 0.2"))
def near_dup_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = (table(spark, sf_dir, n).select(i, T.normalize(F.col("text")).alias("t")) for n, i in (("benchmark", "item_id"), ("documents", "doc_id")))
    return text_jaccard(a, b, "item_id", "doc_id", "t", 0.2).withColumn("jaccard", F.round("jaccard", 9))


@query(_JACCARD.format(a=_gram_sql("benchmark", "item_id"), b=_gram_sql("benchmark", "item_id"), x="item_id", y="item_id", p="a_id", q="b_id", w="s.i < s.j") + " ORDER BY jaccard DESC, a_id DESC, b_id DESC LIMIT 5")
def top5_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five most similar pairs of all items."""
    a = table(spark, sf_dir, "benchmark").select("item_id", T.char_grams(T.normalize(F.col("text"))).alias("grams"))
    pairs, _ = top_pairs(a, "item_id", "grams", 5)
    return pairs.withColumn("jaccard", F.round("jaccard", 9))


@query("SELECT sha256(text) AS value, count(*) AS rows, count(DISTINCT source) AS splits, CASE WHEN count(DISTINCT source) > 1 THEN 'ERROR' ELSE 'WARN' END AS severity, string_agg(DISTINCT source, ',' ORDER BY source) AS sources FROM documents GROUP BY 1 HAVING count(*) > 1")
def value_reuse_leak(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents", "source", "text").select("source", F.sha2("text", 256).alias("value"))
    # first by (value, source), so that a value with many rows is summed where it is read
    part = d.groupBy("value", "source").agg(F.count(F.lit(1)).alias("n"))
    g = part.groupBy("value").agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("splits"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"))
    return g.filter("rows > 1").withColumn("severity", F.when(F.col("splits") > 1, "ERROR").otherwise("WARN"))


@query("SELECT user_id, list_sort(a) = list_sort(b) AS same, len(list_filter(a, lambda x: NOT list_contains(b, x))) = 0 AS contained FROM (SELECT user_id, list(DISTINCT event_type) FILTER (WHERE event_id % 2 = 0) AS a, list(DISTINCT event_type) FILTER (WHERE event_id % 2 = 1) AS b FROM events GROUP BY user_id) WHERE a IS NOT NULL AND b IS NOT NULL")
def set_equality_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events", "user_id", "event_id", "event_type")
    side = lambda k: F.array_sort(F.collect_set(F.when(F.col("event_id") % 2 == k, F.col("event_type"))))
    g = e.groupBy("user_id").agg(side(0).alias("a"), side(1).alias("b")).filter((F.size("a") > 0) & (F.size("b") > 0))
    return g.select("user_id", (F.col("a") == F.col("b")).alias("same"), (F.size(F.array_except("a", "b")) == 0).alias("contained"))


@query("""WITH a AS (SELECT user_id, event_type, count(*) AS n FROM events WHERE event_id % 2 = 0 GROUP BY ALL), b AS (SELECT user_id, event_type, count(*) AS n FROM events WHERE event_id % 2 = 1 GROUP BY ALL)
SELECT a.user_id, sum(least(a.n, coalesce(b.n, 0)))::BIGINT AS ok, sum(a.n)::BIGINT AS total FROM a LEFT JOIN b ON a.user_id = b.user_id AND a.event_type = b.event_type GROUP BY a.user_id""")
def multiset_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events", "event_id", "user_id", "event_type")
    m = R.multiset_match(e.filter("event_id % 2 = 0"), e.filter("event_id % 2 = 1"), ["user_id", "event_type"], "event_id")
    return m.groupBy("user_id").agg(F.count_if("matched").alias("ok"), F.count(F.lit(1)).alias("total"))


_HALVES = "SELECT user_id, event_type FROM events WHERE event_id % 2 = {k}"


@query(f"{_HALVES.format(k=0)} INTERSECT ALL {_HALVES.format(k=1)}")
def intersect_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.filter("event_id % 2 = 0").select("user_id", "event_type").intersectAll(e.filter("event_id % 2 = 1").select("user_id", "event_type"))


@query(f"{_HALVES.format(k=0)} EXCEPT ALL {_HALVES.format(k=1)}")
def except_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.filter("event_id % 2 = 0").select("user_id", "event_type").exceptAll(e.filter("event_id % 2 = 1").select("user_id", "event_type"))


@query("SELECT d.doc_id, quality - (1 - toxic) AS delta, quality <> (1 - toxic) AS discordant FROM documents d JOIN labels l ON d.doc_id = l.doc_id")
def paired_systems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two verdicts on the same case: the difference, and whether they are at odds."""
    l = table(spark, sf_dir, "documents", "doc_id").join(_labels(spark, sf_dir), "doc_id")  # noqa: E741
    other = 1 - F.col("toxic")
    return l.select("doc_id", (F.col("quality") - other).alias("delta"), (F.col("quality") != other).alias("discordant"))


@query("SELECT doc_id, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) > 1 AS repeated FROM documents")
def duplicate_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second and later rows of a text: a row is repeated where its id is not the text's least."""
    d = table(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", F.sha2("text", 256).alias("h"))
    least = d.groupBy("h").agg(F.min("doc_id").alias("first_id"))
    return d.join(least, "h").select("doc_id", (F.col("doc_id") != F.col("first_id")).alias("repeated"))
