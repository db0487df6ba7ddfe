"""Aggregation, metric, JSON and rendering queries over the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnloom.functions import measures as M
from turnloom.functions import text as T
from turnloom.operators import relational as R
from turnloom.operators.selection import nearest_rank, order_statistics
from turnloom.plans.registry import query
from turnloom.sources.tables import table


@query("SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY event_type")
def group_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events", "event_type", "user_id").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("users"))


@query("SELECT event_type, sum((value > 50)::INT)::BIGINT AS ok, count(*) AS total, round(100.0 * sum((value > 50)::INT) / count(*), 6) AS value FROM events GROUP BY event_type")
def counter_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "events", "event_type", "value").select("event_type", (F.col("value") > 50).cast("long").alias("ok"), F.lit(1).cast("long").alias("total"))
    r = R.counter_rollup(c, ["event_type"])
    return r.withColumn("value", F.round(M.ratio_pct(F.col("ok"), F.col("total")), 6))


@query("""SELECT lang, ok, total, round(100.0 * greatest(0, (p + 1.9208 / total - 1.96 * sqrt((p * (1 - p) + 0.9604 / total) / total)) / (1 + 3.8416 / total)), 6) AS ci_low
FROM (SELECT lang, sum(quality)::BIGINT AS ok, count(*) AS total, sum(quality) / count(*) AS p FROM documents JOIN labels USING (doc_id) GROUP BY lang)""")
def wilson_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "documents", "doc_id", "lang").join(table(spark, sf_dir, "labels", "doc_id", "quality"), "doc_id")  # noqa: E741
    g = l.groupBy("lang").agg(F.sum("quality").cast("long").alias("ok"), F.count(F.lit(1)).alias("total"))
    return g.withColumn("ci_low", F.round(M.wilson_low(F.col("ok"), F.col("total")), 6))


@query("SELECT l_returnflag, round(sum(l_extendedprice * l_discount) / sum(l_extendedprice), 9) AS mean_discount, round(sum(l_tax * l_quantity) / sum(l_quantity), 9) AS mean_tax FROM lineitem GROUP BY l_returnflag")
def weighted_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = table(spark, sf_dir, "lineitem", "l_returnflag", "l_extendedprice", "l_discount", "l_tax", "l_quantity")
    mean = lambda x, w: F.round(F.sum(F.col(x) * F.col(w)) / F.sum(w), 9)
    return i.groupBy("l_returnflag").agg(mean("l_discount", "l_extendedprice").alias("mean_discount"), mean("l_tax", "l_quantity").alias("mean_tax"))


@query("""WITH u AS (SELECT user_id, bool_and(value >= 0) AS g1, bool_and(event_type <> 'error') AS g2, count(*) AS items, count(*) FILTER (WHERE value > 100) AS high FROM events GROUP BY user_id)
SELECT count(*) AS calls, count(*) FILTER (WHERE g1) AS pass_g1, count(*) FILTER (WHERE g1 AND g2) AS pass_both, sum(items)::BIGINT AS items, sum(high)::BIGINT AS high_items, count(*) FILTER (WHERE high > 0) AS high_calls FROM u""")
def call_level_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gates that hold for a call if all its items pass; item level beside call level."""
    e = table(spark, sf_dir, "events", "user_id", "event_type", "value")
    u = e.groupBy("user_id").agg(F.bool_and(F.col("value") >= 0).alias("g1"), F.bool_and(F.col("event_type") != "error").alias("g2"), F.count(F.lit(1)).alias("items"), F.count_if(F.col("value") > 100).alias("high"))
    return u.agg(F.count(F.lit(1)).alias("calls"), F.count_if("g1").alias("pass_g1"), F.count_if(F.col("g1") & F.col("g2")).alias("pass_both"), F.sum("items").alias("items"), F.sum("high").alias("high_items"), F.count_if(F.col("high") > 0).alias("high_calls"))


@query("SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, max(value) AS worst, round(avg(value), 9) AS mean FROM events GROUP BY event_type")
def latency_nearest_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact percentiles by selection; the rest by partial sums."""
    e = table(spark, sf_dir, "events", "event_type", "value")
    ranked = order_statistics(e, ["event_type"], "value", {"p50": nearest_rank(0.5), "p95": nearest_rank(0.95)})
    return ranked.join(e.groupBy("event_type").agg(F.max("value").alias("worst"), F.round(F.avg("value"), 9).alias("mean")), "event_type")


@query("SELECT event_type, max(value) FILTER (WHERE r = floor(0.95 * n) + 1) AS p95 FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events) GROUP BY event_type")
def latency_floor_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sorted[int(p n)]: value counts are summed in order, so a group is never gathered as rows."""
    v = table(spark, sf_dir, "events", "event_type", "value").groupBy("event_type", "value").agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy("event_type")
    upto = F.sum("c").over(w.orderBy("value").rowsBetween(Window.unboundedPreceding, 0))
    ranked = v.withColumn("upto", upto).withColumn("n", F.sum("c").over(w)).filter(F.col("upto") > F.floor(F.lit(0.95) * F.col("n")))
    return ranked.groupBy("event_type").agg(F.min("value").alias("p95"))


@query("SELECT event_type, median(value) AS p50 FROM events GROUP BY event_type")
def latency_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean of the two middle values, found by selection."""
    e = table(spark, sf_dir, "events", "event_type", "value")
    middle = order_statistics(e, ["event_type"], "value", {"low": F.floor((F.col("n") - 1) / 2), "high": F.floor(F.col("n") / 2)})
    return middle.select("event_type", ((F.col("low") + F.col("high")) / 2).alias("p50"))


_AGREE = "SELECT count(*) AS n, count(*) FILTER (WHERE quality = 1 - toxic) AS same, sum(quality) AS a, sum(1 - toxic) AS b, count(*) FILTER (WHERE quality = 0 AND toxic = 1) AS caught, count(*) FILTER (WHERE quality = 0) AS bad, count(*) FILTER (WHERE quality = 1 AND toxic = 1) AS alarms FROM labels"


@query(f"SELECT n, round(CASE WHEN pe = 1 THEN 1 ELSE (same / n - pe) / (1 - pe) END, 9) AS kappa FROM (SELECT *, (a / n) * (b / n) + (1 - a / n) * (1 - b / n) AS pe FROM ({_AGREE}))")
def kappa(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "labels", "quality", "toxic").withColumn("judged", 1 - F.col("toxic"))  # noqa: E741
    g = l.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("quality") == F.col("judged")).alias("same"), F.sum("quality").alias("a"), F.sum("judged").alias("b"))
    a, b = F.col("a") / F.col("n"), F.col("b") / F.col("n")
    return g.select("n", F.round(M.kappa(F.col("same") / F.col("n"), a * b + (1 - a) * (1 - b)), 9).alias("kappa"))


@query(f"SELECT n, same, caught, bad, alarms FROM ({_AGREE})")
def agreement_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, t = F.col("quality"), F.col("toxic")
    return table(spark, sf_dir, "labels", "quality", "toxic").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(q == 1 - t).alias("same"), F.count_if((q == 0) & (t == 1)).alias("caught"), F.count_if(q == 0).alias("bad"), F.count_if((q == 1) & (t == 1)).alias("alarms")
    )


@query("""SELECT lang, count(*) FILTER (WHERE quality = 0 AND toxic = 1) AS tp, count(*) FILTER (WHERE quality = 1 AND toxic = 1) AS fp, count(*) FILTER (WHERE quality = 0 AND toxic = 0) AS fn, count(*) FILTER (WHERE quality = 1 AND toxic = 0) AS tn
FROM documents JOIN labels USING (doc_id) GROUP BY lang""")
def confusion_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "documents", "doc_id", "lang").join(table(spark, sf_dir, "labels", "doc_id", "quality", "toxic"), "doc_id")  # noqa: E741
    cell = lambda q, t: F.count_if((F.col("quality") == q) & (F.col("toxic") == t))
    return l.groupBy("lang").agg(cell(0, 1).alias("tp"), cell(1, 1).alias("fp"), cell(0, 0).alias("fn"), cell(1, 0).alias("tn"))


@query("""WITH a AS (SELECT DISTINCT user_id, event_type FROM events WHERE event_id % 2 = 0), b AS (SELECT DISTINCT user_id, event_type FROM events WHERE event_id % 2 = 1),
f AS (SELECT coalesce(a.event_type, b.event_type) AS event_type, a.user_id IS NOT NULL AS g, b.user_id IS NOT NULL AS p FROM a FULL JOIN b ON a.user_id = b.user_id AND a.event_type = b.event_type)
SELECT event_type, tp, fp, fn, round(tp / greatest(1, tp + fp), 9) AS "precision", round(tp / greatest(1, tp + fn), 9) AS recall, round(2.0 * tp / (2 * tp + fp + fn), 9) AS f1
FROM (SELECT event_type, count(*) FILTER (WHERE g AND p) AS tp, count(*) FILTER (WHERE p AND NOT g) AS fp, count(*) FILTER (WHERE g AND NOT p) AS fn FROM f GROUP BY event_type)""")
def precision_recall_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events", "event_id", "user_id", "event_type")
    sides = e.groupBy("user_id", "event_type").agg(F.bool_or(F.col("event_id") % 2 == 0).alias("g"), F.bool_or(F.col("event_id") % 2 == 1).alias("p"))
    g, p, tp, fp, fn = F.col("g"), F.col("p"), F.col("tp"), F.col("fp"), F.col("fn")
    c = sides.groupBy("event_type").agg(F.count_if(g & p).alias("tp"), F.count_if(p & ~g).alias("fp"), F.count_if(g & ~p).alias("fn"))
    return c.select("event_type", "tp", "fp", "fn", F.round(tp / F.greatest(F.lit(1), tp + fp), 9).alias("precision"), F.round(tp / F.greatest(F.lit(1), tp + fn), 9).alias("recall"), F.round(M.f1(tp, fp, fn), 9).alias("f1"))


@query("""WITH t AS (SELECT l_returnflag, CASE WHEN l_discount = 0 THEN 'dose_missing' WHEN l_tax > 0.06 THEN 'unit_wrong' WHEN l_quantity > 40 THEN 'dose_wrong' ELSE 'ok' END AS label FROM lineitem)
SELECT l_returnflag, count(*) FILTER (WHERE label = 'ok') AS ok, count(*) FILTER (WHERE label = 'dose_missing') AS dose_missing, count(*) FILTER (WHERE label = 'unit_wrong') AS unit_wrong, count(*) FILTER (WHERE label = 'dose_wrong') AS dose_wrong FROM t GROUP BY l_returnflag""")
def error_taxonomy_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = table(spark, sf_dir, "lineitem", "l_returnflag", "l_discount", "l_tax", "l_quantity")
    label = F.when(F.col("l_discount") == 0, "dose_missing").when(F.col("l_tax") > 0.06, "unit_wrong").when(F.col("l_quantity") > 40, "dose_wrong").otherwise("ok")
    names = ["ok", "dose_missing", "unit_wrong", "dose_wrong"]
    return i.withColumn("label", label).groupBy("l_returnflag").pivot("label", names).agg(F.count(F.lit(1))).na.fill(0, names)


_QUOTAS = (("en", 0.60), ("fr", 0.15), ("de", 0.15), ("es", 0.10))


@query(f"""WITH q(lang, frac) AS (VALUES {", ".join(f"('{k}', {v})" for k, v in _QUOTAS)}), n AS (SELECT count(*) AS n FROM documents), h AS (SELECT lang, count(*) AS have FROM documents GROUP BY lang)
SELECT q.lang, coalesce(have, 0) AS have, round_even(n * frac::DOUBLE, 0)::BIGINT AS want, abs(coalesce(have, 0) - round_even(n * frac::DOUBLE, 0)) <= 1 AS ok FROM q CROSS JOIN n LEFT JOIN h ON h.lang = q.lang""")
def quota_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group sizes against target shares, within one; halves round to even."""
    have = table(spark, sf_dir, "documents", "lang").groupBy("lang").agg(F.count(F.lit(1)).alias("have"))
    quota = spark.createDataFrame(list(_QUOTAS), "lang string, frac double")
    total = have.agg(F.sum("have").alias("n"))
    joined = quota.join(F.broadcast(total)).join(have, "lang", "left").withColumn("have", F.coalesce("have", F.lit(0)))
    want = F.bround(F.col("n") * F.col("frac")).cast("long")
    return joined.select("lang", "have", want.alias("want"), (F.abs(F.col("have") - want) <= 1).alias("ok"))


@query("""WITH j AS (SELECT lang, source, CASE WHEN n_chars < 1000 THEN 'short' WHEN n_chars < 4000 THEN 'medium' ELSE 'long' END AS bucket, quality FROM documents JOIN labels USING (doc_id)),
g AS (SELECT CASE WHEN grouping(lang) = 0 THEN 'lang' WHEN grouping(source) = 0 THEN 'source' ELSE 'bucket' END AS dim, coalesce(lang, source, bucket) AS value, sum(quality)::BIGINT AS ok, count(*) AS total FROM j GROUP BY GROUPING SETS ((lang), (source), (bucket)))
SELECT * FROM g QUALIFY count(*) OVER (PARTITION BY dim) >= 2""")
def breakdown_3dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents", "doc_id", "lang", "source", "n_chars").join(table(spark, sf_dir, "labels", "doc_id", "quality"), "doc_id")
    d = d.withColumn("bucket", F.when(F.col("n_chars") < 1000, "short").when(F.col("n_chars") < 4000, "medium").otherwise("long"))
    return R.breakdown(d, {"lang": "lang", "source": "source", "bucket": "bucket"}, F.col("quality"))


@query("""WITH i AS (SELECT event_type, user_id, bool_or(value > 50) AS error, bool_or(value > 20) AS seen, min(event_id) AS id FROM events GROUP BY ALL)
SELECT event_type, count(*) AS n, count(*) FILTER (WHERE error) AS caught_error, count(*) FILTER (WHERE seen) AS caught_any, array_to_string(list_sort(list(user_id) FILTER (WHERE NOT error))[1:3], ',') AS missed FROM i GROUP BY event_type""")
def detection_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per mutation: items, caught by an error, caught at all, and the first three missed."""
    i = table(spark, sf_dir, "events", "event_type", "user_id", "value").groupBy("event_type", "user_id").agg(F.bool_or(F.col("value") > 50).alias("error"), F.bool_or(F.col("value") > 20).alias("seen"))
    rates = i.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_if("error").alias("caught_error"), F.count_if("seen").alias("caught_any"))
    w = Window.partitionBy("event_type").orderBy("user_id")
    first = i.filter("not error").withColumn("k", F.row_number().over(w)).filter("k <= 3").groupBy("event_type").agg(F.array_join(F.array_sort(F.collect_list("user_id")).cast("array<string>"), ",").alias("missed"))
    return rates.join(first, "event_type", "left").withColumn("missed", F.col("missed"))


_METRICS = """SELECT 'events' AS grp, event_type AS name, count(*) FILTER (WHERE value > 30) AS num, count(*) AS den FROM events GROUP BY event_type
UNION ALL SELECT 'labels', 'quality', count(*) FILTER (WHERE quality = 1), count(*) FROM labels UNION ALL SELECT 'labels', 'clean', count(*) FILTER (WHERE toxic = 0), count(*) FROM labels"""


@query(f"SELECT grp, name, num, den, round(100.0 * num / den, 6) AS value, num / den >= 0.5 AS high FROM ({_METRICS})")
def metric_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events", "event_type", "value").select(F.lit("events").alias("grp"), F.col("event_type").alias("name"), (F.col("value") > 30).cast("long").alias("ok"))
    l = table(spark, sf_dir, "labels", "quality", "toxic")  # noqa: E741
    cells = F.array(F.struct(F.lit("quality").alias("name"), (F.col("quality") == 1).cast("long").alias("ok")), F.struct(F.lit("clean").alias("name"), (F.col("toxic") == 0).cast("long").alias("ok")))
    judged = l.select(F.lit("labels").alias("grp"), F.explode(cells).alias("c")).select("grp", "c.name", "c.ok")
    sums = R.counter_rollup(e.unionByName(judged).withColumn("total", F.lit(1).cast("long")), ["grp", "name"])
    return sums.select("grp", "name", F.col("ok").alias("num"), F.col("total").alias("den"), F.round(M.ratio_pct(F.col("ok"), F.col("total")), 6).alias("value"), (F.col("ok") / F.col("total") >= 0.5).alias("high"))


@query("""WITH s AS (SELECT lang AS metric, CASE WHEN doc_id % 2 = 0 THEN 'base' ELSE 'tuned' END AS system, 100.0 * sum(quality) / count(*) AS v FROM documents JOIN labels USING (doc_id) GROUP BY ALL)
SELECT metric, round(max(v) FILTER (WHERE system = 'base'), 6) AS base, round(max(v) FILTER (WHERE system = 'tuned'), 6) AS tuned, round(max(v) FILTER (WHERE system = 'tuned') - max(v) FILTER (WHERE system = 'base'), 6) AS delta FROM s GROUP BY metric""")
def matrix_pivot_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = table(spark, sf_dir, "documents", "doc_id", "lang").join(table(spark, sf_dir, "labels", "doc_id", "quality"), "doc_id")
    j = j.select(F.col("lang").alias("metric"), F.when(F.col("doc_id") % 2 == 0, "base").otherwise("tuned").alias("system"), "quality")
    p = j.groupBy("metric").pivot("system", ["base", "tuned"]).agg(100.0 * F.sum("quality") / F.count(F.lit(1)))
    return p.select("metric", F.round("base", 6).alias("base"), F.round("tuned", 6).alias("tuned"), F.round(F.col("tuned") - F.col("base"), 6).alias("delta"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events", "event_id", "props").select("event_id", F.from_json("props", "k long").getField("k").alias("k"))


_CUT = "CASE WHEN event_id % 3 = 0 THEN {left}(props, length(props) - 1) WHEN event_id % 3 = 1 THEN concat('note: ', props, ' end') ELSE props END"


@query(f"SELECT event_id, json_valid(raw) AS whole, json_valid(regexp_extract(raw, '\\{{.*\\}}', 0, 's')) AS salvaged FROM (SELECT event_id, {_CUT.format(left='left')} AS raw FROM events)")
def json_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON as it stands, or the text from its first to its last brace."""
    e = table(spark, sf_dir, "events", "event_id", "props").withColumn("raw", F.expr(_CUT.format(left="left")))
    inside = F.regexp_extract("raw", r"(?s)\{.*\}", 0)
    return e.select("event_id", F.try_parse_json("raw").isNotNull().alias("whole"), F.try_parse_json(F.nullif(inside, F.lit(""))).isNotNull().alias("salvaged"))


@query("SELECT count(*) AS total, count(*) FILTER (WHERE json_type(props, '$.k') IN ('BIGINT', 'UBIGINT')) AS integers, count(*) FILTER (WHERE CAST(json_extract(props, '$.k') AS BIGINT) BETWEEN 0 AND 49) AS in_range FROM events")
def json_schema_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "events", "props").select(F.try_variant_get(F.try_parse_json("props"), "$.k", "string").alias("k"), F.schema_of_variant(F.try_parse_json("props")).alias("s"))
    whole = F.col("s") == "OBJECT<k: BIGINT>"
    return v.agg(F.count(F.lit(1)).alias("total"), F.count_if(whole).alias("integers"), F.count_if(whole & F.col("k").try_cast("long").between(0, 49)).alias("in_range"))


@query("SELECT event_id, event_id % 3 <> 1 AS ordered FROM events")
def json_key_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Do the keys of every event's object come in the schema's order? A third of the objects turn two of them round, a third lack one."""
    e = table(spark, sf_dir, "events", "event_id", "user_id", "event_type", "props")
    parts = [F.concat(F.lit('"user":'), "user_id"), F.concat(F.lit('"type":"'), "event_type", F.lit('"')), F.concat(F.lit('"props":'), "props")]
    body = lambda *order: F.concat(F.lit("{"), F.concat_ws(", ", *(parts[k] for k in order)), F.lit("}"))
    raw = F.when(F.col("event_id") % 3 == 0, body(0, 1, 2)).when(F.col("event_id") % 3 == 1, body(1, 0, 2)).otherwise(body(0, 2))
    keys, schema = F.json_object_keys("raw"), F.array(F.lit("user"), F.lit("type"), F.lit("props"))
    return e.withColumn("raw", raw).select("event_id", (keys == F.filter(schema, lambda k: F.array_contains(keys, k))).alias("ordered"))


@query("SELECT c_custkey, field, value FROM (SELECT c_custkey, unnest(['name', 'segment', 'nation']) AS field, unnest([c_name, c_mktsegment, c_nationkey::VARCHAR]) AS value FROM customer)")
def unpivot_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").cast("string").alias("nation"))
    return c.unpivot("c_custkey", ["name", "segment", "nation"], "field", "value")


@query("SELECT conv_id, turn, turn >= 0 AND turn + 2 <= n AS inside FROM (SELECT conv_id, turn, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)")
def bounds_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids cited by each turn (its own and the next) lie within the conversation; no ids fail."""
    c = table(spark, sf_dir, "conversations", "conv_id", "turn")
    n = c.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    j = c.join(n, "conv_id").withColumn("ids", F.array(F.col("turn") + 1, F.col("turn") + 2))
    return j.select("conv_id", "turn", ((F.size("ids") > 0) & F.forall("ids", lambda i: (i >= 1) & (i <= F.col("n")))).alias("inside"))


@query("SELECT doc_id, CASE WHEN n_chars < 500 THEN 'tiny' WHEN n_chars < 2000 THEN 'short' WHEN n_chars < 8000 THEN 'medium' ELSE 'long' END AS bucket, CASE WHEN lang = 'en' THEN n_chars BETWEEN 150 AND 8000 ELSE n_chars BETWEEN 300 AND 9000 END AS fits FROM documents")
def length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_chars")
    bucket = F.when(n < 500, "tiny").when(n < 2000, "short").when(n < 8000, "medium").otherwise("long")
    fits = F.when(F.col("lang") == "en", n.between(150, 8000)).otherwise(n.between(300, 9000))
    return table(spark, sf_dir, "documents", "doc_id", "lang", "n_chars").select("doc_id", bucket.alias("bucket"), fits.alias("fits"))


@query("SELECT user_id, CASE WHEN errors > 5 THEN 'FAILED' WHEN errors > 0 OR low > 3 THEN 'REVIEW' ELSE 'PASS' END AS status FROM (SELECT user_id, count(*) FILTER (WHERE value > 90) AS errors, count(*) FILTER (WHERE value < 5) AS low FROM events GROUP BY user_id)")
def status_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = table(spark, sf_dir, "events", "user_id", "value").groupBy("user_id").agg(F.count_if(F.col("value") > 90).alias("errors"), F.count_if(F.col("value") < 5).alias("low"))
    return u.select("user_id", F.when(F.col("errors") > 5, "FAILED").when((F.col("errors") > 0) | (F.col("low") > 3), "REVIEW").otherwise("PASS").alias("status"))


@query("SELECT o_orderkey, concat_ws(', ', 'order ' || o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'filled' END, CASE WHEN o_orderpriority LIKE '1%' THEN 'urgent' END) AS sentence FROM orders")
def checklist_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders", "o_orderkey", "o_orderstatus", "o_orderpriority")
    state = F.when(F.col("o_orderstatus") == "O", "open").when(F.col("o_orderstatus") == "F", "filled")
    return o.select("o_orderkey", F.concat_ws(", ", F.concat(F.lit("order "), "o_orderkey"), state, F.when(F.col("o_orderpriority").startswith("1"), "urgent")).alias("sentence"))


@query("SELECT c_custkey, '[' || strftime(max(o_orderdate), '%Y-%m-%d %H:%M') || ' UTC]' || chr(10) || c_name || chr(10) || string_agg('- ' || o_orderkey || ' (' || o_orderpriority || ')', chr(10) ORDER BY o_orderkey) AS document FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey, c_name")
def render_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    line = F.concat(F.lit("- "), "o_orderkey", F.lit(" ("), "o_orderpriority", F.lit(")"))
    per = o.groupBy("o_custkey").agg(F.max("o_orderdate").alias("at"), F.array_sort(F.collect_list(F.struct("o_orderkey", line.alias("line")))).alias("l"))
    c = table(spark, sf_dir, "customer", "c_custkey", "c_name").join(per, F.col("c_custkey") == F.col("o_custkey"))
    head = F.concat(F.lit("["), F.date_format("at", "yyyy-MM-dd HH:mm"), F.lit(" UTC]"))
    return c.select("c_custkey", F.concat_ws("\n", head, "c_name", F.array_join("l.line", "\n")).alias("document"))


@query("SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(html, 'lang=\"([a-z]+)\"', 1) AS lang, len(regexp_extract_all(html, '<p>')) AS paragraphs FROM pages")
def html_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages", "page_id", "html")
    n = F.size(F.regexp_extract_all("html", F.lit("<p>"), 0)).cast("long")
    return p.select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.regexp_extract("html", 'lang="([a-z]+)"', 1).alias("lang"), n.alias("paragraphs"))


@query("SELECT label, count(*) AS n, round(avg(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))), 4) AS mean_square FROM embeddings GROUP BY label")
def vector_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings", "label", "embedding")
    square = F.aggregate(F.transform("embedding", lambda x: x.cast("double")), F.lit(0.0), lambda s, x: s + x * x)
    return e.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(square), 4).alias("mean_square"))


@query("SELECT doc_id, TRY_CAST(regexp_replace(nullif(array_to_string(list_slice(regexp_extract_all(text, '[0-9]+/[0-9]+|[0-9]+'), 1, 1), ''), ''), '[^0-9.]', '', 'g') AS DOUBLE) AS value FROM documents")
def digits_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first number of each text with all signs taken out: '104/62' reads 10462."""
    d = table(spark, sf_dir, "documents", "doc_id", "text")
    first = F.get(F.regexp_extract_all("text", F.lit("[0-9]+/[0-9]+|[0-9]+"), 0), F.lit(0))
    return d.select("doc_id", T.digits_value(first).alias("value"))


@query("""WITH d AS (SELECT count(*) FILTER (WHERE quality > 1 - toxic) AS up, count(*) FILTER (WHERE quality < 1 - toxic) AS down FROM labels)
SELECT up, down, abs(up - down) AS margin FROM d""")
def sign_test_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Discordant pairs of two verdicts, the input of an exact sign test."""
    q, j = F.col("quality"), 1 - F.col("toxic")
    c = table(spark, sf_dir, "labels", "quality", "toxic").agg(F.count_if(q > j).alias("up"), F.count_if(q < j).alias("down"))
    return c.withColumn("margin", F.abs(F.col("up") - F.col("down")))
