"""Scans, text and window queries over the driver tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnloom.functions import text as T
from turnloom.functions.measures import ratio_pct, wilson_low
from turnloom.operators.relational import even_sample, sessions_by_flag, turn_windows
from turnloom.plans.registry import query
from turnloom.sources.tables import table, turns

# SQL of normalize() for texts: the same steps, repeated words dropped through a list.
_PLAIN = "trim(regexp_replace(replace(lower(translate({0}, '’‘“”–—', '''''\"\"--')), '''', ''), '[^a-z0-9]+', ' ', 'g'))"


def sql_normalize(column: str) -> str:
    # the one-element list binds the words, which a lambda would else split again for every word
    words = f"[string_split({_PLAIN.format(column)}, ' ')]"
    kept = "list_filter(list_zip(ws, list_prepend(NULL, ws)), lambda p: p[1] IS DISTINCT FROM p[2])"
    return f"list_transform({words}, lambda ws: array_to_string(list_transform({kept}, lambda p: p[1]), ' '))[1]"


_SENTENCES = (
    "list_filter(list_transform(string_split(regexp_replace({0}, '([.?!])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: trim(s)), lambda s: s <> '')"
)


@query(
    f"""
WITH s AS (
  SELECT conv_id, turn, role, unnest({_SENTENCES.format("text")}) AS sentence FROM conversations),
q AS (SELECT conv_id, turn, role, {sql_normalize("sentence")} AS quote FROM s),
c AS (SELECT conv_id, turn, {sql_normalize("text")} AS words FROM conversations),
m AS (
  SELECT q.role, q.quote <> '' AND contains(' ' || own.words || ' ', ' ' || q.quote || ' ') AS cited,
         EXISTS (SELECT 1 FROM c o WHERE o.conv_id = q.conv_id AND o.turn <> q.turn AND q.quote <> ''
                 AND contains(' ' || o.words || ' ', ' ' || q.quote || ' ')) AS elsewhere
  FROM q JOIN c own ON own.conv_id = q.conv_id AND own.turn = q.turn),
k AS (
  SELECT role, 'exact_in_cited' AS name, count(*) FILTER (WHERE cited) AS ok, count(*) AS total FROM m GROUP BY role
  UNION ALL SELECT role, 'found_elsewhere', count(*) FILTER (WHERE elsewhere), count(*) FROM m GROUP BY role)
SELECT role, name, ok, total, 100.0 * ok / total AS value,
  100.0 * greatest(0, (ok / total + 1.9208 / total - 1.96 * sqrt((ok / total * (1 - ok / total) + 0.9604 / total) / total)) / (1 + 3.8416 / total)) AS ci_low
FROM k
"""
)
def grounding_scorecard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each sentence as a quote of its own turn, and looked for in the conversation's other turns.

    Quotes of one conversation that are alike are looked for once. A quote meets the turns that have
    its first three words (or all it has) in this order; the whole of it is checked on those. Rows made
    of a small table are many: its size says nothing of theirs, so no side is sent to the driver.
    """
    t = turns(spark, sf_dir).select("conv_id", "turn_id", "role", T.normalize(F.col("text")).alias("words"), F.transform(T.sentences(F.col("text")), T.normalize).alias("quotes"))
    quotes = t.select("conv_id", "turn_id", "role", "words", F.explode("quotes").alias("quote"))
    quotes = quotes.select("conv_id", "turn_id", "role", "quote", T.padded_contains(F.col("words"), F.col("quote")).alias("cited"))
    counted = quotes.groupBy("conv_id", "turn_id", "role", "quote", "cited").agg(F.count(F.lit(1)).alias("n"))
    asked = counted.filter("quote != ''").select("conv_id", "turn_id", "quote", F.array_join(F.slice(F.split("quote", " "), 1, 3), " ").alias("key"))

    def starts(w: Column) -> Column:
        return F.flatten(F.transform(w, lambda x, k: F.array(x, F.concat_ws(" ", x, F.get(w, k + 1)), F.concat_ws(" ", x, F.get(w, k + 1), F.get(w, k + 2)))))

    split = t.select("conv_id", F.col("turn_id").alias("other_id"), F.explode(F.array(F.split("words", " "))).alias("w"))  # binds the words for the lambda
    keys = split.select("conv_id", "other_id", F.explode(F.array_distinct(starts(F.col("w")))).alias("key"))
    met = asked.join(keys.hint("merge"), ["conv_id", "key"]).filter("turn_id != other_id").select("conv_id", "turn_id", "quote", "other_id")
    other = t.select("conv_id", F.col("turn_id").alias("other_id"), F.col("words").alias("other"))
    hit = met.join(other.hint("merge"), ["conv_id", "other_id"]).filter(T.padded_contains(F.col("other"), F.col("quote")))
    found = hit.select("conv_id", "turn_id", "quote").distinct().withColumn("hit", F.lit(True))
    marked = counted.join(found.hint("merge"), ["conv_id", "turn_id", "quote"], "left")
    cells = F.array(
        F.struct(F.lit("exact_in_cited").alias("name"), F.col("cited").alias("ok")),
        F.struct(F.lit("found_elsewhere").alias("name"), F.coalesce("hit", F.lit(False)).alias("ok")),
    )
    long = marked.select("role", "n", F.explode(cells).alias("c")).groupBy("role", "c.name")
    sums = long.agg(F.sum(F.when(F.col("c.ok"), F.col("n")).otherwise(0)).alias("ok"), F.sum("n").alias("total"))
    return sums.select("role", "name", "ok", "total", ratio_pct(F.col("ok"), F.col("total")).alias("value"), wilson_low(F.col("ok"), F.col("total")).alias("ci_low"))


@query("""
SELECT conv_id, string_agg('[T' || (turn + 1) || '] ' || CASE role WHEN 'user' THEN 'Caller' WHEN 'assistant' THEN 'Nurse' ELSE role END
  || ' -> ' || text, chr(10) ORDER BY turn) AS transcript FROM conversations GROUP BY conv_id""")
def scan_turns_numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat(F.lit("[T"), F.col("turn_id"), F.lit("] "), "speaker", F.lit(" -> "), "text")
    lines = turns(spark, sf_dir).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn_id", line.alias("line")))).alias("l"))
    return lines.select("conv_id", F.array_join("l.line", "\n").alias("transcript"))


@query("SELECT conv_id, string_agg(text, ' ' ORDER BY turn) AS full_text, count(*) AS n_turns FROM conversations GROUP BY conv_id")
def transcript_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = turns(spark, sf_dir).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn_id", "text"))).alias("l"))
    return rows.select("conv_id", F.array_join("l.text", " ").alias("full_text"), F.size("l").cast("long").alias("n_turns"))


_GATES = {"future": "\\b(will|going to|plan to|que|und)\\b", "negation": "\\b(no|not|denies|without|nicht|ne)\\b", "done": "\\b(was|gave|took|did|est|ist)\\b"}


@query(
    f"SELECT doc_id, {', '.join(f"regexp_matches(n, '{p}') AS {k}" for k, p in _GATES.items())} FROM (SELECT doc_id, {_PLAIN.format('text')} AS n FROM documents) "
    f"WHERE {' OR '.join(f"regexp_matches(n, '{p}')" for p in _GATES.values())}"
)
def lexicon_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents", "doc_id", "text")
    plain = F.trim(F.regexp_replace(F.regexp_replace(F.lower(T.straight(F.col("text"))), "'", ""), "[^a-z0-9]+", " "))
    hits = d.select("doc_id", plain.alias("n")).select("doc_id", *(F.col("n").rlike(p).alias(k) for k, p in _GATES.items()))
    return hits.filter(" OR ".join(_GATES))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def limit_by_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders", "o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25)


@query("SELECT 'train' AS split, doc_id AS id, length(text) AS n FROM documents UNION ALL SELECT 'held_out', item_id, length(text) FROM benchmark")
def union_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "documents").select(F.lit("train").alias("split"), F.col("doc_id").alias("id"), F.length("text").cast("long").alias("n"))
    b = table(spark, sf_dir, "benchmark").select(F.lit("held_out").alias("split"), F.col("item_id").alias("id"), F.length("text").cast("long").alias("n"))
    return a.unionByName(b)


@query("SELECT sha256(text) AS sha, count(*) AS files, min(doc_id) AS first_id FROM documents GROUP BY 1")
def checksum_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", F.sha2("text", 256).alias("sha"))
    return d.groupBy("sha").agg(F.count(F.lit(1)).alias("files"), F.min("doc_id").alias("first_id"))


@query(f"SELECT doc_id, md5({sql_normalize('text')}) AS digest, length({sql_normalize('text')}) AS n FROM documents")
def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", T.normalize(F.col("text")).alias("n"))
    return d.select("doc_id", F.md5(F.col("n").cast("binary")).alias("digest"), F.length("n").cast("long").alias("n"))


_TOKENS = "regexp_extract_all(lower(text), '[a-z'']+|[0-9]+')"


@query(f"SELECT doc_id, len(w) AS n_tokens, len(list_distinct(w)) AS n_distinct FROM (SELECT doc_id, {_TOKENS} AS w FROM documents)")
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", T.tokens(F.col("text")).alias("w"))
    return d.select("doc_id", F.size("w").cast("long").alias("n_tokens"), F.size(F.array_distinct("w")).cast("long").alias("n_distinct"))


_STOP = ", ".join(f"'{w}'" for w in T.STOP_WORDS)
_FOLD = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in T.SYNONYMS.items())


@query(
    f"SELECT word, count(*) AS docs FROM (SELECT DISTINCT doc_id, CASE w {_FOLD} ELSE w END AS word FROM "
    f"(SELECT doc_id, unnest(string_split({sql_normalize('text')}, ' ')) AS w FROM documents) WHERE length(w) >= 3 AND w NOT IN ({_STOP})) GROUP BY word"
)
def content_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents", "doc_id", "text").select(F.explode_outer(T.content_words(F.col("text"))).alias("word"))
    return d.filter("word is not null").groupBy("word").agg(F.count(F.lit(1)).alias("docs"))


@query(f"SELECT conv_id, turn, len({_SENTENCES.format('text')}) AS n, {_SENTENCES.format('text')}[1] AS first_sentence FROM conversations")
def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations", "conv_id", "turn", "text").withColumn("s", T.sentences(F.col("text")))
    return c.select("conv_id", "turn", F.size("s").cast("long").alias("n"), F.get("s", F.lit(0)).alias("first_sentence"))


_SPELLED = r"\b((?:[A-Za-z](?:\s*[,\-.]\s*|\s+)){2,}[A-Za-z])\b"


@query(f"""WITH t AS (SELECT conv_id, turn, regexp_replace(text, '[^A-Za-z .,]', '', 'g') AS plain FROM conversations),
s AS (SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN array_to_string(l, '-') WHEN 1 THEN array_to_string(l, ', ') ELSE array_to_string(l, ' ') END || ' is spelled so: ' || plain AS spoken FROM (SELECT *, string_split(regexp_extract(plain, '[A-Za-z]{{3,}}'), '') AS l FROM t))
SELECT conv_id, turn, list_reduce(list_concat([spoken], regexp_extract_all(spoken, '{_SPELLED}', 1)), lambda t, m: replace(t, m, regexp_replace(m, '[^A-Za-z]', '', 'g'))) AS joined FROM s""")
def spelled_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn behind its first longer word, which is spelled letter by letter."""
    c = table(spark, sf_dir, "conversations", "conv_id", "turn", "text").withColumn("plain", F.regexp_replace("text", "[^A-Za-z .,]", ""))
    letters = F.split(F.regexp_extract("plain", "[A-Za-z]{3,}", 0), "")
    between = F.when(F.col("turn") % 3 == 0, "-").when(F.col("turn") % 3 == 1, ", ").otherwise(" ")
    spelled = F.aggregate(F.slice(letters, F.lit(2), F.greatest(F.size(letters) - 1, F.lit(0))), F.get(letters, F.lit(0)), lambda t, x: F.concat(t, between, x))
    return c.select("conv_id", "turn", T.collapse_spelled(F.concat(spelled, F.lit(" is spelled so: "), "plain")).alias("joined"))


@query(
    f"WITH n AS (SELECT item_id, {sql_normalize('text')} AS t FROM benchmark), g AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, length(t) - 3), lambda i: substr(t, i, 5))) AS gram FROM n WHERE length(t) >= 5) "
    "SELECT gram, count(*) AS items FROM g GROUP BY gram ORDER BY items DESC, gram LIMIT 20"
)
def char_ngrams_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "benchmark").select("item_id", F.explode(F.array_distinct(T.char_grams(T.normalize(F.col("text"))))).alias("gram"))
    return g.groupBy("gram").agg(F.count(F.lit(1)).alias("items")).orderBy(F.desc("items"), "gram").limit(20)


_STATS = f"""
WITH w AS (SELECT lang, length(text) AS chars, {_TOKENS} AS w FROM documents),
c AS (SELECT lang, chars, len(w) AS toks, len(list_filter(w, lambda x: x IN ({", ".join(f"'{f}'" for f in T.FILLERS)}))) AS fill,
      len(list_filter(w, lambda x, i: i > 1 AND x = w[i - 1])) AS rep FROM w),
s AS (SELECT lang, count(*) AS docs, sum(chars) / count(*) AS mean_chars, sum(toks)::BIGINT AS toks, 1000.0 * sum(fill) / sum(toks) AS fillers_per_1k,
      1000.0 * sum(rep) / sum(toks) AS repeats_per_1k FROM c GROUP BY lang)
"""


def _stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents", "lang", "text").select("lang", F.length("text").alias("chars"), T.tokens(F.col("text")).alias("w"))
    fill = F.size(F.filter("w", lambda x: x.isin(*T.FILLERS)))
    per = d.select("lang", "chars", F.size("w").alias("toks"), fill.alias("fill"), T.immediate_repeats(F.col("w")).alias("rep"))
    return per.groupBy("lang").agg(
        F.count(F.lit(1)).alias("docs"),
        F.avg("chars").alias("mean_chars"),
        F.sum("toks").alias("toks"),
        (1000.0 * F.sum("fill") / F.sum("toks")).alias("fillers_per_1k"),
        (1000.0 * F.sum("rep") / F.sum("toks")).alias("repeats_per_1k"),
    )


@query(_STATS + "SELECT lang, docs, round(mean_chars, 6) AS mean_chars, toks, round(fillers_per_1k, 6) AS fillers_per_1k, round(repeats_per_1k, 6) AS repeats_per_1k FROM s")
def corpus_stats_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    rounded = ("mean_chars", "fillers_per_1k", "repeats_per_1k")
    return _stats(spark, sf_dir).select("lang", "docs", "toks", *(F.round(c, 6).alias(c) for c in rounded))


@query(_STATS + "SELECT s.lang, abs(s.repeats_per_1k - r.repeats_per_1k) / r.repeats_per_1k > 0.3 AS off, abs(s.mean_chars - r.mean_chars) / r.mean_chars > 0.3 AS length_off FROM s, s r WHERE r.lang = 'en'")
def realism_vs_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _stats(spark, sf_dir)
    # one row per language; the reference is a single row
    r = s.filter("lang = 'en'").select(F.col("repeats_per_1k").alias("r0"), F.col("mean_chars").alias("c0"))
    off = lambda a, b: F.abs(F.col(a) - F.col(b)) / F.nullif(F.col(b), F.lit(0.0)) > 0.3
    return s.join(F.broadcast(r)).select("lang", off("repeats_per_1k", "r0").alias("off"), off("mean_chars", "c0").alias("length_off"))


@query(
    "SELECT doc_id, len(n) AS n_numbers, array_to_string(n, ',') AS numbers FROM (SELECT doc_id, list_transform(list_filter(regexp_extract_all("
    "translate(text, '’‘“”–—', '''''\"\"--'), '/?(?:[0-9]{1,2}:[0-9]{2}|[0-9]+(?:\\.[0-9]+)?)'), lambda x: x <> '/10'), lambda x: ltrim(x, '/')) AS n FROM documents) WHERE len(n) > 0"
)
def digits_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents", "doc_id", "text").withColumn("n", T.numbers_in(F.col("text")))
    return d.select("doc_id", F.size("n").cast("long").alias("n_numbers"), F.array_join("n", ",").alias("numbers")).filter("n_numbers > 0")


_PHONE = r"[0-9][0-9\-\s.()]{6,}[0-9]"


@query(f"SELECT doc_id, unnest(list_transform(regexp_extract_all(text, '{_PHONE}'), lambda m: regexp_replace(m, '[^0-9]', '', 'g'))) AS digits FROM documents")
def phone_like_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents", "doc_id", "text")
    groups = F.transform(F.regexp_extract_all("text", F.lit(_PHONE), 0), lambda m: F.regexp_replace(m, "[^0-9]", ""))
    return d.select("doc_id", F.explode_outer(groups).alias("digits")).filter("digits is not null")


_TALL = ("tHe", "aNd", "oF", "qUe", "dIe")


def _tall_sql(inner: str) -> str:
    for w in _TALL:
        inner = f"regexp_replace({inner}, '\\b{w}\\b', '{w}', 'gi')"
    return inner


@query(f"SELECT doc_id, md5({_tall_sql(sql_normalize('text'))}) AS digest FROM documents")
def tallman_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents", "doc_id", "text")
    return d.select("doc_id", F.md5(T.tall_man(T.normalize(F.col("text")), _TALL).cast("binary")).alias("digest"))


@query("SELECT conv_id, turn, role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS previous, coalesce(role = lag(role) OVER (PARTITION BY conv_id ORDER BY turn), false) AS same FROM conversations")
def prev_speaker(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = table(spark, sf_dir, "conversations", "conv_id", "turn", "role").withColumn("previous", F.lag("role").over(w))
    return c.withColumn("same", F.coalesce(F.col("role") == F.col("previous"), F.lit(False)))


@query("SELECT conv_id, turn, md5(coalesce(string_agg(text, ' ') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), '')) AS context FROM conversations")
def trailing_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = turn_windows(table(spark, sf_dir, "conversations", "conv_id", "turn", "text"), ["conv_id"], "turn", -3, -1, "text", "context")
    return c.select("conv_id", "turn", F.md5(F.col("context").cast("binary")).alias("context"))


@query("SELECT conv_id, max((n LIKE '%the%' AND n LIKE '%on%')::INT) = 1 AS together FROM (SELECT conv_id, lower(string_agg(text, ' ') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING)) AS n FROM conversations) GROUP BY conv_id")
def forward_window_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Do two parts stand together in some window of four turns?"""
    c = turn_windows(table(spark, sf_dir, "conversations", "conv_id", "turn", "text"), ["conv_id"], "turn", 0, 3, "text", "near")
    n = F.lower("near")
    return c.groupBy("conv_id").agg(F.bool_or(n.contains("the") & n.contains("on")).alias("together"))


@query("SELECT event_id, user_id, sum((event_type = 'signup')::INT) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS group_id FROM events")
def running_group_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events", "event_id", "user_id", "event_type")
    return sessions_by_flag(e, ["user_id"], "event_id", F.col("event_type") == "signup").select("event_id", "user_id", "group_id")


@query("SELECT user_id, event_type, min(event_id) AS first_id, arg_min(value, event_id) AS first_value FROM events GROUP BY ALL")
def first_hit_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events", "user_id", "event_type", "event_id", "value")
    return e.groupBy("user_id", "event_type").agg(F.min("event_id").alias("first_id"), F.min_by("value", "event_id").alias("first_value"))


@query("SELECT event_id, value FROM (SELECT event_id, value, row_number() OVER (ORDER BY event_id) - 1 AS r, greatest(1, count(*) OVER () // 20) AS step FROM events) WHERE r % step = 0 AND r // step < 20")
def even_sample_20(spark: SparkSession, sf_dir: str) -> DataFrame:
    return even_sample(table(spark, sf_dir, "events", "event_id", "value"), "event_id", 20).select("event_id", "value")


@query("SELECT c_mktsegment, o_orderkey, o_totalprice FROM (SELECT c_mktsegment, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY c_mktsegment ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders JOIN customer ON o_custkey = c_custkey) WHERE r <= 5")
def rank_top_n_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_totalprice")
    c = table(spark, sf_dir, "customer", "c_custkey", "c_mktsegment")
    w = Window.partitionBy("c_mktsegment").orderBy(F.desc("o_totalprice"), "o_orderkey")
    ranked = o.join(c, F.col("o_custkey") == F.col("c_custkey")).withColumn("r", F.row_number().over(w)).filter("r <= 5")
    return ranked.select("c_mktsegment", "o_orderkey", "o_totalprice")


@query("SELECT source, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY source ORDER BY n DESC, first_id LIMIT 10")
def most_common_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents", "source", "doc_id").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id"))
    return d.orderBy(F.desc("n"), "first_id").limit(10)
