"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import crc32_mod, table
from .decontamination import benchmark_matches
from .exact_dedup import content_sort_dedup
from .language import fit_language, predict_language
from .line_dedup import drop_repeated_lines
from .lm_score import fit_ngrams, score_counted
from .merkle import changed_leaf, folded, merkle_manifest, path_text
from .packing import pack_documents
from .preferences import preference_segments
from .quality import fit_quality, score_quality
from .repair import repair_conversations
from .simhash import EXACT, near_duplicate_classes
from .warc import resolve_revisits
from .weighted_sampling import weighted_fingerprints


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """A vocabulary file of the installed public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 1024 tokens; a null text is empty, and the end id 0 closes every document."""
    return pack_documents(table(spark, sf_dir, "documents", "doc_id", "text"), tokenizer_path(), capacity=1024, end_id=0)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and class; null texts and texts without words have the zero fingerprint."""
    classes = near_duplicate_classes(table(spark, sf_dir, "documents", "doc_id", "text"), EXACT)
    return classes.select("doc_id", F.lower(F.lpad(F.hex("f0"), 16, "0")).alias("fingerprint"), "component_id")


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target: documents labelled of good quality; background: all other documents."""
    good = table(spark, sf_dir, "labels", "doc_id", "quality").filter("quality = 1").select("doc_id")
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    models = fit_ngrams(docs, F.lit(False), target_ids=good)
    return score_counted(models)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality score; only labels whose document is not held out are learned from. Null and empty texts are scored too."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    held_out = F.coalesce(crc32_mod(F.col("doc_id"), 3) == 1, F.lit(False))
    model = fit_quality(docs, table(spark, sf_dir, "labels", "doc_id", "quality"), crc32_mod(F.col("doc_id"), 3) != 1)
    scored = score_quality(docs, model)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= model.threshold).cast("int").alias("predicted"))


def preference_pairs(turns: DataFrame, spread: int = 64) -> DataFrame:
    """(conv_id, pair_id, part): conversations that begin with the same turn, two by two in order of id.

    The pair's lower id is the chosen one and names it; a conversation left over is chosen alone.
    Pairs are first made inside ``spread`` groups of ids and the groups' odd ones then meet, so that
    a first turn which many conversations share is not gathered in one place. Ids are not null; null
    roles and texts of a first turn count as absent, turns of equal number go by role and text; empty
    conversations do not exist, repeated first turns count once, other columns are ignored.
    """
    first = turns.groupBy("conv_id").agg(F.min(F.struct("turn", "role", "text")).alias("first"))
    keyed = first.select("conv_id", F.xxhash64("first.role", "first.text").alias("a"), F.md5(F.concat_ws("\x01", "first.role", "first.text")).alias("b"))
    grouped = keyed.withColumn("g", F.pmod("conv_id", F.lit(spread)))
    inner = Window.partitionBy("a", "b", "g").orderBy("conv_id")
    outer = Window.partitionBy("a", "b").orderBy("conv_id")

    def paired(rows: DataFrame, w) -> DataFrame:
        numbered = rows.withColumn("k", F.row_number().over(w)).withColumn("after", F.lead("conv_id").over(w)).withColumn("before", F.lag("conv_id").over(w))
        odd = F.col("k") % 2 == 1
        return numbered.withColumn("pair_id", F.when(odd, F.col("conv_id")).otherwise(F.col("before"))).withColumn("alone", odd & F.col("after").isNull())

    near = paired(grouped, inner)
    left = paired(near.filter("alone").select("conv_id", "a", "b"), outer)
    both = near.filter("not alone").select("conv_id", "pair_id").unionByName(left.select("conv_id", "pair_id"))
    return both.withColumn("part", F.when(F.col("conv_id") == F.col("pair_id"), "chosen").otherwise("rejected"))


def op5_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of conversations that begin alike; turns without a ``conv_id`` belong to no conversation and are left out."""
    turns = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text").filter("conv_id is not null")
    sided = turns.join(preference_pairs(turns), "conv_id")
    return preference_segments(sided.filter("part = 'chosen'"), sided.filter("part = 'rejected'"))


def capture_log(pages: DataFrame) -> DataFrame:
    """A crawl log derived from ``pages``: a full response of each page and a later revisit of its URL.

    What the revisit's headers name follows from the first hex digit of the page's MD5: a stale
    ETag (0, 1), a Last-Modified only (e, f), nothing (d), else the response's ETag; c: the revisit
    came before the response.
    """
    p = pages.select("page_id", "url", F.md5(F.coalesce("html", F.lit("")).cast("binary")).alias("digest"), F.length(F.coalesce("html", F.lit(""))).cast("long").alias("bytes"))
    p = p.withColumn("mark", F.substring("digest", 1, 1)).withColumn("at", F.col("page_id") * 3600)

    def fields(*pairs) -> str:
        return f"filter(array({', '.join(f"named_struct('name', '{n}', 'value', {v})" for n, v in pairs)}), h -> h.value IS NOT NULL)"

    etag, changed = "IF(mark IN ('d', 'e', 'f'), NULL, concat('\"', digest, '\"'))", "concat('day ', cast(page_id as string))"
    seen = "IF(mark IN ('0', '1'), 'W/\"stale\"', IF(mark IN ('d', 'e', 'f'), NULL, concat('W/\"', digest, '\"')))"
    sent = fields(("Content-Type", "'text/html'"), ("Content-Length", "cast(bytes as string)"), ("ETag", etag), ("Last-Modified", changed), ("Cache-Control", "'max-age=60'"))
    again = fields(("Content-Length", "'0'"), ("ETag", seen), ("Last-Modified", f"IF(mark IN ('e', 'f'), {changed}, NULL)"), ("Cache-Control", "'max-age=3600'"), ("Date", "cast(at as string)"))
    names = ("record_id", "url", "at", "kind", "http_status", "headers", "payload_digest", "payload_bytes")
    full = p.selectExpr("page_id * 2", "url", "at", "'response'", "200", sent, "digest", "bytes").toDF(*names)
    back = p.selectExpr("page_id * 2 + 1", "url", "IF(mark = 'c', at - 10, at + 259200)", "'revisit'", "304", again, "cast(NULL as string)", "cast(NULL as bigint)").toDF(*names)
    return full.unionByName(back)


def op6_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every revisit of the log derived from ``pages`` with the response it stands for; a null page counts as empty."""
    return resolve_revisits(capture_log(table(spark, sf_dir, "pages", "page_id", "url", "html")))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language; ``und`` without a letter. Only documents that are not held out are learned from."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    held_out = F.coalesce(crc32_mod(F.col("doc_id"), 4) == 2, F.lit(False))
    model = fit_language(docs, crc32_mod(F.col("doc_id"), 4) != 2)
    return predict_language(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best window of every document and benchmark item with a similarity of 0.8 or more; null and empty texts match nothing."""
    docs, items = table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text")
    return benchmark_matches(docs, items).select("doc_id", "item_id", "start", "n_words", F.round("similarity", 9).alias("similarity"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number of lines taken from each document and a digest of what is left."""
    edited = drop_repeated_lines(table(spark, sf_dir, "documents", "doc_id", "text"), removed_col="lines_removed")
    return edited.select("doc_id", "lines_removed", F.length("text").cast("long").alias("chars_left"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the one of its group that stays, the greatest id; null texts count as empty."""
    return content_sort_dedup(table(spark, sf_dir, "documents", "doc_id", "text"))


LEAF_FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, roots and proof of every document; documents that 7 divides by checksum are verified with one more character."""
    docs = table(spark, sf_dir, "documents", *LEAF_FIELDS)
    changed = changed_leaf(LEAF_FIELDS, {"n_chars": F.col("n_chars") + 1}, crc32_mod(F.col("doc_id"), 7) == 0)
    proofs = merkle_manifest(docs, "doc_id", "lang", LEAF_FIELDS, carry={"changed": changed})
    out = proofs.select("doc_id", "leaf", "subroot", "root", F.sha2(path_text(F.col("path")), 256).alias("proof_sha256"), folded(F.coalesce("changed", "leaf"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text's fingerprint and its likeness to its edited text and to the next document."""
    return weighted_fingerprints(table(spark, sf_dir, "documents", "doc_id", "text"))


def damaged_turns(turns: DataFrame) -> DataFrame:
    """Turns damaged by the CRC-32 of ``conv_id:turn`` modulo 20 (nulls: one space).

    0 drops the row, 1 empties its text, 2 takes the ends of its sentences, 3 repeats it, 4 makes its role user.
    """
    space = F.lit(" ")
    text, role = F.coalesce("text", space), F.coalesce("role", space)
    fault = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space)).cast("binary")) % 20
    rows = turns.select("conv_id", "turn", fault.alias("fault"), role.alias("role"), text.alias("text")).filter("fault <> 0")
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    times = F.explode(F.array_repeat(F.lit(1), F.when(F.col("fault") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), times.alias("times")).drop("times")


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cheapest repair of every damaged conversation; conversations that the damage leaves without rows have zeros."""
    turns = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    report = repair_conversations(damaged_turns(turns))
    every = turns.select("conv_id").distinct()
    joined = every.alias("o").join(report.alias("r"), F.col("o.conv_id").eqNullSafe(F.col("r.conv_id")), "left")
    counts = (F.coalesce(F.col(f"r.{c}"), F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost"))
    return joined.select("o.conv_id", *counts, F.coalesce("r.audit", F.lit("")).alias("audit"), F.coalesce("r.repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_simhash": op2_simhash,
    "op3_lm_score": op3_lm_score,
    "op4_quality": op4_quality,
    "op5_preferences": op5_preferences,
    "op6_revisits": op6_revisits,
    "op7_language": op7_language,
    "op8_decontamination": op8_decontamination,
    "op9_line_dedup": op9_line_dedup,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_merkle": op11_merkle,
    "op12_fingerprints": op12_fingerprints,
    "op13_repair": op13_repair,
}

#: CRC-32 in DuckDB: ``table_of`` holds the 256 steps of a byte, ``crc`` folds a text's characters (ASCII) over them.
CRC = """
crc_table AS (
  SELECT list(list_reduce([k, 0, 0, 0, 0, 0, 0, 0, 0], lambda v, x: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END) ORDER BY k) AS steps
  FROM (SELECT unnest(range(256)) AS k))"""


def crc_of(text: str) -> str:
    """DuckDB SQL: the unsigned CRC-32 of an ASCII text, beside ``crc_table``."""
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split({text}, ''), lambda c: ord(c)::BIGINT)), lambda a, c: xor(a >> 8, steps[(xor(a, c) & 255) + 1])), 4294967295)"


ORACLES: dict[str, str] = {
    "op5_preferences": """
WITH firsts AS (
  SELECT conv_id, min({'t': turn, 'r': role, 'x': text}) AS f FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
numbered AS (
  SELECT conv_id, f.r AS r, f.x AS x,
         row_number() OVER w AS k, lead(conv_id) OVER w AS after, lag(conv_id) OVER w AS before
  FROM firsts WINDOW w AS (PARTITION BY f.r, f.x, conv_id % 64 ORDER BY conv_id)),
left_over AS (
  SELECT conv_id, row_number() OVER w AS k, lag(conv_id) OVER w AS before
  FROM numbered WHERE k % 2 = 1 AND after IS NULL WINDOW w AS (PARTITION BY r, x ORDER BY conv_id)),
pairs AS (
  SELECT conv_id, CASE WHEN k % 2 = 1 THEN conv_id ELSE before END AS pair_id FROM numbered WHERE NOT (k % 2 = 1 AND after IS NULL)
  UNION ALL SELECT conv_id, CASE WHEN k % 2 = 1 THEN conv_id ELSE before END FROM left_over),
sided AS (
  SELECT pair_id, CASE WHEN c.conv_id = pair_id THEN 'chosen' ELSE 'rejected' END AS part,
         coalesce(turn, 9223372036854775807) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations c JOIN pairs p ON c.conv_id = p.conv_id),
slots AS (
  SELECT pair_id, part, turn, string_agg(role || chr(1) || text, chr(2) ORDER BY role, text) AS s FROM sided GROUP BY ALL),
splits AS (
  SELECT coalesce(a.pair_id, b.pair_id) AS pair_id, min(coalesce(a.turn, b.turn)) AS split
  FROM (SELECT * FROM slots WHERE part = 'chosen') a
  FULL JOIN (SELECT * FROM slots WHERE part = 'rejected') b ON a.pair_id = b.pair_id AND a.turn = b.turn
  WHERE a.s IS DISTINCT FROM b.s GROUP BY 1),
placed AS (
  SELECT s.*, (split IS NULL OR turn < split) AS common FROM sided s LEFT JOIN splits p ON s.pair_id = p.pair_id),
parts AS (
  SELECT pair_id, CASE WHEN common THEN 'prompt' ELSE part END AS part, turn, role,
         '<|im_start|>' || role || chr(10) AS header, text || '<|im_end|>' || chr(10) AS body
  FROM placed WHERE NOT (common AND part = 'rejected'))
SELECT pair_id, part, turn, role, header || body AS segment,
       CASE WHEN part <> 'prompt' AND role = 'assistant' THEN length(header) ELSE length(header || body) END AS loss_from,
       CASE WHEN part <> 'prompt' AND role = 'assistant' THEN length(body) ELSE 0 END AS loss_chars
FROM parts
""",
    "op6_revisits": """
WITH p AS (
  SELECT page_id, md5(coalesce(html, '')) AS digest, length(coalesce(html, '')) AS bytes, page_id * 3600 AS t,
         regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS rest
  FROM pages),
q AS (
  SELECT *, digest[1] AS mark,
         regexp_replace(regexp_replace(lower(regexp_extract(rest, '^[^/?]*', 0)), '^www\\.', ''), ':(80|443)$', '') AS host,
         regexp_replace(regexp_extract(rest, '^[^/?]*([^?]*)', 1), '/+$', '') AS path,
         list_sort(list_filter(string_split(regexp_extract(rest, '\\?(.*)$', 1), '&'),
                   lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[^=]*|ref|gclid|fbclid)(=|$)'))) AS params
  FROM p),
c AS (
  SELECT *, host || path || CASE WHEN len(params) > 0 THEN '?' || array_to_string(params, '&') ELSE '' END AS canonical_url FROM q),
full_responses AS (
  SELECT canonical_url, t, max(page_id * 2) AS response_id, arg_max(digest, page_id) AS digest, arg_max(bytes, page_id) AS bytes,
         arg_max(mark, page_id) AS mark, max(page_id) AS pid FROM c GROUP BY canonical_url, t),
revisits AS (
  SELECT page_id * 2 + 1 AS record_id, canonical_url, CASE WHEN mark = 'c' THEN t - 10 ELSE t + 259200 END AS at_s, t AS sent, mark, digest, page_id FROM c),
met AS (
  SELECT r.*, f.response_id, f.digest AS f_digest, f.bytes AS f_bytes, f.mark AS f_mark, f.pid
  FROM revisits r ASOF LEFT JOIN full_responses f ON r.canonical_url = f.canonical_url AND r.at_s > f.t),
judged AS (
  SELECT *, CASE WHEN response_id IS NULL THEN 'missing'
    WHEN mark IN ('0', '1') THEN 'mismatch'
    WHEN mark IN ('e', 'f') THEN CASE WHEN page_id = pid THEN 'resolved' ELSE 'mismatch' END
    WHEN mark = 'd' THEN 'unverified'
    WHEN f_mark NOT IN ('d', 'e', 'f') AND f_digest = digest THEN 'resolved' ELSE 'mismatch' END AS status
  FROM met)
SELECT record_id, canonical_url, at_s AS "at", response_id, status,
  CASE WHEN status IN ('resolved', 'unverified') THEN
    'cache-control: max-age=3600' || chr(10) || 'content-length: ' || f_bytes || chr(10) || 'content-type: text/html' || chr(10)
    || 'date: ' || sent
    || CASE WHEN mark NOT IN ('d', 'e', 'f') THEN chr(10) || 'etag: W/"' || digest || '"'
            WHEN f_mark NOT IN ('d', 'e', 'f') THEN chr(10) || 'etag: "' || f_digest || '"' ELSE '' END
    || chr(10) || 'last-modified: day ' || pid END AS headers,
  CASE WHEN status IN ('resolved', 'unverified') THEN f_digest END AS payload_digest,
  CASE WHEN status IN ('resolved', 'unverified') THEN f_bytes END AS payload_bytes
FROM judged
""",
    "op10_exact_dedup": """
SELECT doc_id,
       max(doc_id) OVER g AS keep_id,
       count(*) OVER g AS group_size,
       row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW g AS (PARTITION BY coalesce(text, ''))
""",
    "op11_merkle": f"""
WITH RECURSIVE {CRC.strip()},
fields AS (
  SELECT doc_id, coalesce('=' || lang, '') AS g, n_chars,
         coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS head,
         coalesce(strlen(text) || ':' || text, '-') AS tail,
         {crc_of("doc_id::VARCHAR")} % 7 = 0 AS tampered
  FROM documents, crc_table),
leaves AS (
  SELECT doc_id, g, sha256(head || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') || tail) AS leaf,
         CASE WHEN tampered THEN sha256(head || coalesce(strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1), '-') || tail) END AS changed
  FROM fields),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM leaves),
low AS (
  SELECT g, 0 AS l, i, n, leaf AS node FROM placed
  UNION ALL
  SELECT g, l + 1, i // 2, (n + 1) // 2, sha256(string_agg(node, '' ORDER BY i)) FROM low WHERE n > 1 GROUP BY g, l, i // 2, n),
tops AS (
  SELECT g, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS n, l AS height, node FROM low WHERE n = 1),
high AS (
  SELECT 0 AS l, i, n, node FROM tops
  UNION ALL
  SELECT l + 1, i // 2, (n + 1) // 2, sha256(string_agg(node, '' ORDER BY i)) FROM high WHERE n > 1 GROUP BY l, i // 2, n),
steps AS (
  SELECT p.doc_id, p.leaf, p.g, p.i AS leaf_i, t.node AS subroot, p.changed, s.l AS l, ((p.i >> s.l) & 1) = 1 AS on_left, o.node AS sibling
  FROM placed p JOIN tops t ON p.g = t.g JOIN (SELECT DISTINCT g, l FROM low WHERE n > 1) s ON s.g = p.g
  LEFT JOIN low o ON o.g = p.g AND o.l = s.l AND o.i = xor(p.i >> s.l, 1)
  UNION ALL
  SELECT p.doc_id, p.leaf, p.g, p.i, t.node, p.changed, t.height + s.l, ((t.i >> s.l) & 1) = 1, o.node
  FROM placed p JOIN tops t ON p.g = t.g, (SELECT DISTINCT l FROM high WHERE n > 1) s
  LEFT JOIN high o ON o.l = s.l AND o.i = xor(t.i >> s.l, 1)),
paths AS (
  SELECT p.doc_id, p.leaf, p.g, p.i, t.node AS subroot, coalesce(any_value(p.changed), p.leaf) AS start,
         coalesce(list({{'left': on_left, 'h': coalesce(sibling, '')}} ORDER BY s.l) FILTER (s.l IS NOT NULL), []) AS path
  FROM placed p JOIN tops t ON p.g = t.g LEFT JOIN steps s ON s.g = p.g AND s.leaf_i = p.i
  GROUP BY p.doc_id, p.leaf, p.g, p.i, t.node),
folds AS (
  SELECT doc_id, leaf, subroot, path, 0 AS k, start AS node, g, i FROM paths
  UNION ALL
  SELECT doc_id, leaf, subroot, path, k + 1, sha256(CASE WHEN path[k + 1].left THEN path[k + 1].h || node ELSE node || path[k + 1].h END), g, i
  FROM folds WHERE k < len(path))
SELECT doc_id, leaf, subroot, r.node AS root, sha256(list_aggregate(list_concat([''], list_transform(path, lambda x: x.h)), 'string_agg', '')) AS proof_sha256,
       f.node AS folded_root, f.node = r.node AS verified
FROM folds f, (SELECT node FROM high WHERE n = 1) r WHERE k = len(path)
""",
    "op13_repair": f"""
WITH RECURSIVE {CRC.strip()},
filled AS (
  SELECT conv_id, coalesce(conv_id::VARCHAR, ' ') AS g, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         {crc_of("(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))")} % 20 AS fault
  FROM conversations, crc_table),
damaged AS (
  SELECT g, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
         CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM filled, range(2) times(k) WHERE fault <> 0 AND (k = 0 OR fault = 3)),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY g ORDER BY turn NULLS FIRST, role, text) AS i, left(role, 1) AS cls,
         NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank,
         regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS tail
  FROM damaged),
rows AS (
  SELECT *, NOT blank AND again AS duplicate, NOT blank AND NOT again AND NOT tail IN ('.', '!', '?') AS truncated,
         lag(cls) OVER (PARTITION BY g ORDER BY i) || cls AS pair
  FROM (SELECT *, row_number() OVER (PARTITION BY g, role, text ORDER BY i) > 1 AS again FROM placed)),
ins(q, q2, cost, letters, added) AS (
  VALUES (0, 0, 0, '', []::VARCHAR[]), (0, 2, 3, 'I', ['user:']), (0, 3, 6, 'II', ['user:', 'assistant:']), (1, 1, 0, '', []), (1, 2, 3, 'I', ['user:']),
         (1, 3, 6, 'II', ['user:', 'assistant:']), (2, 2, 0, '', []), (2, 3, 3, 'I', ['assistant:']), (3, 3, 0, '', []), (3, 2, 3, 'I', ['user:'])),
moves(letter, q, q2, cls, cost, role) AS (
  VALUES ('D', 0, 0, NULL, 4, NULL), ('D', 1, 1, NULL, 4, NULL), ('D', 2, 2, NULL, 4, NULL), ('D', 3, 3, NULL, 4, NULL),
         ('K', 0, 1, 's', 0, NULL), ('K', 0, 2, 'u', 0, NULL), ('K', 1, 2, 'u', 0, NULL), ('K', 2, 3, 'a', 0, NULL), ('K', 3, 2, 'u', 0, NULL),
         ('R', 0, 2, NULL, 3, 'user'), ('R', 1, 2, NULL, 3, 'user'), ('R', 2, 3, NULL, 3, 'assistant'), ('R', 3, 2, NULL, 3, 'user')),
dp AS (
  SELECT g, 0::BIGINT AS i, q2 AS q, {{'c': cost, 'a': letters, 't': added}} AS s FROM (SELECT DISTINCT g FROM rows), ins WHERE q = 0
  UNION ALL
  SELECT d.g, r.i, e.q2, min({{'c': d.s.c + m.cost + CASE WHEN m.letter <> 'D' AND r.truncated THEN 3 ELSE 0 END + e.cost, 'a': d.s.a || m.letter || e.letters,
         't': list_concat(d.s.t, CASE WHEN m.letter = 'D' THEN []::VARCHAR[] ELSE [coalesce(m.role, r.role) || ':' || r.text] END, e.added)}})
  FROM dp d JOIN rows r ON r.g = d.g AND r.i = d.i + 1 JOIN moves m ON m.q = d.q AND (m.letter = 'D' OR NOT (r.blank OR r.duplicate)) AND (m.cls IS NULL OR m.cls = r.cls)
  JOIN ins e ON e.q = m.q2 GROUP BY d.g, r.i, e.q2),
counts AS (
  SELECT g, max(i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate,
         count(*) FILTER (truncated) AS truncated, count(*) FILTER (pair IS NOT NULL AND NOT pair IN ('su', 'ua', 'au')) AS illegal
  FROM rows GROUP BY g),
best AS (
  SELECT c.*, (SELECT min(s) FROM dp WHERE dp.g = c.g AND dp.i = c.n AND q IN (0, 3)) AS s FROM counts c)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, coalesce(s.c, 0)::BIGINT AS cost, coalesce(s.a, '') AS audit, sha256(coalesce(array_to_string(s.t, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, g FROM filled) o LEFT JOIN best b ON b.g = o.g
""",
}
