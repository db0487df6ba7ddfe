"""WARC captures: resolving not-modified revisits to the latest earlier full response.

An as-of join by canonical URL. Captures are put into time buckets, so that a URL with a third of
all captures is spread over many groups: the answer is looked for inside the revisit's bucket, and
else taken from the last response of the URL's earlier buckets, of which there is one row each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Header fields that a 304 response may update (RFC 9110 section 15.4.5, RFC 9111 section 3.2). Fixed values.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
#: Query parameters that do not name a resource. Fixed values.
TRACKING = "^(utm_[^=]*|ref|gclid|fbclid)(=|$)"
BUCKET_SECONDS = 7 * 86_400


def canonical_url(url: Column) -> Column:
    """Host in lower case without ``www.`` and default port, path without end slashes, sorted query
    without tracking parameters; no scheme, no fragment. Null stays null."""
    rest = F.regexp_replace(F.regexp_replace(F.trim(url), "#.*$", ""), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(rest, "^[^/?]*", 0)), r"^www\.", ""), ":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(rest, r"^[^/?]*([^?]*)", 1), "/+$", "")
    query = F.split(F.regexp_extract(rest, r"\?(.*)$", 1), "&")
    params = F.array_sort(F.filter(query, lambda p: (p != "") & ~p.rlike(TRACKING)))
    return F.concat(host, path, F.when(F.size(params) > 0, F.concat(F.lit("?"), F.array_join(params, "&"))).otherwise(F.lit("")))


def _header(headers: str, name: str) -> Column:
    return F.expr(f"get(filter({headers}, h -> h.name = '{name}'), 0).value")


def _lower_names(headers: Column) -> Column:
    none = F.expr("cast(array() as array<struct<name:string,value:string>>)")
    return F.coalesce(F.transform(headers, lambda h: F.struct(F.lower(h["name"]).alias("name"), h["value"].alias("value"))), none)


def resolve_revisits(captures: DataFrame, bucket_seconds: int = BUCKET_SECONDS) -> DataFrame:
    """One row per revisit of ``captures``: record_id, canonical_url, at, response_id, status, headers,
    payload_digest, payload_bytes.

    ``captures``: record_id long, url string, at long (seconds), kind string (``response`` or
    ``revisit``), http_status int, headers array<struct<name, value>>, payload_digest string,
    payload_bytes long. A full response is a ``response`` of status 200 with a URL and a time. A
    revisit meets the response of its canonical URL with the greatest time below its own (of equal
    times the greatest record_id). ``status``:

    * ``resolved``: the revisit's ETag (weak comparison), or without one its Last-Modified, is the response's;
    * ``unverified``: it names neither; it is resolved all the same;
    * ``mismatch``: it names one and the response's is another or absent; headers and payload stay null;
    * ``missing``: no earlier full response, a null URL or a null time.

    Resolved headers are the response's, of which those that a 304 may send are replaced by the
    revisit's, with lower-case names, sorted. Repeated revisits are resolved each; other columns are
    ignored; an empty table gives an empty result.
    """
    rows = captures.select(
        F.col("record_id").cast("long").alias("record_id"),
        canonical_url(F.col("url")).alias("canonical_url"),
        F.col("at").cast("long").alias("at"),
        "kind",
        "http_status",
        _lower_names(F.col("headers")).alias("headers"),
        "payload_digest",
        "payload_bytes",
    ).withColumn("bucket", F.floor(F.col("at") / bucket_seconds))
    usable = F.col("canonical_url").isNotNull() & F.col("at").isNotNull()
    full = (F.col("kind") == "response") & (F.col("http_status") == 200) & usable
    response = F.when(full, F.struct("at", F.col("record_id").alias("id"), "headers", "payload_digest", "payload_bytes"))
    marked = rows.withColumn("response", response).filter(full | (F.col("kind") == "revisit"))
    inside = Window.partitionBy("canonical_url", "bucket").orderBy("at").rangeBetween(Window.unboundedPreceding, -1)
    near = marked.withColumn("found", F.max("response").over(inside)).filter((F.col("kind") == "revisit") & usable)
    lasts = marked.filter(full).groupBy("canonical_url", "bucket").agg(F.max("response").alias("last"))
    # one row per URL and bucket with a capture: what earlier buckets hold
    steps = marked.filter(usable).select("canonical_url", "bucket").distinct().join(lasts, ["canonical_url", "bucket"], "left")
    before = Window.partitionBy("canonical_url").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = steps.withColumn("carried", F.max("last").over(before)).select("canonical_url", "bucket", "carried").filter("carried is not null")
    met = near.join(carried, ["canonical_url", "bucket"], "left").withColumn("response", F.coalesce("found", "carried")).drop("found", "carried")
    lost = rows.filter((F.col("kind") == "revisit") & ~usable).withColumn("response", F.lit(None).cast(met.schema["response"].dataType))
    out = met.unionByName(lost.select(met.columns))

    tag, old_tag = (F.regexp_replace(_header(h, "etag"), "^W/", "") for h in ("headers", "response.headers"))
    changed, old_changed = (_header(h, "last-modified") for h in ("headers", "response.headers"))
    status = (
        F.when(F.col("response").isNull(), "missing")
        .when(tag.isNotNull(), F.when(tag.eqNullSafe(old_tag), "resolved").otherwise("mismatch"))
        .when(changed.isNotNull(), F.when(changed.eqNullSafe(old_changed), "resolved").otherwise("mismatch"))
        .otherwise("unverified")
    )
    allowed = ", ".join(f"'{n}'" for n in PERMITTED)
    fresh = f"filter(headers, h -> h.name IN ({allowed}))"
    kept = f"filter(response.headers, h -> NOT exists({fresh}, f -> f.name = h.name))"
    merged = F.expr(f"array_join(array_sort(transform(concat({kept}, {fresh}), h -> concat(h.name, ': ', coalesce(h.value, '')))), '\n')")
    good = F.col("status").isin("resolved", "unverified")
    return out.withColumn("status", status).select(
        "record_id",
        "canonical_url",
        "at",
        F.col("response.id").alias("response_id"),
        "status",
        F.when(good, merged).alias("headers"),
        F.when(good, F.col("response.payload_digest")).alias("payload_digest"),
        F.when(good, F.col("response.payload_bytes")).alias("payload_bytes"),
    )
