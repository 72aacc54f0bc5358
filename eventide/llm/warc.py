"""Web archives: not-modified revisits resolved by an as-of join to the latest earlier full response.

Records are captures (record_id, url, at, kind, headers, payload_sha256, payload_bytes) of kind 'response' or
'revisit'. A revisit refers to the latest response with the same canonical URL before it (ties in time:
the larger record_id); its validators (ETag, compared weakly, or else Last-Modified) must agree with that
response's. Its headers then update the stored ones, but for those that a not-modified answer must not
change. Payloads are never moved: only their digests and sizes go through the join.

The join holds up if most captures share one URL: records are dealt by ranges of (URL, time), so a hot
URL is cut into chunks; a window finds the last response within a chunk, and one row per URL and chunk
carries it on to later chunks.

Canonical URLs drop the scheme, "www.", default ports, fragments, trailing slashes and tracking parameters, and
sort the other parameters; hosts are put in lower case. A record without URL or time resolves to nothing
and is given as 'unresolved'. Repeated rows are kept. Extra columns are left aside. No records, no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

# Fields of a stored response that a not-modified answer does not replace (RFC 9111, 3.2).
KEPT = ("connection", "content-encoding", "content-length", "content-range", "content-type", "transfer-encoding")
TRACKING = "^(utm_[^=]*|ref|fbclid|gclid)(=|$)"
SCHEME = "^[A-Za-z][A-Za-z0-9+.-]*://"


def canonical_url(url: Column) -> Column:
    host = F.lower(F.regexp_extract(url, SCHEME + "([^/?#]*)", 1))
    host = F.regexp_replace(F.regexp_replace(host, "^www[.]", ""), ":(80|443)$", "")
    rest = F.regexp_replace(F.regexp_replace(url, SCHEME + "[^/?#]*", ""), "#.*$", "")
    path = F.regexp_replace(F.regexp_replace(rest, "[?].*$", ""), "/+$", "")
    asked = F.when(F.instr(rest, "?") > 0, F.regexp_replace(rest, "^[^?]*[?]", "")).otherwise("")
    parts = F.array_sort(F.filter(F.split(asked, "&"), lambda x: (x != "") & ~x.rlike(TRACKING)))
    return F.concat(host, path, F.when(F.size(parts) > 0, F.concat(F.lit("?"), F.array_join(parts, "&"))).otherwise(""))


def resolve(records: DataFrame) -> DataFrame:
    """One row per revisit: (record_id, url, canonical, at, response_id, verdict, headers, payload_sha256, payload_bytes).

    verdict is 'resolved', 'mismatch' (the validators differ) or 'unresolved' (no earlier response); headers
    and payload are those of the merged response where resolved, else null.
    """
    light = records.select("record_id", "url", canonical_url(F.col("url")).alias("canonical"), "at", "kind", "headers", "payload_sha256", "payload_bytes")
    light = light.withColumn("late", (F.col("kind") == "response").cast("int"))
    dealt = light.repartitionByRange("canonical", "at", "late", "record_id").withColumn("chunk", F.spark_partition_id())
    dealt = materialize(dealt, "captures")  # the chunks must not change from here on
    full = F.when((F.col("kind") == "response") & F.col("canonical").isNotNull() & F.col("at").isNotNull(), F.struct("at", "record_id", "headers", "payload_sha256", "payload_bytes"))
    order = ["at", "late", "record_id"]
    within = Window.partitionBy("canonical", "chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    seen = dealt.withColumn("seen", F.last(full, ignorenulls=True).over(within)).where("kind = 'revisit'")
    ends = dealt.groupBy("canonical", "chunk").agg(F.max_by(full, F.when(full.isNotNull(), F.struct("at", "record_id"))).alias("last"))
    before = Window.partitionBy("canonical").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.withColumn("carried", F.last("last", ignorenulls=True).over(before)).select("canonical", "chunk", "carried").where("canonical is not null and carried is not null")
    found = seen.join(carried, ["canonical", "chunk"], "left").withColumn("r", F.when(F.col("canonical").isNotNull() & F.col("at").isNotNull(), F.coalesce("seen", "carried")))
    weak = lambda c: F.regexp_replace(c, "^W/", "")
    mine, theirs = F.col("headers"), F.col("r.headers")
    agree = F.when(mine["etag"].isNotNull(), F.coalesce(weak(mine["etag"]) == weak(theirs["etag"]), F.lit(False))).when(mine["last-modified"].isNotNull(), F.coalesce(mine["last-modified"] == theirs["last-modified"], F.lit(False))).otherwise(True)
    verdict = F.when(F.col("r").isNull(), "unresolved").when(agree, "resolved").otherwise("mismatch")
    fresh = F.map_filter(F.coalesce(mine, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))), lambda k, v: ~k.isin(*KEPT) & v.isNotNull())
    merged = F.map_concat(F.map_filter(theirs, lambda k, v: ~F.array_contains(F.map_keys(fresh), k)), fresh)
    good = lambda c: F.when(F.col("verdict") == "resolved", c)
    found = found.withColumn("verdict", verdict)
    return found.select("record_id", "url", "canonical", "at", F.when(F.col("verdict") != "unresolved", F.col("r.record_id")).alias("response_id"), "verdict", good(merged).alias("headers"), good(F.col("r.payload_sha256")).alias("payload_sha256"), good(F.col("r.payload_bytes")).alias("payload_bytes"))


def captures(pages: DataFrame) -> DataFrame:
    """A crawl made of pages: page p is fetched at minute p, and asked for again a day later with its ETag."""
    html = F.coalesce("html", F.lit(""))
    tag = F.concat(F.lit('"'), F.md5(html.cast("binary")), F.lit('"'))
    date = lambda at: F.date_format(F.timestamp_seconds(at), "yyyy-MM-dd HH:mm:ss")
    base = pages.select(F.col("page_id").cast("long").alias("p"), "url", F.sha2(html.cast("binary"), 256).alias("digest"), F.octet_length(html).cast("long").alias("size"), tag.alias("tag"))
    first, again = F.col("p") * 60, F.col("p") * 60 + 86400
    row = lambda *x: F.struct(*(c.alias(n) for c, n in zip(x, ("record_id", "url", "at", "kind", "headers", "payload_sha256", "payload_bytes"))))
    text = F.lit(None).cast("string")
    response = row(F.col("p"), F.col("url"), first, F.lit("response"), F.create_map(F.lit("cache-control"), F.lit("max-age=60"), F.lit("content-length"), F.col("size").cast("string"), F.lit("content-type"), F.lit("text/html"), F.lit("date"), date(first), F.lit("etag"), F.col("tag"), F.lit("last-modified"), date(first)), F.col("digest"), F.col("size"))
    revisit = row(F.col("p"), F.col("url"), again, F.lit("revisit"), F.create_map(F.lit("cache-control"), F.concat(F.lit("max-age="), (60 + F.col("p") % 7).cast("string")), F.lit("content-length"), F.lit("0"), F.lit("content-type"), F.lit("text/plain"), F.lit("date"), date(again), F.lit("etag"), F.concat(F.lit("W/"), F.col("tag"))), text, F.lit(None).cast("long"))
    return base.select(F.inline(F.array(response, revisit)))


def op6_revisits(spark, sf_dir: str) -> DataFrame:
    out = resolve(captures(spark.read.parquet(f"{sf_dir}/pages.parquet")))
    lines = F.array_join(F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "\n")
    return out.select(F.col("record_id").alias("page_id"), "url", "canonical", "at", F.col("response_id").alias("response_page_id"), "verdict", lines.alias("merged_headers"), "payload_sha256", "payload_bytes")


ORACLE = r"""
WITH p AS (
  SELECT page_id AS p, url, coalesce(html, '') AS html,
    regexp_replace(regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), '^www[.]', ''), ':(80|443)$', '') AS host,
    regexp_replace(regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*', ''), '#.*$', '') AS rest
  FROM pages
), c AS (
  SELECT *, regexp_replace(regexp_replace(rest, '[?].*$', ''), '/+$', '') AS path,
    list_sort(list_filter(string_split(CASE WHEN contains(rest, '?') THEN regexp_replace(rest, '^[^?]*[?]', '') ELSE '' END, '&'),
      lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[^=]*|ref|fbclid|gclid)(=|$)'))) AS parts
  FROM p
), d AS (
  SELECT p, url, html, host || path || CASE WHEN len(parts) > 0 THEN '?' || array_to_string(parts, '&') ELSE '' END AS canonical FROM c
), r AS (
  SELECT d.p, d.url, d.canonical, d.p * 60 + 86400 AS at, max(e.p) AS q
  FROM d LEFT JOIN d e ON d.canonical = e.canonical AND e.p * 60 < d.p * 60 + 86400
  GROUP BY ALL
)
SELECT r.p AS page_id, r.url, r.canonical, r.at, r.q AS response_page_id,
  CASE WHEN r.q IS NULL THEN 'unresolved' WHEN d.html = o.html THEN 'resolved' ELSE 'mismatch' END AS verdict,
  CASE WHEN d.html = o.html THEN 'cache-control: max-age=' || (60 + r.p % 7)::VARCHAR || chr(10) || 'content-length: ' || strlen(o.html)::VARCHAR || chr(10)
    || 'content-type: text/html' || chr(10) || 'date: ' || strftime(make_timestamp(r.at * 1000000), '%Y-%m-%d %H:%M:%S') || chr(10)
    || 'etag: W/"' || md5(d.html) || '"' || chr(10) || 'last-modified: ' || strftime(make_timestamp(o.p * 60000000), '%Y-%m-%d %H:%M:%S') END AS merged_headers,
  CASE WHEN d.html = o.html THEN sha256(o.html) END AS payload_sha256,
  CASE WHEN d.html = o.html THEN strlen(o.html)::BIGINT END AS payload_bytes
FROM r JOIN d ON d.p = r.p LEFT JOIN d o ON o.p = r.q
"""
