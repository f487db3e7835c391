"""Operator 2: not-modified revisit records resolved to the latest earlier full response of their URL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import settle

#: Fixed names (RFC 9110, RFC 9111): fields of a 304 response that never replace those of the stored response.
KEPT_FIELDS = (
    "connection", "content-encoding", "content-length", "content-range", "content-type", "keep-alive",
    "proxy-authenticate", "proxy-authentication-info", "proxy-authorization", "te", "trailer", "transfer-encoding",
    "upgrade",
)
#: Query parameters that only track a visit.
TRACKING = "^(utm_[a-z]+|ref|fbclid|gclid|sessionid)(=|$)"
#: Width of a time slice: a URL's records meet slice by slice, its slices meet as one row each.
SLICE_SECONDS = 86_400


def canonical_url(url: Column) -> Column:
    """Lower-case host without www. and default port, path without index page and end slash, sorted
    parameters without tracking, no scheme, no fragment.  Null stays null."""
    bare = F.regexp_replace(F.trim(url), "#.*$", "")
    rest = F.regexp_replace(bare, "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(rest, "^[^/?]*", 0)), "^www\\.|:(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(rest, "^[^/?]*([^?]*)", 1), "(/(index\\.html?)?)$", "")
    asked = F.filter(
        F.split(F.regexp_extract(rest, "\\?(.*)$", 1), "&"), lambda p: (p != "") & ~F.lower(p).rlike(TRACKING)
    )
    return F.concat(host, path, F.when(F.size(asked) > 0, F.concat(F.lit("?"), F.array_join(F.array_sort(asked), "&"))).otherwise(""))


def header_map(block: Column) -> Column:
    """An HTTP header block as map(lower-case name -> value); repeated names are joined by a comma."""
    lines = F.filter(F.split(F.coalesce(block, F.lit("")), "\r?\n"), lambda x: x.rlike("^[^:\\s]+:"))
    fields = F.transform(
        lines,
        lambda x: F.struct(F.lower(F.substring_index(x, ":", 1)).alias("k"), F.trim(F.regexp_replace(x, "^[^:]*:", "")).alias("v")),
    )
    names = F.array_distinct(F.transform(fields, lambda x: x["k"]))
    return F.map_from_entries(
        F.transform(
            names,
            lambda n: F.struct(n, F.array_join(F.transform(F.filter(fields, lambda x: x["k"] == n), lambda x: x["v"]), ", ")),
        )
    )


def merge_headers(stored: Column, new: Column) -> Column:
    """stored, with every field of new that a not-modified response may update."""
    taken = F.map_filter(new, lambda k, v: ~k.isin(*KEPT_FIELDS))
    return F.map_concat(F.map_filter(stored, lambda k, v: ~F.map_contains_key(taken, k)), taken)


def resolve_revisits(records: DataFrame, slice_seconds: int = SLICE_SECONDS) -> DataFrame:
    """One row per revisit of records(record_id, warc_type, target_uri, warc_date timestamp, http_status int,
    http_headers string, payload_digest string).

    Adds canonical_url, referred_id, verdict and headers (stored fields merged with the permitted new ones).
    verdict: resolved; changed (a validator differs: entity tag compared weakly, else Last-Modified, else the
    payload digest); unchecked (the revisit has none that the response has); unresolved (no strictly earlier full
    response).  Only resolved and unchecked rows take headers and referred_id.

    As-of join in two steps: inside a slice of time a window finds the last response; for revisits without
    one, the last response of earlier slices, where each slice is one row.  So a URL with any share of
    the records is spread over its slices.  Of responses at one instant the largest record_id counts.  Rows
    without URL or date are unresolved; repeated rows repeat; other columns are ignored.  Headers are parsed once,
    into a written table that the steps read.
    """
    full = (F.col("warc_type") == "response") & (F.col("http_status") == 200)
    row = records.select(
        "record_id",
        canonical_url(F.col("target_uri")).alias("canonical_url"),
        F.col("warc_date").alias("at"),
        F.coalesce(full, F.lit(False)).alias("full"),
        F.coalesce((F.col("warc_type") == "revisit") & (F.coalesce("http_status", F.lit(304)) == 304), F.lit(False)).alias("asks"),
        header_map(F.col("http_headers")).alias("h"),
        F.col("payload_digest").alias("digest"),
    ).where("full or asks")
    slot = F.floor(F.unix_micros(F.col("at").cast("timestamp")) / (slice_seconds * 1_000_000)).cast("long")
    row = settle(row.withColumn("slot", slot))
    known = "canonical_url is not null and at is not null"
    stored = F.when(F.col("full"), F.struct("record_id", "h", "digest"))
    inside = Window.partitionBy("canonical_url", "slot").orderBy("at", F.col("full").cast("int"), "record_id")
    near = row.where(known).withColumn("near", F.last(stored, ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    ends = (
        row.where(known)
        .groupBy("canonical_url", "slot")
        .agg(
            F.max_by(stored, F.when(F.col("full"), F.struct("at", "record_id"))).alias("last"),
            F.max("asks").alias("any_asks"),
        )
    )
    across = Window.partitionBy("canonical_url").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.withColumn("before", F.last("last", ignorenulls=True).over(across)).where("any_asks and before is not null")
    asked = near.where("asks").join(carried.select("canonical_url", "slot", "before"), ["canonical_url", "slot"], "left")
    asked = asked.withColumn("found", F.coalesce("near", "before")).unionByName(
        row.where(f"asks and not ({known})"), allowMissingColumns=True
    )
    tag = lambda h: F.regexp_replace(h["etag"], "^W/", "")
    mine, theirs = F.col("h"), F.col("found.h")
    verdict = (
        F.when(F.col("found").isNull(), "unresolved")
        .when(tag(mine).isNotNull() & tag(theirs).isNotNull(), F.when(tag(mine) == tag(theirs), "resolved").otherwise("changed"))
        .when(
            mine["last-modified"].isNotNull() & theirs["last-modified"].isNotNull(),
            F.when(mine["last-modified"] == theirs["last-modified"], "resolved").otherwise("changed"),
        )
        .when(
            F.col("digest").isNotNull() & F.col("found.digest").isNotNull(),
            F.when(F.col("digest") == F.col("found.digest"), "resolved").otherwise("changed"),
        )
        .otherwise("unchecked")
    )
    ok = F.col("verdict").isin("resolved", "unchecked")
    return asked.withColumn("verdict", verdict).select(
        "record_id",
        "canonical_url",
        "verdict",
        F.when(ok, F.col("found.record_id")).alias("referred_id"),
        F.when(ok, F.col("found.digest")).alias("payload_digest"),
        F.when(ok, merge_headers(theirs, mine)).alias("headers"),
    )


#: Start and spacing of the visits that records() derives.
EPOCH = "2024-01-01 00:00:00"


def records(pages: DataFrame) -> DataFrame:
    """A crawl's WARC records derived from pages(page_id, url, html): one full response and three revisits each.

    Visit k of page p lies k * 40,000 + (p * 7919) % 90,000 seconds after the start; every 11th page's first
    revisit comes before its response.  Every 7th page changes its entity tag at the third visit, every 5th
    sends no entity tag, every 35th no validator at all; revisits vary in scheme, fragment and tracking."""
    p, k = F.col("page_id"), F.col("k")
    at = k * 40_000 + (p * 7919) % 90_000 - F.when((k == 1) & (p % 11 == 0), 50_000).otherwise(0)
    tag = F.concat(F.lit("ETag: \""), F.md5(F.concat(F.coalesce("html", F.lit("")), F.when((k == 2) & (p % 7 == 0), "changed").otherwise(""))), F.lit("\"\r\n"))
    modified = F.concat(F.lit("Last-Modified: "), (p % 28 + 1).cast("string"), F.lit(" Dec 2023\r\n"))
    block = F.concat(
        F.when(k == 0, "HTTP/1.1 200 OK\r\n").otherwise("HTTP/1.1 304 Not Modified\r\n"),
        F.when(p % 5 == 0, "").otherwise(tag),
        F.when(p % 35 == 0, "").otherwise(modified),
        F.when(k == 0, F.concat(F.lit("Content-Type: text/html\r\nContent-Length: "), F.length(F.coalesce("html", F.lit(""))).cast("string"), F.lit("\r\n"))).otherwise("Content-Length: 0\r\n"),
        F.lit("Cache-Control: max-age="), (k * 60).cast("string"), F.lit("\r\n"),
    )
    bare = F.regexp_replace("url", "#.*$", "")
    mark = F.when(F.contains(bare, F.lit("?")), "&").otherwise("?")
    uri = F.when(k == 1, F.concat(bare, F.lit("#again"))).when(k == 2, F.concat(bare, mark, F.lit("utm_source=feed"))).otherwise(F.col("url"))
    return pages.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(3)))).select(
        (p * 4 + k).alias("record_id"),
        F.when(k == 0, "response").otherwise("revisit").alias("warc_type"),
        uri.alias("target_uri"),
        F.timestamp_seconds(F.unix_timestamp(F.lit(EPOCH)) + at).alias("warc_date"),
        F.when(k == 0, 200).otherwise(304).alias("http_status"),
        block.alias("http_headers"),
        F.when(k == 0, F.md5("html")).alias("payload_digest"),
    )


def op2(pages: DataFrame) -> DataFrame:
    fields = F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit(": "), e["value"])))
    return resolve_revisits(records(pages.select("page_id", "url", "html"))).withColumn("headers", F.array_join(fields, "\n"))


SQL = f"""
WITH visits AS (
  SELECT page_id AS p, k, url, html, page_id * 4 + k AS record_id,
    k * 40000 + (page_id * 7919) % 90000 - CASE WHEN k = 1 AND page_id % 11 = 0 THEN 50000 ELSE 0 END AS seen,
    regexp_replace(url, '#.*$', '') AS bare
  FROM pages, range(4) r(k)),
named AS (
  SELECT *, CASE WHEN k = 2 THEN bare || CASE WHEN contains(bare, '?') THEN '&' ELSE '?' END || 'utm_source=feed' ELSE bare END AS uri,
    CASE WHEN p % 5 = 0 THEN NULL ELSE '"' || md5(coalesce(html, '') || CASE WHEN k = 2 AND p % 7 = 0 THEN 'changed' ELSE '' END) || '"' END AS etag,
    CASE WHEN p % 35 = 0 THEN NULL ELSE (p % 28 + 1) || ' Dec 2023' END AS modified FROM visits),
split AS (SELECT *, regexp_replace(trim(uri), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS rest FROM named),
urls AS (
  SELECT *, regexp_replace(lower(regexp_extract(rest, '^[^/?]*')), '^www\\.|:(80|443)$', '', 'g')
    || regexp_replace(regexp_extract(rest, '^[^/?]*([^?]*)', 1), '(/(index\\.html?)?)$', '') AS start,
    list_sort(list_filter(string_split(regexp_extract(rest, '\\?(.*)$', 1), '&'),
      lambda x: x <> '' AND NOT regexp_matches(lower(x), '{TRACKING}'))) AS asked FROM split),
canon AS (SELECT *, start || CASE WHEN len(asked) > 0 THEN '?' || array_to_string(asked, '&') ELSE '' END AS canonical_url FROM urls),
stored AS (SELECT * FROM canon WHERE k = 0 QUALIFY row_number() OVER (PARTITION BY canonical_url, seen ORDER BY record_id DESC) = 1),
joined AS (
  SELECT v.record_id, v.canonical_url, v.k, v.etag, v.modified, s.record_id AS sid, s.etag AS setag, s.modified AS smod, s.html AS shtml
  FROM (SELECT * FROM canon WHERE k > 0) v ASOF LEFT JOIN stored s ON v.canonical_url = s.canonical_url AND v.seen > s.seen),
judged AS (SELECT *, CASE WHEN sid IS NULL THEN 'unresolved'
    WHEN etag IS NOT NULL AND setag IS NOT NULL THEN CASE WHEN etag = setag THEN 'resolved' ELSE 'changed' END
    WHEN modified IS NOT NULL AND smod IS NOT NULL THEN CASE WHEN modified = smod THEN 'resolved' ELSE 'changed' END
    ELSE 'unchecked' END AS verdict FROM joined)
SELECT record_id, canonical_url, verdict,
  CASE WHEN verdict IN ('resolved', 'unchecked') THEN sid END AS referred_id,
  CASE WHEN verdict IN ('resolved', 'unchecked') THEN md5(shtml) END AS payload_digest,
  CASE WHEN verdict IN ('resolved', 'unchecked') THEN
    'cache-control: max-age=' || k * 60 || chr(10) || 'content-length: ' || length(shtml) || chr(10) || 'content-type: text/html'
    || coalesce(chr(10) || 'etag: ' || coalesce(etag, setag), '')
    || coalesce(chr(10) || 'last-modified: ' || coalesce(modified, smod), '') END AS headers
FROM judged
"""
