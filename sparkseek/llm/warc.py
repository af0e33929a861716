"""Resolution of not-modified revisit records.

A revisit (a 304 answer) says that a page is as an earlier capture has it. It is
joined as of its time to the latest strictly earlier full response of the same
canonical URL; their validators are compared (entity tags by weak comparison,
else dates of last change); and the response's headers are given with those that
a 304 may update (RFC 9110, 15.4.5) taken from the revisit.

The as-of join has two levels. All records are dealt into ranges of time; within
a range and a URL a running maximum finds the latest response; across ranges one
row for each URL and range carries the last response on. No task holds a URL's
whole history, so a URL with a third of all records is no different.

Defined results: of responses at one time the largest record_id is the later; a
response at the revisit's own time is not earlier; a null URL or time resolves to
nothing (no_response); validators that one side lacks are not compared, with none
to compare the result is unverified; repeated records each give their row;
columns beyond those named are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, table

#: What a 304 answer may change.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "vary")
_TRACKING = "^(utm_[a-z]+|ref|fbclid|gclid)(=|$)"


def canonical_url(url: Column) -> Column:
    """Without scheme, www, default port, fragment, tracking parameters and the
    path's last slash; host in lower case; parameters in order."""
    bare = F.regexp_replace(F.trim(url), r"#.*$", "")
    rest = F.regexp_replace(bare, r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(rest, r"^([^/?]*)", 1)), r"^www\.", ""), r":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(rest, r"^[^/?]*([^?]*)", 1), r"/+$", "")
    query = F.regexp_extract(rest, r"\?(.*)$", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.lower(p).rlike(_TRACKING)))
    return F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit("")))


def _tag(etag: Column) -> Column:
    return F.regexp_replace(etag, "^[Ww]/", "")


RECORD = ("record_id", "url", "ts", "kind", "etag", "last_modified", "headers")


def resolve_revisits(records: DataFrame) -> DataFrame:
    """record_id, url, response_id, status, headers (map): a row a revisit.

    records: record_id long, url string, ts long, kind string ('response' or
    'revisit'), etag, last_modified string, headers map with lower-case names.
    status: resolved, unverified, mismatch or no_response.
    """
    r = records.select(*RECORD).where(F.col("kind").isin("response", "revisit")).withColumn("u", canonical_url(F.col("url")))
    r = r.withColumn("headers", F.map_entries("headers"))
    full = F.when(F.col("kind") == "response", F.struct("ts", "record_id", "etag", "last_modified", "headers"))
    known = r.where("u IS NOT NULL AND ts IS NOT NULL").withColumn("full", full)
    dealt = materialize(known.repartitionByRange("ts").withColumn("range", F.spark_partition_id()), "records")
    earlier = Window.partitionBy("u", "range").orderBy("ts").rangeBetween(Window.unboundedPreceding, -1)
    within = dealt.withColumn("here", F.max("full").over(earlier)).where("kind = 'revisit'")
    lasts = dealt.where("kind = 'response'").groupBy("u", "range").agg(F.max("full").alias("last"))
    stops = lasts.select("u", "range", "last").unionAll(within.where("here IS NULL").select("u", "range", F.lit(None).cast(lasts.schema["last"].dataType)).distinct())
    before = Window.partitionBy("u").orderBy("range").rangeBetween(Window.unboundedPreceding, -1)
    carried = stops.withColumn("before", F.max("last").over(before)).groupBy("u", "range").agg(F.max("before").alias("before"))
    found = within.join(carried, ["u", "range"], "left").withColumn("full", F.coalesce("here", "before")).drop("here", "before", "range")
    unknown = r.where("(u IS NULL OR ts IS NULL) AND kind = 'revisit'").withColumn("full", F.lit(None).cast(found.schema["full"].dataType))
    return _checked(found.unionByName(unknown))


def _checked(found: DataFrame) -> DataFrame:
    tags = _tag(F.col("etag")) == _tag(F.col("full.etag"))
    dates = F.col("last_modified") == F.col("full.last_modified")
    same = F.coalesce(tags, dates)
    status = F.when(F.col("full").isNull(), "no_response").when(same.isNull(), "unverified").when(same, "resolved").otherwise("mismatch")
    fresh = F.filter(F.coalesce("headers", F.array().cast("array<struct<key:string,value:string>>")), lambda e: e["key"].isin(*PERMITTED))
    names = F.transform(fresh, lambda e: e["key"])
    old = F.filter(F.coalesce(F.col("full.headers"), F.array().cast("array<struct<key:string,value:string>>")), lambda e: ~F.array_contains(F.col("names"), e["key"]))
    out = found.withColumn("status", status).withColumn("fresh", fresh).withColumn("names", names)
    good = F.col("status").isin("resolved", "unverified")
    merged = F.when(good, F.map_from_entries(F.array_sort(F.concat(old, F.col("fresh")))))
    return out.select("record_id", "url", F.when(F.col("status") != "no_response", F.col("full.record_id")).alias("response_id"), "status", merged.alias("headers"))


def records_of_pages(pages: DataFrame) -> DataFrame:
    """Capture records from the table of pages: every third is a revisit.

    As pages seldom share a URL, a record is a capture of the front page of the
    section that its page lies in (scheme, host, first part of the path, query).
    The page's id serves as its time; tags and headers follow from the id.
    """
    url = F.concat(F.regexp_extract("url", r"^([^:]+://[^/]+/[^/?#]*)", 1), F.regexp_extract("url", r"(\?.*)$", 1))
    i = F.col("page_id")
    tag = F.concat(F.when(i % 4 == 1, "W/").otherwise(""), F.lit('"'), (i % 2).cast("string"), F.lit('"'))
    date = F.concat(F.lit("day "), (F.floor(i / 50) % 3).cast("string"))
    kind = F.when(i % 3 == 2, "revisit").otherwise("response")
    headers = F.create_map(
        F.lit("date"), i.cast("string"), F.lit("content-length"), F.length("html").cast("string"), F.lit("cache-control"), F.concat(F.lit("max-age="), (i % 7).cast("string"))
    )
    return pages.select(i.alias("record_id"), url.alias("url"), i.alias("ts"), kind.alias("kind"), F.when(i % 5 != 0, tag).alias("etag"), F.when(i % 11 != 0, date).alias("last_modified"), headers.alias("headers"))


def op4_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resolve_revisits(records_of_pages(table(spark, sf_dir, "pages")))
    text = F.array_join(F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "; ")
    return found.select(F.col("record_id").alias("page_id"), "url", "response_id", "status", text.alias("headers"))


ORACLE = r"""
WITH p AS (SELECT page_id, html, regexp_extract(url, '^([^:]+://[^/]+/[^/?#]*)', 1) || regexp_extract(url, '(\?.*)$', 1) AS url FROM pages),
b AS (SELECT page_id, url, html, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS rest FROM p),
q AS (SELECT *, list_sort(list_filter(string_split(regexp_extract(rest, '\?(.*)$', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(lower(p), '^(utm_[a-z]+|ref|fbclid|gclid)(=|$)'))) AS k FROM b),
r AS (SELECT page_id AS id, url,
  regexp_replace(regexp_replace(lower(regexp_extract(rest, '^([^/?]*)', 1)), '^www\.', ''), ':(80|443)$', '') || regexp_replace(regexp_extract(rest, '^[^/?]*([^?]*)', 1), '/+$', '')
  || CASE WHEN len(k) > 0 THEN '?' || array_to_string(k, '&') ELSE '' END AS u,
  page_id % 3 = 2 AS revisit, CASE WHEN page_id % 5 <> 0 THEN (page_id % 2)::VARCHAR END AS tag,
  CASE WHEN page_id % 11 <> 0 THEN (page_id // 50) % 3 END AS dt, length(html) AS n FROM q),
j AS (SELECT v.*, f.id AS fid, f.tag AS ftag, f.dt AS fdt, f.n AS fn FROM (SELECT * FROM r WHERE revisit) v ASOF LEFT JOIN (SELECT * FROM r WHERE NOT revisit) f ON v.u = f.u AND v.id > f.id),
s AS (SELECT *, CASE WHEN fid IS NULL THEN 'no_response' WHEN coalesce(tag = ftag, dt = fdt) IS NULL THEN 'unverified' WHEN coalesce(tag = ftag, dt = fdt) THEN 'resolved' ELSE 'mismatch' END AS status FROM j)
SELECT id AS page_id, url, fid AS response_id, status,
  CASE WHEN status IN ('resolved', 'unverified') THEN 'cache-control: max-age=' || (id % 7) || '; content-length: ' || fn || '; date: ' || id END AS headers FROM s
"""

QUERIES = {"op4_revisits": op4_revisits}
ORACLES = {"op4_revisits": ORACLE}
