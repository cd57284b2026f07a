"""Not-modified revisits of a crawl resolved to the full responses that they stand for.

An as-of join by canonical URL, in built-in functions only: each revisit takes
the latest earlier full response of its URL, its validators are checked, and
the headers that a not-modified response may update replace those of the
response. Captures are dealt out by ranges of (URL, time, id): within a range a
window finds the latest response of a URL, and the last response of the ranges
before comes from one row for each URL and range. So a URL with a great share of all
captures, even within one second, is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm import common

#: Query parameters that don't tell pages apart.
IGNORED_PARAMETERS = r"^(utm_[a-z]+|ref|fbclid|gclid|sessionid|sid)(=|$)"
#: Headers that a 304 response may update; others stay as the full response had them.
PERMITTED_HEADERS = ("age", "cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
_PARTS = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?"


def canonical_url(url: str) -> Column:
    """Host in lower case without ``www.`` and its scheme's default port, path without slashes at its end, the other parameters in order; scheme and fragment go. Null if it has no scheme and host."""
    u = F.trim(F.col(url))
    default = F.when(F.lower(F.regexp_extract(u, _PARTS, 1)) == "https", ":443").otherwise(":80")
    host = F.lower(F.regexp_extract(u, _PARTS, 2))
    host = F.regexp_replace(F.when(F.endswith(host, default), F.left(host, F.length(host) - F.length(default))).otherwise(host), r"^www\.", "")
    path = F.regexp_replace(F.regexp_extract(u, _PARTS, 3), r"/+$", "")
    pairs = F.filter(F.split(F.substring(F.regexp_extract(u, _PARTS, 4), 2, 1 << 30), "&"), lambda p: (p != "") & ~p.rlike(IGNORED_PARAMETERS))
    query = F.array_join(F.array_sort(pairs), "&")
    return F.when(host != "", F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")))


def _opaque(tag: Column) -> Column:
    return F.regexp_replace(tag, r"^W/", "")


def by_name(headers: str) -> Column:
    """A header map with names in lower case; of names that differ in case only, the last in the order of code points stays. Null gives no header."""
    entries = F.transform(F.array_sort(F.map_entries(headers)), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    later = lambda e, i: F.exists(F.slice(entries, i + 2, F.size(entries)), lambda x: x["key"] == e["key"])
    return F.coalesce(F.map_from_entries(F.filter(entries, lambda e, i: ~later(e, i))), F.create_map().cast("map<string,string>"))


def resolve(captures: DataFrame, parts: int | None = None) -> DataFrame:
    """One row for each revisit of ``captures``.

    Input: record_id, url, ts (seconds), kind (``response`` or ``revisit``), status, etag,
    last_modified, digest, headers (a map; names in any case). A full response has
    status 200. Output: record_id, canonical_url, ts, outcome, original_id, original_ts
    and the merged headers. Outcomes, by the first validator that both sides have
    (etag, compared weakly, then last_modified, then digest): ``resolved``, ``mismatch``,
    or ``unverified`` if they share none; ``no_original`` if no full response of the URL
    is earlier. Captures of one second come in the order of record_id. Revisits
    without a URL, a time or an id have no original, and such responses serve
    none. Headers of a revisit without an original are its own; null headers are none.
    Of header names that differ in case only, the last in the order of code points stays.
    Repeated rows give repeated rows. ``parts``: ranges, by default as many as
    shuffle partitions.
    """
    rows = captures.select("record_id", canonical_url("url").alias("u"), F.col("ts").cast("long").alias("ts"), "kind", "status", "etag", "last_modified", "digest", by_name("headers").alias("headers"))
    usable = F.col("u").isNotNull() & F.col("ts").isNotNull() & F.col("record_id").isNotNull()
    full = (F.col("kind") == "response") & (F.col("status") == 200)
    rows = rows.where(full | (F.col("kind") == "revisit"))
    response = F.struct("record_id", "ts", "etag", "last_modified", "digest", "headers")
    ranged = rows.where(usable).repartitionByRange(parts or common.shuffle_partitions(captures.sparkSession), "u", "ts", "record_id")
    good = common.cut(ranged.withColumn("span", F.spark_partition_id())).withColumn("r", F.when(full, response))
    within = Window.partitionBy("u", "span").orderBy("ts", "record_id").rowsBetween(Window.unboundedPreceding, -1)
    near = good.withColumn("near", F.last("r", ignorenulls=True).over(within)).where("kind = 'revisit'").drop("r")
    # One row for each URL and range: its last full response, and that of the ranges before.
    ends = good.groupBy("u", "span").agg(F.max_by("r", F.when(full, F.struct("ts", "record_id"))).alias("end"))
    before = Window.partitionBy("u").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(F.col("u").alias("cu"), F.col("span").alias("cs"), F.last("end", ignorenulls=True).over(before).alias("far")).where(F.col("far").isNotNull())
    found = near.join(carried, (F.col("u") == F.col("cu")) & (F.col("span") == F.col("cs")), "left").withColumn("o", F.coalesce("near", "far")).drop("near", "far", "cu", "cs", "span")
    lost = rows.where(~usable & (F.col("kind") == "revisit")).withColumn("o", F.lit(None).cast(found.schema["o"].dataType))
    both = found.unionByName(lost)
    outcome = (
        F.when(F.col("o").isNull(), "no_original")
        .when(F.col("etag").isNotNull() & F.col("o.etag").isNotNull(), F.when(_opaque(F.col("etag")) == _opaque(F.col("o.etag")), "resolved").otherwise("mismatch"))
        .when(F.col("last_modified").isNotNull() & F.col("o.last_modified").isNotNull(), F.when(F.col("last_modified") == F.col("o.last_modified"), "resolved").otherwise("mismatch"))
        .when(F.col("digest").isNotNull() & F.col("o.digest").isNotNull(), F.when(F.col("digest") == F.col("o.digest"), "resolved").otherwise("mismatch"))
        .otherwise("unverified")
    )
    update = F.map_filter("headers", lambda k, _: k.isin(*PERMITTED_HEADERS))
    kept = F.map_filter("o.headers", lambda k, _: ~F.map_contains_key(update, k))
    merged = F.when(F.col("o").isNull(), F.col("headers")).otherwise(F.map_concat(kept, update))
    return both.select("record_id", F.col("u").alias("canonical_url"), "ts", outcome.alias("outcome"), F.col("o.record_id").alias("original_id"), F.col("o.ts").alias("original_ts"), merged.alias("headers"))


def header_text(headers: str) -> Column:
    """Headers as one line each, by name."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(headers)), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "\n")


#: Captures of each page in ``captures_of``.
CAPTURES = 5


def captures_of(pages: DataFrame) -> DataFrame:
    """A crawl log over ``pages``, five captures of each, numbered page_id * 5 and on.

    0: a revisit an hour before the first response; 1: the response; 2: a revisit 1 to 30 days
    later; 3: after 15 days a response with another entity tag; 4: a revisit a month later that has
    this tag. By page_id mod 10, revisit 2 repeats the first response's tag (0 to 5), weakens it (6),
    has another (7), has only the time of last modification (8) or no validator at all (9).
    """
    base, case = F.col("page_id") * 60, F.pmod("page_id", F.lit(10))
    first, second = (F.concat(F.lit('"'), F.substring("digest", at, 16), F.lit('"')) for at in (1, 17))
    day = lambda t: F.concat(F.lit("day "), F.floor(t / 86_400).cast("string"))
    # Only the page's digest goes on from here; its text is never shuffled.
    pages = pages.select("page_id", "url", F.md5(F.coalesce("html", F.lit(""))).alias("digest"))
    nothing = F.lit(None).cast("string")

    def capture(n: int, ts: Column, kind: str, etag: Column, modified: Column, digest: Column, headers: tuple) -> Column:
        return F.struct((F.col("page_id") * CAPTURES + n).alias("record_id"), ts.alias("ts"), F.lit(kind).alias("kind"), F.lit(200 if kind == "response" else 304).alias("status"), etag.alias("etag"), modified.alias("last_modified"), digest.alias("digest"), F.create_map(*headers).alias("headers"))

    def response(n: int, ts: Column, etag: Column) -> Column:
        headers = (F.lit("Content-Type"), F.lit("text/html"), F.lit("Cache-Control"), F.lit("max-age=60"), F.lit("ETag"), etag, F.lit("X-Page"), F.col("page_id").cast("string"))
        return capture(n, ts, "response", etag, day(ts), F.col("digest"), headers)

    def revisit(n: int, ts: Column, etag: Column, modified: Column) -> Column:
        headers = (F.lit("content-type"), F.lit("text/plain"), F.lit("cache-control"), F.concat(F.lit("max-age="), case.cast("string")), F.lit("Date"), day(ts))
        return capture(n, ts, "revisit", etag, modified, nothing, headers)

    tag = F.when(case <= 5, first).when(case == 6, F.concat(F.lit("W/"), first)).when(case == 7, F.lit('"changed"'))
    captures = [
        revisit(0, base - 3600, first, nothing),
        response(1, base, first),
        revisit(2, base + (1 + F.pmod("page_id", F.lit(30))) * 86_400, tag, F.when(case == 8, day(base))),
        response(3, base + 15 * 86_400, second),
        revisit(4, base + 45 * 86_400, second, nothing),
    ]
    return pages.select("url", F.explode(F.array(*captures)).alias("c")).select("url", "c.*")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All not-modified revisits of the crawl log over ``pages``, resolved."""
    done = resolve(captures_of(common.table(spark, sf_dir, "pages")))
    return done.select("record_id", "canonical_url", "ts", "outcome", "original_id", "original_ts", F.sha2(header_text("headers"), 256).alias("headers_sha256"), F.size("headers").cast("long").alias("n_headers"))


OP1_SQL = r"""
WITH p AS (
  SELECT page_id, md5(coalesce(html, '')) AS digest,
         regexp_replace(regexp_replace(lower(regexp_extract(trim(url), '^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?', 2)),
           CASE WHEN lower(regexp_extract(trim(url), '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) = 'https' THEN ':443$' ELSE ':80$' END, ''), '^www\.', '') AS host,
         regexp_replace(regexp_extract(trim(url), '^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?', 3), '/+$', '') AS path,
         array_to_string(list_sort(list_filter(string_split(substr(regexp_extract(trim(url), '^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?', 4), 2), '&'),
           lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[a-z]+|ref|fbclid|gclid|sessionid|sid)(=|$)'))), '&') AS query
  FROM pages),
u AS (
  SELECT page_id, '"' || substr(digest, 1, 16) || '"' AS first_, '"' || substr(digest, 17, 16) || '"' AS second_, page_id * 60 AS base,
         CASE WHEN host <> '' THEN host || path || CASE WHEN query <> '' THEN '?' || query ELSE '' END END AS u
  FROM p),
c AS (
  SELECT u, page_id * 5 AS record_id, base - 3600 AS ts, 'revisit' AS kind, first_ AS etag, NULL AS last_modified, page_id FROM u
  UNION ALL SELECT u, page_id * 5 + 1, base, 'response', first_, 'day ' || CAST(base // 86400 AS VARCHAR), page_id FROM u
  UNION ALL
  SELECT u, page_id * 5 + 2, base + (1 + page_id % 30) * 86400, 'revisit',
         CASE WHEN page_id % 10 <= 5 THEN first_ WHEN page_id % 10 = 6 THEN 'W/' || first_ WHEN page_id % 10 = 7 THEN '"changed"' END,
         CASE WHEN page_id % 10 = 8 THEN 'day ' || CAST(base // 86400 AS VARCHAR) END, page_id FROM u
  UNION ALL SELECT u, page_id * 5 + 3, base + 15 * 86400, 'response', second_, 'day ' || CAST(base // 86400 + 15 AS VARCHAR), page_id FROM u
  UNION ALL SELECT u, page_id * 5 + 4, base + 45 * 86400, 'revisit', second_, NULL, page_id FROM u),
a AS (
  SELECT *, CASE WHEN u IS NOT NULL THEN last_value(CASE WHEN kind = 'response' THEN struct_pack(record_id := record_id, ts := ts, etag := etag, last_modified := last_modified, page_id := page_id) END IGNORE NULLS)
            OVER (PARTITION BY u ORDER BY ts, record_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END AS o
  FROM c)
SELECT record_id, u AS canonical_url, ts,
  CASE WHEN o IS NULL THEN 'no_original'
       WHEN etag IS NOT NULL THEN CASE WHEN regexp_replace(etag, '^W/', '') = o.etag THEN 'resolved' ELSE 'mismatch' END
       WHEN last_modified IS NOT NULL THEN CASE WHEN last_modified = o.last_modified THEN 'resolved' ELSE 'mismatch' END
       ELSE 'unverified' END AS outcome,
  o.record_id AS original_id, o.ts AS original_ts,
  sha256('cache-control: max-age=' || CAST(page_id % 10 AS VARCHAR) || chr(10) ||
         'content-type: ' || CASE WHEN o IS NULL THEN 'text/plain' ELSE 'text/html' END || chr(10) ||
         'date: day ' || CAST(CAST(floor(ts / 86400) AS BIGINT) AS VARCHAR) ||
         CASE WHEN o IS NULL THEN '' ELSE chr(10) || 'etag: ' || o.etag || chr(10) || 'x-page: ' || CAST(o.page_id AS VARCHAR) END) AS headers_sha256,
  CAST(CASE WHEN o IS NULL THEN 3 ELSE 5 END AS BIGINT) AS n_headers
FROM a WHERE kind = 'revisit'
"""
