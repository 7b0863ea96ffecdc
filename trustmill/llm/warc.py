r"""WARC: not-modified revisits resolved to the response they stand for.

A revisit (304) is joined as of its time to the latest full response (200) of the same canonical URL that is strictly
earlier. Validators decide: with an entity tag on the revisit it must weakly equal the response's; without one, its
last-modified date must equal the response's. A resolved revisit takes the response's body, and its headers updated by
the revisit's, but for those that describe the message or the body (FIXED_HEADERS).

Outcomes: `response` (not a revisit), `resolved`, `changed` (validators differ), `unvalidated` (revisit without validators),
`unmatched` (no earlier response).

The as-of join works in spans of time: cuts at quantiles of all times bound what one task orders, also for a URL that
holds a large share of all captures; the last response of each span is carried on to the later ones. Bodies do not travel.

Defined cases: a null url or time never matches (`unmatched` for a revisit); responses of one time yield to the greater record
id; statuses other than 200 and 304 are passed on as `other`; null headers count as none; repeated records are each
resolved; an empty table gives an empty table; extra columns are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common
from .fingerprint import _range

#: Captures in a span of time that one task orders for a URL, and the most spans.
SPAN_ROWS, MOST_SPANS = 20_000, 4096
#: Headers that a revisit does not update; query parameters that do not tell pages apart.
FIXED_HEADERS = ("connection", "content-encoding", "content-length", "content-md5", "content-range", "content-type", "keep-alive", "proxy-authenticate", "proxy-connection", "set-cookie", "te", "trailer", "transfer-encoding", "upgrade")
TRACKING = r"^(utm_[a-z]+|ref|fbclid|gclid|msclkid|sessionid)(=|$)"
_SPLIT = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?]*)([^?]*)\??(.*)$"


def canonical(url: Column) -> Column:
    """Without scheme, `www.`, default port, fragment, trailing slash and tracking parameters; host in lower case, parameters sorted."""
    bare = F.regexp_replace(url, r"#.*$", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(bare, _SPLIT, 1)), r"^www\.", ""), r":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(bare, _SPLIT, 2), r"/+$", "")
    query = F.array_join(F.array_sort(F.filter(F.split(F.regexp_extract(bare, _SPLIT, 3), "&"), lambda p: (p != "") & ~p.rlike(TRACKING))), "&")
    return F.when(url.isNotNull(), F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit(""))))


def _tag(etag: Column) -> Column:
    return F.regexp_replace(etag, r"^W/", "")


def merged(old: Column, new: Column) -> Column:
    """ARRAY<STRUCT<name, value>> sorted by name: headers of the response, updated by those a revisit may change."""
    update = F.filter(new, lambda h: ~h["name"].isin(*FIXED_HEADERS))
    names = F.transform(update, lambda h: h["name"])
    return F.array_sort(F.concat(F.filter(old, lambda h: ~F.array_contains(names, h["name"])), update))


def _headers(headers: Column) -> Column:
    entries = F.coalesce(F.map_entries(headers), F.array().cast("array<struct<key:string,value:string>>"))
    return F.array_sort(F.transform(entries, lambda h: F.struct(F.lower(h["key"]).alias("name"), h["value"].alias("value"))))


def _header(headers: Column, name: str) -> Column:
    return F.get(F.filter(headers, lambda h: h["name"] == name), F.lit(0))["value"]


def resolve(captures: DataFrame) -> DataFrame:
    """captures: record_id LONG, url, ts LONG, status INT, headers MAP<STRING, STRING>, digest. Returns record_id,
    canonical_url, outcome, source_id, headers (ARRAY of name and value), digest: of the body that the record stands for."""
    own = captures.select("record_id", canonical(F.col("url")).alias("canonical_url"), "ts", "status", _headers(F.col("headers")).alias("headers"), "digest")
    full = (F.col("status") == 200) & F.col("ts").isNotNull() & F.col("canonical_url").isNotNull()
    n = captures.count()
    pieces = min(MOST_SPANS, n // SPAN_ROWS + 1)
    shares = [(k + 1) / pieces for k in range(pieces - 1)]
    cuts = sorted(set(captures.select(F.percentile_approx("ts", shares, 20 * pieces)).first()[0] or [])) if shares else []
    spanned = own.withColumn("span", _range(F.coalesce("ts", F.lit(0)), cuts))
    as_source = F.when(full, F.struct("ts", "record_id", "headers", "digest"))
    # Within a span: the greatest (time, id) of the strictly earlier responses.
    before = Window.partitionBy("canonical_url", "span").orderBy("ts").rangeBetween(Window.unboundedPreceding, -1)
    here = spanned.withColumn("near", F.max(as_source).over(before))
    # Of earlier spans: one row for each URL and span that has a response.
    last = spanned.where(full).groupBy("canonical_url", "span").agg(F.max(F.struct("ts", "record_id", "headers", "digest")).alias("last"))
    seen = here.select("canonical_url", "span").distinct().join(last, ["canonical_url", "span"], "left")
    earlier = Window.partitionBy("canonical_url").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    carried = seen.withColumn("far", F.last("last", ignorenulls=True).over(earlier)).where(F.col("far").isNotNull()).select("canonical_url", "span", "far")
    found = here.join(carried, ["canonical_url", "span"], "left").withColumn("source", F.when(F.col("ts").isNotNull() & F.col("canonical_url").isNotNull(), F.coalesce("near", "far")))
    etag, modified = _header(F.col("headers"), "etag"), _header(F.col("headers"), "last-modified")
    their_etag, their_modified = _header(F.col("source.headers"), "etag"), _header(F.col("source.headers"), "last-modified")
    same = F.when(etag.isNotNull(), F.coalesce(_tag(etag) == _tag(their_etag), F.lit(False))).otherwise(F.coalesce(modified == their_modified, F.lit(False)))
    outcome = (
        F.when(F.col("status") == 200, F.lit("response"))
        .when(F.coalesce(F.col("status") != 304, F.lit(True)), F.lit("other"))
        .when(F.col("source").isNull(), F.lit("unmatched"))
        .when(etag.isNull() & modified.isNull(), F.lit("unvalidated"))
        .when(same, F.lit("resolved"))
        .otherwise(F.lit("changed"))
    )
    good = F.col("outcome") == "resolved"
    return found.withColumn("outcome", outcome).select(
        "record_id", "canonical_url", "outcome", F.when(good, F.col("source.record_id")).alias("source_id"),
        F.when(good, merged(F.col("source.headers"), F.col("headers"))).otherwise(F.col("headers")).alias("headers"),
        F.when(good, F.col("source.digest")).when(F.col("status") == 304, F.lit(None)).otherwise(F.col("digest")).alias("digest"),
    )


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Captures of WARC files (plain or gzip): record_id, url, ts (seconds), status, headers, digest, body. A file is read by one task."""
    import pandas as pd

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, content in zip(frame["path"], frame["content"], strict=True):
                yield pd.DataFrame(list(parse_warc(name, bytes(content))), columns=["record_id", "url", "ts", "status", "headers", "digest", "body"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, "record_id long, url string, ts long, status int, headers map<string,string>, digest string, body binary")


def parse_warc(name: str, raw: bytes) -> Iterator[tuple]:
    """Response and revisit records of a WARC file."""
    import gzip
    import hashlib
    from datetime import datetime

    if raw[:2] == b"\x1f\x8b":
        raw = gzip.decompress(raw)
    at = 0
    while (at := raw.find(b"WARC/", at)) >= 0:
        cut = raw.find(b"\r\n\r\n", at)
        if cut < 0:
            return
        fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in raw[at:cut].decode("utf-8", "replace").split("\r\n")[1:])}
        size = int(fields.get("content-length", 0))
        block, start = raw[cut + 4 : cut + 4 + size], at
        at = cut + 4 + size
        if fields.get("warc-type") not in ("response", "revisit"):
            continue
        head, _, body = block.partition(b"\r\n\r\n")
        lines = head.decode("iso-8859-1").split("\r\n")
        words = lines[0].split()
        status = int(words[1]) if len(words) > 1 and words[1].isdigit() else None
        headers = {k.strip(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
        key = int.from_bytes(hashlib.blake2b(f"{name}:{start}".encode(), digest_size=8).digest(), "big", signed=True)
        date = fields.get("warc-date")
        ts = int(datetime.fromisoformat(date.replace("Z", "+00:00")).timestamp()) if date else None
        yield key, fields.get("warc-target-uri"), ts, status, headers, hashlib.sha256(body).hexdigest(), body


def captures_of_pages(pages: DataFrame) -> DataFrame:
    """Two captures of each page: the response, at page_id, and a later revisit with validators that hold, are weak, are dates
    only, differ or are missing, by page_id."""
    p = F.col("page_id")
    etag = F.concat(F.lit('"'), F.substring(F.md5(F.coalesce("html", F.lit(""))), 1, 16), F.lit('"'))
    date = F.concat(F.lit("day "), (p % 97).cast("string"))
    size = F.length(F.coalesce("html", F.lit(""))).cast("string")
    first = F.create_map(*map(F.lit, ("Content-Type", "text/html")), F.lit("Content-Length"), size, F.lit("ETag"), etag, F.lit("Last-Modified"), date, *map(F.lit, ("Cache-Control", "max-age=60")))
    always = [F.lit("Cache-Control"), F.lit("max-age=600"), F.lit("Content-Length"), F.lit("0"), F.lit("X-Checked"), p.cast("string")]
    second = (
        F.when(p % 5 == 0, F.create_map(F.lit("Last-Modified"), date, *always))
        .when(p % 5 == 1, F.create_map(F.lit("ETag"), F.lit('"other"'), F.lit("Last-Modified"), date, *always))
        .when(p % 5 == 2, F.create_map(F.lit("ETag"), F.concat(F.lit("W/"), etag), *always))
        .when((p % 5 == 3) & (p % 2 == 0), F.create_map(*always))
        .otherwise(F.create_map(F.lit("ETag"), etag, *always))
    )
    nothing = F.lit(None).cast("string")
    both = F.array(
        F.struct((p * 2).alias("record_id"), p.alias("ts"), F.lit(200).alias("status"), first.alias("headers"), F.sha2(F.coalesce("html", F.lit("")), 256).alias("digest")),
        F.struct((p * 2 + 1).alias("record_id"), (p + 1 + (p % 7) * 1000).alias("ts"), F.lit(304).alias("status"), second.alias("headers"), nothing.alias("digest")),
    )
    return pages.select("url", F.explode(both).alias("c")).select("c.record_id", "url", "c.ts", "c.status", "c.headers", "c.digest")


def op8_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Stored once: several steps read it, and html is needed for its digest only.
    captures = common.materialise(captures_of_pages(common.read(spark, sf_dir, "pages")), "captures")
    listed = F.array_join(F.transform("headers", lambda h: F.concat_ws(": ", h["name"], h["value"])), "\n")
    return resolve(captures).select("record_id", "canonical_url", "outcome", "source_id", listed.alias("headers"), F.col("digest").alias("body_sha256"))


ORACLE = r"""
WITH u AS (
  SELECT page_id AS p, coalesce(html, '') AS html, regexp_replace(url, '#.*$', '') AS b FROM pages
), q AS (
  SELECT p, html,
    regexp_replace(regexp_replace(lower(regexp_extract(b, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?]*)([^?]*)\??(.*)$', 1)), '^www\.', ''), ':(80|443)$', '')
      || regexp_replace(regexp_extract(b, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?]*)([^?]*)\??(.*)$', 2), '/+$', '') AS base,
    array_to_string(list_sort(list_filter(string_split(regexp_extract(b, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?]*)([^?]*)\??(.*)$', 3), '&'),
      lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[a-z]+|ref|fbclid|gclid|msclkid|sessionid)(=|$)'))), '&') AS query
  FROM u
), c AS (
  SELECT p, base || CASE WHEN query <> '' THEN '?' || query ELSE '' END AS url, '"' || substr(md5(html), 1, 16) || '"' AS tag,
    'day ' || CAST(p % 97 AS VARCHAR) AS day, CAST(length(html) AS VARCHAR) AS size, sha256(html) AS digest FROM q
), r AS (
  SELECT p, url, p + 1 + (p % 7) * 1000 AS ts,
    CASE WHEN p % 5 = 1 THEN '"other"' WHEN p % 5 = 0 OR (p % 5 = 3 AND p % 2 = 0) THEN NULL ELSE tag END AS tag,
    CASE WHEN p % 5 = 2 THEN 'W/' || tag WHEN p % 5 = 1 THEN '"other"' WHEN p % 5 = 0 OR (p % 5 = 3 AND p % 2 = 0) THEN NULL ELSE tag END AS shown,
    CASE WHEN p % 5 IN (0, 1) THEN day END AS day FROM c
), a AS (
  SELECT r.*, s.p AS sp, s.tag AS stag, s.day AS sday, s.size AS ssize, s.digest AS sdigest
  FROM r LEFT JOIN c s ON s.url = r.url AND s.p < r.ts
  QUALIFY row_number() OVER (PARTITION BY r.p ORDER BY s.p DESC NULLS LAST) = 1
), o AS (
  SELECT *, CASE WHEN sp IS NULL THEN 'unmatched' WHEN tag IS NULL AND day IS NULL THEN 'unvalidated'
    WHEN (tag IS NOT NULL AND tag = stag) OR (tag IS NULL AND day = sday) THEN 'resolved' ELSE 'changed' END AS outcome FROM a
)
SELECT p * 2 AS record_id, url AS canonical_url, 'response' AS outcome, CAST(NULL AS BIGINT) AS source_id,
  'cache-control: max-age=60' || chr(10) || 'content-length: ' || size || chr(10) || 'content-type: text/html' || chr(10) || 'etag: ' || tag || chr(10) || 'last-modified: ' || day AS headers,
  digest AS body_sha256 FROM c
UNION ALL
SELECT p * 2 + 1, url, outcome, CASE WHEN outcome = 'resolved' THEN sp * 2 END,
  CASE WHEN outcome = 'resolved' THEN 'cache-control: max-age=600' || chr(10) || 'content-length: ' || ssize || chr(10) || 'content-type: text/html' || chr(10) || 'etag: ' || coalesce(shown, stag) || chr(10) || 'last-modified: ' || coalesce(day, sday) || chr(10) || 'x-checked: ' || CAST(p AS VARCHAR)
  ELSE 'cache-control: max-age=600' || chr(10) || 'content-length: 0' || coalesce(chr(10) || 'etag: ' || shown, '') || coalesce(chr(10) || 'last-modified: ' || day, '') || chr(10) || 'x-checked: ' || CAST(p AS VARCHAR) END,
  CASE WHEN outcome = 'resolved' THEN sdigest END FROM o
"""
