"""WARC: not-modified revisits resolved by an as-of join to the latest earlier full response of their URL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ionquarry.llm.common import ascii_lower

#: Header fields a 304 answer may update in the stored response.
PERMITTED = ("date", "etag", "last-modified", "cache-control", "content-location", "expires", "vary")
#: Seconds of one URL's records that one task orders.
SLICE_SECONDS = 86_400


def canonical_url(url: Column) -> Column:
    """What stands for all spellings of a URL; null stays null, and what has no ``://`` stays as it is.

    http and https are one scheme, ``web``; scheme and host are in lower case (A-Z); a leading ``www.``, the ports 80 and
    443 (of any scheme), the fragment, and one slash at the end of path and query are left out.
    """
    scheme = ascii_lower(F.regexp_extract(url, "^([^:/?#]*)://", 1))
    host = F.regexp_replace(ascii_lower(F.regexp_extract(url, "://([^/?#]*)", 1)), r"^(www\.)?(.*?)(:80|:443)?$", "$2")
    rest = F.regexp_replace(F.regexp_extract(url, "://[^/?#]*([^#]*)", 1), r"/$", "")
    return F.when(url.contains("://"), F.concat(F.when(scheme.isin("http", "https"), F.lit("web")).otherwise(scheme), F.lit("://"), host, rest)).otherwise(url)


def _keys(*columns: Column) -> list[Column]:
    """128 bits, as two longs, that stand for the columns' values."""
    return [F.xxhash64(F.lit(seed), *columns).alias(f"_k{seed}") for seed in (1, 2)]


def resolve_revisits(records: DataFrame) -> DataFrame:
    """Each revisit with the response it stands for: record_id, status, source_id, payload, headers.

    ``records``: record_id, url, at (timestamp), kind (response or revisit), etag, last_modified, headers (map), payload; other
    columns are left out. The response is the latest one of the canonical URL strictly before the revisit. status is
    ``missing`` without one, ``mismatch`` if a validator (etag, else last_modified) that both name differs, else ``resolved``;
    only then payload is filled, and the response's headers take over the revisit's permitted fields.

    Records are ordered within one URL and day; the last response of each earlier day is carried over in a second, far smaller
    pass, so no task orders a hot URL's whole history. Payloads are not in the ordering; they are joined by a digest of the
    whole record. Records with null url or time are ``missing``. Of responses at the same time the largest id counts, of
    those with equal ids the largest digest. Each row of a revisit gives one row, also where rows or ids repeat; repeated
    responses count once. An empty table gives an empty one.
    """
    own = records.select("record_id", "url", "at", "kind", "etag", "last_modified", "headers", "payload")
    listed = F.array_sort(F.map_entries("headers"))
    rows = own.withColumns({"_url": canonical_url(F.col("url")), "_day": F.floor(F.unix_timestamp(F.col("at").cast("timestamp")) / SLICE_SECONDS)})
    rows = rows.select("*", *_keys(F.col("record_id"), F.col("url"), F.col("at").cast("timestamp"), F.col("kind"), F.col("etag"), F.col("last_modified"), listed, F.col("payload")))
    full = F.when(F.col("kind") == "response", F.struct("at", "record_id", "_k1", "_k2", "etag", "last_modified"))
    slim = rows.filter("url IS NOT NULL AND at IS NOT NULL").select("_k1", "_k2", "kind", "at", "etag", "last_modified", "_url", "_day", full.alias("_full"))
    before = Window.partitionBy("_url", "_day").orderBy(F.unix_micros(F.col("at").cast("timestamp"))).rangeBetween(Window.unboundedPreceding, -1)
    days = slim.groupBy("_url", "_day").agg(F.max("_full").alias("_last"))
    days = days.select("_url", "_day", F.max("_last").over(Window.partitionBy("_url").orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)).alias("_carried"))
    found = slim.withColumn("_near", F.max("_full").over(before)).filter("kind = 'revisit'").join(days, ["_url", "_day"], "left").withColumn("_at", F.coalesce("_near", "_carried"))
    differs = F.when(F.col("etag").isNotNull() & F.col("_at.etag").isNotNull(), F.col("etag") != F.col("_at.etag")).otherwise(F.coalesce(F.col("last_modified") != F.col("_at.last_modified"), F.lit(False)))
    status = F.when(F.col("_at").isNull(), "missing").when(differs, "mismatch").otherwise("resolved")
    judged = found.select("_k1", "_k2", F.col("_at.record_id").alias("_source"), F.col("_at._k1").alias("_s1"), F.col("_at._k2").alias("_s2"), status.alias("status")).distinct()
    stored = rows.filter("kind = 'response'").groupBy(F.col("_k1").alias("_s1"), F.col("_k2").alias("_s2")).agg(F.first("payload").alias("_payload"), F.first(F.map_entries("headers")).alias("_stored"))
    out = rows.filter("kind = 'revisit'").select("record_id", "headers", "_k1", "_k2").join(judged, ["_k1", "_k2"], "left").join(stored, ["_s1", "_s2"], "left")
    ok = F.col("status") == "resolved"
    none = F.create_map().cast("map<string,string>")
    taken = F.map_filter(F.coalesce("headers", none), lambda k, v: F.lower(k).isin(*PERMITTED))
    kept = F.map_filter(F.coalesce(F.map_from_entries("_stored"), none), lambda k, v: ~F.array_contains(F.transform(F.map_keys(taken), F.lower), F.lower(k)))
    return out.select("record_id", F.coalesce("status", F.lit("missing")).alias("status"), F.when(ok | (F.col("status") == "mismatch"), F.col("_source")).alias("source_id"), F.when(ok, F.col("_payload")).alias("payload"), F.when(ok, F.map_concat(kept, taken)).alias("headers"))


HOUR = 3600


def records_of_pages(pages: DataFrame) -> DataFrame:
    """Crawl records made of ``pages`` (page_id, url, html): of each page two responses and four revisits, on three days.

    Counted from a time of the page's own, within 1000 seconds: a revisit 1 hour before anything was stored; the response
    at 0; a revisit 6 hours later, within the day; the second response, whose content has changed, after 2 days, and a revisit 5
    hours behind it with its validators; and after 3 days one that still names the first's. All have a last_modified, those
    of every fifth page no etag, so that the date decides. Ids: 8 * page_id and the record's number.
    """
    start = F.lit("2024-01-01 02:00:00").cast("timestamp")
    at = lambda hours: F.timestamp_add("SECOND", F.col("page_id") % 1000 + hours * HOUR, start)
    none = F.lit(None).cast("string")
    etags = [F.when(F.col("page_id") % 5 != 0, F.md5(F.concat(F.coalesce("html", F.lit("")), F.lit(x)).cast("binary"))) for x in ("", "changed")]
    dates = [F.lit("Mon, 01 Jan 2024 00:00:00 GMT"), F.lit("Wed, 03 Jan 2024 00:00:00 GMT")]
    texts = [F.col("html"), F.concat("html", F.lit("<!-- changed -->"))]

    def row(k: int, kind: str, hours: int, version: int) -> Column:
        full = kind == "response"
        headers = F.create_map(F.lit("Content-Type"), F.lit("text/html"), F.lit("Last-Modified"), dates[version]) if full else F.create_map(F.lit("Date"), F.lit("later"), F.lit("Content-Length"), F.lit("0"))
        return F.struct((F.col("page_id") * 8 + k).alias("record_id"), F.col("url").alias("url"), at(hours).alias("at"), F.lit(kind).alias("kind"), etags[version].alias("etag"), dates[version].alias("last_modified"), headers.alias("headers"), (texts[version] if full else none).alias("payload"))

    made = [row(0, "revisit", -1, 0), row(1, "response", 0, 0), row(2, "revisit", 6, 0), row(3, "response", 48, 1), row(4, "revisit", 53, 1), row(5, "revisit", 72, 0)]
    return pages.select("page_id", "url", "html").select(F.inline(F.array(*made)))


def revisit_report(pages: DataFrame) -> DataFrame:
    """record_id, status, source_id, payload_md5, n_headers of each revisit."""
    found = resolve_revisits(records_of_pages(pages))
    return found.select("record_id", "status", "source_id", F.md5(F.col("payload").cast("binary")).alias("payload_md5"), F.size(F.map_keys("headers")).alias("n_headers"))


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_CANONICAL = (
    f"CASE WHEN contains(url, '://') THEN CASE WHEN translate(regexp_extract(url, '^([^:/?#]*)://', 1), '{_UPPER}', '{_LOWER}') IN ('http', 'https') THEN 'web' ELSE translate(regexp_extract(url, '^([^:/?#]*)://', 1), '{_UPPER}', '{_LOWER}') END || '://' "
    f"|| regexp_replace(translate(regexp_extract(url, '://([^/?#]*)', 1), '{_UPPER}', '{_LOWER}'), '^(www\\.)?(.*?)(:80|:443)?$', '\\2') || regexp_replace(regexp_extract(url, '://[^/?#]*([^#]*)', 1), '/$', '') ELSE url END"
)
#: The report's rows from ``pages``, by an as-of join; a resolved revisit of these records has three header fields.
ORACLE_SQL = f"""
WITH p AS (SELECT page_id, url, {_CANONICAL} AS c, html, TIMESTAMP '2024-01-01 02:00:00' + to_seconds(page_id % 1000) AS t,
    CASE WHEN page_id % 5 <> 0 THEN md5(coalesce(html, '')) END AS e0, CASE WHEN page_id % 5 <> 0 THEN md5(coalesce(html, '') || 'changed') END AS e1 FROM pages),
r AS (SELECT page_id * 8 + k AS id, c, t + to_hours(h) AS ts, v, CASE WHEN v = 0 THEN e0 ELSE e1 END AS etag, html FROM p, (VALUES (0, -1, 0), (2, 6, 0), (4, 53, 1), (5, 72, 0)) x(k, h, v)),
s AS (SELECT c, ts, arg_max(id, id) AS id, arg_max(v, id) AS v, arg_max(struct_pack(e := etag), id).e AS etag, arg_max(struct_pack(h := html), id).h AS html
  FROM (SELECT page_id * 8 + k AS id, c, t + to_hours(h) AS ts, v, CASE WHEN v = 0 THEN e0 ELSE e1 END AS etag, html FROM p, (VALUES (1, 0, 0), (3, 48, 1)) x(k, h, v)) WHERE c IS NOT NULL GROUP BY c, ts),
j AS (SELECT r.id, s.id AS source, CASE WHEN s.id IS NULL THEN 'missing' WHEN CASE WHEN r.etag IS NOT NULL AND s.etag IS NOT NULL THEN r.etag <> s.etag ELSE r.v <> s.v END THEN 'mismatch' ELSE 'resolved' END AS status,
    CASE WHEN s.v = 0 THEN s.html ELSE s.html || '<!-- changed -->' END AS payload FROM r ASOF LEFT JOIN s ON r.c = s.c AND r.ts > s.ts)
SELECT id AS record_id, status, source AS source_id, CASE WHEN status = 'resolved' THEN md5(payload) END AS payload_md5, CAST(CASE WHEN status = 'resolved' THEN 3 END AS INT) AS n_headers FROM j"""
