"""WARC: not-modified revisits resolved to the response that they stand for.

A revisit record holds the headers of a 304 answer and no body.  It is resolved by an as-of join on the canonical URL
to the latest full response with an earlier time; its validators (entity tag, else last-modified, else payload digest)
are checked against that response, and of its headers those that a 304 answer may update replace the response's.

Plan: the join never brings all captures of one URL together.  Time is cut into blocks of `block` units, these into blocks
of `block` blocks, and so on for `LEVELS` levels.  Within a (URL, block) a running maximum finds the latest earlier
response; what earlier blocks have is carried in from one row for each (URL, block), found in the same way one level up.
So above the captures no window has more than `block` rows, whatever the unit of time, but for the top one, which has a
row for each block**LEVELS units.  Bodies are not moved: the result names the response, and `with_payload` joins.

Defined cases: null URLs or times are never resolved (`no_response`); a response at the same time is not earlier; of
several responses at one time the greatest record_id counts; null headers count as empty; a revisit without validators
is `unvalidated` and still resolved; repeated rows repeat; headers of any length and number are merged; extra columns are
ignored, whatever their names; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BLOCK = 1_000
LEVELS = 3
#: Headers of a 304 answer that update a stored response.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "vary")
#: Query parameters that do not change a page.
TRACKING = r"(?:utm_[a-z]+|ref|fbclid|gclid|sessionid)"


def canonical(url: Column) -> Column:
    """Lower-case host without www. and default port, path without a trailing slash, query without tracking, no fragment or scheme."""
    u = F.regexp_replace(F.trim(url), r"#.*$", "")
    u = F.regexp_replace(u, rf"([?&]){TRACKING}=[^&]*", "$1")
    u = F.regexp_replace(F.regexp_replace(F.regexp_replace(u, r"&+", "&"), r"\?&", "?"), r"[?&]+$", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(u, r"^(?:[A-Za-z][A-Za-z0-9+.-]*://)?([^/?]*)", 1)), r"^www\.|:(?:80|443)$", "")
    rest = F.regexp_extract(u, r"^(?:[A-Za-z][A-Za-z0-9+.-]*://)?[^/?]*(.*)$", 1)
    return F.concat(host, F.regexp_replace(rest, r"/+(?=\?|$)", ""))


def _bare(tag: Column) -> Column:
    """An entity tag for weak comparison."""
    return F.regexp_replace(tag, "^W/", "")


def _carried(wanted: DataFrame, latest: DataFrame, block: int, levels: int) -> DataFrame:
    """url_key, block and carried (the greatest latest response of earlier blocks) for the wanted (url_key, block) pairs.

    latest: url_key, block, latest.
    """
    both = wanted.join(latest, ["url_key", "block"], "full_outer")
    if levels == 1:
        before = Window.partitionBy("url_key").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
        return both.withColumn("carried", F.max("latest").over(before)).select("url_key", "block", "carried")
    parent = F.floor(F.col("block") / block)
    before = Window.partitionBy("url_key", "parent").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    inside = both.withColumn("parent", parent).withColumn("inside", F.max("latest").over(before)).drop("latest")
    up = _carried(
        wanted.select("url_key", parent.alias("block")).distinct(),
        latest.groupBy("url_key", parent.alias("block")).agg(F.max("latest").alias("latest")), block, levels - 1,
    )
    joined = inside.join(up.select("url_key", F.col("block").alias("parent"), "carried"), ["url_key", "parent"], "left")
    return joined.select("url_key", "block", F.coalesce("inside", "carried").alias("carried"))


def resolve(records: DataFrame, block: int = BLOCK, levels: int = LEVELS) -> DataFrame:
    """One row for each revisit: record_id, url_key, target_id, verdict, headers (map) and payload_digest.

    records: record_id long, url, ts long, kind ('response' or 'revisit'), etag, last_modified, digest (strings) and
    headers map<string,string>.  verdict: resolved, unvalidated, mismatch (target_id is still given, headers are null)
    or no_response.
    """
    none = F.create_map().cast("map<string,string>")
    held = records.select(
        "record_id", "ts", "kind", canonical(F.col("url")).alias("url_key"), F.floor(F.col("ts") / block).alias("block"), "etag", "last_modified", "digest",
        F.coalesce("headers", none).alias("headers"),
    )
    fields = ["ts", "record_id", "etag", "last_modified", "digest", F.map_entries("headers").alias("headers")]
    placed = F.col("ts").isNotNull() & F.col("url_key").isNotNull()
    rows = held.where(placed).withColumn("response", F.when(F.col("kind") == "response", F.struct(*fields)))
    blocks = rows.where(F.col("response").isNotNull()).groupBy("url_key", "block").agg(F.max("response").alias("latest"))
    wanted = rows.where(F.col("kind") == "revisit").select("url_key", "block").distinct()
    carried = _carried(wanted, blocks, block, levels)
    within = Window.partitionBy("url_key", "block").orderBy("ts").rangeBetween(Window.unboundedPreceding, -1)
    revisits = rows.withColumn("inside", F.max("response").over(within)).where(F.col("kind") == "revisit").drop("response")
    joined = revisits.join(carried, ["url_key", "block"], "left").withColumn("r", F.coalesce("inside", "carried"))
    lost = held.where(~placed & (F.col("kind") == "revisit"))
    same = (
        F.when(F.col("etag").isNotNull() & F.col("r.etag").isNotNull(), _bare(F.col("etag")) == _bare(F.col("r.etag")))
        .when(F.col("last_modified").isNotNull() & F.col("r.last_modified").isNotNull(), F.col("last_modified") == F.col("r.last_modified"))
        .when(F.col("digest").isNotNull() & F.col("r.digest").isNotNull(), F.col("digest") == F.col("r.digest"))
    )
    verdict = F.when(F.col("r").isNull(), "no_response").when(same.isNull(), "unvalidated").when(same, "resolved").otherwise("mismatch")
    update = F.map_filter("headers", lambda k, _: F.lower(k).isin(*PERMITTED))
    names = F.transform(F.map_keys(update), F.lower)
    stored = F.map_filter(F.map_from_entries("r.headers"), lambda k, _: ~F.array_contains(names, F.lower(k)))
    fine = verdict.isin("resolved", "unvalidated")
    unresolved = lost.select("record_id", "url_key", F.lit(None).cast("long").alias("target_id"), F.lit("no_response").alias("verdict"), F.lit(None).cast("map<string,string>").alias("headers"), F.lit(None).cast("string").alias("payload_digest"))
    found = joined.select(
        "record_id", "url_key", F.col("r.record_id").alias("target_id"), verdict.alias("verdict"), F.when(fine, F.map_concat(stored, update)).alias("headers"), F.when(fine, F.col("r.digest")).alias("payload_digest")
    )
    return found.unionByName(unresolved)


def with_payload(resolved: DataFrame, payloads: DataFrame) -> DataFrame:
    """Adds the payload of the response named by target_id (payloads: record_id, payload); null where none may be used."""
    bodies = payloads.select(F.col("record_id").alias("target_id"), "payload")
    return resolved.join(bodies, "target_id", "left").withColumn("payload", F.when(F.col("headers").isNotNull(), F.col("payload")))


def captures(pages: DataFrame) -> DataFrame:
    """Captures of all pages: a response of each at time 2 * page_id, and a revisit of the page's address later.

    The pages table has one capture of a page, so the revisits are made from it: of every page, 10 + page_id % 4000 later,
    under another spelling of its address.  A fifth of them carries no validator, another fifth a stale one.
    """
    tag = F.concat(F.lit('"'), F.substring(F.sha2("html", 256), 1, 16), F.lit('"'))
    page = F.col("page_id")
    body = pages.select("page_id", "url", tag.alias("tag"), F.sha2("html", 256).alias("sha"), F.length("html").cast("string").alias("size"))
    responses = body.select(
        (2 * page).alias("record_id"), "url", (2 * page).alias("ts"), F.lit("response").alias("kind"), F.col("tag").alias("etag"), F.lit(None).cast("string").alias("last_modified"), F.col("sha").alias("digest"),
        F.create_map(F.lit("content-type"), F.lit("text/html"), F.lit("content-length"), F.col("size"), F.lit("etag"), F.col("tag"), F.lit("date"), page.cast("string")).alias("headers"),
    )
    sent = F.when(page % 5 == 3, F.lit(None)).when(page % 5 == 4, F.lit('"stale"')).otherwise(F.concat(F.lit("W/"), F.col("tag")))
    revisits = body.select(
        (2 * page + 1).alias("record_id"), F.concat("url", F.lit("#again")).alias("url"), (2 * page + 10 + page % 4000).alias("ts"), F.lit("revisit").alias("kind"), sent.alias("etag"), F.lit(None).cast("string").alias("last_modified"), F.lit(None).cast("string").alias("digest"),
        F.create_map(F.lit("Date"), (page + 10).cast("string"), F.lit("cache-control"), F.lit("no-cache"), F.lit("server"), F.lit("edge")).alias("headers"),
    )
    return responses.unionByName(revisits)


def op5_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resolve(captures(spark.read.parquet(f"{sf_dir}/pages.parquet")))
    lines = F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))
    return found.withColumn("headers", F.array_join(lines, "\n"))


def _sql_canonical(url: str) -> str:
    u = f"regexp_replace(trim({url}), '#.*$', '')"
    u = f"regexp_replace({u}, '([?&]){TRACKING}=[^&]*', '\\1', 'g')"
    u = f"regexp_replace(regexp_replace(regexp_replace({u}, '&+', '&', 'g'), '\\?&', '?', 'g'), '[?&]+$', '')"
    scheme = "^(?:[A-Za-z][A-Za-z0-9+.-]*://)?"
    host = f"regexp_replace(lower(regexp_extract({u}, '{scheme}([^/?]*)', 1)), '^www\\.|:(?:80|443)$', '', 'g')"
    rest = f"regexp_extract({u}, '{scheme}[^/?]*(.*)$', 1)"
    return f"{host} || regexp_replace(regexp_replace({rest}, '/+$', ''), '/+\\?', '?')"


ORACLE_SQL = f"""
WITH p AS (SELECT page_id, url, sha256(html) AS sha, '"' || substr(sha256(html), 1, 16) || '"' AS tag, length(html) AS size FROM pages),
r AS (SELECT 2 * page_id AS rid, {_sql_canonical("url")} AS k, 2 * page_id AS ts, tag, sha, size, page_id FROM p),
v AS (SELECT 2 * page_id + 1 AS record_id, {_sql_canonical("url || '#again'")} AS k, 2 * page_id + 10 + page_id % 4000 AS ts, page_id,
  CASE WHEN page_id % 5 = 3 THEN NULL WHEN page_id % 5 = 4 THEN '"stale"' ELSE tag END AS sent FROM p),
j AS (SELECT v.record_id, v.k, v.page_id AS vp, v.sent, max(struct_pack(ts := r.ts, rid := r.rid)) AS best FROM v LEFT JOIN r ON r.k = v.k AND r.ts < v.ts GROUP BY ALL),
m AS (SELECT j.*, r.rid, r.tag, r.sha, r.size, r.page_id AS rp FROM j LEFT JOIN r ON r.rid = j.best.rid),
c AS (SELECT *, CASE WHEN rid IS NULL THEN 'no_response' WHEN sent IS NULL THEN 'unvalidated' WHEN sent = tag THEN 'resolved' ELSE 'mismatch' END AS verdict FROM m)
SELECT record_id, k AS url_key, rid AS target_id, verdict,
  CASE WHEN verdict IN ('resolved', 'unvalidated') THEN 'Date: ' || (vp + 10) || chr(10) || 'cache-control: no-cache' || chr(10) || 'content-length: ' || size || chr(10) || 'content-type: text/html' || chr(10) || 'etag: ' || tag END AS headers,
  CASE WHEN verdict IN ('resolved', 'unvalidated') THEN sha END AS payload_digest
FROM c
"""
