"""Queries over logs, snapshots and caches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import log, lsm
from tessera.plans import fixtures as X
from tessera.plans.cells import _LIVE
from tessera.plans.registry import query

_MARK = 5


@query(f"WITH {X.EVLOG} SELECT shard, 100 + row_number() OVER (PARTITION BY shard ORDER BY idx) AS idx, CAST(3 AS BIGINT) AS term, key, col FROM evlog")
def log_append(spark: SparkSession, d: str) -> DataFrame:
    events = X.evlog(spark, d)
    last = events.select("shard").distinct().withColumn("last_idx", F.lit(100).cast("long"))
    return log.append(events.withColumnRenamed("idx", "at"), last, "at", term=3).select("shard", "idx", "term", "key", "col")


@query(f"WITH {X.CLOG}, g AS (SELECT shard, coalesce(lag(idx) OVER (PARTITION BY shard ORDER BY idx), 0) + 1 AS expected, idx AS actual FROM gaplog) SELECT * FROM g WHERE expected <> actual")
def log_gap_check(spark: SparkSession, d: str) -> DataFrame:
    return log.gaps(X.clog(spark, d, gaps=True), first=1)


@query(f"WITH {X.CLOG}, g AS (SELECT shard, lag(idx) OVER (PARTITION BY shard ORDER BY idx) + 1 AS expected, idx AS actual FROM gaplog WHERE idx > 1) SELECT * FROM g WHERE expected <> actual")
def log_gap_truncated(spark: SparkSession, d: str) -> DataFrame:
    """A truncated prefix is no hole."""
    return log.gaps(log.truncate_prefix(X.clog(spark, d, gaps=True), 1))


@query(f"WITH {X.CLOG}, c AS (SELECT shard, idx, role, idx - row_number() OVER (PARTITION BY shard ORDER BY idx) AS shift, min(idx) OVER (PARTITION BY shard) AS low FROM gaplog WHERE idx > 1) SELECT shard, idx, role FROM c WHERE shift = low - 1")
def log_contiguous_truncated(spark: SparkSession, d: str) -> DataFrame:
    """The prefix before the first hole of logs that begin at 2."""
    return log.contiguous(log.truncate_prefix(X.clog(spark, d, gaps=True), 1)).select("shard", "idx", "role")


@query(f"WITH {X.CLOG}, c AS (SELECT shard, idx, role, row_number() OVER (PARTITION BY shard ORDER BY idx) AS place FROM gaplog WHERE idx BETWEEN 2 AND 5) SELECT shard, idx, role, place FROM c WHERE idx - place = 1")
def log_scan_holes(spark: SparkSession, d: str) -> DataFrame:
    """Scans end at the first hole."""
    return log.scan(X.clog(spark, d, gaps=True), 2, 4).select("shard", "idx", "role", "place")


@query(f"WITH {X.EVLOG}, s AS (SELECT shard, idx AS at, 50 + row_number() OVER (PARTITION BY shard ORDER BY idx) AS idx FROM evlog), r AS (SELECT * FROM s WHERE idx > 60 AND idx <> 70) SELECT shard, min(idx) AS first_ok, max(idx) AS last_ok, count(*) AS n_ok FROM r WHERE idx < 70 GROUP BY shard")
def log_strict_read(spark: SparkSession, d: str) -> DataFrame:
    """Reads of a long log from 61 on, in which 70 is missing."""
    events = X.evlog(spark, d)
    entries = log.append(events.withColumnRenamed("idx", "at"), events.select("shard", F.lit(50).cast("long").alias("last_idx")).distinct(), "at")
    return log.read_from(entries.where(F.col("idx") != 70), 61).groupBy("shard").agg(F.min("idx").alias("first_ok"), F.max("idx").alias("last_ok"), F.count(F.lit(1)).alias("n_ok"))


@query(f"WITH {X.CLOG} SELECT s.shard, coalesce(max(c.idx), 0) AS idx, coalesce(arg_max(c.term, c.idx), 0) AS term, arg_max(c.role, c.idx) AS role FROM (SELECT DISTINCT shard FROM clog) s LEFT JOIN clog c ON s.shard = c.shard AND c.idx > 4 GROUP BY s.shard")
def log_last_or_none(spark: SparkSession, d: str) -> DataFrame:
    """Shards whose log is empty after a truncation have index 0."""
    entries = X.clog(spark, d)
    return log.last(log.truncate_prefix(entries, 4), "term", "role", shards=entries)


@query(f"WITH {X.CLOG} SELECT shard, idx, role FROM clog WHERE idx >= 4")
def log_read_from(spark: SparkSession, d: str) -> DataFrame:
    return log.read_from(X.clog(spark, d), 4).select("shard", "idx", "role")


@query(f"WITH {X.CLOG} SELECT shard, idx, role, idx - 1 AS place FROM clog WHERE idx BETWEEN 2 AND 4")
def log_scan_limit(spark: SparkSession, d: str) -> DataFrame:
    return log.scan(X.clog(spark, d), 2, 3).select("shard", "idx", "role", "place")


@query(f"WITH {X.CLOG} SELECT s.shard, CAST(5 AS BIGINT) AS idx, coalesce(c.term, 0) AS term, c.role, c.shard IS NOT NULL AS has_index FROM (SELECT DISTINCT shard FROM clog) s LEFT JOIN clog c ON s.shard = c.shard AND c.idx = 5")
def log_point(spark: SparkSession, d: str) -> DataFrame:
    entries = X.clog(spark, d)
    return log.point(entries, entries.select("shard").distinct(), 5)


@query(f"WITH {X.CLOG} SELECT shard, max(idx) AS idx, arg_max(term, idx) AS term, arg_max(role, idx) AS role FROM clog GROUP BY shard")
def log_last(spark: SparkSession, d: str) -> DataFrame:
    return log.last(X.clog(spark, d), "term", "role")


@query(f"WITH {X.CLOG} SELECT shard, idx, role, length(text) AS n_chars FROM clog")
def log_iterate(spark: SparkSession, d: str) -> DataFrame:
    return X.clog(spark, d).select("shard", "idx", "role", F.length("text").cast("long").alias("n_chars"))


@query(f"WITH {X.CLOG}, c AS (SELECT shard, idx, row_number() OVER (PARTITION BY shard ORDER BY idx) AS rn FROM gaplog) SELECT shard, count(*) AS n_ok, max(idx) AS last_ok FROM c WHERE idx = rn GROUP BY shard")
def log_contiguous_prefix(spark: SparkSession, d: str) -> DataFrame:
    return log.contiguous(X.clog(spark, d, gaps=True)).groupBy("shard").agg(F.count(F.lit(1)).alias("n_ok"), F.max("idx").alias("last_ok"))


_EXTENT = "SELECT shard, min(idx) AS first_idx, max(idx) AS last_idx, count(*) AS n FROM clog WHERE {0} GROUP BY shard"


@query(f"WITH {X.CLOG} {_EXTENT.format('idx > 2')}")
def log_truncate_prefix(spark: SparkSession, d: str) -> DataFrame:
    return log.extent(log.truncate_prefix(X.clog(spark, d), 2))


@query(f"WITH {X.CLOG} {_EXTENT.format('idx < 3')}")
def log_truncate_suffix(spark: SparkSession, d: str) -> DataFrame:
    return log.extent(log.truncate_suffix(X.clog(spark, d), 3))


@query(f"WITH {X.EVLOG}, r AS (SELECT shard, idx, row_number() OVER (PARTITION BY shard ORDER BY idx) AS rn FROM evlog) SELECT shard, coalesce(max(idx) FILTER (rn % {_MARK} = 0), 0) AS mark, max(idx) AS last_idx FROM r GROUP BY shard")
def wal_flush_mark(spark: SparkSession, d: str) -> DataFrame:
    return lsm.flush_marks(X.evlog(spark, d), _MARK)


@query(f"WITH {X.EVLOG} SELECT key, col, arg_max(op, idx) AS op, arg_max(value, idx) AS value, max(idx) AS idx FROM evlog WHERE batch_id % 2 = 0 GROUP BY key, col")
def wal_compact(spark: SparkSession, d: str) -> DataFrame:
    return lsm.compact(X.evlog(spark, d), F.col("batch_id") % 2 == 0).select("key", "col", "op", "value", "idx")


@query(_LIVE)
def wal_replay(spark: SparkSession, d: str) -> DataFrame:
    """Snapshot up to a mark with the tail applied equals the whole log applied."""
    entries, upto = X.evlog(spark, d), F.col("batch_id") < 40
    return lsm.replay(lsm.compact(entries, upto), entries.where(~upto)).select("key", "col", "value")


_ENTRIES = "e AS (SELECT shard, key, col, max(idx) AS last_access, max(strlen(key) + strlen(col) + 8) AS bytes FROM evlog GROUP BY shard, key, col)"


@query(f"""WITH {X.EVLOG}, {_ENTRIES} SELECT shard, key, col, last_access, CAST(sum(bytes) OVER w AS BIGINT) AS running, sum(bytes) OVER w <= 400 AS kept FROM e
WINDOW w AS (PARTITION BY shard ORDER BY last_access DESC, key, col ROWS UNBOUNDED PRECEDING)""")
def mem_evict(spark: SparkSession, d: str) -> DataFrame:
    size = F.octet_length("key") + F.octet_length("col") + 8
    return lsm.least_recent(X.evlog(spark, d), 400, size, ["key", "col"]).select("shard", "key", "col", "last_access", "running", "kept")


@query(f"WITH {X.EVLOG}, {_ENTRIES}, r AS (SELECT shard, key, col, last_access, row_number() OVER (PARTITION BY shard ORDER BY last_access DESC, key, col) AS place FROM e) SELECT * FROM r WHERE place <= 20")
def cache_lru(spark: SparkSession, d: str) -> DataFrame:
    return lsm.most_recent(X.evlog(spark, d), 20, ["key", "col"])


@query(f"WITH {X.EVLOG} SELECT idx, (16 + strlen(key) + 16 + 8 + 7) // 8 * 8 AS weight FROM evlog")
def cache_weight(spark: SparkSession, d: str) -> DataFrame:
    return X.evlog(spark, d).select("idx", lsm.weight(F.octet_length("key"), F.lit(8)).alias("weight"))


@query(f"WITH {X.EVLOG}, l AS (SELECT key, col, max(ts) AS ts, max(idx) AS idx FROM evlog GROUP BY key, col) SELECT key, col, idx FROM l WHERE (SELECT max(ts) FROM evlog) <= ts + INTERVAL 30 SECONDS * 600")
def cache_expire(spark: SparkSession, d: str) -> DataFrame:
    entries = X.evlog(spark, d)
    latest = entries.groupBy("key", "col").agg(F.max("ts").alias("ts"), F.max("idx").alias("idx"))
    now = entries.agg(F.max("ts").alias("now"))
    return lsm.unexpired(latest.crossJoin(F.broadcast(now)), F.col("now"), F.col("ts"), 18_000).select("key", "col", "idx")


@query(f"WITH {X.EVLOG} SELECT key, col, idx, ts + INTERVAL 7200 SECONDS AS expires_at FROM evlog WHERE (SELECT max(ts) FROM evlog) <= ts + INTERVAL 7200 SECONDS")
def ttl_expire(spark: SparkSession, d: str) -> DataFrame:
    entries = X.evlog(spark, d)
    now = entries.agg(F.max("ts").alias("now"))
    return lsm.unexpired(entries.crossJoin(F.broadcast(now)), F.col("now"), F.col("ts"), 7_200).select("key", "col", "idx", (F.col("ts") + F.expr("INTERVAL 7200 SECONDS")).alias("expires_at"))


@query(f"WITH {X.EVLOG}, r AS (SELECT *, row_number() OVER (PARTITION BY shard ORDER BY idx DESC) AS rn FROM evlog) SELECT shard, idx, key FROM r WHERE rn <= 63")
def ring_tail(spark: SparkSession, d: str) -> DataFrame:
    return lsm.ring_tail(X.evlog(spark, d), 64).select("shard", "idx", "key")


@query(f"WITH {X.EVLOG} SELECT idx, key, col, lag(value) OVER (PARTITION BY family, key, col ORDER BY idx) AS old_value, value AS new_value FROM evlog")
def cdc_feed(spark: SparkSession, d: str) -> DataFrame:
    return lsm.changes(X.evlog(spark, d)).select("idx", "key", "col", "old_value", "new_value")
