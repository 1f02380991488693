"""Queries that write to durable stores and read through them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.model import ADDRESS
from tessera.plans import fixtures as X
from tessera.plans.registry import query
from tessera.sources.client import TableClient
from tessera.sources.log_store import LogStore
from tessera.sources.metadata import MetaStore
from tessera.sources.queue import Topic
from tessera.sources.shared import shared
from tessera.sources.store import CellStore, move_shards


def _filled(spark: SparkSession, d: str) -> CellStore:
    """OCELL in a store: written, then partly overwritten and deleted."""
    store = CellStore(spark, shared(spark, "cells"), shards=X.SHARDS)
    cells = X.ocell(spark, d)
    store.put(cells)
    number = F.col("key").cast("long")
    store.put(cells.where((F.col("col") == "status") & (number % 5 == 0)).withColumn("value", F.lit("X")))
    store.delete(cells.where((F.col("col") == "priority") & (number % 7 == 0)))
    return store


_STATE = f"""WITH {X.OCELL}, {X.KEYS}, state AS (SELECT family, key, col, CASE WHEN col = 'status' AND CAST(key AS BIGINT) % 5 = 0 THEN 'X' ELSE value END AS value FROM ocell
  WHERE NOT (col = 'priority' AND CAST(key AS BIGINT) % 7 = 0))"""


@query(f"{_STATE} SELECT 'status' AS col, max(value) AS value, count(*) > 0 AS found FROM state WHERE key = '5' AND col = 'status' UNION ALL SELECT 'priority', max(value), count(*) > 0 FROM state WHERE key = '7' AND col = 'priority'")
def store_get(spark: SparkSession, d: str) -> DataFrame:
    """Single reads of an overwritten and a deleted cell, each from one shard."""
    store = _filled(spark, d)
    rows = [(col, *reversed(store.get("o", key, col))) for key, col in (("5", "status"), ("7", "priority"))]
    return spark.createDataFrame(rows, "col string, value string, found boolean")


@query(f"{_STATE}, asked AS (SELECT ord, key, c.col FROM keys, (SELECT unnest(['status', 'priority', 'none']) AS col) c) SELECT asked.ord, asked.key, asked.col, value, state.key IS NOT NULL AS found FROM asked LEFT JOIN state ON asked.key = state.key AND asked.col = state.col")
def store_batch_get(spark: SparkSession, d: str) -> DataFrame:
    """A batch read that asks the store's Bloom filter first."""
    store = _filled(spark, d)
    store.use_filter()
    asked = X.keys(spark, d).select("ord", F.lit("o").alias("family"), "key", F.explode(F.array(*map(F.lit, ("status", "priority", "none")))).alias("col"))
    return store.get_many(asked).drop("family")


@query(f"{_STATE} SELECT key, col, value FROM state")
def store_compact(spark: SparkSession, d: str) -> DataFrame:
    """Cells of a store after a compaction in files of at most 1,000 records."""
    store = _filled(spark, d)
    store.compact(records_per_file=1000)
    return store.cells().select("key", "col", "value")


@query(f"{_STATE} SELECT count(*) AS n, count(DISTINCT key) AS n_rows, 'COMPLETED' AS outcome FROM state")
def store_move(spark: SparkSession, d: str) -> DataFrame:
    """Cells of two stores after half of the shards moved: none is lost or doubled."""
    source, target = _filled(spark, d), CellStore(spark, shared(spark, "cells"), shards=X.SHARDS)
    outcome = move_shards(source, target, list(range(0, X.SHARDS, 2)))
    both = source.cells().select(*ADDRESS).unionByName(target.cells().select(*ADDRESS))
    return both.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("key").alias("n_rows")).withColumn("outcome", F.lit(outcome))


@query(f"WITH {X.OCELL}, {X.KEYS} SELECT ord, keys.key, value, ocell.key IS NOT NULL AS found FROM keys LEFT JOIN ocell ON keys.key = ocell.key AND ocell.col = 'status'")
def proxy_get(spark: SparkSession, d: str) -> DataFrame:
    """Writes and reads that are routed by key to one of three partitions."""
    client = TableClient(spark, "orders", [f"{shared(spark, 'proxy')}/node{i}" for i in range(3)], shards=4)
    client.put(X.ocell(spark, d))
    return client.get_many(X.keys(spark, d).select("ord", F.lit("o").alias("family"), "key", F.lit("status").alias("col"))).select("ord", "key", "value", "found")


@query("SELECT n_name AS name, 'v' || (n_nationkey + 1) AS record FROM nation WHERE n_name LIKE 'NATION_1%' AND n_nationkey <> 12")
def meta_list(spark: SparkSession, d: str) -> DataFrame:
    """Catalog records that were saved twice, one of them removed, listed by a prefix."""
    store = MetaStore(spark, shared(spark, "meta"))
    nations = X.table(spark, d, "nation").select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("n"))
    for k in range(2):
        store.save("table", nations.select("name", F.concat(F.lit("v"), (F.col("n") + k).cast("string")).alias("record")))
    store.save("node", nations.select("name", F.lit("other").alias("record")))
    store.remove("table", nations.where("n = 12"))
    return store.list("table", "NATION_1")


def _cut_log(spark: SparkSession, d: str) -> LogStore:
    store = LogStore(spark, shared(spark, "log"))
    store.append(X.clog(spark, d).withColumnRenamed("role", "command"), "idx")
    store.truncate_prefix(1, 2)
    store.truncate_suffix(2, 2)
    store.append(spark.createDataFrame([(1, "more", 1), (2, "again", 2)], "shard long, command string, at int"), "at", term=2)
    return store


_CUT = f"""WITH {X.CLOG}, l AS (SELECT shard, idx, term, role AS command FROM clog WHERE NOT (shard = 1 AND idx <= 2) AND NOT (shard = 2 AND idx >= 2)
  UNION ALL SELECT 1, max(idx) + 1, 2, 'more' FROM clog WHERE shard = 1 UNION ALL SELECT 2, 2, 2, 'again')"""


@query(f"{_CUT} SELECT * FROM l")
def log_store_cut(spark: SparkSession, d: str) -> DataFrame:
    """A durable log cut at both ends and written on, read after a compaction."""
    store = _cut_log(spark, d)
    store.compact()
    return store.entries()


@query(f"{_CUT} SELECT idx, term, command FROM l WHERE shard = 1 AND idx >= 3")
def log_store_scan(spark: SparkSession, d: str) -> DataFrame:
    """A strict read from the first index that a truncation has left."""
    return _cut_log(spark, d).scan(1, 3).select("idx", "term", "command")


@query("SELECT CAST(unnest([1, 2]) AS BIGINT) AS shard, CAST(unnest([4, 1]) AS BIGINT) AS mark")
def log_store_mark(spark: SparkSession, d: str) -> DataFrame:
    """Flush marks: the last one of a shard counts."""
    store = _cut_log(spark, d)
    for shard, mark in ((1, 3), (2, 1), (1, 4)):
        store.mark_flushed(shard, mark)
    store.compact()
    return store.flushed()


@query("SELECT CAST(event_id AS VARCHAR) AS body, CAST(user_id AS VARCHAR) AS key FROM events WHERE event_id < 200")
def queue_consume(spark: SparkSession, d: str) -> DataFrame:
    """All messages of a topic, read by a group in three polls."""
    topic = Topic(spark, shared(spark, "topic"), partitions=4)
    events = X.table(spark, d, "events").where("event_id < 200")
    topic.publish(events.select(F.col("user_id").cast("string").alias("key"), F.col("event_id").cast("string").alias("body"), "event_id"), "event_id")
    found = spark.createDataFrame([], "body string, key string")
    for most in (10, 40, 200):
        read = topic.poll("g", most)
        found = found.unionByName(spark.createDataFrame(read.select("body", "key").toArrow()))
        topic.commit("g", read)
    return found
