"""Inputs of the queries, derived from the driver's tables, each in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SHARDS = 16


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ocell(spark: SparkSession, d: str) -> DataFrame:
    """orders as cells: family o, one row of the table for each order."""
    rows = table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("key"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), F.col("o_custkey").cast("string").alias("custkey"))
    return rows.unpivot(["key"], ["status", "priority", "custkey"], "col", "value").select(F.lit("o").alias("family"), "key", "col", "value")


OCELL = """ocell AS (
  SELECT 'o' AS family, CAST(o_orderkey AS VARCHAR) AS key, 'status' AS col, o_orderstatus AS value FROM orders
  UNION ALL SELECT 'o', CAST(o_orderkey AS VARCHAR), 'priority', o_orderpriority FROM orders
  UNION ALL SELECT 'o', CAST(o_orderkey AS VARCHAR), 'custkey', CAST(o_custkey AS VARCHAR) FROM orders)"""


def lver(spark: SparkSession, d: str) -> DataFrame:
    """lineitem as versions of cells."""
    return table(spark, d, "lineitem").select(
        F.lit("l").alias("family"), F.col("l_orderkey").cast("string").alias("key"), F.col("l_linenumber").cast("string").alias("col"), F.col("l_quantity").alias("value"),
        F.struct("l_shipdate", "l_partkey", "l_suppkey").alias("version"),
    )


LVER = """lver AS (
  SELECT 'l' AS family, CAST(l_orderkey AS VARCHAR) AS key, CAST(l_linenumber AS VARCHAR) AS col, l_quantity AS value,
    struct_pack(a := l_shipdate, b := l_partkey, c := l_suppkey) AS version FROM lineitem)"""


def evlog(spark: SparkSession, d: str) -> DataFrame:
    """events as a log of puts and deletes."""
    return table(spark, d, "events").select(
        F.pmod("user_id", F.lit(SHARDS)).cast("int").alias("shard"), (F.col("event_id") + 1).alias("idx"), F.floor(F.col("event_id") / 100).cast("long").alias("batch_id"),
        F.when(F.col("event_id") % 11 == 0, "DELETE").otherwise("PUT").alias("op"), F.lit("ev").alias("family"), F.col("user_id").cast("string").alias("key"), F.col("event_type").alias("col"), "value", "ts",
    )


EVLOG = f"""evlog AS (
  SELECT CAST(user_id % {SHARDS} AS INTEGER) AS shard, event_id + 1 AS idx, event_id // 100 AS batch_id, CASE WHEN event_id % 11 = 0 THEN 'DELETE' ELSE 'PUT' END AS op,
    'ev' AS family, CAST(user_id AS VARCHAR) AS key, event_type AS col, value, ts FROM events)"""


def clog(spark: SparkSession, d: str, gaps: bool = False) -> DataFrame:
    """conversations as logs by shard; with gaps, every third shard lacks its third entry."""
    rows = table(spark, d, "conversations").select(F.col("conv_id").alias("shard"), (F.col("turn") + 1).alias("idx"), F.lit(1).cast("long").alias("term"), "role", "text")
    return rows.where(~((F.col("shard") % 3 == 0) & (F.col("idx") == 3))) if gaps else rows


CLOG = """clog AS (SELECT conv_id AS shard, turn + 1 AS idx, CAST(1 AS BIGINT) AS term, role, text FROM conversations),
gaplog AS (SELECT * FROM clog WHERE NOT (shard % 3 = 0 AND idx = 3))"""


def catalog(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation").select(
        F.col("n_name").alias("table"), (2 + F.col("n_nationkey") % 7).cast("int").alias("partitions"), (1 + F.col("n_nationkey") % 3).cast("int").alias("replications"), F.lit(1).cast("long").alias("version"), F.lit("init").alias("status")
    )


CAT = """cat AS (SELECT n_name AS "table", CAST(2 + n_nationkey % 7 AS INTEGER) AS partitions, CAST(1 + n_nationkey % 3 AS INTEGER) AS replications, CAST(1 AS BIGINT) AS version, 'init' AS status FROM nation)"""


def nodes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("node"), F.concat(F.lit("10.0.0."), F.col("s_suppkey").cast("string"), F.lit(":9000")).alias("endpoint"))


NODES = """nodes AS (SELECT s_suppkey AS node, '10.0.0.' || s_suppkey || ':9000' AS endpoint FROM supplier)"""

PLACE = f"""{CAT}, {NODES},
place AS (
  SELECT "table", replica, partition, node, replica = 0 AS is_leader, CAST(0 AS BIGINT) AS term
  FROM (SELECT *, unnest(range(partitions)) AS partition FROM (SELECT *, unnest(range(replications)) AS replica FROM cat)) c
  JOIN (SELECT node, row_number() OVER (ORDER BY node) - 1 AS slot FROM nodes) n ON n.slot = (c.replica * c.partitions + c.partition) % (SELECT count(*) FROM nodes)),
heart AS (SELECT * FROM place WHERE (node + partition) % 5 <> 0)"""


def up(placement: DataFrame) -> DataFrame:
    return placement.where((F.col("node") + F.col("partition")) % 5 != 0)


def keys(spark: SparkSession, d: str) -> DataFrame:
    """Requested keys with their ordinal, two of them absent."""
    known = table(spark, d, "orders").where(F.col("o_orderkey") % 97 == 0).select((F.col("o_orderkey") / 97).cast("long").alias("ord"), F.col("o_orderkey").cast("string").alias("key")).distinct()
    return known.unionByName(spark.createDataFrame([(-1, "-1"), (-2, "-2")], "ord long, key string"))


KEYS = """keys AS (
  SELECT DISTINCT o_orderkey // 97 AS ord, CAST(o_orderkey AS VARCHAR) AS key FROM orders WHERE o_orderkey % 97 = 0
  UNION ALL SELECT -1, '-1' UNION ALL SELECT -2, '-2')"""


def route_keys(spark: SparkSession, d: str) -> DataFrame:
    made = table(spark, d, "events").select(F.concat(F.lit("user:{"), F.col("user_id").cast("string"), F.lit("}:"), F.col("event_type")).alias("key"))
    urls = table(spark, d, "pages").select(F.col("url").alias("key"))
    edge = spark.createDataFrame([("{}",), ("tail:",), ("plain",), ("a{}b:",), ("a:b:c:d",)], "key string")
    return made.unionByName(urls).unionByName(edge).distinct()


ROUTEKEYS = """rk AS (
  SELECT 'user:{' || user_id || '}:' || event_type AS key FROM events UNION SELECT url FROM pages
  UNION SELECT unnest(['{}', 'tail:', 'plain', 'a{}b:', 'a:b:c:d']))"""


def followers(spark: SparkSession, d: str) -> DataFrame:
    shards = clog(spark, d).select("shard").distinct().withColumn("follower", F.explode(F.sequence(F.lit(1), F.lit(3))))
    following = 1 + (F.col("shard") + F.col("follower")) % 8
    return shards.select("shard", "follower", following.alias("next"), (following - 1).alias("match"))


FOLLOW = """follow AS (
  SELECT shard, follower, 1 + (shard + follower) % 8 AS next, (shard + follower) % 8 AS "match"
  FROM (SELECT DISTINCT conv_id AS shard FROM conversations), (SELECT CAST(unnest(range(1, 4)) AS INTEGER) AS follower))"""
