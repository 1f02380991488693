"""Queries over shard keys, partitions and addresses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import codec, hashing, routing
from tessera.operators import cluster
from tessera.plans import fixtures as X
from tessera.plans.registry import query


def _route(spark: SparkSession, d: str, strategy: routing.Strategy) -> DataFrame:
    made = strategy(F.lit("t"), F.col("key"), F.lit("f"), F.lit("c"))
    return X.route_keys(spark, d).select("key", made.alias("shard_key"))


def _sql(made: str) -> str:
    return f"WITH {X.ROUTEKEYS} SELECT key, {made} AS shard_key FROM rk"


_BRACE = r"CASE WHEN regexp_matches(key, '\{.*?\}') THEN regexp_extract(key, '\{(.*?)\}', 1) ELSE key END"
_COLON = "string_split(key, ':')[-1]"


@query(_sql("key"))
def route_row_key(spark: SparkSession, d: str) -> DataFrame:
    return _route(spark, d, routing.parse("row_key"))


@query(_sql("'t#' || key || '#f#c'"))
def route_full_key(spark: SparkSession, d: str) -> DataFrame:
    return _route(spark, d, routing.parse("full_key"))


@query(_sql(_BRACE))
def route_brace(spark: SparkSession, d: str) -> DataFrame:
    return _route(spark, d, routing.parse("brace"))


@query(_sql(_COLON))
def route_colon(spark: SparkSession, d: str) -> DataFrame:
    return _route(spark, d, routing.parse("colon"))


@query(_sql(f"coalesce(nullif({_BRACE}, ''), nullif({_COLON}, ''), key)"))
def route_composite(spark: SparkSession, d: str) -> DataFrame:
    return _route(spark, d, routing.composite(routing.brace(), routing.colon()))


@query(_sql("array_to_string(string_split(key, ':')[1:2], ':')"))
def route_prefix(spark: SparkSession, d: str) -> DataFrame:
    return _route(spark, d, routing.parse("prefix:2"))


@query(_sql(r"CASE WHEN regexp_matches(key, 'user:\{(\d+)\}') THEN regexp_extract(key, 'user:\{(\d+)\}', 1) ELSE key END"))
def route_regex(spark: SparkSession, d: str) -> DataFrame:
    return _route(spark, d, routing.parse(r"regex:user:\{(\d+)\}"))


_HASH = "list_reduce(list_prepend(0::HUGEINT, list_transform(string_split({0}, ''), lambda c: unicode(c)::HUGEINT)), lambda a, c: (a * 31 + c) % 4294967296)"
_ROUTED = f"""u AS (SELECT key, CAST({_HASH.format("key")} AS BIGINT) AS u FROM (SELECT DISTINCT CAST(o_orderkey AS VARCHAR) AS key FROM orders)),
x AS (SELECT key, xor(u, u >> 16) AS w FROM u), h AS (SELECT key, CASE WHEN w >= 2147483648 THEN w - 4294967296 ELSE w END AS hash FROM x)"""


def _keys(spark: SparkSession, d: str) -> DataFrame:
    return X.table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("key")).distinct()


@query(f"WITH {_ROUTED} SELECT key, hash, CAST(((hash % 16) + 16) % 16 AS INTEGER) AS partition FROM h")
def route_partition(spark: SparkSession, d: str) -> DataFrame:
    return _keys(spark, d).withColumn("hash", hashing.spread_hash(F.col("key"))).select("key", "hash", F.pmod("hash", F.lit(16)).cast("int").alias("partition"))


@query(f"""WITH {_ROUTED}, {X.PLACE}, t AS (SELECT * FROM place WHERE is_leader AND "table" = 'NATION_5'), n AS (SELECT count(*) AS n FROM t),
p AS (SELECT key, CAST(((hash % n) + n) % n AS INTEGER) AS partition FROM h, n)
SELECT key, p.partition, endpoint FROM p LEFT JOIN t ON t.partition = p.partition LEFT JOIN nodes USING (node)""")
def route_endpoint(spark: SparkSession, d: str) -> DataFrame:
    """Key, partition and endpoint of the partition's leader, through the placement of one table (at most 8 partitions)."""
    catalog = X.catalog(spark, d).where(F.col("table") == "NATION_5")
    leaders = cluster.place(catalog, X.nodes(spark, d)).where("is_leader").join(X.nodes(spark, d), "node").select("partition", "endpoint")
    total = catalog.select(F.col("partitions").alias("n"))
    return _keys(spark, d).crossJoin(F.broadcast(total)).withColumn("partition", hashing.partition_of(F.col("key"), F.col("n"))).join(F.broadcast(leaders), "partition", "left").select("key", "partition", "endpoint")


@query(f"""WITH {X.PLACE} SELECT "table" || '_' || replica || '_' || partition AS trp, "table", CAST(replica AS INTEGER) AS replica, CAST(partition AS INTEGER) AS partition FROM place""")
def trp_codec(spark: SparkSession, d: str) -> DataFrame:
    coded = cluster.place(X.catalog(spark, d), X.nodes(spark, d)).select(codec.trp(F.col("table"), F.col("replica"), F.col("partition")).alias("trp"))
    return coded.withColumn("p", codec.parse_trp(F.col("trp"))).select("trp", "p.*")


@query(f"""WITH {X.CAT} SELECT "table", sha256("table" || '|' || partitions || '|' || replications || '|' || version || '|' || status) AS checksum FROM cat""")
def meta_checksum(spark: SparkSession, d: str) -> DataFrame:
    return X.catalog(spark, d).select("table", cluster.checksum(*[F.col(c) for c in ("table", "partitions", "replications", "version", "status")]).alias("checksum"))


@query(f"WITH {X.NODES} SELECT node, string_split(endpoint, ':')[1] AS ip, CAST(string_split(endpoint, ':')[2] AS INTEGER) AS port FROM nodes")
def endpoint_parse(spark: SparkSession, d: str) -> DataFrame:
    return X.nodes(spark, d).withColumn("e", codec.endpoint(F.col("endpoint"))).select("node", "e.ip", "e.port")


@query("""WITH h AS (SELECT o_orderkey AS value, lpad(printf('%X', o_orderkey), 16, '0') AS x FROM orders)
SELECT value, x[15:16] || x[13:14] || x[11:12] || x[9:10] || x[7:8] || x[5:6] || x[3:4] || x[1:2] AS hex FROM h""")
def long_codec(spark: SparkSession, d: str) -> DataFrame:
    return X.table(spark, d, "orders").select(F.col("o_orderkey").alias("value"), codec.long_bytes(F.col("o_orderkey")).alias("hex"))


@query("SELECT p_partkey AS part, CAST(pow(2, ceil(log2(p_size))) AS BIGINT) AS ring FROM part")
def ring_size(spark: SparkSession, d: str) -> DataFrame:
    return X.table(spark, d, "part").select(F.col("p_partkey").alias("part"), codec.power_of_two(F.col("p_size")).alias("ring"))
