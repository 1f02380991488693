"""Queries over the control plane: catalog, placement, replication and migration."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import cluster, replication
from tessera.plans import fixtures as X
from tessera.plans.registry import query


def _place(spark: SparkSession, d: str) -> DataFrame:
    return cluster.place(X.catalog(spark, d), X.nodes(spark, d))


@query(f'WITH {X.PLACE} SELECT "table", CAST(replica AS INTEGER) AS replica, CAST(partition AS INTEGER) AS partition, node, is_leader, term FROM place')
def placement(spark: SparkSession, d: str) -> DataFrame:
    return _place(spark, d)


@query(f'WITH {X.PLACE} SELECT "table", CAST(partition AS INTEGER) AS partition, count(*) AS replicas, count(DISTINCT node) AS nodes FROM place GROUP BY ALL HAVING count(DISTINCT node) < count(*)')
def placement_colocated(spark: SparkSession, d: str) -> DataFrame:
    return cluster.colocated(_place(spark, d))


@query(f"WITH {X.PLACE} SELECT node, count(*) AS n_trps, count(*) FILTER (is_leader) AS n_leaders FROM place GROUP BY node")
def placement_skew(spark: SparkSession, d: str) -> DataFrame:
    return cluster.skew(_place(spark, d))


@query(f"WITH {X.PLACE}, c AS (SELECT nodes.node, count(place.node) AS n_trps FROM nodes LEFT JOIN place ON nodes.node = place.node GROUP BY 1) SELECT node, n_trps, avg(n_trps) OVER () AS average, max(n_trps) OVER () / avg(n_trps) OVER () AS ratio FROM c")
def placement_balance(spark: SparkSession, d: str) -> DataFrame:
    return cluster.balance(_place(spark, d), X.nodes(spark, d))


@query(f"""WITH {X.NODES}, fresh AS (SELECT r_name AS "table", 4 + r_regionkey AS partitions, 2 AS replications FROM region)
SELECT "table", CAST(replica AS INTEGER) AS replica, CAST(partition AS INTEGER) AS partition, node, replica = 0 AS is_leader, CAST(0 AS BIGINT) AS term
FROM (SELECT *, unnest(range(partitions)) AS partition FROM (SELECT *, unnest(range(replications)) AS replica FROM fresh)) c
JOIN (SELECT node, row_number() OVER (ORDER BY node) - 1 AS slot FROM nodes) n ON n.slot = (c.replica * c.partitions + c.partition) % (SELECT count(*) FROM nodes)""")
def ddl_create_placed(spark: SparkSession, d: str) -> DataFrame:
    """Placement of tables that are new; one that exists is not placed again."""
    catalog = X.catalog(spark, d)
    fresh = X.table(spark, d, "region").select(F.col("r_name").alias("table"), (4 + F.col("r_regionkey")).cast("int").alias("partitions"), F.lit(2).alias("replications"))
    known = catalog.where(F.col("table") == "NATION_3").select("table", F.lit(9).alias("partitions"), F.lit(2).alias("replications"))
    return cluster.place_created(catalog, fresh.unionByName(known), X.nodes(spark, d))


@query(f"""WITH {X.CAT} SELECT "table", partitions, replications, version, status FROM cat
UNION ALL SELECT r_name, CAST(4 + r_regionkey AS INTEGER), CAST(2 AS INTEGER), CAST(1 AS BIGINT), 'init' FROM region""")
def ddl_create(spark: SparkSession, d: str) -> DataFrame:
    """Tables named after regions, and one that exists already and is left alone."""
    catalog = X.catalog(spark, d)
    fresh = X.table(spark, d, "region").select(F.col("r_name").alias("table"), (4 + F.col("r_regionkey")).cast("int").alias("partitions"), F.lit(2).alias("replications"))
    known = catalog.where(F.col("table") == "NATION_3").select("table", F.lit(99).alias("partitions"), F.lit(9).alias("replications"))
    return cluster.create(catalog, fresh.unionByName(known))


@query(f"""WITH {X.PLACE} SELECT "table", CAST(replica AS INTEGER) AS replica, CAST(partition AS INTEGER) AS partition FROM place WHERE "table" NOT IN (SELECT n_name FROM nation WHERE n_nationkey % 4 = 0)""")
def ddl_drop(spark: SparkSession, d: str) -> DataFrame:
    gone = X.table(spark, d, "nation").where(F.col("n_nationkey") % 4 == 0).select(F.col("n_name").alias("table"))
    return cluster.drop(_place(spark, d), gone).select("table", "replica", "partition")


@query(f"""WITH {X.PLACE}, a AS (SELECT "table", replica, partition FROM place UNION SELECT "table", replica + 1, partition FROM place)
SELECT "table", CAST(replica AS INTEGER) AS replica, CAST(partition AS INTEGER) AS partition FROM a WHERE NOT ("table" = 'NATION_2' AND replica = 0)""")
def ddl_trp_add(spark: SparkSession, d: str) -> DataFrame:
    """Another replica is asked for everywhere (some exist), then one table's first replicas are removed."""
    placed = _place(spark, d)
    added = cluster.add_trps(placed, placed.withColumn("replica", F.col("replica") + 1))
    return cluster.remove_trps(added, placed.where((F.col("table") == "NATION_2") & (F.col("replica") == 0)))


_BEAT = f"""WITH {X.PLACE}, u AS (SELECT "table", count(*) AS up FROM heart GROUP BY 1),
b AS (SELECT cat."table", coalesce(up, 0) AS up, CAST(partitions * replications AS BIGINT) AS expected, version, status FROM cat LEFT JOIN u ON u."table" = cat."table")"""


@query(f"""{_BEAT} SELECT "table", up, expected, CASE WHEN up = expected THEN 'NORMAL' ELSE status END AS status, version + CASE WHEN up > 0 THEN 1 ELSE 0 END AS version FROM b""")
def heartbeat_merge(spark: SparkSession, d: str) -> DataFrame:
    placed = _place(spark, d)
    return cluster.merge_heartbeats(X.catalog(spark, d), placed, X.up(placed))


@query(f"""{_BEAT} SELECT CASE WHEN up = expected THEN 'NORMAL' ELSE status END AS status, count(*) AS n FROM b GROUP BY 1""")
def table_status(spark: SparkSession, d: str) -> DataFrame:
    placed = _place(spark, d)
    return cluster.merge_heartbeats(X.catalog(spark, d), placed, X.up(placed)).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {X.NODES} SELECT node, endpoint FROM nodes WHERE node = 7")
def node_lookup(spark: SparkSession, d: str) -> DataFrame:
    return X.nodes(spark, d).where(F.col("node") == 7)


@query("""SELECT 'pd/table/' || n_name AS path, n_nationkey AS id FROM nation WHERE starts_with('pd/table/' || n_name, 'pd/table/NATION_1')""")
def list_prefix(spark: SparkSession, d: str) -> DataFrame:
    """Metadata records below a path prefix."""
    rows = X.table(spark, d, "nation").select(F.concat(F.lit("pd/table/"), "n_name").alias("path"), F.col("n_nationkey").alias("id"))
    return rows.where(F.startswith("path", F.lit("pd/table/NATION_1")))


@query(f"""WITH {X.CAT}, p AS (SELECT "table", CAST(partitions AS BIGINT) % 3 AS version, 'pushed' AS payload FROM cat)
SELECT cat."table", CASE WHEN p.version > cat.version THEN 'pushed' ELSE 'known' END AS payload, greatest(p.version, cat.version) AS version FROM cat JOIN p ON p."table" = cat."table" """)
def route_merge(spark: SparkSession, d: str) -> DataFrame:
    catalog = X.catalog(spark, d)
    pushes = catalog.select("table", (F.col("partitions").cast("long") % 3).alias("version"), F.lit("pushed").alias("payload"))
    return cluster.newest(pushes, catalog.select("table", "version", F.lit("known").alias("payload")))


@query("WITH e AS (SELECT event_id AS seq, '10.1.0.' || (user_id % 50) || ':8080' AS endpoint, CASE WHEN event_id % 3 = 0 THEN 'UNREGISTER' ELSE 'REGISTER' END AS action FROM events) SELECT endpoint FROM e GROUP BY endpoint HAVING arg_max(action, seq) = 'REGISTER'")
def registry_replay(spark: SparkSession, d: str) -> DataFrame:
    events = X.table(spark, d, "events").select(
        F.col("event_id").alias("seq"), F.concat(F.lit("10.1.0."), (F.col("user_id") % 50).cast("string"), F.lit(":8080")).alias("endpoint"), F.when(F.col("event_id") % 3 == 0, "UNREGISTER").otherwise("REGISTER").alias("action")
    )
    return cluster.registry(events)


@query(f"""WITH {X.PLACE}, t AS (SELECT DISTINCT "table", partition FROM place WHERE replica = 1 AND partition % 2 = 0)
SELECT p."table", CAST(p.replica AS INTEGER) AS replica, CAST(p.partition AS INTEGER) AS partition, node,
  CASE WHEN t.partition IS NOT NULL THEN p.replica = 1 ELSE is_leader END AS is_leader, term + CASE WHEN t.partition IS NOT NULL THEN 1 ELSE 0 END AS term
FROM place p LEFT JOIN t ON t."table" = p."table" AND t.partition = p.partition""")
def transfer_leader(spark: SparkSession, d: str) -> DataFrame:
    """Every even partition is asked to move to replica 1; tables without that replica keep their leader."""
    placed = _place(spark, d)
    asked = placed.where(F.col("is_leader") & (F.col("partition") % 2 == 0)).select("table", "partition", F.lit(1).alias("to_replica"))
    return cluster.transfer_leader(placed, asked)


@query(f"WITH {X.CLOG}, {X.FOLLOW}, l AS (SELECT shard, max(idx) AS last_idx FROM clog GROUP BY shard) SELECT shard, follower, next AS from_idx, least(next + 2, last_idx) AS to_idx, least(next + 2, last_idx) - next + 1 AS n FROM follow JOIN l USING (shard) WHERE next <= last_idx")
def repl_batch(spark: SparkSession, d: str) -> DataFrame:
    return replication.next_batch(X.followers(spark, d), X.clog(spark, d), 3)


@query(f"""WITH {X.CLOG}, {X.FOLLOW}, l AS (SELECT shard, max(idx) AS last_idx FROM clog GROUP BY shard) SELECT shard, follower, greatest(last_idx - "match", 0) AS lag FROM follow JOIN l USING (shard)""")
def repl_lag(spark: SparkSession, d: str) -> DataFrame:
    return replication.lag(X.followers(spark, d), X.clog(spark, d))


@query(f"""WITH {X.CLOG}, {X.FOLLOW}, e AS (SELECT f.shard, follower, next, (c.idx - f.next) / greatest(1, c.idx - f."match") AS ratio, 10 + (f.shard * 7 + c.idx) % 91 AS i, c.idx FROM follow f JOIN clog c USING (shard) WHERE c.idx >= f.next)
SELECT shard, follower, idx, CAST(least(100, greatest(10, trunc(0.8::DOUBLE * i * least(2.0, greatest(0.5, 1.0 + ln(1 + ratio))) + 0.2::DOUBLE * i))) AS INTEGER) AS "interval" FROM e""")
def repl_speed(spark: SparkSession, d: str) -> DataFrame:
    rows = X.followers(spark, d).join(X.clog(spark, d).select("shard", "idx"), "shard").where(F.col("idx") >= F.col("next"))
    current = 10 + (F.col("shard") * 7 + F.col("idx")) % 91
    return rows.select("shard", "follower", "idx", replication.interval(F.col("idx"), F.col("next"), F.col("match"), current).cast("int").alias("interval"))


@query(f"""WITH {X.CLOG}, {X.FOLLOW} SELECT f.shard, follower, "match" AS prev_idx, (SELECT count(*) FROM clog p WHERE p.shard = f.shard AND p.idx = f."match") AS prev_term, array_to_string(list(c.role ORDER BY c.idx), ',') AS entries, count(*) AS n
FROM follow f JOIN clog c ON c.shard = f.shard AND c.idx BETWEEN f.next AND f.next + 2 GROUP BY ALL""")
def append_entries(spark: SparkSession, d: str) -> DataFrame:
    """The requests sent to followers: the entry before the first, and up to three entries in order."""
    sent = replication.append_requests(X.followers(spark, d), X.clog(spark, d), 3)
    return sent.select("shard", "follower", "prev_idx", "prev_term", F.array_join(F.transform("entries", lambda e: e["role"]), ",").alias("entries"), F.size("entries").cast("long").alias("n"))


@query(f"WITH {X.EVLOG} SELECT shard, idx AS seq, max(CAST((idx * 7919) % 1000 AS BIGINT)) OVER (PARTITION BY shard ORDER BY idx ROWS UNBOUNDED PRECEDING) AS committed FROM evlog")
def commit_monotone(spark: SparkSession, d: str) -> DataFrame:
    acks = X.evlog(spark, d).select("shard", F.col("idx").alias("seq"), ((F.col("idx") * 7919) % 1000).alias("commit"))
    return replication.monotone(acks).select("shard", "seq", "committed")


@query(f"""WITH {X.FOLLOW}, r AS (SELECT shard, "match", row_number() OVER (PARTITION BY shard ORDER BY "match" DESC) AS rn FROM follow) SELECT shard, "match" AS commit FROM r WHERE rn = 2""")
def commit_quorum(spark: SparkSession, d: str) -> DataFrame:
    return replication.quorum(X.followers(spark, d), 3)


@query(f"WITH {X.CLOG} SELECT shard, (shard + 1) % 10 AS target, count(*) AS n_entries, max(idx) AS last_idx, count(*) = max(idx) - min(idx) + 1 AS complete FROM gaplog WHERE shard % 2 = 1 GROUP BY shard")
def migrate_trp(spark: SparkSession, d: str) -> DataFrame:
    entries = X.clog(spark, d, gaps=True)
    moves = entries.select("shard").distinct().where(F.col("shard") % 2 == 1).withColumn("target", (F.col("shard") + 1) % 10)
    return cluster.migrate(entries, moves)


_REPORTS = "r AS (SELECT event_id AS seq, 'trp_' || (user_id % 20) AS trp, least(1.0::DOUBLE, (event_id % 120) / 100.0::DOUBLE) AS progress FROM events)"


@query(f"WITH {_REPORTS} SELECT trp, arg_max(progress, seq) AS progress, bool_or(progress >= 1.0) AS completed FROM r GROUP BY trp")
def migration_status(spark: SparkSession, d: str) -> DataFrame:
    reports = X.table(spark, d, "events").select(F.col("event_id").alias("seq"), F.concat(F.lit("trp_"), (F.col("user_id") % 20).cast("string")).alias("trp"), F.least(F.lit(1.0), (F.col("event_id") % 120) / F.lit(100.0)).alias("progress"))
    return cluster.progress(reports)


_STEPS = ", ".join(f"'{a}>{b}'" for a, after in {"PENDING": ("LOCKED",), "LOCKED": ("COMMITTING", "ROLLBACK"), "COMMITTING": ("COMPLETED", "ROLLBACK"), "ROLLBACK": ("PENDING",)}.items() for b in after)


@query(f"""WITH e AS (SELECT event_id AS seq, 'trp_' || (user_id % 200) AS trp, ['PENDING', 'LOCKED', 'COMMITTING', 'COMPLETED', 'ROLLBACK'][1 + (event_id // 3) % 5] AS status FROM events),
p AS (SELECT *, lag(status) OVER (PARTITION BY trp ORDER BY seq) AS previous FROM e)
SELECT seq, trp, status, previous, CASE WHEN previous IS NULL THEN status = 'PENDING' ELSE previous || '>' || status IN ({_STEPS}) END AS valid FROM p""")
def migration_fsm(spark: SparkSession, d: str) -> DataFrame:
    names = F.array(*[F.lit(s) for s in ("PENDING", "LOCKED", "COMMITTING", "COMPLETED", "ROLLBACK")])
    events = X.table(spark, d, "events").select(
        F.col("event_id").alias("seq"), F.concat(F.lit("trp_"), (F.col("user_id") % 200).cast("string")).alias("trp"), F.get(names, (F.floor(F.col("event_id") / 3) % 5).cast("int")).alias("status")
    )
    return cluster.transitions(events)


@query(f"""WITH {X.PLACE}, q AS (SELECT "table", count(*) AS priority FROM place GROUP BY 1) SELECT "table", priority, rank() OVER (ORDER BY priority DESC, "table") AS place FROM q ORDER BY place LIMIT 10""")
def migration_queue(spark: SparkSession, d: str) -> DataFrame:
    """The ten most urgent tables: most replicas first."""
    from pyspark.sql import Window

    queue = _place(spark, d).groupBy("table").agg(F.count(F.lit(1)).alias("priority")).orderBy(F.desc("priority"), "table").limit(10)
    return queue.withColumn("place", F.row_number().over(Window.orderBy(F.desc("priority"), "table")).cast("long"))


@query("""WITH b AS (SELECT doc_id, text, CAST(ceil(length(text) / 1000.0) AS INTEGER) AS total_block FROM documents WHERE length(text) > 0),
u AS (SELECT *, unnest(range(0, total_block)) AS block_id FROM b)
SELECT doc_id, CAST(block_id AS INTEGER) AS block_id, total_block, sha256(substr(text, block_id * 1000 + 1, 1000)) AS checksum FROM u""")
def snapshot_blocks(spark: SparkSession, d: str) -> DataFrame:
    return cluster.snapshot_blocks(X.table(spark, d, "documents"), 1000)


@query("SELECT name FROM (SELECT 'shard_' || (user_id % 16) AS name FROM events UNION SELECT 'shard_' || (conv_id % 24) FROM conversations UNION SELECT 'default') WHERE name <> 'default'")
def family_union(spark: SparkSession, d: str) -> DataFrame:
    """Existing and requested column families, without the default one."""
    existing = X.table(spark, d, "events").select(F.concat(F.lit("shard_"), (F.col("user_id") % 16).cast("string")).alias("name"))
    asked = X.table(spark, d, "conversations").select(F.concat(F.lit("shard_"), (F.col("conv_id") % 24).cast("string")).alias("name"))
    return existing.unionByName(asked).unionByName(spark.createDataFrame([("default",)], "name string")).distinct().where(F.col("name") != "default")
