"""The control plane: placement, catalog changes, heartbeats, leadership and migration as state tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.model import MIGRATION_STEPS
from tessera.operators.table import bounded

_TRP = ["table", "replica", "partition"]


def place(catalog: DataFrame, nodes: DataFrame) -> DataFrame:
    """node (by rank) of every replica r of partition p: (r * partitions + p) modulo the nodes; replica 0 leads.

    Each catalog row explodes into its own replicas and partitions; nodes are ranked once.  More replicas than nodes are
    an error, as two of them would share a node.
    """
    most = catalog.agg(F.max("replications")).first()[0]
    if most is not None and nodes.limit(most).count() < most:
        raise ValueError("a table has more replications than there are nodes")
    ranked = nodes.withColumn("slot", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("node")) - 1)
    total = nodes.agg(F.count(F.lit(1)).alias("n_nodes"))
    exploded = (
        catalog.select("table", "partitions", "replications", F.explode(F.sequence(F.lit(0), F.col("replications") - 1)).alias("replica"))
        .select("*", F.explode(F.sequence(F.lit(0), F.col("partitions") - 1)).alias("partition"))
    )
    slot = F.pmod(F.col("replica") * F.col("partitions") + F.col("partition"), F.col("n_nodes")).cast("int")
    return (
        exploded.crossJoin(F.broadcast(total)).withColumn("slot", slot).join(bounded(ranked.select("slot", "node")), "slot")
        .select(*_TRP, "node", (F.col("replica") == 0).alias("is_leader"), F.lit(0).cast("long").alias("term"))
    )


def colocated(placement: DataFrame) -> DataFrame:
    """Partitions of which two replicas share a node."""
    counts = placement.groupBy("table", "partition").agg(F.count(F.lit(1)).alias("replicas"), F.count_distinct("node").alias("nodes"))
    return counts.where(F.col("nodes") < F.col("replicas"))


def skew(placement: DataFrame) -> DataFrame:
    """Replicas and leaders of each node."""
    return placement.groupBy("node").agg(F.count(F.lit(1)).alias("n_trps"), F.count_if("is_leader").alias("n_leaders"))


def balance(placement: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, n_trps, average (of all nodes) and ratio of the fullest node to it; nodes without replicas count as 0."""
    counts = nodes.select("node").join(placement.groupBy("node").agg(F.count(F.lit(1)).alias("n")), "node", "left").select("node", F.coalesce("n", F.lit(0)).cast("long").alias("n_trps"))
    whole = counts.agg(F.avg("n_trps").alias("average"), F.max("n_trps").alias("most"))
    return counts.crossJoin(F.broadcast(whole)).select("node", "n_trps", "average", F.when(F.col("average") > 0, F.col("most") / F.col("average")).alias("ratio"))


def moves(placement: DataFrame, nodes: DataFrame) -> DataFrame:
    """Replicas to move (table, replica, partition, node, to_node) from nodes above the average, rounded up, to nodes below it, rounded down.

    A move that would put two replicas of a partition on one node is left out.
    """
    each = balance(placement, nodes)
    place = F.row_number().over(Window.partitionBy("node").orderBy(F.col("is_leader").asc(), *_TRP))
    over = placement.withColumn("_place", place).join(each.select("node", F.ceil("average").alias("_most")), "node").where(F.col("_place") > F.col("_most"))
    room = each.where(F.col("n_trps") < F.floor("average")).select(F.col("node").alias("to_node"), F.explode(F.sequence(F.col("n_trps") + 1, F.floor("average"))).alias("_slot"))
    number = lambda *by: F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*by))
    paired = over.withColumn("_n", number("node", "_place")).join(room.withColumn("_n", number("_slot", "to_node")), "_n")
    return paired.join(placement.select("table", "partition", F.col("node").alias("to_node")), ["table", "partition", "to_node"], "left_anti").select(*_TRP, "node", "to_node")


def create(catalog: DataFrame, requests: DataFrame) -> DataFrame:
    """Catalog with the requested tables that it lacks, at version 1 and status init; a known name is left as it is."""
    fresh = requests.join(catalog.select("table"), "table", "left_anti")
    return catalog.unionByName(fresh.select("table", "partitions", "replications", F.lit(1).cast("long").alias("version"), F.lit("init").alias("status")))


def place_created(catalog: DataFrame, requests: DataFrame, nodes: DataFrame) -> DataFrame:
    """Placement rows of the requested tables that the catalog lacks."""
    return place(requests.join(catalog.select("table"), "table", "left_anti"), nodes)


def drop(frame: DataFrame, requests: DataFrame) -> DataFrame:
    """Catalog or placement without the dropped tables."""
    return frame.join(requests.select("table"), "table", "left_anti")


def add_trps(placement: DataFrame, requests: DataFrame) -> DataFrame:
    """Placement with requested replicas that it lacks; asking twice changes nothing."""
    return placement.select(*_TRP).unionByName(requests.select(*_TRP).distinct().join(placement, _TRP, "left_anti").select(*_TRP))


def remove_trps(placement: DataFrame, requests: DataFrame) -> DataFrame:
    return placement.join(requests.select(*_TRP), _TRP, "left_anti")


def merge_heartbeats(catalog: DataFrame, placement: DataFrame, up: DataFrame) -> DataFrame:
    """Catalog after heartbeats: a table with all its replicas up is NORMAL; each heartbeat of it raises the version."""
    seen = placement.select(*_TRP).join(up.select(*_TRP).distinct(), _TRP, "left_semi").groupBy("table").agg(F.count(F.lit(1)).alias("n_up"))
    n_up, expected = F.coalesce("n_up", F.lit(0)).cast("long"), (F.col("partitions") * F.col("replications")).cast("long")
    return catalog.join(seen, "table", "left").select(
        "table", n_up.alias("up"), expected.alias("expected"), F.when(n_up == expected, "NORMAL").otherwise(F.col("status")).alias("status"), (F.col("version") + F.when(n_up > 0, 1).otherwise(0)).cast("long").alias("version")
    )


def newest(pushes: DataFrame, known: DataFrame) -> DataFrame:
    """Routing by table after pushes (table, version, payload): only strictly newer versions replace what is known."""
    both = known.select("table", "version", "payload", F.lit(1).alias("rank")).unionByName(pushes.select("table", "version", "payload", F.lit(0).alias("rank")))
    return both.groupBy("table").agg(F.max_by("payload", F.struct("version", "rank")).alias("payload"), F.max("version").alias("version"))


def registry(events: DataFrame) -> DataFrame:
    """Endpoints that stay registered after (seq, endpoint, action) events."""
    return events.groupBy("endpoint").agg(F.max_by("action", "seq").alias("action")).where(F.col("action") == "REGISTER").select("endpoint")


def transfer_leader(placement: DataFrame, transfers: DataFrame) -> DataFrame:
    """Placement after transfers (table, partition, to_replica): the leader moves and the partition's term rises by one.

    A transfer to a replica that does not exist changes nothing.
    """
    real = transfers.join(placement.select("table", "partition", F.col("replica").alias("to_replica")), ["table", "partition", "to_replica"], "left_semi")
    moved = placement.join(real, ["table", "partition"], "left")
    hit = F.col("to_replica").isNotNull()
    return moved.select(*_TRP, "node", F.when(hit, F.col("replica") == F.col("to_replica")).otherwise(F.col("is_leader")).alias("is_leader"), (F.col("term") + F.when(hit, 1).otherwise(0)).cast("long").alias("term"))


def migrate(log: DataFrame, moves: DataFrame) -> DataFrame:
    """Entries exported from each moved shard and imported under its target, with a check of the counts."""
    exported = log.join(moves, "shard")
    return exported.groupBy("shard", "target").agg(F.count(F.lit(1)).alias("n_entries"), F.max("idx").alias("last_idx"), (F.count(F.lit(1)) == F.max("idx") - F.min("idx") + 1).alias("complete"))


def progress(reports: DataFrame) -> DataFrame:
    """Latest progress of each migration; one that reached 1 is completed."""
    return reports.groupBy("trp").agg(F.max_by("progress", "seq").alias("progress"), F.bool_or(F.col("progress") >= 1.0).alias("completed"))


def transitions(events: DataFrame) -> DataFrame:
    """Each status of a migration with the one before and whether the step is allowed (the first must be PENDING)."""
    before = F.lag("status").over(Window.partitionBy("trp").orderBy("seq"))
    steps = F.array(*[F.lit(f"{a}>{b}") for a, after in MIGRATION_STEPS.items() for b in after])
    allowed = F.when(F.col("previous").isNull(), F.col("status") == "PENDING").otherwise(F.array_contains(steps, F.concat("previous", F.lit(">"), "status")))
    return events.withColumn("previous", before).withColumn("valid", allowed)


def snapshot_blocks(rows: DataFrame, size: int) -> DataFrame:
    """Texts cut into blocks of `size` characters, each with its number, the number of blocks and a checksum."""
    total = F.ceil(F.length("text") / size).cast("int")
    blocks = rows.where(F.length("text") > 0).select("doc_id", "text", total.alias("total_block"), F.explode(F.sequence(F.lit(0), total - 1)).alias("block_id"))
    return blocks.select("doc_id", "block_id", "total_block", F.sha2(F.col("text").substr(F.col("block_id") * size + 1, F.lit(size)), 256).alias("checksum"))


def checksum(*fields: Column) -> Column:
    """Lower-case SHA-256 over the fields of a metadata record."""
    return F.sha2(F.concat_ws("|", *[f.cast("string") for f in fields]), 256)
