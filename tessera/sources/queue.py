"""A durable topic: messages by partition on the log store, read by groups that commit how far they are."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.hashing import partition_of
from tessera.operators.table import bounded
from tessera.sources.log_store import LogStore


class Topic:
    """Messages with a key stay in order within their partition; a message is read again until its group has committed it."""

    def __init__(self, spark: SparkSession, path: str, partitions: int = 8):
        self.log, self.partitions = LogStore(spark, path), partitions

    def publish(self, messages: DataFrame, order: str) -> int:
        """Append messages (key, body) in the order of a numeric column; returns their number."""
        rows = messages.select(partition_of(F.col("key"), self.partitions).cast("long").alias("shard"), F.to_json(F.struct("key", "body")).alias("command"), order)
        return self.log.append(rows, order)

    def poll(self, group: str, most: int) -> DataFrame:
        """partition, offset, key and body of at most `most` messages of each partition behind what the group has committed."""
        done = self.log.flushed(f"group:{group}")
        rows = self.log.entries().join(bounded(done), "shard", "left").withColumn("mark", F.coalesce("mark", F.lit(0)))
        body = F.from_json("command", "key string, body string")
        fresh = rows.where((F.col("idx") > F.col("mark")) & (F.col("idx") <= F.col("mark") + most))
        return fresh.select(F.col("shard").alias("partition"), F.col("idx").alias("offset"), body.alias("m")).select("partition", "offset", "m.key", "m.body")

    def commit(self, group: str, read: DataFrame) -> None:
        """Everything up to the greatest offset read of each partition is done; partitions are few."""
        for partition, offset in read.groupBy("partition").agg(F.max("offset")).collect():
            self.log._mark(f"group:{group}", partition, offset)
