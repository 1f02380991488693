"""Snapshot and log: compaction, replay, caches, expiry and change feeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.model import ADDRESS
from tessera.operators.ranking import ranked, running
from tessera.operators.table import last_write


def compact(log: DataFrame, upto: Column) -> DataFrame:
    """Newest state (with tombstones) of the log entries up to a mark: the snapshot that a flush writes."""
    return last_write(log.where(upto), F.col("idx"), "op", "value", "idx").drop("version_count")


def replay(snapshot: DataFrame, tail: DataFrame) -> DataFrame:
    """Live cells of a snapshot with the later log entries applied; an empty tail is the snapshot itself."""
    columns = [*ADDRESS, "op", "value", "idx"]
    merged = last_write(snapshot.select(*columns).unionByName(tail.select(*columns)), F.col("idx"), "op", "value")
    return merged.where(F.col("op") != "DELETE").drop("op", "version_count")


def flush_marks(log: DataFrame, every: int) -> DataFrame:
    """shard, mark and last_idx: the mark is the index of the last entry of the last full group of `every` entries (0: none)."""
    full = F.when(F.col("place") % every == 0, F.col("idx"))
    return ranked(log, ["shard"], "idx").groupBy("shard").agg(F.coalesce(F.max(full), F.lit(0).cast("long")).alias("mark"), F.max("idx").alias("last_idx"))


def weight(key_bytes: Column, value_bytes: Column) -> Column:
    """Bytes of a cache entry: both sides with a header of 16, rounded up to 8."""
    return (F.floor((16 + key_bytes + 16 + F.coalesce(value_bytes, F.lit(0)) + 7) / 8) * 8).cast("long")


def least_recent(accesses: DataFrame, budget: int, size: Column, by: list[str]) -> DataFrame:
    """Entries of each shard by last access (their indexes are distinct), newest first, with their running size and whether they fit the budget."""
    entries = accesses.groupBy("shard", *by).agg(F.max("idx").alias("last_access"), F.max(size).alias("bytes"))
    summed = running(entries, ["shard"], "last_access", "bytes", "running", descending=True)
    return summed.withColumn("running", F.col("running").cast("long")).withColumn("kept", F.col("running") <= budget)


def most_recent(accesses: DataFrame, capacity: int, by: list[str]) -> DataFrame:
    """The entries of each shard that a cache of `capacity` entries holds after all accesses (their indexes are distinct)."""
    return ranked(accesses.groupBy("shard", *by).agg(F.max("idx").alias("last_access")), ["shard"], "last_access", descending=True, most=capacity)


def unexpired(entries: DataFrame, now: Column, since: Column, seconds: int) -> DataFrame:
    """Entries not older than a number of seconds at a time."""
    return entries.where(now <= since + F.expr(f"INTERVAL {seconds} SECONDS"))


def ring_tail(log: DataFrame, size: int) -> DataFrame:
    """What a ring of `size` slots holds of each shard: the last size - 1 entries."""
    return ranked(log, ["shard"], "idx", descending=True, most=size - 1).drop("place")


def changes(log: DataFrame) -> DataFrame:
    """Every entry with the value that it replaces."""
    before = F.lag("value").over(Window.partitionBy(*ADDRESS).orderBy("idx"))
    return log.withColumn("old_value", before).withColumnRenamed("value", "new_value")
