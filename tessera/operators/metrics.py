"""Counters of the engine, as aggregations over its log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def memory(log: DataFrame) -> DataFrame:
    """Bytes written to each shard; overwritten cells count again."""
    return log.groupBy("shard").agg(F.sum(F.octet_length("key") + F.octet_length("col") + F.lit(8)).cast("long").alias("bytes"), F.count(F.lit(1)).alias("n_writes"))


def total(by_shard: DataFrame) -> DataFrame:
    return by_shard.agg(F.sum("bytes").cast("long").alias("bytes"))


def counters(log: DataFrame) -> DataFrame:
    """Puts, deletes and distinct cells; the share of writes that hit a cell again is the hit rate of a cache that fits all."""
    return log.agg(
        F.count_if(F.col("op") == "PUT").alias("n_puts"), F.count_if(F.col("op") == "DELETE").alias("n_deletes"), F.count_distinct("key", "col").alias("n_cells"), F.count(F.lit(1)).alias("n_commands"),
    ).withColumn("n_hits", F.col("n_commands") - F.col("n_cells"))


def hottest(log: DataFrame) -> DataFrame:
    """The shard with most commands (the least of several)."""
    counts = log.groupBy("shard").agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.max_by("shard", F.struct("n", (-F.col("shard")).alias("s"))).alias("shard"), F.max("n").alias("n"))


def batches(log: DataFrame, failed: str) -> DataFrame:
    """Outcome of every batch: it succeeds if no command failed; else the first failing index is its error."""
    bad = F.expr(failed)
    return log.groupBy("batch_id").agg((~F.bool_or(bad)).alias("success"), F.min(F.when(bad, F.col("idx"))).alias("first_error"))
