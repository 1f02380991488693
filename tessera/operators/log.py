"""The append-only log: dense indexes by shard, strict reads, truncation and checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.ranking import ranked, runs
from tessera.operators.table import bounded


def append(batch: DataFrame, last: DataFrame, order: str, term: int = 1) -> DataFrame:
    """Log rows for a batch: indexes go on from each shard's last one (last: shard, last_idx), in the order of a numeric column."""
    known = ranked(batch, ["shard"], order).join(bounded(last), "shard", "left")
    return known.withColumn("idx", F.coalesce("last_idx", F.lit(0)).cast("long") + F.col("place")).withColumn("term", F.lit(term).cast("long")).drop("last_idx", "place")


def gaps(log: DataFrame, first: int | None = None) -> DataFrame:
    """shard, expected, actual where an index does not follow the one before.

    A log may begin anywhere (a prefix may have been truncated), unless `first` names the index it has to begin at.
    """
    before = F.lag("last").over(Window.partitionBy("shard").orderBy("first"))
    expected = before + 1 if first is None else F.coalesce(before + 1, F.lit(first))
    return runs(log).withColumn("expected", expected.cast("long")).where(F.col("first") != F.col("expected")).select("shard", "expected", F.col("first").alias("actual"))


def contiguous(log: DataFrame, start: int | None = None) -> DataFrame:
    """The entries of each shard from its first index (or from start, if it has that entry) up to its first hole."""
    if start is None:
        kept = runs(log).where(F.col("n") == 1)
    else:
        log = log.where(F.col("idx") >= start)
        kept = runs(log).where(F.col("first") == start)
    return log.join(bounded(kept.select("shard", F.col("last").alias("_last"))), "shard").where(F.col("idx") <= F.col("_last")).drop("_last")


def read_from(log: DataFrame, start: int) -> DataFrame:
    """The entries of each shard from start on, up to the first hole; a shard without the entry at start gives none."""
    if start < 0:
        raise ValueError("start is negative")
    return contiguous(log, start)


def scan(log: DataFrame, start: int, size: int) -> DataFrame:
    """At most size entries of each shard from start on, up to the first hole, with their place from 1.

    Only these entries, `size` for a shard at most, are ordered.
    """
    if start < 0 or size <= 0:
        raise ValueError("start is negative or size not positive")
    place = F.row_number().over(Window.partitionBy("shard").orderBy("idx"))
    return log.where(F.col("idx").between(start, start + size - 1)).withColumn("place", place.cast("long")).where(F.col("idx") - F.col("place") == start - 1)


def point(log: DataFrame, shards: DataFrame, index: int) -> DataFrame:
    """The entry at an index of every shard; a shard without it has term 0 and no command, and has_index false (true for 0)."""
    hit = log.where(F.col("idx") == index).select("shard", "term", "role", F.lit(True).alias("hit"))
    return shards.join(hit, "shard", "left").select(
        "shard", F.lit(index).cast("long").alias("idx"), F.coalesce("term", F.lit(0).cast("long")).alias("term"), "role", (F.coalesce("hit", F.lit(False)) | F.lit(index == 0)).alias("has_index")
    )


def last(log: DataFrame, *values: str, shards: DataFrame | None = None) -> DataFrame:
    """The entry with the greatest index of every shard; of a shard (of those given) without entries index 0, term 0 and no command."""
    found = log.groupBy("shard").agg(F.max("idx").alias("idx"), *[F.max_by(v, "idx").alias(v) for v in values])
    if shards is None:
        return found
    zero = {c: F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("idx", "term")}
    return shards.select("shard").distinct().join(found, "shard", "left").select("shard", *[zero.get(c, F.col(c)) for c in ("idx", *values)])


def truncate_prefix(log: DataFrame, index: int) -> DataFrame:
    """Without the entries up to index."""
    return log.where(F.col("idx") > index)


def truncate_suffix(log: DataFrame, start: int) -> DataFrame:
    """Without the entries from start on."""
    return log.where(F.col("idx") < start)


def extent(log: DataFrame) -> DataFrame:
    return log.groupBy("shard").agg(F.min("idx").alias("first_idx"), F.max("idx").alias("last_idx"), F.count(F.lit(1)).alias("n"))
