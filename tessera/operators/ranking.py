"""Ranks and boundaries of long ordered sequences without one task for each sequence."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 1 << 16


def ranked(frame: DataFrame, by: list[str], order: str, descending: bool = False, most: int | None = None, block: int = BLOCK) -> DataFrame:
    """frame with place: the rank (from 1) of each row in its group by a numeric column; with most, only the first ranks.

    Groups are cut into blocks of `block` values of the order.  Rows are counted by block, and a row's place is the number
    of rows in the blocks before plus its place in its own, so a group is spread over tasks.  Blocks that begin behind
    `most` drop out before they are sorted.  Rows of equal order have places in no defined order.
    """
    cut = F.floor(F.col(order) / block)
    turn = (lambda c: F.desc(c)) if descending else (lambda c: F.asc(c))
    before = F.sum("_n").over(Window.partitionBy(*by).orderBy(turn("_block")).rowsBetween(Window.unboundedPreceding, -1))
    blocks = frame.groupBy(*by, cut.alias("_block")).agg(F.count(F.lit(1)).alias("_n")).withColumn("_before", F.coalesce(before, F.lit(0))).drop("_n")
    if most is not None:
        blocks = blocks.where(F.col("_before") < most)
    inside = F.row_number().over(Window.partitionBy(*by, "_block").orderBy(turn(order)))
    placed = frame.withColumn("_block", cut).join(blocks, [*by, "_block"]).withColumn("place", (F.col("_before") + inside).cast("long")).drop("_block", "_before")
    return placed if most is None else placed.where(F.col("place") <= most)


def runs(log: DataFrame) -> DataFrame:
    """shard, first, last and n (from 1) of each maximal run of consecutive indexes.

    Entries without a neighbour are found by joins on (shard, idx); only these are ordered by shard.
    """
    ids = log.select("shard", "idx").distinct()
    begins = ids.join(ids.select("shard", (F.col("idx") + 1).alias("idx")), ["shard", "idx"], "left_anti")
    ends = ids.join(ids.select("shard", (F.col("idx") - 1).alias("idx")), ["shard", "idx"], "left_anti")
    n = F.row_number().over(Window.partitionBy("shard").orderBy("idx"))
    return begins.select("shard", F.col("idx").alias("first"), n.alias("n")).join(ends.select("shard", F.col("idx").alias("last"), n.alias("n")), ["shard", "n"])


def running(frame: DataFrame, by: list[str], order: str, value: str, name: str, how: str = "sum", descending: bool = False, block: int = BLOCK) -> DataFrame:
    """frame with the running sum (or max) of a column in each group, in a numeric order of distinct values; by blocks as in `ranked`."""
    fold = {"sum": F.sum, "max": F.max}[how]
    cut, turn = F.floor(F.col(order) / block), F.desc if descending else F.asc
    before = fold("_t").over(Window.partitionBy(*by).orderBy(turn("_block")).rowsBetween(Window.unboundedPreceding, -1))
    blocks = frame.groupBy(*by, cut.alias("_block")).agg(fold(value).alias("_t")).withColumn("_before", before).drop("_t")
    inside = fold(value).over(Window.partitionBy(*by, "_block").orderBy(turn(order)).rowsBetween(Window.unboundedPreceding, 0))
    total = F.coalesce("_before", F.lit(0)) + inside if how == "sum" else F.greatest("_before", inside)
    return frame.withColumn("_block", cut).join(blocks, [*by, "_block"]).withColumn(name, total).drop("_block", "_before")
