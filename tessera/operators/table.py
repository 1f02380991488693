"""Cell access: reads, writes, deletes and views over a set of cells or commands.

State is what the last write says: commands carry an order (`seq`), a delete is a command like any other, and the
newest command of an address decides.  All functions are lazy plans over DataFrames.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.model import ADDRESS

#: Request lists up to this many rows are broadcast; longer ones are joined by shuffle.
MAX_BROADCAST = 100_000


def bounded(frame: DataFrame, most: int = MAX_BROADCAST) -> DataFrame:
    """A broadcast hint where a frame is shown to have at most `most` rows, else the frame."""
    return F.broadcast(frame) if frame.limit(most + 1).count() <= most else frame


def get(cells: DataFrame, family: str, key: str, col: str) -> DataFrame:
    """One row: key, col, value, found.  A stored null is found with a null value."""
    hit = cells.where((F.col("family") == family) & (F.col("key") == key) & (F.col("col") == col))
    return hit.agg(F.max("value").alias("value"), (F.count(F.lit(1)) > 0).alias("found")).select(F.lit(key).alias("key"), F.lit(col).alias("col"), "value", "found")


def multi_get(cells: DataFrame, keys: DataFrame) -> DataFrame:
    """Every requested key (ord, key) with its cells, in no order but with the ordinal; missing keys give one row.

    The cells are first cut down to the requested keys, by broadcast where keys carries the hint, so only hits move.
    """
    rows = cells.join(keys.select("key"), "key", "left_semi").select("key", "col", "value", F.lit(True).alias("hit"))
    return keys.join(rows, "key", "left").select("ord", "key", "col", "value", F.coalesce("hit", F.lit(False)).alias("found"))


def all_found(requests: DataFrame, cells: DataFrame) -> DataFrame:
    """For each batch of requests (batch_id, key, col): rows, rows found, and whether all were."""
    stored = cells.join(requests.select("key", "col"), ["key", "col"], "left_semi").select("key", "col", F.lit(True).alias("hit")).distinct()
    seen = requests.join(stored, ["key", "col"], "left").select("batch_id", F.coalesce("hit", F.lit(False)).alias("found"))
    return seen.groupBy("batch_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("found").alias("n_found"), F.bool_and("found").alias("all_found"))


def last_write(commands: DataFrame, order: Column, *values: str, by: list[str] | None = None) -> DataFrame:
    """The values of the newest command of every address; aggregated before the shuffle."""
    newest = F.max_by(F.struct(*values), order).alias("_newest")
    return commands.groupBy(*(by or ADDRESS)).agg(newest, F.count(F.lit(1)).alias("version_count")).select(*(by or ADDRESS), "_newest.*", "version_count")


def upsert(cells: DataFrame, updates: DataFrame) -> DataFrame:
    """Cells after a batch of newer cells."""
    log = cells.select(*ADDRESS, "value", F.lit(0).alias("seq")).unionByName(updates.select(*ADDRESS, "value", F.lit(1).alias("seq")))
    return last_write(log, F.col("seq"), "value").drop("version_count")


def apply(commands: DataFrame, order: Column) -> DataFrame:
    """Live cells of a command log: the newest command of an address, unless it deletes."""
    return last_write(commands, order, "op", "value").where(F.col("op") != "DELETE").drop("op", "version_count")


def dispatch(commands: DataFrame, order: Column) -> DataFrame:
    """Outcome of each address: last operation, whether it is live, and the puts and deletes seen."""
    return commands.groupBy(*ADDRESS).agg(
        F.max_by("op", order).alias("last_op"), F.count_if(F.col("op") == "PUT").alias("n_puts"), F.count_if(F.col("op") == "DELETE").alias("n_deletes")
    ).withColumn("live", F.col("last_op") != "DELETE")


def delete_keys(cells: DataFrame, keys: DataFrame) -> DataFrame:
    """Cells whose key is not in a list of keys."""
    return cells.join(keys.select("key"), "key", "left_anti")


def wide(cells: DataFrame, columns: list[str]) -> DataFrame:
    """One row for each (family, key), one column for each named column."""
    return cells.groupBy("family", "key").pivot("col", columns).agg(F.first("value"))


def ordered(cells: DataFrame, shard: Column, encoded: Column) -> DataFrame:
    """Rank of each cell in the key order of its shard."""
    from pyspark.sql import Window

    return cells.withColumn("shard", shard).withColumn("encoded", encoded).withColumn("rank", F.row_number().over(Window.partitionBy("shard").orderBy("encoded")).cast("long"))


def by_shard(commands: DataFrame, shard: str = "shard") -> DataFrame:
    """What one batched write sends to each shard: rows, distinct rows of the table, bytes."""
    return commands.groupBy(shard).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("key").alias("n_keys"), F.sum(F.octet_length("key") + F.octet_length("col")).cast("long").alias("bytes")
    )
