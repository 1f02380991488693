"""A durable cell table on a file system: a log of parquet folders, snapshots, and reads that prune by shard."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.bloom import KeyFilter
from tessera.functions.hashing import memory_shard, memory_shard_literal
from tessera.model import ADDRESS
from tessera.operators import lsm
from tessera.operators.table import bounded, last_write
from tessera.sources.folders import Folders

_ROW = "family string, key string, col string, value string, op string, idx long, shard int"


def _row_key(family, key):  # noqa: ANN001, ANN202
    return F.concat_ws("#", family, key)


class CellStore:
    """Cells below one path, written by one writer at a time.

    Each write is a folder of the log, numbered by its last index and partitioned by shard; a compaction writes the state as
    a snapshot, numbered by the last index it holds, and deletes what it covers.  A folder counts once its
    success marker exists.  `counters` has the reads, those that found a cell, and those that the Bloom filter answered.
    """

    def __init__(self, spark: SparkSession, path: str, shards: int = 16):
        self.spark, self.folders = spark, Folders(spark, path)
        self.path, self.counters, self.filter = self.folders.path, Counter(), None
        if not self.folders.exists("meta/_SUCCESS"):
            spark.createDataFrame([(shards,)], "shards int").coalesce(1).write.parquet(f"{self.path}/meta")
        elif (found := spark.read.schema("shards int").parquet(f"{self.path}/meta").first()[0]) != shards:
            raise ValueError(f"the table has {found} shards; re-shard it explicitly")
        self.shards = shards

    def last_index(self) -> int:
        return max(self.folders.last("log"), self.folders.last("snapshot"))

    def _write(self, rows: DataFrame) -> int:
        """Append rows (family, key, col, value, op, place) in the order of place; returns the last index (an empty batch changes nothing)."""
        base = self.last_index()
        total, n, n_addresses = rows.agg(F.max("place"), F.count(F.lit(1)), F.count_distinct(F.struct(*ADDRESS, "place"))).first()
        if total is None:
            return base
        if n != n_addresses:
            raise ValueError("an address occurs twice at one place of the batch; give an order")
        indexed = rows.withColumn("idx", F.lit(base).cast("long") + F.col("place")).withColumn("shard", memory_shard(F.col("family"), F.col("key"), self.shards))
        last = base + int(total)
        self.folders.write(indexed.select(*ADDRESS, "value", "op", "idx", "shard").repartition("shard"), "log", last, by="shard")
        if self.filter is not None:
            self.filter.merge(KeyFilter(rows.select(_row_key("family", "key").alias("k")), "k", *self._filter_size))
        return last

    def put(self, cells: DataFrame, order: str | None = None) -> int:
        """Write cells (family, key, col, value).

        order: a column of positive longs that ranks the cells of an address.  Without it the batch is one point in the
        order, and an address that occurs twice is an error.
        """
        place = F.col(order).cast("long") if order else F.lit(1).cast("long")
        return self._write(cells.select(*ADDRESS, "value", F.lit("PUT").alias("op"), place.alias("place")))

    def delete(self, addresses: DataFrame) -> int:
        """Write tombstones for addresses (family, key, col)."""
        gone = addresses.select(*ADDRESS).distinct()
        return self._write(gone.select(*ADDRESS, F.lit(None).cast("string").alias("value"), F.lit("DELETE").alias("op"), F.lit(1).cast("long").alias("place")))

    def log(self) -> DataFrame:
        """Snapshot and later log entries, as one frame; empty for a new table."""
        snapshots = self.folders.finished("snapshot")[-1:]
        mark = snapshots[0][0] if snapshots else 0
        parts = [f for _, f in snapshots], [f for i, f in self.folders.finished("log") if i > mark]
        return self.folders.read([*parts[0], *parts[1]], _ROW)

    def cells(self) -> DataFrame:
        """Live cells."""
        log = self.log()
        return lsm.replay(log.limit(0), log)

    def use_filter(self, expected: int = 1_000_000, rate: float = 0.01) -> None:
        """From now on reads ask a Bloom filter of all rows first; writes add to it."""
        self._filter_size = (expected, rate)
        self.filter = KeyFilter(self.log().select(_row_key("family", "key").alias("k")), "k", expected, rate)

    def get(self, family: str, key: str, col: str) -> tuple[bool, str | None]:
        """Whether a cell exists, and its value; reads one shard's folders only, and none for a row that the filter does not know."""
        self.counters["reads"] += 1
        if self.filter is not None and not self.filter.might_contain(f"{family}#{key}"):
            self.counters["filtered"] += 1
            return False, None
        shard = memory_shard_literal(family, key, self.shards)
        rows = self.log().where((F.col("shard") == shard) & (F.col("family") == family) & (F.col("key") == key) & (F.col("col") == col))
        found = last_write(rows, F.col("idx"), "op", "value").where(F.col("op") != "DELETE").select("value").head(1)
        self.counters["found"] += len(found)
        return bool(found), found[0][0] if found else None

    def get_many(self, requests: DataFrame) -> DataFrame:
        """ord, family, key, col, value and found of every request (ord, family, key, col).

        Only the folders of the requested shards are read, and only the requested rows leave their scan.
        """
        self.counters["batch_reads"] += 1
        asked = requests.select("ord", *ADDRESS)
        shards = [r[0] for r in asked.select(memory_shard(F.col("family"), F.col("key"), self.shards)).distinct().collect()]
        likely = asked if self.filter is None else self.filter.passing(asked.withColumn("_k", _row_key("family", "key")), "_k").drop("_k")
        rows = self.log().where(F.col("shard").isin(shards)).join(bounded(likely.select(*ADDRESS).distinct()), ADDRESS, "left_semi")
        live = last_write(rows, F.col("idx"), "op", "value").where(F.col("op") != "DELETE").select(*ADDRESS, "value", F.lit(True).alias("hit"))
        return asked.join(live, ADDRESS, "left").select("ord", *ADDRESS, "value", F.coalesce("hit", F.lit(False)).alias("found"))

    def compact(self, records_per_file: int = 0) -> int:
        """Write the state up to now as a snapshot, in files of at most so many records (0: any), and delete what it covers."""
        last = self.last_index()
        state = last_write(self.log(), F.col("idx"), "op", "value", "idx", by=[*ADDRESS, "shard"]).where(F.col("op") != "DELETE").drop("version_count")
        self.folders.write(state.select(*ADDRESS, "value", "op", "idx", "shard"), "snapshot", last, by="shard", records_per_file=records_per_file)
        snapshots = self.folders.finished("snapshot")
        self.folders.delete([f for i, f in self.folders.finished("log") if i <= last] + [f for _, f in snapshots[:-1]])
        return last

    def export(self, shards: list[int]) -> DataFrame:
        """Live cells of some shards."""
        rows = self.log().where(F.col("shard").isin(shards))
        return last_write(rows, F.col("idx"), "op", "value").where(F.col("op") != "DELETE").select(*ADDRESS, "value")


def fingerprint(cells: DataFrame) -> tuple[int, int]:
    """Number of cells and a sum over their hashes that no order changes."""
    h = F.pmod(F.xxhash64(*ADDRESS, "value", F.col("value").isNull()), F.lit(1 << 40))
    n, total = cells.agg(F.count(F.lit(1)), F.coalesce(F.sum(h), F.lit(0))).first()
    return n, total


def move_shards(source: CellStore, target: CellStore, shards: list[int]) -> str:
    """Copy shards to another store and delete them in the first: COMPLETED, or ROLLBACK if what arrived differs.

    The import is checked before anything is deleted.  After a rollback the target has none of the cells, and a move may be
    tried again; a move that died between the two steps is finished by the next one, as both are idempotent.
    """
    moved = source.export(shards)
    expected = fingerprint(moved)
    target.put(moved)
    arrived = target.cells().select(*ADDRESS, "value").join(bounded(moved.select(*ADDRESS)), ADDRESS, "left_semi")
    if fingerprint(arrived) != expected:
        target.delete(moved)
        return "ROLLBACK"
    source.delete(moved)
    return "COMPLETED"
