"""One entry to a table that is cut into partitions: routes addresses to the store of their partition, then reads or writes there."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import routing
from tessera.functions.hashing import partition_of
from tessera.model import ADDRESS
from tessera.sources.store import CellStore


class TableClient:
    """Partition of a cell: the hash of its shard key (by a declared strategy) modulo the partitions.

    endpoints: the folder that serves each partition, in the order of partitions.
    """

    def __init__(self, spark: SparkSession, table: str, endpoints: list[str], strategy: str = "row_key", shards: int = 16):
        self.spark, self.table, self.endpoints, self.shards = spark, table, endpoints, shards
        self.strategy, self._stores = routing.parse(strategy), {}

    def partition(self, key: Column, family: Column, col: Column) -> Column:
        return partition_of(self.strategy(F.lit(self.table), key, family, col), len(self.endpoints))

    def store(self, partition: int) -> CellStore:
        if partition not in self._stores:
            self._stores[partition] = CellStore(self.spark, f"{self.endpoints[partition]}/{self.table}/{partition}", self.shards)
        return self._stores[partition]

    def _parts(self, cells: DataFrame) -> list[tuple[CellStore, DataFrame]]:
        routed = cells.withColumn("_partition", self.partition(F.col("key"), F.col("family"), F.col("col")))
        present = sorted(r[0] for r in routed.select("_partition").distinct().collect())
        return [(self.store(p), routed.where(F.col("_partition") == p).drop("_partition")) for p in present]

    def put(self, cells: DataFrame, order: str | None = None) -> None:
        for store, part in self._parts(cells):
            store.put(part, order)

    def delete(self, addresses: DataFrame) -> None:
        for store, part in self._parts(addresses.select(*ADDRESS)):
            store.delete(part)

    def get(self, family: str, key: str, col: str) -> tuple[bool, str | None]:
        place = self.spark.range(1).select(self.partition(F.lit(key), F.lit(family), F.lit(col))).first()[0]
        return self.store(place).get(family, key, col)

    def get_many(self, requests: DataFrame) -> DataFrame:
        """ord, family, key, col, value and found of every request (ord, family, key, col)."""
        found = [store.get_many(part) for store, part in self._parts(requests.select("ord", *ADDRESS))]
        none = requests.select("ord", *ADDRESS, F.lit(None).cast("string").alias("value"), F.lit(False).alias("found")).limit(0)
        return reduce(DataFrame.unionByName, found, none)
