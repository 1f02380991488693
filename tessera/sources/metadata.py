"""Durable records of the control plane: tables, nodes, replicas and migrations, by key with prefix lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.store import CellStore

#: Where each kind of record lives.
PREFIXES = {"table": "pd/table/", "trp": "pd/trp/", "node": "pd/node/", "migration": "pd/migration/"}


class MetaStore:
    """Records (a JSON text for each kind and name) as cells; a later save replaces an earlier one."""

    def __init__(self, spark: SparkSession, path: str):
        self.store = CellStore(spark, path, shards=4)

    def _cells(self, kind: str, records: DataFrame, value: str | None) -> DataFrame:
        held = F.lit(None).cast("string") if value is None else F.col(value)
        return records.select(F.lit("meta").alias("family"), F.concat(F.lit(PREFIXES[kind]), "name").alias("key"), F.lit("record").alias("col"), held.alias("value"))

    def save(self, kind: str, records: DataFrame) -> None:
        """records: name and record (a JSON text)."""
        self.store.put(self._cells(kind, records, "record"))

    def remove(self, kind: str, names: DataFrame) -> None:
        self.store.delete(self._cells(kind, names, None))

    def get(self, kind: str, name: str) -> str | None:
        return self.store.get("meta", PREFIXES[kind] + name, "record")[1]

    def list(self, kind: str, prefix: str = "") -> DataFrame:
        """name and record of every record of a kind whose name begins with a prefix."""
        whole = PREFIXES[kind] + prefix
        found = self.store.cells().where(F.col("key").startswith(whole))
        return found.select(F.substring("key", len(PREFIXES[kind]) + 1, 1 << 30).alias("name"), F.col("value").alias("record"))
