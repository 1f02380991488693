"""Numbered folders of Parquet files below a path: each counts once its success marker exists."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


class Folders:
    """Access through the file system of the path, so that any store which Spark reads will do.

    A folder is named `part_of=KIND/write=NUMBER-UNIQUE`, so that Spark takes folders of all kinds as one partitioned table.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _at(self, name: str):  # noqa: ANN202
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def exists(self, name: str) -> bool:
        files, where = self._at(name)
        return files.exists(where)

    def finished(self, kind: str) -> list[tuple[int, str]]:
        """(number, folder) of every finished folder of a kind, in order."""
        files, where = self._at(f"part_of={kind}")
        names = [s.getPath().getName() for s in files.listStatus(where)] if files.exists(where) else []
        done = [name for name in names if self.exists(f"part_of={kind}/{name}/_SUCCESS")]
        return sorted((int(name.removeprefix("write=").split("-")[0]), f"{self.path}/part_of={kind}/{name}") for name in done)

    def last(self, kind: str) -> int:
        return max([0, *(n for n, _ in self.finished(kind))])

    def write(self, rows: DataFrame, kind: str, number: int, by: str | None = None, records_per_file: int = 0) -> None:
        writer = rows.write.option("maxRecordsPerFile", records_per_file)
        (writer.partitionBy(by) if by else writer).parquet(f"{self.path}/part_of={kind}/write={number:019d}-{uuid.uuid4().hex}")

    def read(self, folders: list[str], schema: str) -> DataFrame:
        """All rows of folders that may be partitioned by different values; without folders an empty frame."""
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", self.path).parquet(*folders).select(*StructType.fromDDL(schema).names)

    def delete(self, folders: list[str]) -> None:
        for folder in folders:
            files, where = self._at(folder.removeprefix(f"{self.path}/"))
            files.delete(where, True)
