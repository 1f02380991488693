"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder only where that is unset and the driver is the only machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tessera-"))
    return spark.sparkContext.getCheckpointDir()


def stored(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write a frame as Parquet in the shared folder and read it back: its lineage ends there."""
    spark = df.sparkSession
    path = f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def drop(spark: SparkSession, *paths: str) -> None:
    """Delete intermediate tables through the file system that holds them."""
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def least_hashed(rows: DataFrame, column: str, most: int) -> DataFrame:
    """At most `most` rows, those with the least hash of a column (then the least value): a bounded sample that any run repeats.

    Rows are counted first; of many, only those whose hash is below twice the share asked for are ordered, so what tasks
    send to be merged stays bounded however many tasks there are.
    """
    place, whole = F.pmod(F.xxhash64(column), F.lit(1 << 40)), 1 << 40
    total = rows.count()
    if total > 4 * most:
        rows = rows.where(place < int(whole * (2 * most / total)))
    return rows.orderBy(place, column).limit(most)


def carry(docs: DataFrame, keep: list[str], added: list[str]) -> tuple[dict[str, str], list[str]]:
    """Inner names of the columns to keep (without those that added ones replace), so that no name can clash on the way; and added."""
    taken = {x.lower() for x in added}
    return {f"_c{i}": c for i, c in enumerate(keep) if c.lower() not in taken}, added
