"""Queries whose rows pass through Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.plans import fixtures as X
from tessera.plans.cells import _LIVE
from tessera.plans.registry import query
from tessera.sources.shared import shared
from tessera.streaming import ingest


@query(_LIVE)
def stream_upsert(spark: SparkSession, d: str) -> DataFrame:
    """The event log written through micro-batches, then applied: the same cells as the batch path."""
    base = shared(spark, "stream")
    X.evlog(spark, d).write.parquet(f"{base}/in")
    stream = spark.readStream.schema(spark.read.parquet(f"{base}/in").schema).option("maxFilesPerTrigger", 4).parquet(f"{base}/in")
    ingest.append_batches(stream, f"{base}/log", f"{base}/state").awaitTermination()
    applied = ingest.latest(spark.read.parquet(f"{base}/log"))
    return applied.where(F.col("op") != "DELETE").select("key", "col", "value")
