"""Streaming writes: a log of commands becomes cells, by micro-batches or by keyed state."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tessera.model import ADDRESS
from tessera.operators.table import last_write


def latest(stream: DataFrame) -> DataFrame:
    """Newest command of every address of a stream (complete or update mode); deletes stay as tombstones."""
    return last_write(stream, F.col("idx"), "op", "value", "idx")


def append_batches(stream: DataFrame, path: str, checkpoint: str, listener: Callable[[int, DataFrame], None] | None = None, every: str | None = None) -> StreamingQuery:
    """Append a stream to a log by micro-batches.  Each batch has a folder of its own, so a batch that runs again replaces itself.

    listener, if given, is called with (batch_id, entries) after the batch is written; entries is a frame of what was
    written.  every: time between batches, such as "10 seconds"; without it, what is there now is taken and the query ends.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").partitionBy("shard").parquet(f"{path}/batch={batch_id}")
        if listener is not None:
            listener(batch_id, batch.sparkSession.read.parquet(f"{path}/batch={batch_id}"))

    trigger = {"processingTime": every} if every else {"availableNow": True}
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def node_states(heartbeats: DataFrame) -> DataFrame:
    """Newest report of every node of a stream of heartbeats (node, seq, trps: what it serves), in update or complete mode."""
    return heartbeats.groupBy("node").agg(F.max("seq").alias("seq"), F.max_by("trps", "seq").alias("trps"), F.count(F.lit(1)).alias("n_reports"))


class LastWrite(StatefulProcessor):
    """Keeps the newest command of an address in the state store; entries expire by time to live, if it is set."""

    def __init__(self, ttl_ms: int | None = None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.newest = handle.getValueState("newest", "idx long, op string, value string", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        best = self.newest.get() if self.newest.exists() else None
        for part in rows:
            top = part.loc[part["idx"].idxmax()]
            if best is None or top["idx"] > best[0]:
                best = (int(top["idx"]), str(top["op"]), None if pd.isna(top["value"]) else str(top["value"]))
        if best is not None:
            self.newest.update(best)
            yield pd.DataFrame({"family": [key[0]], "key": [key[1]], "col": [key[2]], "idx": [best[0]], "op": [best[1]], "value": [best[2]]})

    def close(self) -> None:
        pass


def stateful(stream: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """Newest command of each address after each micro-batch, from keyed state (RocksDB state store); values are strings, perhaps null."""
    return stream.withColumn("value", F.col("value").cast("string")).groupBy(*ADDRESS).transformWithStateInPandas(
        statefulProcessor=LastWrite(ttl_ms), outputStructType="family string, key string, col string, idx long, op string, value string", outputMode="Update", timeMode="ProcessingTime" if ttl_ms else "None"
    )
