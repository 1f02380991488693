"""A bitmap over 64-bit keys: a filter before a shuffle, never a verdict.

The bitmap holds a bit for each key's hash.  Keys are counted first and get eight bits each, up to 2**`LOG2_MOST` bits
(16 MB), so it can always be broadcast; of more keys than that it only lets more rows through.  What passes is joined
exactly later.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import drop, stored

LOG2_LEAST = 16
LOG2_MOST = 27


def table(keys: DataFrame, column: str, most: int = LOG2_MOST) -> np.ndarray:
    """Bitmap (as longs) of a long column whose values are spread evenly; nulls are left out."""
    spark = keys.sparkSession
    held, path = stored(keys.select(F.col(column).alias("key")).where(F.col("key").isNotNull()), "sieve")
    log2 = min(most, max(LOG2_LEAST, (8 * held.count()).bit_length()))
    word = F.floor(F.pmod("key", F.lit(1 << log2)) / 64).cast("int")
    words = held.select(word.alias("word"), F.expr("shiftleft(1L, CAST(pmod(key, 64) AS INT))").alias("bits")).groupBy("word").agg(F.bit_or("bits").alias("bits"))
    found = words.toArrow()
    bits = np.zeros(1 << (log2 - 6), np.int64)
    bits[found["word"].to_numpy()] = found["bits"].to_numpy()
    drop(spark, path)
    return bits


def build(keys: DataFrame, column: str, most: int = LOG2_MOST) -> Broadcast:
    """Broadcast bitmap, for `passes` in Python workers."""
    return keys.sparkSession.sparkContext.broadcast(table(keys, column, most).view(np.uint64))


def passes(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which of the (signed or unsigned) 64-bit keys may be in the bitmap."""
    bit = keys.view(np.uint64) & np.uint64(64 * len(table) - 1)
    return (table[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1) == 1


def without(docs: DataFrame, key: Column, gone: DataFrame) -> DataFrame:
    """Rows of docs whose key (a well-spread long, perhaps null) is not in gone (one long column), without a shuffle of the others.

    Rows that do not pass the bitmap stay as they are; only those that pass it are joined.  The bitmap is one broadcast row.
    """
    spark, columns, name = docs.sparkSession, docs.columns, gone.columns[0]
    own, held = (next(f"{x}{i}" for i in range(len(columns) + 1) if f"{x}{i}" not in columns) for x in ("_key", "_bits"))
    bits = table(gone, name)
    one = spark.createDataFrame(pa.table({held: pa.ListArray.from_arrays(pa.array([0, len(bits)], pa.int32()), pa.array(bits))}))
    bit = F.pmod(F.col(own), F.lit(64 * len(bits)))
    hit = F.coalesce(F.getbit(F.get(F.col(held), F.shiftright(bit, 6).cast("int")), F.pmod(bit, F.lit(64)).cast("int")) == 1, F.lit(False))
    marked = docs.withColumn(own, key)
    maybe = marked.join(F.broadcast(one), hit).select(*columns, own).join(gone.select(F.col(name).alias(own)), own, "left_anti")
    return marked.join(F.broadcast(one), ~hit).select(*columns).unionByName(maybe.select(*columns))
