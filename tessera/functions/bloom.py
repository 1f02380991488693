"""A Bloom filter over a string column, built by an aggregation and asked by expressions of the built-in functions.

The bits are one row of longs.  A filter of n keys at rate p has `bloom_size(n, p)` bits and hash functions; bit i of a key
is (h + i * g) modulo the bits, with h and g two 64-bit hashes of it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.codec import bloom_size

_MARK = "\x01"


def _positions(key: Column, bits: int, hashes: int) -> Column:
    h, g = F.pmod(F.xxhash64(key), F.lit(bits)), F.pmod(F.xxhash64(F.concat(key, F.lit(_MARK))), F.lit(bits))
    return F.transform(F.sequence(F.lit(0), F.lit(hashes - 1)), lambda i: F.pmod(h + i * g, F.lit(bits)))


class KeyFilter:
    """Never misses a key that was added; `rate` is the chance that it lets another one through while it has `expected` keys.

    The bits come to the driver, so their number is bounded: `expected` and `rate` fix it, whatever the frame holds.
    """

    def __init__(self, frame: DataFrame, column: str, expected: int = 1_000_000, rate: float = 0.01):
        self.spark: SparkSession = frame.sparkSession
        self.n_bits, self.n_hashes = bloom_size(expected, rate)
        at = frame.where(F.col(column).isNotNull()).select(F.explode(_positions(F.col(column).cast("string"), self.n_bits, self.n_hashes)).alias("at"))
        words = at.groupBy(F.floor(F.col("at") / 64).cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(at % 64 AS INT))")).alias("bits")).toArrow()
        self.words = np.zeros(-(-self.n_bits // 64), np.int64)
        self.words[words["word"].to_numpy()] = words["bits"].to_numpy()

    def _of(self, key: str) -> list[int]:
        h, g = (int(np.int64(np.uint64(xxhash.xxh64_intdigest(text.encode(), 42)))) % self.n_bits for text in (key, key + _MARK))
        return [(h + i * g) % self.n_bits for i in range(self.n_hashes)]

    def might_contain(self, key: str) -> bool:
        return all(int(self.words[at // 64]) >> at % 64 & 1 for at in self._of(key))

    def add(self, key: str) -> None:
        for at in self._of(key):
            self.words[at // 64] |= np.int64(np.uint64(1 << at % 64))

    def merge(self, other: KeyFilter) -> KeyFilter:
        """Keys of both (filters of equal size and rate)."""
        if (self.n_bits, self.n_hashes) != (other.n_bits, other.n_hashes):
            raise ValueError("the filters differ in size")
        self.words |= other.words
        return self

    def passing(self, frame: DataFrame, column: str) -> DataFrame:
        """Rows of frame whose key may have been added (a null never was): asked in the scan's stage, against one broadcast row."""
        bits = self.spark.createDataFrame(pa.table({"_bits": pa.ListArray.from_arrays(pa.array([0, len(self.words)], pa.int32()), pa.array(self.words))}))
        hit = F.forall(_positions(F.col(column), self.n_bits, self.n_hashes), lambda at: F.getbit(F.get("_bits", F.floor(at / 64).cast("int")), F.pmod(at, F.lit(64)).cast("int")) == 1)
        return frame.join(F.broadcast(bits), F.col(column).isNotNull() & hit).drop("_bits")
