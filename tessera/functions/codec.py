"""Encodings of cells, addresses and numbers."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def json_text(value: Column) -> Column:
    """The JSON text of any value; null is the literal null, so a stored null differs from a missing cell."""
    wrapped = F.to_json(F.struct(value.alias("v")))
    return F.when(value.isNull(), "null").otherwise(wrapped.substr(F.lit(6), F.length(wrapped) - 6))


def cell_key(family: Column, key: Column, col: Column) -> Column:
    """The quoted, escaped text of family#key#column."""
    return json_text(F.concat_ws("#", family, key, col))


def trp(table: Column, replica: Column, partition: Column) -> Column:
    return F.concat_ws("_", table, replica.cast("string"), partition.cast("string"))


def parse_trp(text: Column) -> Column:
    """table, replica, partition, read from the right, so a table name may hold underscores."""
    part = lambda i: F.regexp_extract(text, r"^(.*)_(\d+)_(\d+)$", i)
    return F.struct(part(1).alias("table"), part(2).cast("int").alias("replica"), part(3).cast("int").alias("partition"))


def endpoint(text: Column) -> Column:
    """ip and port of ip:port."""
    return F.struct(F.substring_index(text, ":", 1).alias("ip"), F.substring_index(text, ":", -1).cast("int").alias("port"))


def long_bytes(value: Column) -> Column:
    """Eight little-endian bytes, in hex.  Their order is not numeric order, so logs keep the number itself."""
    digits = F.lpad(F.hex(value), 16, "0")
    return F.concat(*[F.substring(digits, 15 - 2 * i, 2) for i in range(8)])


def bloom_size(n: int, p: float) -> tuple[int, int]:
    """Bits and hash functions of a Bloom filter for n keys at a false-positive rate p."""
    m = int(-n * math.log(p) / math.log(2) ** 2)
    return m, max(1, round(m / n * math.log(2)))


def power_of_two(value: Column) -> Column:
    """The least power of two that is not below a positive number."""
    return F.pow(F.lit(2.0), F.ceil(F.log2(value.cast("double")))).cast("long")


def envelope(failed: Column, code: Column, message: Column) -> Column:
    """success, code, msg of a result."""
    return F.struct((~failed).alias("success"), F.when(failed, code).otherwise(F.lit(0)).alias("code"), F.when(failed, message).otherwise("success").alias("msg"))
