"""JVM-compatible string and byte hashes as Catalyst expressions.

Wrapping 32-bit arithmetic is done in longs modulo 2**32.  The string hash folds UTF-16 units, as on the JVM: a character
beyond U+FFFF is two of them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_WORD = 1 << 32


def _fold(values: Column, seed: int) -> Column:
    return F.aggregate(values, F.lit(seed).cast("long"), lambda h, x: F.pmod(h * 31 + x, F.lit(_WORD)))


def signed(unsigned: Column) -> Column:
    """A 32-bit word, held unsigned in a long, as the signed value."""
    return F.when(unsigned >= _WORD // 2, unsigned - _WORD).otherwise(unsigned)


def _string_word(text: Column) -> Column:
    def step(h: Column, x: Column) -> Column:
        high, low = 0xD800 + F.shiftright(x - 0x10000, 10), 0xDC00 + x.bitwiseAND(0x3FF)
        return F.pmod(F.when(x > 0xFFFF, F.pmod(h * 31 + high, F.lit(_WORD)) * 31 + low).otherwise(h * 31 + x), F.lit(_WORD))

    points = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    return F.aggregate(points, F.lit(0).cast("long"), step)


def string_hash(text: Column) -> Column:
    """String.hashCode as a long; null hashes to 0."""
    return F.coalesce(signed(_string_word(text)), F.lit(0).cast("long"))


def spread_hash(text: Column) -> Column:
    """h ^ (h >>> 16) over the string hash; null hashes to 0."""
    word = _string_word(text)
    return F.coalesce(signed(word.bitwiseXOR(F.shiftrightunsigned(word, 16))), F.lit(0).cast("long"))


def bytes_hash(text: Column) -> Column:
    """Arrays.hashCode over the UTF-8 bytes."""
    latin = F.decode(F.encode(text, "UTF-8"), "ISO-8859-1")
    values = F.transform(F.filter(F.split(latin, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    return signed(_fold(F.transform(values, lambda b: F.when(b > 127, b - 256).otherwise(b)), 1))


def partition_of(text: Column, partitions: Column | int) -> Column:
    """Partition of a shard key: never negative, whatever the sign of the hash."""
    return F.pmod(spread_hash(text), F.lit(partitions) if isinstance(partitions, int) else partitions).cast("int")


def memory_shard(family: Column, key: Column, shards: int) -> Column:
    """Shard of a row: the column is left out, so all cells of a row share it."""
    h = bytes_hash(F.concat_ws("#", family, key))
    return F.pmod(F.abs(h), F.lit(shards)).cast("int")


def encoded_shard(encoded: Column, shards: int) -> Column:
    """Shard of a cell by its whole encoded key, column included: the cells of a row may lie apart."""
    return F.pmod(F.abs(bytes_hash(encoded)), F.lit(shards)).cast("int")


def string_hash_literal(text: str) -> int:
    """The string hash of a Python literal, to inject shard predicates that prune partitions."""
    h, units = 0, text.encode("utf-16-be")
    for at in range(0, len(units), 2):
        h = (h * 31 + int.from_bytes(units[at : at + 2])) % _WORD
    return h - _WORD if h >= _WORD // 2 else h


def bytes_hash_literal(text: str) -> int:
    h = 1
    for b in text.encode():
        h = (h * 31 + (b - 256 if b > 127 else b)) % _WORD
    return h - _WORD if h >= _WORD // 2 else h


def memory_shard_literal(family: str, key: str, shards: int) -> int:
    return abs(bytes_hash_literal(f"{family}#{key}")) % shards
