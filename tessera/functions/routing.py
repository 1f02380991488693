"""Shard-key strategies: a registry of functions from the address columns to the shard key."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Strategy = Callable[[Column, Column, Column, Column], Column]
STRATEGIES: dict[str, Callable[..., Strategy]] = {}


def register(name: str) -> Callable:
    def keep(make: Callable[..., Strategy]) -> Callable[..., Strategy]:
        STRATEGIES[name] = make
        return make

    return keep


@register("row_key")
def row_key() -> Strategy:
    return lambda table, key, family, col: key


@register("full_key")
def full_key() -> Strategy:
    """table#key#family#column, with the word null for a missing part."""
    return lambda *parts: F.concat_ws("#", *[F.coalesce(p, F.lit("null")) for p in parts])


@register("brace")
def brace() -> Strategy:
    """What stands in the first pair of braces (possibly nothing), else the whole key."""
    return lambda table, key, family, col: F.when(key.rlike(r"\{.*?\}"), F.regexp_extract(key, r"\{(.*?)\}", 1)).otherwise(key)


@register("colon")
def colon() -> Strategy:
    """What follows the last colon (possibly nothing), else the whole key."""
    return lambda table, key, family, col: F.substring_index(key, ":", -1)


@register("prefix")
def prefix(parts: int = 2) -> Strategy:
    """The first parts of a key between colons."""
    return lambda table, key, family, col: F.substring_index(key, ":", parts)


@register("regex")
def regex(pattern: str) -> Strategy:
    """The first group of a pattern, else the whole key."""
    return lambda table, key, family, col: F.when(key.rlike(pattern), F.regexp_extract(key, pattern, 1)).otherwise(key)


@register("composite")
def composite(*strategies: Strategy) -> Strategy:
    """The first strategy with a result that is neither null nor empty, else the row key."""
    return lambda table, key, family, col: F.coalesce(*[F.nullif(s(table, key, family, col), F.lit("")) for s in strategies], key)


def parse(text: str) -> Strategy:
    """A strategy from its declaration: full_key, row_key, brace, colon, prefix:N or regex:PATTERN."""
    name, _, argument = text.partition(":")
    if name == "prefix":
        return prefix(int(argument))
    if name == "regex":
        return regex(argument)
    return STRATEGIES[name]()
