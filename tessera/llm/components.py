"""Connected components of a distributed edge list, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import drop, stored

SALTS = 16


def _with_least(pairs: DataFrame, least: DataFrame) -> DataFrame:
    """pairs (u, v) with the m of their u, salted by v: a node with very many neighbours is spread over tasks."""
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    salt = F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int")
    return pairs.withColumn("salt", salt).join(least.withColumn("salt", salts).hint("merge"), ["u", "salt"]).select("u", "v", "m")


def _star(pairs: DataFrame) -> DataFrame:
    """pairs (u, v), v a neighbour of u: every v and u itself pointed at the least of u and its neighbours."""
    least = pairs.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    moved = _with_least(pairs, least).select(F.col("v").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).where(F.col("a") != F.col("b")).distinct()


def labels(edges: DataFrame) -> DataFrame:
    """node, label (the least node of its component) for every node of edges (a, b: longs).

    Both steps keep the components and at most the number of edges (and nodes).  They end when every node points at a
    node that points nowhere, as the edge list is then a set of stars.  Each round is cut off as a shared table.
    """
    spark = edges.sparkSession
    now, path = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where(F.col("a") != F.col("b")).distinct(), "edges")
    while True:
        heads = now.select(F.col("b").alias("a")).distinct()
        if now.join(heads, "a", "left_semi").isEmpty() and now.groupBy("a").count().where("count > 1").isEmpty():
            return now.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(heads.select(F.col("a").alias("node"), F.col("a").alias("label")))
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = _with_least(both.where(F.col("v") > F.col("u")), least).select(F.col("v").alias("u"), F.col("m").alias("v")).where(F.col("u") != F.col("v")).distinct()
        after, next_path = stored(_star(large), "edges")
        drop(spark, path)
        now, path = after, next_path
