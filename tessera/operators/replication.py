"""Leader to follower: what to send next, how much at once, and what is committed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.ranking import running


def next_batch(followers: DataFrame, log: DataFrame, interval: int) -> DataFrame:
    """Entries to send to each follower: from `next` on, at most interval of them; none if it has all."""
    last = log.groupBy("shard").agg(F.max("idx").alias("last_idx"))
    upto = F.least(F.col("next") + interval - 1, F.col("last_idx"))
    return followers.join(last, "shard").where(F.col("next") <= F.col("last_idx")).select("shard", "follower", F.col("next").alias("from_idx"), upto.alias("to_idx"), (upto - F.col("next") + 1).alias("n"))


def append_requests(followers: DataFrame, log: DataFrame, interval: int) -> DataFrame:
    """One request for each follower that lacks entries: previous index and term (0: none), and its entries in order."""
    before = log.select("shard", F.col("idx").alias("prev_idx"), F.col("term").alias("prev_term"))
    due = followers.join(log, "shard").where(F.col("idx").between(F.col("next"), F.col("next") + interval - 1))
    packed = due.groupBy("shard", "follower", F.col("match").alias("prev_idx")).agg(F.array_sort(F.collect_list(F.struct("idx", "term", "role"))).alias("entries"))
    return packed.join(before, ["shard", "prev_idx"], "left").withColumn("prev_term", F.coalesce("prev_term", F.lit(0).cast("long")))


def lag(followers: DataFrame, log: DataFrame) -> DataFrame:
    last = log.groupBy("shard").agg(F.max("idx").alias("last_idx"))
    return followers.join(last, "shard").select("shard", "follower", F.greatest(F.col("last_idx") - F.col("match"), F.lit(0)).cast("long").alias("lag"))


def interval(last: Column, following: Column, committed: Column, current: Column) -> Column:
    """Next number of entries to send at once: grows with the share of the backlog, between 10 and 100.

    A follower at the start (following = 0) gets 10.
    """
    ratio = (last - following) / F.greatest(F.lit(1), last - committed)
    factor = F.least(F.lit(2.0), F.greatest(F.lit(0.5), 1.0 + F.log1p(ratio)))
    smooth = (0.8 * current * factor + 0.2 * current).cast("int")
    return F.when(following == 0, 10).otherwise(F.least(F.lit(100), F.greatest(F.lit(10), smooth)))


def monotone(acks: DataFrame) -> DataFrame:
    """Commit index that a follower holds after each message (shard, seq, commit): it never falls."""
    return running(acks, ["shard"], "seq", "commit", "committed", how="max")


def quorum(matches: DataFrame, members: int) -> DataFrame:
    """Highest index of each shard that a majority of its members holds (members that do not answer hold 0)."""
    sorted_matches = F.sort_array(F.collect_list("match"), asc=False)
    majority = members // 2 + 1
    return matches.groupBy("shard").agg(F.coalesce(F.get(sorted_matches, F.lit(majority - 1)), F.lit(0)).cast("long").alias("commit"))
