import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera.operators import cluster, log, lsm, ranking, replication, table

ROW = "family string, key string, col string, value string"


def cells(spark, *rows):
    return spark.createDataFrame(list(rows), ROW)


def test_get_tells_a_stored_null_from_a_missing_cell(spark):
    frame = cells(spark, ("f", "k", "c", None), ("f", "k", "d", "1"))
    assert tuple(table.get(frame, "f", "k", "c").first()) == ("k", "c", None, True)
    assert tuple(table.get(frame, "f", "k", "d").first()) == ("k", "d", "1", True)
    assert tuple(table.get(frame, "f", "x", "c").first()) == ("x", "c", None, False)


def test_separators_in_names_do_not_collide(spark):
    frame = cells(spark, ("a#b", "c", "x", "1"), ("a", "b#c", "x", "2")).withColumn("seq", F.lit(1))
    assert table.last_write(frame, F.col("seq"), "value").count() == 2


def test_newest_of_a_batch_wins_and_an_empty_batch_changes_nothing(spark):
    commands = spark.createDataFrame([(1, "PUT", "f", "k", "c", "old"), (2, "PUT", "f", "k", "c", "new"), (3, "PUT", "f", "k", "d", "x"), (4, "DELETE", "f", "k", "d", None)], "seq long, op string, " + ROW)
    assert [r.value for r in table.apply(commands, F.col("seq")).collect()] == ["new"]
    base = cells(spark, ("f", "k", "c", "1"))
    assert [tuple(r) for r in table.upsert(base, base.limit(0)).collect()] == [("f", "k", "c", "1")]


def test_multi_get_plan_broadcasts_a_short_request_list(spark):
    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet").select(F.lit("o").alias("family"), F.col("o_orderkey").cast("string").alias("key"), F.lit("s").alias("col"), F.col("o_orderstatus").alias("value"))
    asked = table.bounded(spark.createDataFrame([(1, "7"), (2, "-1")], "ord long, key string"))
    frame = table.multi_get(orders, asked)
    assert {(r.ord, r.found) for r in frame.collect()} == {(1, True), (2, False)}
    assert "BroadcastHashJoin" in frame._jdf.queryExecution().toString()


def entries(spark, *pairs):
    return spark.createDataFrame([(s, i, 1, f"r{i}") for s, i in pairs], "shard long, idx long, term long, role string")


def test_log_reads(spark):
    frame = entries(spark, *[(1, i) for i in range(1, 301)])
    assert [r.idx for r in log.scan(frame, 255, 3).orderBy("idx").collect()] == [255, 256, 257]
    assert log.read_from(frame, 299).count() == 2 and log.read_from(frame, 301).count() == 0
    assert log.last(frame, "role").first().role == "r300"
    assert log.extent(log.truncate_prefix(log.truncate_suffix(frame, 10), 3)).first().asDict() == {"shard": 1, "first_idx": 4, "last_idx": 9, "n": 6}
    with pytest.raises(ValueError):
        log.scan(frame, 1, 0)
    with pytest.raises(ValueError):
        log.read_from(frame, -1)


def test_holes_end_the_contiguous_prefix(spark):
    frame = entries(spark, (1, 1), (1, 2), (1, 4), (2, 2))
    assert [(r.shard, r.idx) for r in log.contiguous(frame, start=1).orderBy("idx").collect()] == [(1, 1), (1, 2)]
    assert {tuple(r) for r in log.gaps(frame, first=1).collect()} == {(1, 3, 4), (2, 1, 2)}


def test_a_truncated_prefix_is_no_hole(spark):
    frame = entries(spark, *[(1, i) for i in (3, 4, 5, 7)], (2, 9))
    assert {(r.shard, r.idx) for r in log.contiguous(frame).collect()} == {(1, 3), (1, 4), (1, 5), (2, 9)}
    assert [tuple(r) for r in log.gaps(frame).collect()] == [(1, 6, 7)]
    assert [r.idx for r in log.scan(frame, 3, 10).orderBy("idx").collect()] == [3, 4, 5] and log.scan(frame, 6, 3).count() == 0
    assert [r.idx for r in log.read_from(frame, 4).orderBy("idx").collect()] == [4, 5] and log.read_from(frame, 6).count() == 0
    empty = log.last(frame.where("shard = 2"), "term", "role", shards=frame).orderBy("shard").collect()
    assert [tuple(r) for r in empty] == [(1, 0, 0, None), (2, 9, 1, "r9")]


def test_ranks_over_blocks(spark):
    frame = spark.range(2000).select((F.col("id") % 3).alias("shard"), (F.col("id") * 7 - 900).alias("idx"))
    rows = frame.collect()
    wanted = {s: sorted(r.idx for r in rows if r.shard == s) for s in range(3)}
    for block in (16, 1 << 16):
        assert all(wanted[r.shard][r.place - 1] == r.idx for r in ranking.ranked(frame, ["shard"], "idx", block=block).collect())
        top = ranking.ranked(frame, ["shard"], "idx", descending=True, most=5, block=block).collect()
        assert len(top) == 15 and all(wanted[r.shard][-r.place] == r.idx for r in top)
    for block in (16, 1 << 16):
        summed = ranking.running(frame.withColumn("v", F.col("idx") % 5), ["shard"], "idx", "v", "total", descending=True, block=block).collect()
        best = ranking.running(frame.withColumn("v", F.col("idx") % 97), ["shard"], "idx", "v", "top", how="max", block=block).collect()
        assert all(r.total == sum(int(math.fmod(i, 5)) for i in wanted[r.shard] if i >= r.idx) for r in summed[::37])
        assert all(r.top == max(int(math.fmod(i, 97)) for i in wanted[r.shard] if i <= r.idx) for r in best[::37])
    marks = {r.shard: (r["mark"], r.last_idx) for r in lsm.flush_marks(frame, 100).collect()}
    assert marks == {s: (v[len(v) // 100 * 100 - 1], v[-1]) for s, v in wanted.items()}


def test_a_missing_index_gives_the_sentinel(spark):
    frame = entries(spark, (1, 1))
    shards = frame.select("shard").distinct()
    assert tuple(log.point(frame, shards, 9).first()) == (1, 9, 0, None, False)
    assert log.point(frame, shards, 0).first().has_index


def test_append_goes_on_from_the_last_index(spark):
    batch = spark.createDataFrame([(1, 10), (1, 11), (2, 12)], "shard long, at long")
    last = spark.createDataFrame([(1, 5)], "shard long, last_idx long")
    assert {(r.shard, r.at, r.idx) for r in log.append(batch, last, "at").collect()} == {(1, 10, 6), (1, 11, 7), (2, 12, 1)}


def test_replay_after_compaction_equals_the_whole_log(spark):
    rows = [("f", "k", "c", "PUT", "1", 1), ("f", "k", "d", "PUT", "2", 2), ("f", "k", "d", "DELETE", None, 3), ("f", "k", "c", "PUT", "4", 4)]
    frame = spark.createDataFrame(rows, "family string, key string, col string, op string, value string, idx long")
    for mark in range(5):
        upto = F.col("idx") <= mark
        assert [tuple(r) for r in lsm.replay(lsm.compact(frame, upto), frame.where(~upto)).collect()] == [("f", "k", "c", "4")]


def test_placement_repeats_nodes_when_partitions_are_a_multiple_of_them(spark):
    catalog = spark.createDataFrame([("t", 4, 2, 1, "init")], "table string, partitions int, replications int, version long, status string")
    nodes = spark.createDataFrame([(1, "a"), (2, "b")], "node long, endpoint string")
    placed = cluster.place(catalog, nodes)
    assert placed.count() == 8 and cluster.colocated(placed).count() == 4
    assert {r.n_leaders for r in cluster.skew(placed).collect()} == {2}
    more = nodes.unionByName(spark.createDataFrame([(3, "c"), (4, "d")], "node long, endpoint string"))
    assert {(r.node, r.n_trps) for r in cluster.balance(placed, more).collect()} == {(1, 4), (2, 4), (3, 0), (4, 0)} and cluster.balance(placed, more).first().ratio == 2
    moved = cluster.moves(placed, more).collect()
    assert Counter(r.node for r in moved) == {1: 2, 2: 2} and Counter(r.to_node for r in moved) == {3: 2, 4: 2}
    assert cluster.moves(placed, nodes).count() == 0
    with pytest.raises(ValueError):
        cluster.place(catalog.withColumn("replications", F.lit(3)), nodes)


def test_migration_steps(spark):
    events = spark.createDataFrame([("a", 1, "PENDING"), ("a", 2, "LOCKED"), ("a", 3, "COMPLETED"), ("b", 1, "LOCKED")], "trp string, seq long, status string")
    assert {(r.trp, r.seq): r.valid for r in cluster.transitions(events).collect()} == {("a", 1): True, ("a", 2): True, ("a", 3): False, ("b", 1): False}


def test_quorum_and_interval(spark):
    matches = spark.createDataFrame([(1, 5), (1, 3), (1, 9), (2, 4)], "shard long, match long")
    assert {r.shard: r["commit"] for r in replication.quorum(matches, 3).collect()} == {1: 5, 2: 0}
    row = spark.createDataFrame([(100, 1, 50, 40), (10, 0, 0, 40), (5, 5, 5, 2)], "a long, n long, c long, i long")
    assert [r[0] for r in row.select(replication.interval(F.col("a"), F.col("n"), F.col("c"), F.col("i"))).collect()] == [72, 10, 10]
