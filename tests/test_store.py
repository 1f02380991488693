import pytest
from pyspark.sql import functions as F

from tessera.sources.client import TableClient
from tessera.sources.log_store import LogStore
from tessera.sources.queue import Topic
from tessera.sources.store import CellStore, move_shards
from tessera.streaming import ingest

ROW = "family string, key string, col string, value string"


def test_put_get_delete_compact(spark, tmp_path):
    store = CellStore(spark, str(tmp_path / "t"), shards=4)
    assert store.get("f", "k", "c") == (False, None) and store.cells().count() == 0
    store.put(spark.createDataFrame([("f", "key1", "c", "value1"), ("f", "业务", "c", None)], ROW))
    assert store.get("f", "key1", "c") == (True, "value1") and store.get("f", "业务", "c") == (True, None)
    store.put(spark.createDataFrame([("f", "key1", "c", "a", 1), ("f", "key1", "c", "b", 2)], ROW + ", n long"), order="n")
    assert store.get("f", "key1", "c") == (True, "b")
    last = store.last_index()
    assert store.put(spark.createDataFrame([], ROW)) == last
    store.compact()
    store.delete(spark.createDataFrame([("f", "业务", "c")], "family string, key string, col string"))
    again = CellStore(spark, str(tmp_path / "t"), shards=4)
    assert [tuple(r) for r in again.cells().collect()] == [("f", "key1", "c", "b")]
    again.compact()
    assert again.get("f", "业务", "c") == (False, None) and again.cells().count() == 1
    with pytest.raises(ValueError):
        CellStore(spark, str(tmp_path / "t"), shards=8)


def test_reads_prune_by_shard(spark, tmp_path):
    store = CellStore(spark, str(tmp_path / "t"), shards=8)
    store.put(spark.range(100).select(F.lit("f").alias("family"), F.col("id").cast("string").alias("key"), F.lit("c").alias("col"), F.lit("v").alias("value")))
    plan = store.log().where((F.col("shard") == 3) & (F.col("key") == "7"))._jdf.queryExecution().executedPlan().toString()
    assert "isnotnull(shard" in plan.split("PartitionFilters: [")[1].split("]")[0] and "EqualTo(key,7)" in plan


def test_repeated_addresses_need_an_order(spark, tmp_path):
    store = CellStore(spark, str(tmp_path / "t"), shards=4)
    twice = spark.createDataFrame([("f", "k", "c", "a"), ("f", "k", "c", "b")], ROW)
    with pytest.raises(ValueError):
        store.put(twice)
    store.put(twice.withColumn("n", F.when(F.col("value") == "a", 2).otherwise(1)), order="n")
    assert store.get("f", "k", "c") == (True, "a")


def test_batch_reads_filter_and_counters(spark, tmp_path):
    store = CellStore(spark, str(tmp_path / "t"), shards=8)
    store.put(spark.range(200).selectExpr("'f' AS family", "CAST(id AS STRING) AS key", "'c' AS col", "CONCAT('v', id) AS value"))
    store.delete(spark.createDataFrame([("f", "7", "c")], "family string, key string, col string"))
    asked = spark.createDataFrame([(1, "f", "5", "c"), (2, "f", "7", "c"), (3, "f", "x", "c"), (4, "f", "5", "c"), (5, "f", "5", "d")], "ord int, family string, key string, col string")
    wanted = {(1, "v5", True), (2, None, False), (3, None, False), (4, "v5", True), (5, None, False)}
    assert {(r.ord, r.value, r.found) for r in store.get_many(asked).collect()} == wanted
    store.use_filter(1000)
    assert {(r.ord, r.value, r.found) for r in store.get_many(asked).collect()} == wanted
    store.put(spark.createDataFrame([("f", "later", "c", "z")], ROW))
    assert store.get("f", "later", "c") == (True, "z") and store.get("f", "never", "c") == (False, None)
    assert store.counters["filtered"] == 1 and store.counters["found"] == 1 and store.counters["reads"] == 2
    mark = store.compact(records_per_file=10)
    assert [n for n, _ in store.folders.finished("log") if n <= mark] == [] and len(store.folders.finished("snapshot")) == 1
    store.compact()
    assert len(store.folders.finished("snapshot")) == 1 and store.cells().count() == 200


def test_shards_move_between_stores(spark, tmp_path):
    a, b = (CellStore(spark, str(tmp_path / x), shards=4) for x in "ab")
    a.put(spark.range(50).selectExpr("'f' AS family", "CAST(id AS STRING) AS key", "'c' AS col", "IF(id = 3, NULL, 'v') AS value"))
    before = {tuple(r) for r in a.cells().select("key", "value").collect()}
    gone = {tuple(r) for r in a.export([1, 2]).select("key", "value").collect()}
    assert gone and move_shards(a, b, [1, 2]) == "COMPLETED"
    assert {tuple(r) for r in b.cells().select("key", "value").collect()} == gone
    assert {tuple(r) for r in a.cells().select("key", "value").collect()} == before - gone


def test_a_durable_log(spark, tmp_path):
    store = LogStore(spark, str(tmp_path / "log"))
    assert store.last(1) == (0, 0, None) and store.entry(1, 0) == (0, 0, None) and store.entry(1, 1) is None
    heard = []
    batch = spark.createDataFrame([(1, f"a{i}", i) for i in range(5)] + [(2, "b0", 9)], "shard long, command string, at long")
    assert store.append(batch, "at", done=lambda e, n: heard.append((e, n))) == 6 and heard == [(None, 6)]
    assert store.append(batch.drop("command"), "at", done=lambda e, n: heard.append((type(e).__name__, n))) == 0 and heard[1][1] == 0
    again = LogStore(spark, str(tmp_path / "log"))
    again.append(batch.where("at < 2"), "at", term=2)
    assert again.last(1) == (7, 2, "a1") and again.entry(1, 6) == (6, 2, "a0")
    store.truncate_suffix(1, 4)
    assert store.last(1) == (3, 1, "a2")
    store.append(batch.where("at = 4"), "at", term=3)
    store.truncate_prefix(1, 1)
    store.truncate_prefix(2, 1)
    for _ in range(2):
        assert [tuple(r) for r in store.scan(1, 2).select("idx", "term", "command").collect()] == [(2, 1, "a1"), (3, 1, "a2"), (4, 3, "a4")]
        assert [r.idx for r in store.scan(1, 2, 2).collect()] == [2, 3] and store.scan(1, 1).count() == 0
        assert store.last(2) == (1, 0, None)
        store.compact()
    assert store.append(batch.where("shard = 2"), "at") == 1 and store.last(2)[0] == 2
    store.mark_flushed(1, 2)
    store.mark_flushed(1, 4)
    store.compact()
    store.mark_flushed(2, 1)
    assert {tuple(r) for r in store.flushed().collect()} == {(1, 4), (2, 1)}
    for bad in ((1, -1, None), (1, 2, 0), (1, 5, None)):
        with pytest.raises(ValueError):
            store.scan(*bad)


def _stream(spark, path):
    rows = [(1 + i % 2, i, "DELETE" if i == 9 else "PUT", "f", f"k{i % 3}", "c", float(i)) for i in range(1, 10)]
    spark.createDataFrame(rows, "shard int, idx long, op string, family string, key string, col string, value double").repartition(3).write.parquet(path)
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_micro_batches_and_listener(spark, tmp_path):
    heard = []
    query = ingest.append_batches(_stream(spark, str(tmp_path / "in")), str(tmp_path / "log"), str(tmp_path / "state"), lambda i, entries: heard.append(entries.count()))
    query.awaitTermination()
    assert sum(heard) == 9
    applied = ingest.latest(spark.read.parquet(str(tmp_path / "log")))
    assert {r.key: (r.op, r.value) for r in applied.collect()} == {"k0": ("DELETE", 9.0), "k1": ("PUT", 7.0), "k2": ("PUT", 8.0)}


def test_aggregating_stream(spark, tmp_path):
    out = ingest.latest(_stream(spark, str(tmp_path / "in")))
    query = out.writeStream.outputMode("complete").format("memory").queryName("newest").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    query.awaitTermination()
    assert {r.key: r.value for r in spark.table("newest").collect()} == {"k0": 9.0, "k1": 7.0, "k2": 8.0}


def test_keyed_state_keeps_the_newest_command(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    out = ingest.stateful(_stream(spark, str(tmp_path / "in")))
    query = out.writeStream.outputMode("update").foreachBatch(lambda batch, i: batch.write.mode("overwrite").parquet(str(tmp_path / f"out/{i}"))).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    query.awaitTermination()
    rows = spark.read.option("recursiveFileLookup", True).parquet(str(tmp_path / "out")).groupBy("key").agg(F.max_by("value", "idx").alias("value")).collect()
    assert {r.key: r.value for r in rows} == {"k0": "9.0", "k1": "7.0", "k2": "8.0"}


def test_a_null_value_stays_null_in_keyed_state(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = [(1, 1, "PUT", "f", "k", "c", "a"), (1, 2, "PUT", "f", "k", "c", None)]
    spark.createDataFrame(rows, "shard int, idx long, op string, family string, key string, col string, value string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).parquet(str(tmp_path / "in"))
    query = ingest.stateful(stream).writeStream.outputMode("update").foreachBatch(lambda batch, i: batch.write.mode("overwrite").parquet(str(tmp_path / f"out/{i}"))).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    query.awaitTermination()
    assert [(r.idx, r.value) for r in spark.read.option("recursiveFileLookup", True).parquet(str(tmp_path / "out")).collect()] == [(2, None)]


def test_clients_route_and_groups_commit(spark, tmp_path):
    client = TableClient(spark, "t", [str(tmp_path / f"n{i}") for i in range(2)], strategy="brace", shards=2)
    client.put(spark.createDataFrame([("f", f"{{u{i}}}:{k}", "c", f"{i}{k}") for i in range(6) for k in "ab"], ROW))
    assert client.get("f", "{u3}:b", "c") == (True, "3b") and client.get("f", "{u9}:b", "c") == (False, None)
    client.delete(spark.createDataFrame([("f", "{u3}:b", "c")], "family string, key string, col string"))
    asked = spark.createDataFrame([(1, "f", "{u3}:b", "c"), (2, "f", "{u4}:a", "c")], "ord int, family string, key string, col string")
    assert {(r.ord, r.value, r.found) for r in client.get_many(asked).collect()} == {(1, None, False), (2, "4a", True)} and client.get_many(asked.limit(0)).count() == 0
    topic = Topic(spark, str(tmp_path / "topic"), partitions=2)
    topic.publish(spark.createDataFrame([(f"k{i % 3}", f"m{i}", i) for i in range(9)], "key string, body string, n int"), "n")
    first = topic.poll("g", 2).cache()
    assert first.count() == 4 and topic.poll("g", 2).count() == 4
    topic.commit("g", first)
    rest = topic.poll("g", 100)
    assert {r.body for r in first.collect()} | {r.body for r in rest.collect()} == {f"m{i}" for i in range(9)} and rest.count() == 5 and topic.poll("h", 100).count() == 9
    by_key = {k: [r.body for r in sorted(topic.poll("h", 100).collect(), key=lambda r: r.offset) if r.key == k] for k in ("k0", "k1", "k2")}
    assert all(v == sorted(v) for v in by_key.values())


def test_periodic_batches(spark, tmp_path):
    query = ingest.append_batches(_stream(spark, str(tmp_path / "in")), str(tmp_path / "log"), str(tmp_path / "state"), every="1 second")
    query.processAllAvailable()
    query.stop()
    assert spark.read.parquet(str(tmp_path / "log")).count() == 9


def test_heartbeats_become_node_states(spark, tmp_path):
    beats = [(1, 1, ["a"]), (1, 2, ["a", "b"]), (2, 1, [])]
    spark.createDataFrame(beats, "node long, seq long, trps array<string>").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).parquet(str(tmp_path / "in"))
    query = ingest.node_states(stream).writeStream.outputMode("complete").format("memory").queryName("states").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    query.awaitTermination()
    assert {r.node: (r.seq, r.trps, r.n_reports) for r in spark.table("states").collect()} == {1: (2, ["a", "b"], 2), 2: (1, [], 1)}
