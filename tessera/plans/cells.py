"""Queries over cells: reads, writes, deletes, encodings and views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import codec, hashing
from tessera.functions.bloom import KeyFilter
from tessera.operators import metrics, table
from tessera.plans import fixtures as X
from tessera.plans.registry import query

@query(f"WITH {X.OCELL} SELECT '7' AS key, 'status' AS col, max(value) AS value, count(*) > 0 AS found FROM ocell WHERE family = 'o' AND key = '7' AND col = 'status'")
def kv_get(spark: SparkSession, d: str) -> DataFrame:
    return table.get(X.ocell(spark, d), "o", "7", "status")


@query(f"WITH {X.OCELL}, {X.KEYS} SELECT ord, keys.key, col, value, ocell.key IS NOT NULL AS found FROM keys LEFT JOIN ocell ON keys.key = ocell.key")
def kv_multi_get(spark: SparkSession, d: str) -> DataFrame:
    return table.multi_get(X.ocell(spark, d), table.bounded(X.keys(spark, d)))


@query(f"WITH {X.OCELL}, {X.KEYS} SELECT keys.ord % 10 AS batch_id, count(*) AS n, count(c.key) AS n_found, bool_and(c.key IS NOT NULL) AS all_found FROM keys LEFT JOIN ocell c ON keys.key = c.key AND c.col = 'status' GROUP BY 1")
def kv_batch_get_all(spark: SparkSession, d: str) -> DataFrame:
    requests = table.bounded(X.keys(spark, d)).select((F.col("ord") % 10).alias("batch_id"), "key", F.lit("status").alias("col"))
    return table.all_found(requests, X.ocell(spark, d))


@query(f"WITH {X.LVER} SELECT key, col, arg_max(value, version) AS value, count(*) AS version_count FROM lver GROUP BY key, col")
def kv_lww(spark: SparkSession, d: str) -> DataFrame:
    return table.last_write(X.lver(spark, d), F.col("version"), "value").select("key", "col", "value", "version_count")


@query(f"WITH {X.OCELL} SELECT key, col, CASE WHEN col = 'status' AND CAST(key AS BIGINT) % 5 = 0 THEN 'X' ELSE value END AS value FROM ocell")
def kv_put_upsert(spark: SparkSession, d: str) -> DataFrame:
    cells = X.ocell(spark, d)
    updates = cells.where((F.col("col") == "status") & (F.col("key").cast("long") % 5 == 0)).withColumn("value", F.lit("X"))
    return table.upsert(cells, updates).select("key", "col", "value")


@query(f"WITH {X.EVLOG} SELECT shard, count(*) AS n_rows, count(DISTINCT key) AS n_keys, CAST(sum(strlen(key) + strlen(col)) AS BIGINT) AS bytes FROM evlog GROUP BY shard")
def kv_put_by_shard(spark: SparkSession, d: str) -> DataFrame:
    return table.by_shard(X.evlog(spark, d))


_LIVE = f"WITH {X.EVLOG}, s AS (SELECT key, col, arg_max(value, idx) AS value, arg_max(op, idx) AS op FROM evlog GROUP BY key, col) SELECT key, col, value FROM s WHERE op <> 'DELETE'"


@query(_LIVE)
def kv_delete(spark: SparkSession, d: str) -> DataFrame:
    return table.apply(X.evlog(spark, d), F.col("idx")).select("key", "col", "value")


@query(f"WITH {X.OCELL}, {X.KEYS} SELECT key, col, value FROM ocell WHERE key NOT IN (SELECT key FROM keys)")
def kv_batch_delete(spark: SparkSession, d: str) -> DataFrame:
    return table.delete_keys(X.ocell(spark, d), table.bounded(X.keys(spark, d))).select("key", "col", "value")


@query(f"WITH {X.EVLOG} SELECT key, col, arg_max(op, idx) AS last_op, arg_max(op, idx) <> 'DELETE' AS live, count(*) FILTER (op = 'PUT') AS n_puts, count(*) FILTER (op = 'DELETE') AS n_deletes FROM evlog GROUP BY key, col")
def command_apply(spark: SparkSession, d: str) -> DataFrame:
    return table.dispatch(X.evlog(spark, d), F.col("idx")).select("key", "col", "last_op", "live", "n_puts", "n_deletes")


@query(f"""WITH {X.OCELL} SELECT key, col, '"' || family || '#' || key || '#' || col || '"' AS encoded FROM ocell""")
def cell_key(spark: SparkSession, d: str) -> DataFrame:
    return X.ocell(spark, d).select("key", "col", codec.cell_key(F.col("family"), F.col("key"), F.col("col")).alias("encoded"))


@query(f"""WITH {X.OCELL} SELECT key, col, CASE WHEN CAST(key AS BIGINT) % 7 = 0 THEN 'null' ELSE '"' || value || '"' END AS encoded FROM ocell""")
def cell_value_json(spark: SparkSession, d: str) -> DataFrame:
    value = F.when(F.col("key").cast("long") % 7 == 0, F.lit(None)).otherwise(F.col("value"))
    return X.ocell(spark, d).select("key", "col", codec.json_text(value).alias("encoded"))


_BYTES = "list_reduce(list_prepend(1::HUGEINT, list_transform(string_split({0}, ''), lambda c: unicode(c)::HUGEINT)), lambda a, c: (a * 31 + c) % 4294967296)"
_SIGNED = "CASE WHEN {0} >= 2147483648 THEN {0} - 4294967296 ELSE {0} END"
SQL_SHARD = f"CAST(abs({_SIGNED.format('u')}) % {X.SHARDS} AS INTEGER)"


@query(f"""WITH {X.OCELL}, k AS (SELECT *, {_BYTES.format("family || '#' || key")} AS u FROM ocell)
SELECT key, col, {SQL_SHARD} AS shard, row_number() OVER (PARTITION BY {SQL_SHARD} ORDER BY '"' || family || '#' || key || '#' || col || '"') AS rank FROM k""")
def cell_order(spark: SparkSession, d: str) -> DataFrame:
    cells = X.ocell(spark, d)
    shard = hashing.memory_shard(F.col("family"), F.col("key"), X.SHARDS)
    return table.ordered(cells, shard, codec.cell_key(F.col("family"), F.col("key"), F.col("col"))).select("key", "col", "shard", "rank")


@query(f"""WITH {X.OCELL}, k AS (SELECT *, {_BYTES.format("family || '#' || key")} AS u FROM ocell) SELECT {SQL_SHARD} AS shard, count(*) AS n FROM k GROUP BY 1""")
def shard_split(spark: SparkSession, d: str) -> DataFrame:
    shard = hashing.memory_shard(F.col("family"), F.col("key"), X.SHARDS)
    return X.ocell(spark, d).groupBy(shard.alias("shard")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {X.OCELL}, k AS (SELECT *, {_BYTES.format("'\"' || family || '#' || key || '#' || col || '\"'")} AS u FROM ocell) SELECT {SQL_SHARD} AS shard, count(*) AS n FROM k GROUP BY 1""")
def shard_split_encoded(spark: SparkSession, d: str) -> DataFrame:
    """Cells by shard where the whole encoded key decides."""
    shard = hashing.encoded_shard(codec.cell_key(F.col("family"), F.col("key"), F.col("col")), X.SHARDS)
    return X.ocell(spark, d).groupBy(shard.alias("shard")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT CAST(o_orderkey AS VARCHAR) AS key, o_orderstatus AS status, o_orderpriority AS priority, CAST(o_custkey AS VARCHAR) AS custkey FROM orders")
def wide_row(spark: SparkSession, d: str) -> DataFrame:
    return table.wide(X.ocell(spark, d), ["status", "priority", "custkey"]).drop("family")


_CRC_TABLE = "list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END))"


@query(f"""WITH {X.EVLOG}, t AS (SELECT {_CRC_TABLE} AS crc_table), b AS (SELECT batch_id, string_agg(key || col || CAST(CAST(round(value * 100) AS BIGINT) AS VARCHAR), '' ORDER BY idx) AS s FROM evlog GROUP BY batch_id)
SELECT batch_id, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(s, ''), lambda x: CAST(unicode(x) AS BIGINT))), lambda c, x: xor(c >> 8, crc_table[(xor(c, x) & 255) + 1])), CAST(4294967295 AS BIGINT)) AS crc FROM b, t""")
def batch_crc(spark: SparkSession, d: str) -> DataFrame:
    """CRC-32 over keys, columns and values (in hundredths) of each batch, in log order."""
    entries = F.array_sort(F.collect_list(F.struct("idx", F.concat("key", "col", F.round(F.col("value") * 100).cast("long").cast("string")).alias("text"))))
    rows = X.evlog(spark, d).groupBy("batch_id").agg(entries.alias("entries"))
    return rows.select("batch_id", F.crc32(F.encode(F.array_join(F.transform("entries", lambda e: e["text"]), ""), "UTF-8")).alias("crc"))


@query(f"WITH {X.OCELL}, {X.KEYS} SELECT DISTINCT key FROM ocell WHERE key IN (SELECT key FROM keys)")
def bloom_semi(spark: SparkSession, d: str) -> DataFrame:
    """Keys that may be in a list by a Bloom filter of it, asked in the scan's stage, then checked: no key of the list is lost."""
    asked = X.keys(spark, d).select("key")
    likely = KeyFilter(asked, "key", expected=10_000).passing(X.ocell(spark, d).select("key"), "key")
    return likely.distinct().join(asked, "key", "left_semi")


@query("SELECT n, p, CAST(trunc(-n * ln(p) / (ln(2) * ln(2))) AS BIGINT) AS m, CAST(greatest(1, round(trunc(-n * ln(p) / (ln(2) * ln(2))) / n * ln(2))) AS BIGINT) AS k FROM (SELECT CAST(unnest([1000, 1000000, 5000000]) AS BIGINT) AS n), (SELECT unnest([0.01::DOUBLE, 0.001::DOUBLE]) AS p)")
def bloom_sizing(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(n, p, *codec.bloom_size(n, p)) for n in (1000, 1_000_000, 5_000_000) for p in (0.01, 0.001)], "n long, p double, m long, k long")


@query(f"WITH {X.EVLOG} SELECT shard, CAST(sum(strlen(key) + strlen(col) + 8) AS BIGINT) AS bytes, count(*) AS n_writes FROM evlog GROUP BY shard")
def mem_by_shard(spark: SparkSession, d: str) -> DataFrame:
    return metrics.memory(X.evlog(spark, d))


@query(f"WITH {X.EVLOG} SELECT CAST(sum(strlen(key) + strlen(col) + 8) AS BIGINT) AS bytes FROM evlog")
def mem_total(spark: SparkSession, d: str) -> DataFrame:
    return metrics.total(metrics.memory(X.evlog(spark, d)))


@query(f"WITH {X.EVLOG} SELECT count(*) FILTER (op = 'PUT') AS n_puts, count(*) FILTER (op = 'DELETE') AS n_deletes, count(DISTINCT (key, col)) AS n_cells, count(*) AS n_commands, count(*) - count(DISTINCT (key, col)) AS n_hits FROM evlog")
def engine_counters(spark: SparkSession, d: str) -> DataFrame:
    return metrics.counters(X.evlog(spark, d))


@query(f"WITH {X.EVLOG} SELECT shard, count(*) AS n FROM evlog GROUP BY shard ORDER BY n DESC, shard LIMIT 1")
def hot_shard(spark: SparkSession, d: str) -> DataFrame:
    return metrics.hottest(X.evlog(spark, d))


@query(f"WITH {X.EVLOG}, b AS (SELECT batch_id, NOT bool_or(value < 1) AS success, min(idx) FILTER (value < 1) AS first_error FROM evlog GROUP BY batch_id) SELECT batch_id, success, first_error, CASE WHEN success THEN 0 ELSE 500 END AS code, CASE WHEN success THEN 'success' ELSE 'value below 1' END AS msg FROM b")
def batch_status(spark: SparkSession, d: str) -> DataFrame:
    found = metrics.batches(X.evlog(spark, d), "value < 1")
    result = codec.envelope(~F.col("success"), F.lit(500), F.lit("value below 1"))
    return found.withColumn("r", result).select("batch_id", "success", "first_error", "r.code", "r.msg")
