"""A corpus pipeline of five stages over documents, each an operator of tessera.llm.

Every stage takes (spark, docs, sf_dir) and returns a frame; its rows are written and read again as the next one's docs.
All but the last return the columns of documents, with n_chars of the text as it is then.

1. toxicity: documents that the factorization machine predicts as toxic go.  It is fitted on labels and this stage's docs.
2. near_duplicates: of each near-duplicate class the document with the class id (the least doc_id) stays.
3. suffix_dedup: bytes of windows that start earlier are cut out of texts, and what a cut leaves of a character;
   documents stay, even where little text is left (of a null text an empty one).
4. decontamination: documents that hold a passage of the benchmark go.
5. sentencepiece: texts become ids; the columns of documents stay beside them.

Stages decide by row: rows with a null doc_id and rows that repeat one are numbered for stage 2, in the order of doc_id, and
stage 4 knows texts by a 64-bit hash, so equal texts go together.  Only ids and the rows that a bitmap lets through are
shuffled to drop rows.  Extra columns are carried along, whatever their names (the last stage's own columns replace clashing ones).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import op03_near_duplicates, op04_suffix_dedup, op06_toxicity, op07_decontamination, op08_sentencepiece, sieve
from tessera.llm.shared import folder, stored


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    machine = op06_toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return op06_toxicity.score(docs, machine, keep=docs.columns, prefix="_toxic_").where(F.col("_toxic_predicted") == 0).select(*docs.columns)


def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs and a column of its own number for each row: doc_id where it is one, else a new one in the order of doc_id (nulls last)."""
    if docs.groupBy("doc_id").count().where((F.col("count") > 1) | F.col("doc_id").isNull()).isEmpty():
        return docs, "doc_id"
    name = next(f"_row{i}" for i in range(len(docs.columns) + 1) if f"_row{i}" not in docs.columns)
    first = F.col("doc_id").asc_nulls_last()
    ordered = docs.repartitionByRange(first, F.xxhash64("text")).sortWithinPartitions(first, F.xxhash64("text"))
    return stored(ordered.withColumn(name, F.monotonically_increasing_id()), "pipeline-rows")[0], name


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows, number = _numbered(docs)
    found = op03_near_duplicates.classes(rows.select(F.col(number).alias("doc_id"), "text"))
    gone, _ = stored(found.where(F.col("class_id") != F.col("doc_id")).select(F.xxhash64("doc_id").alias("gone")), "pipeline-copies")
    return sieve.without(rows, F.xxhash64(F.col(number).cast("long")), gone).select(*docs.columns)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = op04_suffix_dedup.remove_repeats(docs, keep=[c for c in docs.columns if c != "text"], prefix="_cut_", whole_characters=True)
    return rows.withColumn("text", F.col("_cut_kept").cast("string")).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    of_text = F.xxhash64("text")
    found = op07_decontamination.leaks(docs.select(of_text.alias("doc_id"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    gone, _ = stored(found.select(F.col("doc_id").alias("gone")).distinct(), "pipeline-leaks")
    return sieve.without(docs, of_text, gone)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op08_sentencepiece.encode(docs, keep=docs.columns)


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("suffix_dedup", suffix_dedup),
    ("decontamination", decontamination),
    ("sentencepiece", sentencepiece),
]

#: Fitting, signatures and the transducer have no SQL form; tests/llm holds the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{i}-{name}")
        docs = spark.read.parquet(f"{base}/{i}-{name}")
    return docs
