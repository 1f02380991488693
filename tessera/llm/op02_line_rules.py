"""Quality rules: base statistics of each text and cross-document line frequency.

Lines (split at \\n) are normalised - ASCII letters lowered, digits to 0, white space runs to one space, ends
trimmed - and hashed.  For each host (`source`) the distinct documents of every line are counted.  Lines in more than
`max_docs` documents of a host are removed from all of them, and a document that loses more than `max_lost` of its
words is depleted and rejected, as is one that fails the base rules.

Plan: a first pass counts lines, aggregated in each chunk before the shuffle, so a line that a third of all documents
hold costs a few rows a task.  A second pass makes the statistics and keeps, for every document, the lines that may be
frequent.  Those are counted by distinct documents and joined back, salted by row, so no line's documents meet in one
task.

Defined cases: a null text has no words, fails the base rules and has no lines; a null host is a host of its own;
lines without a word are never counted; rows that repeat a doc_id count as one document in line counts, rows with a null
doc_id as one each, and every row keeps its own statistics; texts of any length are read whole; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bytesx as B
from tessera.llm import sieve
from tessera.llm.shared import stored

MAX_DOCS = 20
MAX_LOST = 0.5
SALTS = 16

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_NORMAL = B.LOWER.copy()
_NORMAL[48:58] = 48
_STATISTICS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _duplicates(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each position: whether its key came before; whether its key occurs more than once."""
    order = np.argsort(keys, kind="stable")
    same = np.zeros(len(keys) + 1, bool)
    same[1:-1] = keys[order][1:] == keys[order][:-1]
    later, often = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    later[order] = same[:-1]
    often[order] = same[:-1] | same[1:]
    return later, often


def statistics(buf: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """Base statistics of the texts of one buffer, and their distinct normalised lines."""
    n = len(offsets) - 1
    starts, ends, doc = B.words(buf, offsets)
    roll = B.Roll(buf)
    space = B.SPACE[buf]
    salt = B.mix(np.arange(1, n + 1, dtype=np.uint64))

    lead = np.zeros(len(buf) + 1, np.int64)
    np.cumsum(~space & ((buf & 0xC0) != 0x80), out=lead[1:])
    symbols = np.zeros(len(buf) + 1, np.int64)
    np.cumsum(_SYMBOL[buf], out=symbols[1:])

    word = roll.of(starts, ends)
    covered = np.zeros(len(word), bool)
    if len(word) > 2:
        inside = np.flatnonzero(doc[2:] == doc[:-2])
        window = B.mix(word[inside]) + B.mix(word[inside + 1] * np.uint64(3)) + B.mix(word[inside + 2] * np.uint64(5))
        _, often = _duplicates(B.mix(window) ^ salt[doc[inside]])
        for k in range(3):
            covered[inside[often] + k] = True

    # Lines: between line feeds and the borders of texts.
    feeds = np.flatnonzero(buf == 10)
    line_starts = np.concatenate([offsets[:-1], feeds + 1])
    line_ends = np.concatenate([offsets[1:], feeds])
    line_doc = np.concatenate([np.arange(n), B.owner(feeds, offsets)])
    order = np.lexsort((line_starts, line_doc))
    line_starts, line_doc = line_starts[order], line_doc[order]
    line_ends = np.sort(line_ends, kind="stable")
    first_word = np.searchsorted(starts, line_starts)
    n_words = np.searchsorted(starts, line_ends) - first_word
    filled = n_words > 0
    line_starts, line_ends, line_doc, first_word, n_words = (x[filled] for x in (line_starts, line_ends, line_doc, first_word, n_words))
    raw, _ = _duplicates(roll.of(line_starts, line_ends) ^ salt[line_doc])

    # A normalised line is the sequence of its normalised words.
    normal = B.Roll(np.take(_NORMAL, buf)).of(starts, ends)
    place = np.arange(len(normal)) - np.repeat(first_word, n_words)
    mixed = B.mix(normal + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    sums = np.zeros(len(mixed) + 1, np.uint64)
    np.cumsum(mixed, out=sums[1:])
    line_hash = B.mix(sums[first_word + n_words] - sums[first_word] + n_words.astype(np.uint64))

    return {
        "n_words": B.per_text(None, doc, n),
        "word_chars": lead[offsets[1:]] - lead[offsets[:-1]],
        "n_symbols": symbols[offsets[1:]] - symbols[offsets[:-1]],
        "n_dup_lines": B.per_text(raw, line_doc, n),
        "n_repeat_words": B.per_text(covered, doc, n),
        "line_doc": line_doc,
        "line_start": line_starts,
        "line_hash": line_hash,
        "line_words": n_words,
    }


def _lines(s: dict[str, np.ndarray], host: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, key (of host and line) and words of all copies, for each distinct line of a text, by text."""
    key = B.mix(s["line_hash"] ^ host[s["line_doc"]])
    _, at, back = np.unique(B.mix(key) + B.mix(s["line_doc"].astype(np.uint64) + np.uint64(1)), return_index=True, return_inverse=True)
    total = np.bincount(back, weights=s["line_words"], minlength=len(at)).astype(np.int32)
    order = np.argsort(s["line_doc"][at], kind="stable")
    return s["line_doc"][at][order], key[at][order], total[order]


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, dict[str, np.ndarray], np.ndarray]]:
    for batch in batches:
        buf, offsets = B.buffer(batch.column(2))
        host = batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
        for lo, hi in B.chunks(offsets):
            yield batch.slice(lo, hi - lo), statistics(*B.chunked(buf, offsets, lo, hi)), host[lo:hi]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, s, host in _parts(batches):
        _, key, _ = _lines(s, host)
        keys, n = np.unique(key, return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(B.as_long(keys)), pa.array(n)], names=["line", "n"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Drops from each text (with its line feeds) the lines whose keys its row lists as removed."""
    for batch in batches:
        buf, offsets = B.buffer(batch.column("text"))
        host = batch.column("host").to_numpy().view(np.uint64)
        removed = batch.column("removed")
        for lo, hi in B.chunks(offsets):
            part, cuts = B.chunked(buf, offsets, lo, hi)
            s = statistics(part, cuts)
            key = B.as_long(B.mix(s["line_hash"] ^ host[lo:hi][s["line_doc"]]))
            texts = batch.column("text").slice(lo, hi - lo).cast(pa.binary()).to_pylist()
            first = np.searchsorted(s["line_doc"], np.arange(hi - lo + 1))
            for i, gone in enumerate(removed.slice(lo, hi - lo)):
                if not gone.is_valid:
                    continue
                of = slice(first[i], first[i + 1])
                out = set((s["line_start"][of][np.isin(key[of], gone.values.to_numpy())] - cuts[i]).tolist())
                kept, at = [], 0
                for line in texts[i].split(b"\n"):
                    if at not in out:
                        kept.append(line)
                    at += len(line) + 1
                texts[i] = b"\n".join(kept)
            columns = [B.strings(texts) if name == "text" else batch.column(name).slice(lo, hi - lo) for name in batch.schema.names if name not in ("host", "removed")]
            yield pa.RecordBatch.from_arrays(columns, names=[name for name in batch.schema.names if name not in ("host", "removed")])


def cleaned(docs: DataFrame, max_docs: int = MAX_DOCS, max_lost: float = MAX_LOST) -> DataFrame:
    """The rows of line_rules and the text of each without the lines above the limit; a null text stays null."""
    ruled = line_rules(docs, max_docs, max_lost, texts=True)
    schema = ", ".join(f"{name} {kind}" for name, kind in ruled.dtypes if name not in ("host", "removed"))
    return ruled.mapInArrow(_cut, schema)


def line_rules(docs: DataFrame, max_docs: int = MAX_DOCS, max_lost: float = MAX_LOST, texts: bool = False) -> DataFrame:
    """One row for each row of docs: base statistics, base_failed, kept and n_lost_words (words in removed lines).

    docs needs doc_id, source and text.  Two passes over the texts; only lines that pass a bitmap of the lines with
    more than max_docs rows (every line above the limit, and few others) are kept beside the statistics.  With texts, each row also has its host, text and removed lines (null: none).
    """
    carried = {"host": "long", "text": "string"} if texts else {}
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col("source").cast("string"), F.lit("\0null"))).alias("host"), F.col("text").cast("string").alias("text"))
    often = rows.mapInArrow(_count, "line long, n long").groupBy("line").agg(F.sum("n").alias("n")).where(F.col("n") > max_docs).select("line")
    table = sieve.build(often, "line")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, s, host in _parts(batches):
            doc, key, total = _lines(s, host)
            may = sieve.passes(table.value, key)
            cuts = np.zeros(part.num_rows + 1, np.int32)
            np.cumsum(np.bincount(doc[may], minlength=part.num_rows), out=cuts[1:])
            line = pa.StructArray.from_arrays([pa.array(B.as_long(key[may])), pa.array(total[may])], names=["line", "w"])
            columns = [part.column(0)] + [pa.array(s[x]) for x in _STATISTICS] + [pa.ListArray.from_arrays(pa.array(cuts), line)]
            yield pa.RecordBatch.from_arrays(columns + [part.column(x) for x in carried], names=["doc_id", *_STATISTICS, "lines", *carried])

    scanned = rows.mapInArrow(scan, "doc_id long, " + ", ".join(f"{x} long" for x in _STATISTICS) + ", lines array<struct<line:long,w:int>>" + "".join(f", {x} {kind}" for x, kind in carried.items()))
    scanned, _ = stored(scanned.withColumn("row", F.monotonically_increasing_id()), "line-rules")

    held = scanned.select("row", "doc_id", F.explode("lines").alias("l")).select("row", "doc_id", "l.line", "l.w")
    removed = held.groupBy("line").agg(F.count_distinct(F.struct("doc_id", F.when(F.col("doc_id").isNull(), F.col("row")))).alias("n_docs")).where(F.col("n_docs") > max_docs).select("line")
    salt = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    lost = (
        held.withColumn("salt", F.pmod("row", F.lit(SALTS)).cast("int"))
        .join(removed.withColumn("salt", salt).hint("merge"), ["line", "salt"], "left_semi")
        .groupBy("row").agg(F.sum("w").cast("long").alias("n_lost_words"), *([F.collect_set("line").alias("removed")] if texts else []))
    )
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    n_lost = F.coalesce("n_lost_words", F.lit(0).cast("long"))
    return (
        scanned.drop("lines").join(lost, "row", "left")
        .select("doc_id", *_STATISTICS, failed.alias("base_failed"), (~failed & (n_lost <= max_lost * F.col("n_words"))).alias("kept"), n_lost.alias("n_lost_words"), *carried, *(["removed"] if texts else []))
    )


def op2_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))


_SQL_LINE = """trim(regexp_replace(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789', 'abcdefghijklmnopqrstuvwxyz000000000'), '[\\x20\\x09-\\x0D]+', ' ', 'g'), ' ')"""
_SQL_WORD = r"'[^\x20\x09-\x0D]+'"
ORACLE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, regexp_extract_all(text, {_SQL_WORD}) AS ws, text FROM d),
p AS (SELECT r, i, ws[i] AS a, ws[i + 1] AS b, ws[i + 2] AS c FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
often AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS n FROM p) WHERE n > 1),
cover AS (SELECT r, count(DISTINCT i + k) AS n FROM often, (SELECT unnest([0, 1, 2]) AS k) GROUP BY r),
lines AS (SELECT r, doc_id, source, unnest(string_split(text, chr(10))) AS line FROM d),
filled AS (SELECT r, doc_id, source, line, {_SQL_LINE} AS norm, len(regexp_extract_all(line, {_SQL_WORD})) AS n FROM lines WHERE regexp_matches(line, {_SQL_WORD})),
dup AS (SELECT r, sum(n - 1) AS n FROM (SELECT r, line, count(*) AS n FROM filled GROUP BY ALL) GROUP BY r),
frequent AS (SELECT source, norm FROM filled GROUP BY source, norm HAVING count(DISTINCT doc_id) + count(DISTINCT CASE WHEN doc_id IS NULL THEN r END) > {MAX_DOCS}),
lost AS (SELECT r, sum(n) AS n FROM filled f WHERE EXISTS (SELECT 1 FROM frequent q WHERE q.norm = f.norm AND q.source IS NOT DISTINCT FROM f.source) GROUP BY r),
s AS (
  SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
    CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(cover.n, 0) AS BIGINT) AS n_repeat_words,
    CAST(coalesce(lost.n, 0) AS BIGINT) AS n_lost_words
  FROM w LEFT JOIN dup USING (r) LEFT JOIN cover USING (r) LEFT JOIN lost USING (r)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND n_lost_words <= {MAX_LOST} * n_words AS kept, n_lost_words
FROM b
"""
