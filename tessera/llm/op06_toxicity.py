"""Toxicity: a factorization machine over hashed terms.

A text is the set of its terms - runs of ASCII letters and digits and of bytes outside ASCII, ASCII letters lowered,
and the beginnings of longer ones, which stand for their inflected and compound forms - hashed into 2**22 buckets; a
term that occurs again has a second bucket.  Features are the buckets whose document frequency differs between the two
labels (a likelihood-ratio test) and the members of pairs of buckets that tell more about the label together than each by
itself (the same test on the four cells of a pair, less that of its members; over the `max_paired` buckets of most texts).
A term that says nothing by itself thus enters with its partner.  The machine adds a bias, a weight for each feature present
and an inner product of factors for each pair present, so a pair such as an insult with a mention of a group can weigh more
(or less) than its parts; it is fitted by full-batch Adam on the logistic loss.

The fit uses a bounded sample of labelled rows (`max_labelled`, those with the least hash of doc_id); only their hashed
terms come to the driver.  Scoring is one narrow pass with the features and factors (at most `max_features` of each)
in the closure.

Defined cases: null and empty texts have no terms and get the bias alone; null labels are not learned from; of rows that
repeat a doc_id in labels the largest label counts, of those in docs the text with the least hash; without labelled rows, or with one label only, the score is the
smoothed share of label 1 (0 without rows); a null doc_id is not held out; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bytesx as B
from tessera.llm.shared import carry, least_hashed

LOG2_BUCKETS = 22
MAX_LABELLED = 8_000
MAX_FEATURES = 512
LEAST_RATIO = 15.1  # likelihood-ratio statistic of a feature: about 1 in 10,000 by chance
MAX_PAIRED = 2_048
LEAST_PAIR_RATIO = 40.0  # of a pair beyond its members: about 1 in 1,000 for the most likely of all pairs by chance
FACTORS = 4
THRESHOLD = 0.3

_BEGINNINGS = (6, 7, 8)  # bytes
_TERM = np.zeros(256, bool)
_TERM[48:58] = _TERM[65:91] = _TERM[97:123] = _TERM[128:] = True


def terms(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text number and bucket of every term of the texts in one buffer: whole words, then longer words' beginnings."""
    starts, ends = B.runs(_TERM[buf], offsets[1:-1])
    roll, doc = B.Roll(np.take(B.LOWER, buf)), B.owner(starts, offsets)
    docs, hashes = [doc], [roll.of(starts, ends)]
    for size in _BEGINNINGS:
        longer = ends - starts > size
        docs.append(doc[longer])
        hashes.append(B.mix(roll.of(starts[longer], starts[longer] + size)))
    return np.concatenate(docs), (np.concatenate(hashes) & np.uint64((1 << LOG2_BUCKETS) - 1)).astype(np.int64)


def _again(bucket: np.ndarray) -> np.ndarray:
    """The bucket that stands for two or more occurrences of a term."""
    return (B.mix(bucket.astype(np.uint64) + np.uint64(1 << 32)) & np.uint64((1 << LOG2_BUCKETS) - 1)).astype(np.int64)


def present(doc: np.ndarray, bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, bucket) pairs of a bag of terms, with those for terms that occur again; by text."""
    both, n = np.unique((doc << LOG2_BUCKETS) | bucket, return_counts=True)
    mask = (1 << LOG2_BUCKETS) - 1
    more = both[n > 1]
    both = np.unique(np.concatenate([both, (more & ~mask) | _again(more & mask)]))
    return both >> LOG2_BUCKETS, both & mask


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == remainder, F.lit(False))


class Machine:
    """bias + sum of weights + sum over pairs of <factor, factor>, over the features present."""

    def __init__(self, buckets: np.ndarray, bias: float, weights: np.ndarray, factors: np.ndarray):
        self.buckets, self.bias, self.weights, self.factors = buckets, bias, weights, factors

    def raw(self, doc: np.ndarray, feature: np.ndarray, n: int) -> np.ndarray:
        """Log-odds of n texts from their distinct (text, feature) pairs."""
        out = self.bias + np.bincount(doc, self.weights[feature], n)
        for f in self.factors.T:
            v = f[feature]
            out += 0.5 * (np.bincount(doc, v, n) ** 2 - np.bincount(doc, v * v, n))
        return out


def _ratio(with_1: np.ndarray, with_0: np.ndarray, share: float) -> np.ndarray:
    """What a cell of texts (numbers under label 1 and 0) adds to the likelihood-ratio statistic."""
    n = with_1 + with_0
    with np.errstate(divide="ignore", invalid="ignore"):
        return 2 * (np.nan_to_num(with_1 * np.log(with_1 / (n * share))) + np.nan_to_num(with_0 * np.log(with_0 / (n * (1 - share)))))


def screen(toxic: np.ndarray, doc: np.ndarray, bucket: np.ndarray, most: int = MAX_FEATURES, least: float = LEAST_RATIO, max_paired: int = MAX_PAIRED, least_pair: float = LEAST_PAIR_RATIO) -> np.ndarray:
    """Buckets that tell the labels apart by themselves or in pairs, by the likelihood-ratio statistic; the best of each first."""
    n1, n0 = int(toxic.sum()), int((~toxic).sum())
    share = n1 / (n1 + n0)
    with_1 = np.bincount(bucket[toxic[doc]], minlength=1 << LOG2_BUCKETS)
    with_0 = np.bincount(bucket[~toxic[doc]], minlength=1 << LOG2_BUCKETS)
    at = np.flatnonzero(with_1 + with_0 >= 3)
    a, b = with_1[at].astype(float), with_0[at].astype(float)
    ratio = _ratio(a, b, share) + _ratio(n1 - a, n0 - b, share)
    order = np.lexsort((at, -ratio))
    alone = at[order[ratio[order] >= least]]

    # Pairs, by blocks of rows of the table of all of them.
    often = np.sort(np.lexsort((at, -(a + b)))[:max_paired])
    often = often[np.minimum(a + b, n1 + n0 - a - b)[often] >= 5]
    table = np.full(1 << LOG2_BUCKETS, -1, np.int16)
    table[at[often]] = np.arange(len(often))
    known = table[bucket] >= 0
    row = np.empty(len(toxic), np.int64)
    row[np.argsort(~toxic, kind="stable")] = np.arange(len(toxic))
    x = np.zeros((len(toxic), len(often)), np.float32)
    x[row[doc[known]], table[bucket[known]]] = 1
    x1, x0 = x[:n1], x[n1:]
    a, b, single = a[often], b[often], ratio[often]
    firsts, seconds, gains = [], [], []
    for lo in range(0, len(often), 256):
        rows = slice(lo, lo + 256)
        c1, c0 = (x1[:, rows].T @ x1).astype(float), (x0[:, rows].T @ x0).astype(float)
        u1, u0 = a[rows][:, None], b[rows][:, None]
        gain = _ratio(c1, c0, share) + _ratio(u1 - c1, u0 - c0, share) + _ratio(a - c1, b - c0, share) + _ratio(n1 - u1 - a + c1, n0 - u0 - b + c0, share)
        gain -= single[rows][:, None] + single
        i, j = np.nonzero((gain >= least_pair) & (np.arange(len(often)) > np.arange(lo, lo + len(c1))[:, None]))
        firsts.append(i + lo)
        seconds.append(j)
        gains.append(gain[i, j])
    if firsts:
        i, j, gain = (np.concatenate(z) for z in (firsts, seconds, gains))
        order = np.lexsort((j, i, -gain))[:most]
        paired = at[often[np.stack([i[order], j[order]], 1).ravel()]]
    else:
        paired = np.zeros(0, np.int64)
    # Best single buckets and best pairs in turn, until there are `most`.
    ranked = np.concatenate([alone, paired])
    turn = np.concatenate([np.arange(len(alone)), np.arange(len(paired)) // 2])
    ranked = ranked[np.argsort(turn, kind="stable")]
    _, first = np.unique(ranked, return_index=True)
    return np.sort(ranked[np.sort(first)[:most]])


def fit(toxic: np.ndarray, doc: np.ndarray, bucket: np.ndarray, steps: int = 400, rate: float = 0.05, penalty: float = 1e-4, seed: int = 1) -> Machine:
    """Learn from labels and the distinct (text, bucket) pairs of the labelled texts."""
    share = (toxic.sum() + 0.5) / (len(toxic) + 1) if len(toxic) else 0.0
    none = Machine(np.zeros(0, np.int64), float(np.log(share / (1 - share))) if share else -np.inf, np.zeros(0), np.zeros((0, FACTORS)))
    if not len(toxic) or toxic.all() or not toxic.any():
        return none
    buckets = screen(toxic, doc, bucket)
    if not len(buckets):
        return none
    table = np.full(1 << LOG2_BUCKETS, -1, np.int16)
    table[buckets] = np.arange(len(buckets))
    known = np.flatnonzero(table[bucket] >= 0)
    x = np.zeros((len(toxic), len(buckets)), np.float32)
    x[doc[known], table[bucket[known]]] = 1
    y = toxic.astype(np.float32)
    random = np.random.default_rng(seed)
    values = [np.array([none.bias], np.float32), np.zeros(len(buckets), np.float32), random.normal(0, 0.05, (len(buckets), FACTORS)).astype(np.float32)]
    first, second = [np.zeros_like(v) for v in values], [np.zeros_like(v) for v in values]
    for step in range(1, steps + 1):
        bias, w, v = values
        inner = x @ v
        raw = bias[0] + x @ w + 0.5 * (inner**2 - x @ (v * v)).sum(1)
        slope = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - y) / len(y)
        by_feature = x.T @ slope
        gradients = [np.array([slope.sum()]), by_feature + penalty * w, x.T @ (slope[:, None] * inner) - by_feature[:, None] * v + penalty * v]
        for i, g in enumerate(gradients):
            first[i] = 0.9 * first[i] + 0.1 * g
            second[i] = 0.999 * second[i] + 0.001 * g * g
            values[i] = (values[i] - rate * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return Machine(buckets, float(values[0][0]), values[1].astype(float), values[2].astype(float))


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> Machine:
    """Fit on at most max_labelled labelled rows that are not held out (crc32 of doc_id modulo 4 is 2)."""
    known = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
        .where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), 4, 2))
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = B.buffer(batch.column(0))
            for lo, hi in B.chunks(offsets):
                doc, bucket = present(*terms(*B.chunked(buf, offsets, lo, hi)))
                cuts = np.zeros(hi - lo + 1, np.int32)
                np.cumsum(np.bincount(doc, minlength=hi - lo), out=cuts[1:])
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(cuts), pa.array(bucket.astype(np.int32)))], names=["toxic", "buckets"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    one = rows.join(F.broadcast(least_hashed(known, "doc_id", max_labelled)), "doc_id").groupBy("doc_id", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    found = one.select("text", "toxic").mapInArrow(run, "toxic int, buckets array<int>").toArrow().combine_chunks()
    if not found.num_rows:
        return fit(np.zeros(0, bool), np.zeros(0, np.int64), np.zeros(0, np.int64))
    lists = found["buckets"].combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    counts = np.diff(lists.offsets.to_numpy())
    return fit(found["toxic"].to_numpy() == 1, np.repeat(np.arange(found.num_rows, dtype=np.int32), counts), lists.flatten().to_numpy())


def score(docs: DataFrame, machine: Machine, threshold: float = THRESHOLD, keep: list[str] | None = None, prefix: str = "") -> DataFrame:
    """Columns `keep` (default: doc_id) of docs, with score and predicted, named with a prefix.

    A kept column that has the name of an added one is replaced by it.
    """
    carried, added = carry(docs, keep or ["doc_id"], [f"{prefix}score", f"{prefix}predicted"])
    rows = docs.select(*[docs[c].alias(a) for a, c in carried.items()], docs["text"].cast("string").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.full(1 << LOG2_BUCKETS, -1, np.int16)
        table[machine.buckets] = np.arange(len(machine.buckets))
        wanted = table >= 0
        for lo in range(0, 1 << LOG2_BUCKETS, 1 << 18):
            wanted[lo : lo + (1 << 18)] |= table[_again(np.arange(lo, lo + (1 << 18)))] >= 0
        for batch in batches:
            buf, offsets = B.buffer(batch.column(batch.num_columns - 1))
            out = [np.zeros(0)]
            for lo, hi in B.chunks(offsets):
                doc, bucket = terms(*B.chunked(buf, offsets, lo, hi))
                hit = wanted[bucket]
                doc, bucket = present(doc[hit], bucket[hit])
                feature = table[bucket].astype(np.int64)
                raw = machine.raw(doc[feature >= 0], feature[feature >= 0], hi - lo)
                out.append(np.where(raw > -700, 1 / (1 + np.exp(-np.clip(raw, -700, 700))), 0.0))
            value = np.concatenate(out)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(value), pa.array((value >= threshold).astype(np.int32))], names=[*carried, "_score", "_predicted"])

    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "_text"]
    found = rows.mapInArrow(run, ", ".join([*kept, "_score double", "_predicted int"]))
    return found.select(*[F.col(a).alias(c) for a, c in carried.items()], F.col("_score").alias(added[0]), F.col("_predicted").alias(added[1]))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    machine = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, machine).select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "score", "predicted")
