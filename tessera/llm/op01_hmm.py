"""Language-model scoring with a hidden Markov model over words.

Training learns from every document whose crc32 (of doc_id as text) modulo 10 is not 0.  Words are runs of bytes other
than ASCII white space, ASCII letters lowered, followed by one end token.  Words are known by a 64-bit hash.

* Counts.  Every training token is counted, aggregated in each task before the shuffle; the table of counts grows with
  the corpus and stays distributed.
* Symbols.  The model emits a symbol: one of the commonest words (about `MAX_OWN` at most), the end, or one of `BUCKETS` hash
  buckets of all other words.  A word of a bucket then follows with its smoothed share of the bucket's tokens, so the
  model is a proper distribution over words of any vocabulary.
* States.  Baum-Welch: each pass runs scaled forward-backward recursions over all training tokens, each text whole from
  its first token to its end, sums expected counts by symbol within a task, then across partitions; a bounded table
  (symbols by states) comes back to the driver for the next pass.
* Scores.  The scaled forward recursion gives the exact likelihood of every whole text.  Counts of the commonest words
  (about `MAX_KNOWN` at most) are broadcast; the other words of each text are joined with the table of counts.

Defined cases: null and empty texts are one end token; a null doc_id is not held out; rows that repeat a doc_id are
texts of their own; without training rows every count is 0 and the states are as at the start; extra columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bytesx as B
from tessera.llm.op06_toxicity import held_out
from tessera.llm.shared import stored

STATES = 6
PASSES = 4
CELLS = 1 << 18  # positions of texts whose states are kept together in training
MAX_OWN = 1 << 14
MAX_KNOWN = 1 << 18
BUCKETS = 1 << 12
_END = np.int64(-0x5E4D5E4D)
_PRIOR = 2000.0  # tokens of the unigram distribution that smooth each state


def _tokens(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of all tokens of the texts in one buffer, in order, with the ends."""
    low = np.take(B.LOWER, buf)
    starts, ends, doc = B.words(low, offsets)
    n = len(offsets) - 1
    count = np.bincount(doc, minlength=n)
    last = np.cumsum(count + 1) - 1
    keys = np.full(len(starts) + n, _END, np.int64)
    inner = np.ones(len(keys), bool)
    inner[last] = False
    keys[inner] = B.as_long(B.Roll(low).of(starts, ends))
    return keys, np.repeat(np.arange(n), count + 1)


def _sum_keys(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, back = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(back, np.concatenate([n for _, n in parts]), len(keys)).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts: list[tuple[np.ndarray, np.ndarray]] = []
    held = 0

    def out() -> pa.RecordBatch:
        keys, n = _sum_keys(parts)
        return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], names=["key", "c"])

    for batch in batches:
        buf, offsets = B.buffer(batch.column(0))
        for lo, hi in B.chunks(offsets):
            parts.append(np.unique(_tokens(*B.chunked(buf, offsets, lo, hi))[0], return_counts=True))
            held += len(parts[-1][0])
            if held > 1_500_000:
                parts = [_sum_keys(parts)]
                held = len(parts[0][0])
                if held > 750_000:
                    yield out()
                    parts, held = [], 0
    if parts:
        yield out()


def _commonest(histogram: list, most: int) -> Column:
    """Which words (key, level) are about the `most` commonest: all of the upper levels, and of the level at the border a share by hash."""
    total = 0
    for r in sorted(histogram, key=lambda r: -r["level"]):
        if total + r["n"] > most:
            border = (F.col("level") == r["level"]) & (F.pmod(F.shiftright("key", 30), F.lit(1 << 20)) < int((most - total) / r["n"] * (1 << 20)))
            return (F.col("level") > r["level"]) | border
        total += r["n"]
    return F.lit(True)


class Vocabulary:
    """Counts of the commonest words, the symbols of the model and the totals of the buckets; all of bounded size."""

    def __init__(self, counts: DataFrame, most_known: int = MAX_KNOWN, most_own: int = MAX_OWN):
        level = F.floor(F.log2(F.col("c").cast("double")) * 8).cast("int")
        leveled = counts.withColumn("level", level)
        histogram = leveled.groupBy("level").agg(F.count(F.lit(1)).alias("n"), F.sum("c").alias("c")).collect()
        self.n_tokens, self.n_types = sum(r["c"] for r in histogram), sum(r["n"] for r in histogram)
        known, own = _commonest(histogram, most_known), _commonest(histogram, most_own)
        table = leveled.where((known | own) & (F.col("key") != int(_END))).select("key", "c", own.alias("own")).toArrow()
        keys, order = np.unique(table["key"].to_numpy(), return_index=True)
        self.keys, self.counts = keys, table["c"].to_numpy()[order]
        own_flag = table["own"].to_numpy(zero_copy_only=False).astype(bool)[order]
        self.n_own = int(own_flag.sum())
        self.symbols = np.where(own_flag, np.cumsum(own_flag) - 1, self.n_own + (keys & (BUCKETS - 1))).astype(np.int32)
        self.end = self.n_own + BUCKETS
        self.size = self.end + 1
        bucket = F.col("key").bitwiseAND(F.lit(BUCKETS - 1).cast("long")).cast("int")
        rest = leveled.where(~own & (F.col("key") != int(_END))).groupBy(bucket.alias("b")).agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("v")).collect()
        total, types = np.zeros(BUCKETS), np.zeros(BUCKETS)
        for r in rest:
            total[r["b"]], types[r["b"]] = r["c"], r["v"]
        self.bucket_log = np.log10(total + 0.1 * (types + 1))
        self.unigram = np.zeros(self.size)
        self.unigram[: self.n_own] = self.counts[own_flag]
        self.unigram[self.n_own : self.end] = total
        ends = counts.where(F.col("key") == int(_END)).agg(F.sum("c")).first()[0]
        self.n_ends = int(ends or 0)
        self.unigram[self.end] = self.n_ends
        self.unigram = (self.unigram + 0.1) / (self.unigram + 0.1).sum()
        self.base_log = float(np.log10(self.n_tokens + 0.1 * (self.n_types + 1)))

    def read(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbol and count of each token; count -1 for a word outside the broadcast ones."""
        end = keys == _END
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            hit = (self.keys[at] == keys) & ~end
            symbol = np.where(hit, self.symbols[at], self.n_own + (keys & (BUCKETS - 1)))
            count = np.where(hit, self.counts[at], -1)
        else:
            symbol, count = self.n_own + (keys & (BUCKETS - 1)), np.full(len(keys), -1)
        return np.where(end, self.end, symbol).astype(np.int32), np.where(end, self.n_ends, count)


_ENCODED = "doc_id long, held_out boolean, symbols array<int>, known_tokens long, known_log double, inner_log double, rest array<struct<key:long,n:int>>"


def _encode(vocabulary, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
    v: Vocabulary = vocabulary.value
    for batch in batches:
        buf, offsets = B.buffer(batch.column(2))
        for lo, hi in B.chunks(offsets):
            keys, doc = _tokens(*B.chunked(buf, offsets, lo, hi))
            n = hi - lo
            symbol, count = v.read(keys)
            cuts = np.zeros(n + 1, np.int32)
            np.cumsum(np.bincount(doc, minlength=n), out=cuts[1:])
            here = count >= 0
            log_count = np.log10(count[here] + 0.1)
            known_log = np.bincount(doc[here], log_count - v.base_log, n).astype(float)
            in_bucket = here & (symbol >= v.n_own) & (symbol < v.end)
            inner = np.log10(count[in_bucket] + 0.1) - v.bucket_log[symbol[in_bucket] - v.n_own]
            inner_log = np.bincount(doc[in_bucket], inner, n).astype(float)
            far = np.flatnonzero(~here)
            order = far[np.lexsort((keys[far], doc[far]))]
            new = np.ones(len(order), bool)
            new[1:] = (keys[order][1:] != keys[order][:-1]) | (doc[order][1:] != doc[order][:-1])
            first = np.flatnonzero(new)
            times = np.diff(np.append(first, len(order))).astype(np.int32)
            rest_cuts = np.zeros(n + 1, np.int32)
            np.cumsum(np.bincount(doc[order][first], minlength=n), out=rest_cuts[1:])
            rest = pa.StructArray.from_arrays([pa.array(keys[order][first]), pa.array(times)], names=["key", "n"])
            part = batch.slice(lo, n)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.ListArray.from_arrays(pa.array(cuts), pa.array(symbol)), pa.array(np.bincount(doc[here & (count > 0)], minlength=n)), pa.array(known_log), pa.array(inner_log), pa.ListArray.from_arrays(pa.array(rest_cuts), rest)],
                names=["doc_id", "held_out", "symbols", "known_tokens", "known_log", "inner_log", "rest"],
            )


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    offsets = column.offsets.to_numpy().astype(np.int64)
    values = column.values.to_numpy()[offsets[0] : offsets[-1]] if len(column) else np.zeros(0, np.int32)
    return values, offsets - (offsets[0] if len(offsets) else 0)


class Model:
    """Start, transition and emission probabilities (symbols by states)."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, emit

    @classmethod
    def initial(cls, unigram: np.ndarray, states: int = STATES, seed: int = 7) -> Model:
        """Sticky states around the unigram distribution, told apart by seeded noise."""
        random = np.random.default_rng(seed)
        emit = unigram[:, None] * np.exp(random.normal(0, 1, (len(unigram), states)))
        move = np.full((states, states), 0.1 / max(1, states - 1))
        np.fill_diagonal(move, 0.9)
        return cls(np.full(states, 1 / states), move / move.sum(1, keepdims=True), emit / emit.sum(0))

    @classmethod
    def estimated(cls, start: np.ndarray, move: np.ndarray, emit: np.ndarray, unigram: np.ndarray) -> Model:
        """From expected counts, each smoothed by a small prior."""
        emit = emit + _PRIOR * unigram[:, None]
        return cls((start + 1) / (start + 1).sum(), (move + 1) / (move + 1).sum(1, keepdims=True), emit / emit.sum(0))

    def log10(self, symbols: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Exact log-likelihood of every sequence by the scaled forward recursion; sequences advance together."""
        length = np.diff(offsets)
        order = np.argsort(-length, kind="stable")
        starts, length = offsets[:-1][order], length[order]
        total = np.zeros(len(order))
        active = int((length > 0).sum())
        if not active:
            return total
        alpha = np.broadcast_to(self.start, (active, len(self.start)))
        falls = np.searchsorted(-length, -np.arange(1, length[0] + 1), "right")
        for t in range(int(length[0])):
            active = int(falls[t])
            alpha = (alpha[:active] @ self.move if t else alpha[:active]) * self.emit[symbols[starts[:active] + t]]
            scale = alpha.sum(1)
            alpha = alpha / scale[:, None]
            total[:active] += np.log10(scale)
        out = np.empty(len(total))
        out[order] = total
        return out

    def expected(self, symbols: np.ndarray, offsets: np.ndarray, counts: list[np.ndarray], cells: int = CELLS) -> None:
        """Adds expected starts, moves and emissions of whole sequences to counts.

        Sequences of like length advance together; of a longest one above `cells` forward states are kept at the ends of
        pieces only, and made again piece by piece on the way back.
        """
        length = np.diff(offsets)
        order = np.argsort(-length, kind="stable")
        order = order[length[order] > 0]
        emit, move = self.emit.astype(np.float32), self.move.astype(np.float32)
        emit = np.concatenate([emit, np.ones((1, emit.shape[1]), np.float32)])
        back, start, k, pad = move.T.copy(), self.start.astype(np.float32), len(self.start), len(self.emit)
        moves = np.zeros((k, k), np.float64)
        lo = 0
        while lo < len(order):
            block = order[lo : lo + max(1, cells // int(length[order[lo]]))]
            lo += len(block)
            begin, size = offsets[block], length[block]
            active = np.searchsorted(-size, -np.arange(1, int(size[0]) + 1), "right").tolist()
            pieces = [(a, min(a + cells, int(size[0]))) for a in range(0, int(size[0]), cells)]

            def forward(a: int, b: int, now: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
                """Symbols, emissions over scale, and scaled forward states of positions a to b - 1, after the states before a."""
                at = np.arange(a, b)[:, None]
                x = np.where(at < size[: active[a]], symbols[np.minimum(begin[: active[a]] + at, len(symbols) - 1)], pad)  # noqa: B023
                seen = emit[x]
                alpha = np.zeros_like(seen)
                for t in range(b - a):
                    m = active[a + t]  # noqa: B023
                    now = start * seen[t, :m] if now is None else (now[:m] @ move) * seen[t, :m]
                    scale = now.sum(1, keepdims=True)
                    now /= scale
                    seen[t, :m] /= scale
                    alpha[t, :m] = now
                return x, seen, alpha

            ends: list[np.ndarray | None] = [None]
            for a, b in pieces[:-1]:
                ends.append(forward(a, b, ends[-1])[2][-1])
            beta = np.ones((len(block), k), np.float32)
            for (a, b), before in zip(pieces[::-1], ends[::-1], strict=True):
                x, seen, alpha = forward(a, b, before)
                for t in range(b - a - 1, -1, -1):
                    m = active[a + t]
                    ahead = seen[t, :m] * beta[:m]
                    alpha[t, :m] *= beta[:m]
                    if t or before is not None:
                        prior = alpha[t - 1, :m] if t else before[:m]
                        moves += prior.T @ ahead
                        beta[:m] = ahead @ back
                if before is None:
                    counts[0] += alpha[0].sum(0)
                flat = x.ravel()
                for s in range(k):
                    counts[2][:, s] += np.bincount(flat, alpha[:, :, s].ravel(), pad + 1)[:pad]
        counts[1] += moves * move


def baum_welch(encoded: DataFrame, model: Model, unigram: np.ndarray) -> Model:
    """One pass over all training sequences: expected counts by task, summed across partitions, then a new model."""
    spark, states, size = encoded.sparkSession, len(model.start), len(model.emit)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = [np.zeros(states), np.zeros((states, states)), np.zeros((size, states))]
        for batch in batches:
            shared.value.expected(*_lists(batch.column(0)), counts)
        # rows -1 - i: the moves from state i; row -1 - states: the starts
        table = np.concatenate([counts[2], counts[1], counts[0][None]])
        row = np.concatenate([np.arange(size), -1 - np.arange(states + 1)]).astype(np.int32)
        keep = table.sum(1) > 0
        yield pa.RecordBatch.from_arrays([pa.array(row[keep]), *[pa.array(table[keep, s]) for s in range(states)]], names=["row", *[f"s{s}" for s in range(states)]])

    names = [f"s{s}" for s in range(states)]
    summed = (
        encoded.where(~F.col("held_out")).select("symbols").mapInArrow(run, "row int, " + ", ".join(f"{x} double" for x in names))
        .groupBy("row").agg(*[F.sum(x).alias(x) for x in names]).toArrow()
    )
    row = summed["row"].to_numpy()
    values = np.stack([summed[x].to_numpy() for x in names], 1) if summed.num_rows else np.zeros((0, states))
    start, move, emit = np.zeros(states), np.zeros((states, states)), np.zeros((size, states))
    emit[row[row >= 0]] = values[row >= 0]
    for r, v in zip(row[row < 0], values[row < 0], strict=True):
        if r == -1 - states:
            start = v
        else:
            move[-1 - r] = v
    shared.unpersist()
    return Model.estimated(start, move, emit, unigram)


class Fitted(NamedTuple):
    """What training gives: the vocabulary and the model, the table of counts (key, c) and every row of docs as symbols."""

    vocabulary: Vocabulary
    model: Model
    counts: DataFrame
    encoded: DataFrame


def fit(docs: DataFrame, states: int = STATES, passes: int = PASSES) -> Fitted:
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id"), 10, 0).alias("held_out"), F.col("text").cast("string").alias("text"))
    counts, _ = stored(rows.where(~F.col("held_out")).select("text").mapInArrow(_count, "key long, c long").groupBy("key").agg(F.sum("c").alias("c")), "hmm-counts")
    vocabulary = Vocabulary(counts)
    shared = spark.sparkContext.broadcast(vocabulary)
    encoded, _ = stored(rows.mapInArrow(lambda it: _encode(shared, it), _ENCODED).withColumn("row", F.monotonically_increasing_id()), "hmm-encoded")
    model = Model.initial(vocabulary.unigram, states)
    if vocabulary.n_tokens:
        for _ in range(passes):
            model = baum_welch(encoded, model, vocabulary.unigram)
    return Fitted(vocabulary, model, counts, encoded)


def score(docs: DataFrame, states: int = STATES, passes: int = PASSES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row of docs."""
    spark = docs.sparkSession
    vocabulary, model, counts, encoded = fit(docs, states, passes)
    final = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            symbols, offsets = _lists(batch.column(batch.schema.get_field_index("symbols")))
            rest = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(np.diff(offsets)), pa.array(final.value.log10(symbols, offsets))], names=[*batch.schema.names[:-1], "n_tokens", "model_log"])

    columns = ["row", "doc_id", "held_out", "known_tokens", "known_log", "inner_log"]
    scored = encoded.select(*columns, "symbols").mapInArrow(run, "row long, doc_id long, held_out boolean, known_tokens long, known_log double, inner_log double, n_tokens long, model_log double")

    buckets = spark.createDataFrame([(i, float(x)) for i, x in enumerate(vocabulary.bucket_log)], "b int, bucket_log double")
    c = F.log10(F.coalesce("c", F.lit(0)) + F.lit(0.1))
    far = (
        encoded.select("row", F.explode("rest").alias("r")).select("row", "r.key", "r.n")
        .join(counts, "key", "left").withColumn("b", F.col("key").bitwiseAND(F.lit(BUCKETS - 1).cast("long")).cast("int")).join(F.broadcast(buckets), "b")
        .groupBy("row").agg(
            F.sum(F.col("n") * (c - F.lit(vocabulary.base_log))).alias("far_log"),
            F.sum(F.col("n") * (c - F.col("bucket_log"))).alias("far_inner"),
            F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("far_known"),
        )
    )
    zero = F.lit(0.0)
    return scored.join(far, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known_tokens") + F.coalesce("far_known", F.lit(0))).cast("long").alias("n_known"), F.lit(vocabulary.n_tokens).cast("long").alias("train_tokens"),
        (F.col("known_log") + F.coalesce("far_log", zero)).alias("base_score"), (F.col("model_log") + F.col("inner_log") + F.coalesce("far_inner", zero)).alias("score"),
    )


def op1_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"))
