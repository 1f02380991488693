"""Exact repeats of `LENGTH` bytes: suffixes ordered by a depth-limited radix sort, most significant digit first.

Every byte that a LENGTH-byte string covers which also starts earlier (in a document of smaller doc_id, or earlier in
the same one) is removed.  Suffixes are told apart through their first LENGTH bytes only, and a pass goes on with only
those that the pass before left undecided.

* First digit, dealing suffixes into buckets.  Each string of LENGTH bytes (a window) has a least hash among its
  `DIGIT`-byte strings; equal windows have it at the same place.  All windows around one such place, the anchor (about one
  for 30 bytes), are dealt together by the anchor's DIGIT bytes, as equal windows have equal ones.  So one row stands for
  about 30 suffixes, and a bucket of one anchor is done.
* Second digit: all bytes that the windows of an anchor cover.  Anchors equal in both digits but the first in order
  repeat as a whole and are removed.  Both digits are 64-bit hashes and have to agree, 128 bits.
* Further digits, in buckets whose second digits differ (the ends of repeats): the suffixes are ordered by their bytes,
  eight a pass, most significant first.  Groups of one leave after each pass; groups that are left after LENGTH bytes
  are exactly the repeated windows, and all but the first of each go.

No bucket meets in one task.  A chunk of texts drops its own repeats and reports a bucket with several second digits by one
row, so before the byte passes a bucket has one row a chunk at most.  Buckets of more than `HOT` anchors are dealt anew by
whole windows, again one row a chunk.  Texts are only shuffled for documents that pass a bitmap of those concerned.

Defined cases: null texts are empty; texts shorter than LENGTH lose nothing; null doc_ids come last in order, and rows
that repeat a doc_id are ordered by a hash of their bytes, then by the bytes (rows equal in both keep the order in which
Spark sorts them); extra columns may be carried; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bytesx as B
from tessera.llm import sieve
from tessera.llm.shared import carry, stored

LENGTH = 100
DIGIT = 44
HOT = 512
_HELD = 1 << 17  # anchors that a task holds before it deals them
_PLACE = np.uint64(31)  # bits of a place in a chunk; the same for all chunks, so that equal windows choose alike


def anchors(buf: np.ndarray, offsets: np.ndarray, length: int = LENGTH, digit: int = DIGIT) -> tuple[np.ndarray, ...]:
    """Text number, first digit, second digit, first and last window start of every anchor of a buffer's texts."""
    n = len(buf) - digit + 1
    wide = length - digit + 1
    sizes = np.diff(offsets)
    if n < wide or (sizes < length).all():
        empty = np.zeros(0, np.int64)
        return empty, empty.view(np.uint64), empty.view(np.uint64), empty, empty
    roll = B.Roll(buf)
    at = np.arange(n)
    first = roll.of(at, at + digit)
    least = ((first >> _PLACE) << _PLACE) | at.astype(np.uint64)
    size = 1
    while size * 2 <= wide:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if size < wide:
        least = np.minimum(least[: len(least) - (wide - size)], least[wide - size :])
    fits = np.zeros(len(buf) + 1, np.int8)
    whole = np.flatnonzero(sizes >= length)
    fits[offsets[whole]] += 1
    fits[offsets[whole + 1] - length + 1] -= 1
    starts = np.flatnonzero(np.cumsum(fits[: len(least)]))
    anchor = (least[starts] & ((np.uint64(1) << _PLACE) - np.uint64(1))).astype(np.int64)
    new = np.ones(len(starts), bool)
    new[1:] = anchor[1:] != anchor[:-1]
    cut = np.flatnonzero(new)
    begin, end, anchor = starts[cut], starts[np.append(cut[1:], len(starts)) - 1], anchor[cut]
    second = B.mix(roll.of(begin, end + length) + (anchor - begin).astype(np.uint64))
    return B.owner(begin, offsets), first[anchor], second, begin, end


_DEALT = "key long, second long, doc long, place long"
_FRESH, _SEVERAL, _REPEAT, _OPEN = range(4)


def _deal(first: np.ndarray, second: np.ndarray, doc: np.ndarray, begin: np.ndarray, end: np.ndarray) -> pa.RecordBatch:
    """Rows for the shuffle: key to deal by, second digit, document, and place (first window start, number of them, kind).

    An anchor that is alone with its second digit in its bucket of this chunk is dealt by its first digit (_FRESH).  What
    the chunk knows itself is dealt by document: repeats (_REPEAT), and anchors of buckets with several second digits
    (_OPEN, with the first digit as second), for which one row more tells their bucket (_SEVERAL).
    """
    order = np.lexsort((begin, doc, second, first))
    first, second, doc, begin, end = first[order], second[order], doc[order], begin[order], end[order]
    turn = np.ones(len(order), bool)
    turn[1:] = first[1:] != first[:-1]
    new = turn.copy()
    new[1:] |= second[1:] != second[:-1]
    several = np.bincount(np.cumsum(turn) - 1, new)[np.cumsum(turn) - 1] > 1 if len(order) else turn
    kind = np.where(new, np.where(several, _OPEN, _FRESH), _REPEAT)
    key = np.where(kind == _FRESH, B.as_long(first), B.as_long(B.mix(doc.view(np.uint64))))
    tell = np.where(kind == _OPEN, B.as_long(first), np.where(kind == _FRESH, B.as_long(second), 0))
    place = (begin << 16) | ((end - begin + 1) << 2) | kind
    told = B.as_long(first[turn & several])
    none = np.zeros(len(told), np.int64)
    columns = [(key, told), (tell, none + np.iinfo(np.int64).min), (doc, none), (place, none + _SEVERAL)]
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in columns], names=["key", "second", "doc", "place"])


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, ...]] = []
    for batch in batches:
        buf, offsets = B.buffer(batch.column(1))
        ids = batch.column(0).to_numpy()
        for lo, hi in B.chunks(offsets):
            part, cuts = B.chunked(buf, offsets, lo, hi)
            text, first, second, begin, end = anchors(part, cuts)
            held.append((first, second, ids[lo:hi][text], begin - cuts[text], end - cuts[text]))
            if sum(len(h[0]) for h in held) > _HELD:
                yield _deal(*(np.concatenate(x) for x in zip(*held, strict=True)))
                held = []
    if held:
        yield _deal(*(np.concatenate(x) for x in zip(*held, strict=True)))


_SORTED = "doc long, begin int, end int, removed boolean, first long"


def _decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reads rows sorted by key, second digit and order: gives repeats, and (not removed) the anchors of buckets with several second digits."""
    state = None  # first, second, whether their bucket has several second digits, and a row not yet given
    for batch in batches:
        first, second, doc, place = (batch.column(i).to_numpy() for i in range(4))
        begin, kind = place >> 16, place & 3
        end = begin + ((place >> 2) & 0x3FFF) - 1
        known = kind == _REPEAT
        out = [(doc[known], begin[known], end[known], True, 0)]
        known = kind == _OPEN
        out.append((doc[known], begin[known], end[known], False, second[known]))
        dealt = kind <= _SEVERAL
        first, second, doc, begin, end, told = (x[dealt] for x in (first, second, doc, begin, end, kind == _SEVERAL))
        if len(first):
            ghost = state is not None
            if ghost:
                row = state[3] if state[3] is not None else (0, 0, 0)
                first, second, told = np.append(state[0], first), np.append(state[1], second), np.append(False, told)
                doc, begin, end = (np.append(np.array(x, y.dtype), y) for x, y in zip(row, (doc, begin, end), strict=True))
            turn = np.ones(len(first), bool)
            turn[1:] = first[1:] != first[:-1]
            new = turn.copy()
            new[1:] |= second[1:] != second[:-1]
            out.append((doc[~new & ~told], begin[~new & ~told], end[~new & ~told], True, 0))
            group = np.cumsum(turn) - 1
            several = np.bincount(group, np.where(told, 2, new)) > 1
            if ghost:
                several[0] |= state[2]
            give = new & ~told & several[group]
            if ghost and state[3] is None:
                give[0] = False
            out.append((doc[give], begin[give], end[give], False, first[give]))
            last = int(np.flatnonzero(new)[-1])
            waits = not several[-1]
            state = (first[-1], second[-1], bool(several[-1]), (doc[last], begin[last], end[last]) if waits else None)
        for d, b, e, removed, f in out:
            if len(d):
                yield pa.RecordBatch.from_arrays([pa.array(d), pa.array(b.astype(np.int32)), pa.array(e.astype(np.int32)), pa.array(np.full(len(d), removed)), pa.array(np.broadcast_to(f, len(d)).copy())], names=["doc", "begin", "end", "removed", "first"])


_SUFFIXES = "key long, doc long, begin int, size int, bytes binary"


def _gather(buf: np.ndarray, start: np.ndarray, size: np.ndarray) -> pa.Array:
    """The byte ranges of a buffer, as binary values."""
    cuts = np.concatenate([[0], np.cumsum(size)])
    if len(size) and (size == LENGTH).all():
        held = np.lib.stride_tricks.sliding_window_view(buf, LENGTH)[start]
    else:
        held = buf[np.repeat(start - cuts[:-1], size) + np.arange(cuts[-1])]
    return pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(cuts.astype(np.int32).tobytes()), pa.py_buffer(held.tobytes())])


def _suffix_rows(hot):  # noqa: ANN001, ANN202
    """Texts with undecided anchors (begin, end, first): for each the bytes of its windows, dealt by first digit; of hot ones each window, by a hash of its bytes."""

    def rows(part: np.ndarray, key: np.ndarray, doc: np.ndarray, start: np.ndarray, begin: np.ndarray, size: np.ndarray, held: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Rows with `held` bytes from `start` in the chunk."""
        for lo in range(0, len(key), 4096):
            at = slice(lo, lo + 4096)
            columns = [B.as_long(key[at]), doc[at], begin[at].astype(np.int32), size[at].astype(np.int32), _gather(part, start[at], held[at])]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns[:4]] + columns[4:], names=["key", "doc", "begin", "size", "bytes"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = B.buffer(batch.column(1))
            ids, lists = batch.column(0).to_numpy(), batch.column(2)
            for lo, hi in B.chunks(offsets):
                part, cuts = B.chunked(buf, offsets, lo, hi)
                held = lists.slice(lo, hi - lo)
                spans, of = held.flatten(), np.repeat(np.arange(hi - lo), np.diff(held.offsets.to_numpy()))
                begin, first = spans.field(0).to_numpy() + cuts[of], spans.field(2).to_numpy().view(np.uint64)
                count = spans.field(1).to_numpy() + cuts[of] - begin + 1
                many = sieve.passes(hot.value, first)
                cold = ~many
                yield from rows(part, first[cold], ids[lo:hi][of[cold]], begin[cold], begin[cold] - cuts[of[cold]], count[cold], count[cold] + LENGTH - 1)
                begin, count, of = begin[many], count[many], of[many]
                if not len(begin):
                    continue
                start = np.repeat(begin - np.cumsum(count) + count, count) + np.arange(count.sum())
                text = np.repeat(of, count)
                window = B.Roll(part).of(start, start + LENGTH)
                tail = B.Roll(part ^ np.uint8(0x5A)).of(start, start + LENGTH)
                doc = ids[lo:hi][text]
                order = np.lexsort((start, doc, tail, window))
                new = np.ones(len(order), bool)
                new[1:] = (window[order][1:] != window[order][:-1]) | (tail[order][1:] != tail[order][:-1])
                for at, size in ((order[new], 1), (order[~new], -1)):
                    key = window[at] if size > 0 else B.mix(doc[at].view(np.uint64))
                    yield from rows(part, key, doc[at], start[at], start[at] - cuts[text[at]], np.full(len(at), size), np.full(len(at), LENGTH if size > 0 else 0))

    return run


def repeats(buf: np.ndarray, start: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Which windows of LENGTH bytes (by start in buf, in order) equal an earlier one of their group: radix passes over eight bytes each, the most significant first."""
    digits = np.zeros(max(0, len(buf) - 7), np.uint64)
    for i in range(8):
        digits = (digits << np.uint64(8)) | buf[i : len(buf) - 7 + i]
    index, bucket = np.arange(len(start)), group
    for depth in [*range(0, LENGTH - 8, 8), LENGTH - 8]:
        if not len(index):
            break
        digit = digits[start[index] + depth]
        order = np.lexsort((digit, bucket))
        digit, bucket, index = digit[order], bucket[order], index[order]
        new = np.ones(len(order) + 1, bool)
        new[1:-1] = (digit[1:] != digit[:-1]) | (bucket[1:] != bucket[:-1])
        stays = ~(new[:-1] & new[1:])  # not alone in its bucket
        bucket, index = np.cumsum(new[:-1])[stays], index[stays]
    later = np.zeros(len(start), bool)
    later[index[1:][bucket[1:] == bucket[:-1]]] = True
    return later


def _byte_passes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reads rows sorted by key and order; gives ranges of window starts that repeat."""

    def give(doc: np.ndarray, begin: np.ndarray, end: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(doc):
            yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(begin.astype(np.int32)), pa.array(end.astype(np.int32))], names=["doc", "begin", "end"])

    def decide(rows: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row and start (in its bytes) of every window of the rows, and whether it repeats."""
        key, size = rows.column(0).to_numpy(), rows.column(3).to_numpy().astype(np.int64)
        offsets = np.frombuffer(rows.column(4).buffers()[1], np.int32)[rows.column(4).offset :][: rows.num_rows + 1].astype(np.int64)
        buf = np.frombuffer(rows.column(4).buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
        row = np.repeat(np.arange(rows.num_rows), size)
        at = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
        group = np.cumsum(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else key
        return row, at, repeats(buf, offsets[row] - offsets[0] + at, group[row])

    def ranges(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        row, at, later = decide(rows)
        row, at = row[later], at[later]
        edge = np.ones(len(row) + 1, bool)
        edge[1:-1] = (row[1:] != row[:-1]) | (at[1:] != at[:-1] + 1)
        low, high = np.flatnonzero(edge[:-1]), np.flatnonzero(edge[1:])
        begin = rows.column(2).to_numpy().astype(np.int64)
        yield from give(rows.column(1).to_numpy()[row[low]], begin[row[low]] + at[low], begin[row[high]] + at[high])

    def joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        return pa.Table.from_batches(parts).combine_chunks().to_batches()[0]

    wait: list[pa.RecordBatch] = []  # rows of the last key, of which more may come
    for batch in (whole.slice(lo, 2048) for whole in batches for lo in range(0, whole.num_rows, 2048)):
        size = batch.column(3).to_numpy()
        known = size < 0
        doc, begin = batch.column(1).to_numpy()[known], batch.column(2).to_numpy()[known].astype(np.int64)
        yield from give(doc, begin, begin - size[known] - 1)
        batch = batch.filter(pa.array(~known))
        if not batch.num_rows:
            continue
        rows = joined([*wait, batch])
        key = rows.column(0).to_numpy()
        cut = int(np.searchsorted(key, key[-1])) if (key[1:] >= key[:-1]).all() else 0
        if cut:
            yield from ranges(rows.slice(0, cut))
        wait = [rows.slice(cut)]
        if (wait[0].column(3).to_numpy() == 1).all():  # whole windows: only the first of equal ones has to wait
            yield from ranges(wait[0])
            wait = [wait[0].filter(pa.array(~decide(wait[0])[2]))]
    if wait:
        yield from ranges(wait[0])


def _passing(docs: DataFrame, table, wanted: bool = True) -> DataFrame:  # noqa: ANN001
    """Rows of docs (with a column doc) whose document passes the bitmap, or (wanted false) does not."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = B.as_long(B.mix(batch.column(batch.schema.get_field_index("doc")).to_numpy().view(np.uint64)))
            yield batch.filter(pa.array(sieve.passes(table.value, keys) == wanted))

    return docs.mapInArrow(run, docs.schema)


def _bitmap(spans: DataFrame):  # noqa: ANN202
    keys = spans.select("doc").distinct().mapInArrow(
        lambda it: (pa.RecordBatch.from_arrays([pa.array(B.as_long(B.mix(b.column(0).to_numpy().view(np.uint64))))], names=["key"]) for b in it), "key long"
    )
    return sieve.build(keys, "key")


def _gathered(spans: DataFrame) -> DataFrame:
    return spans.groupBy("doc").agg(F.collect_list(F.struct(*[c for c in spans.columns if c != "doc"])).alias("spans"))


def _cut(whole_characters: bool):  # noqa: ANN202
    """Reads texts with the window starts to remove (null: none); gives the bytes that stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.schema.get_field_index("text")
            spans_at = batch.schema.get_field_index("spans")
            buf, offsets = B.buffer(batch.column(texts))
            lists = batch.column(spans_at)
            names = [x for x in batch.schema.names if x not in ("text", "spans")]
            for lo, hi in B.chunks(offsets):
                part, cuts = B.chunked(buf, offsets, lo, hi)
                held = lists.slice(lo, hi - lo).fill_null([])
                spans, of = held.flatten(), np.repeat(np.arange(hi - lo), np.diff(held.offsets.to_numpy()))
                edge = np.zeros(len(part) + 1, np.int32)
                np.add.at(edge, spans.field(0).to_numpy() + cuts[of], 1)
                np.add.at(edge, spans.field(1).to_numpy() + cuts[of] + LENGTH, -1)
                gone = np.cumsum(edge)[: len(part)] > 0
                starts, _ = B.runs(gone, cuts[1:-1])
                n_spans = np.bincount(B.owner(starts, cuts), minlength=hi - lo)
                before = np.concatenate([[0], np.cumsum(gone)])
                n_removed = before[cuts[1:]] - before[cuts[:-1]]
                if whole_characters and len(part):
                    lead = (part & 0xC0) != 0x80
                    lead[cuts[:-1][np.diff(cuts) > 0]] = True
                    character = np.cumsum(lead) - 1
                    gone = (np.bincount(character, gone) > 0)[character]
                    before = np.concatenate([[0], np.cumsum(gone)])
                left = part[~gone].tobytes()
                at = cuts - before[cuts]
                kept = pa.Array.from_buffers(pa.large_binary(), hi - lo, [None, pa.py_buffer(at.astype(np.int64).tobytes()), pa.py_buffer(left)]).cast(pa.binary())
                rows = batch.slice(lo, hi - lo)
                own = [rows.column(rows.schema.get_field_index(x)) for x in names]
                yield pa.RecordBatch.from_arrays([*own, pa.array(np.diff(cuts)), pa.array(n_removed), pa.array(n_spans), kept], names=[*names, "n_bytes", "n_removed", "n_spans", "kept"])

    return run


def remove_repeats(docs: DataFrame, keep: list[str] | None = None, prefix: str = "", whole_characters: bool = False) -> DataFrame:
    """Columns `keep` (default: doc_id) of docs, with n_bytes, n_removed, n_spans (maximal removed runs) and kept (binary), named with a prefix.

    With whole_characters, kept also leaves out the rest of characters that a removed run cuts, so that it is text again.
    docs needs doc_id and text.  A kept column that has the name of an added one is replaced by it.
    """
    made = ["n_bytes", "n_removed", "n_spans", "kept"]
    carried, added = carry(docs, keep or ["doc_id"], [f"{prefix}{x}" for x in made])
    rows = docs.select(F.col("doc_id").cast("long").alias("doc"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *[docs[c].alias(a) for a, c in carried.items()])
    if not rows.groupBy("doc").count().where((F.col("count") > 1) | F.col("doc").isNull()).isEmpty():
        ranked = rows.withColumn("h", F.xxhash64("text")).repartitionByRange(F.col("doc").asc_nulls_last(), "h").sortWithinPartitions(F.col("doc").asc_nulls_last(), "h", "text")
        rows, _ = stored(ranked.drop("doc", "h").withColumn("doc", F.monotonically_increasing_id()), "repeats-ranked")
    plain = rows.select("doc", "text")

    dealt = plain.mapInArrow(_anchor_rows, _DEALT).repartition("key").sortWithinPartitions("key", "second", "doc", "place")
    found, _ = stored(dealt.mapInArrow(_decide, _SORTED), "repeats-anchors")
    undecided = found.where(~F.col("removed")).select("doc", "begin", "end", "first")
    hot = sieve.build(undecided.groupBy("first").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT), "first")
    texts = _passing(plain, _bitmap(undecided)).join(_gathered(undecided), "doc").select("doc", "text", "spans")
    suffixes = texts.mapInArrow(_suffix_rows(hot), _SUFFIXES).repartition("key").sortWithinPartitions("key", "doc", "begin")
    windows, _ = stored(suffixes.mapInArrow(_byte_passes, "doc long, begin int, end int"), "repeats-windows")

    removed = found.where("removed").select("doc", "begin", "end").unionByName(windows)
    table = _bitmap(removed)
    names = ["doc", "text", *carried]
    cut = _passing(rows.select(*names), table).join(_gathered(removed), "doc", "left").select("text", "spans", *carried)
    kept = ", ".join([*[f"{a} {rows.schema[a].dataType.simpleString()}" for a in carried], "n_bytes long, n_removed long, n_spans long, kept binary"])
    whole = _passing(rows.select(*names), table, wanted=False).select(
        *carried, F.octet_length("text").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.col("text").cast("binary").alias("kept")
    )
    return cut.mapInArrow(_cut(whole_characters), kept).unionByName(whole).select(*[F.col(a).alias(c) for a, c in carried.items()], *[F.col(x).alias(y) for x, y in zip(made, added, strict=True)])


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
