"""MinHash near-duplicates: ProbMinHash signatures, banding, exact verification and classes.

A text is a weighted set: its five-word shingles (white space words, ASCII letters lowered; a shorter text is one
shingle) with the number of times each occurs.  The ProbMinHash signature has `SLOTS` places.  Every shingle is a
Poisson process whose rate is its weight; each arrival falls on a place at random, and the first arrival at a place
puts its shingle there.  A shingle's arrivals end once they come later than every place's first, so a long text needs
little more than one arrival a shingle.  Two places of two texts agree with the probability Jaccard similarity.

Plan.  Texts of equal words are one node from the start.  Signatures are cut into bands; nodes that share a band meet
in a bucket.  A bucket is never expanded into pairs: each member is compared with the bucket's least node, and the
pairs (at most one for each node and band) are verified with whole shingle vectors.  A bucket is undecided while its
members that were no hub lie in several components of these links.  Undecided buckets get another hub, a member of their largest
component, which is compared with the members of the others, as long as a round links many: so the texts of a large
family of near copies need not all be compared to become one component.  All pairs of members in different components that are undecided
then are decided by exact filters: shingles are ordered by the pairs that they would propose, and two texts at `least` share
one among the first of both; and the parity sketches of two such texts differ in few bits.  Both are bounds, so no pair at
`least` is lost.  Verified links become classes by distributed connected components.

Defined cases: texts without words (null, empty) are classes of their own; the class id is the least doc_id of a
class; rows with a null doc_id take part and are never the class id unless all are null; rows that repeat a doc_id
are nodes by their words and each gets its class; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm import bytesx as B
from tessera.llm import sieve
from tessera.llm.components import labels
from tessera.llm.shared import stored

WORDS = 5
SIMILARITY = 0.8
BANDS = 25
ROWS = 5
SLOTS = BANDS * ROWS
PARITY = 16  # longs of a parity sketch
GOES_ON = 10  # another hub for each undecided bucket, as long as a round gives a link for every so many undecided nodes
SALTS = 16  # sides repeated for each salt are merge-joined: their size before that says little


def shingles(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text number and hash of every shingle of the texts of a buffer; words and content hash of every text."""
    n = len(offsets) - 1
    low = np.take(B.LOWER, buf)
    starts, ends, doc = B.words(low, offsets)
    word = B.Roll(low).of(starts, ends)
    count = np.bincount(doc, minlength=n)
    first = np.cumsum(count) - count
    place = (np.arange(len(word)) - first[doc]).astype(np.uint64) if len(word) else np.zeros(0, np.uint64)
    sums = np.zeros(len(word) + 1, np.uint64)
    np.cumsum(B.mix(word + place * np.uint64(0x9E3779B97F4A7C15)), out=sums[1:])
    content = B.mix(sums[first + count] - sums[first] + B.mix(count.astype(np.uint64)))
    at = np.flatnonzero(place.astype(np.int64) + WORDS <= np.maximum(count[doc], WORDS)) if len(word) else np.zeros(0, np.int64)
    short = count[doc[at]] < WORDS
    at = at[~short | (place[at] == 0)]
    key = np.zeros(len(at), np.uint64)
    whole = count[doc[at]] >= WORDS
    for k in range(WORDS):
        key[whole] += B.mix(word[at[whole] + k] + np.uint64(k + 1))
    key[~whole] = content[doc[at[~whole]]]
    return doc[at], B.mix(key), count, content


def signatures(doc: np.ndarray, key: np.ndarray, weight: np.ndarray, n: int, slots: int = SLOTS) -> np.ndarray:
    """ProbMinHash of n weighted sets given as distinct (set, key) pairs with weights: an n by slots table of keys."""
    first = np.full(n * slots, np.inf)
    out = np.zeros(n * slots, np.uint64)
    time, wait, active, turn = np.zeros(len(key)), 1.0 / weight, np.arange(len(key)), 0
    while len(active):
        turn += 1
        random = B.mix(key[active] + np.uint64((turn * 0xA0761D6478BD642F) & ((1 << 64) - 1)))
        uniform = ((random >> np.uint64(12)).astype(np.float64) + 0.5) * 2.0**-52
        time[active] -= np.log(uniform) * wait[active]
        when = time[active]
        slot = doc[active] * slots + (B.mix(random) % np.uint64(slots)).astype(np.int64)
        better = when < first[slot]
        np.minimum.at(first, slot[better], when[better])
        won = better & (first[slot] == when)
        out[slot[won]] = key[active[won]]
        latest = first.reshape(n, slots).max(1) if n else np.zeros(0)
        active = active[when < latest[doc[active]]]
    return out.reshape(n, slots)


def _bands(table: np.ndarray) -> np.ndarray:
    mixed = B.mix(table.reshape(len(table), BANDS, ROWS) + np.arange(ROWS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return B.mix(mixed.sum(2, dtype=np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64))


def _weighted(doc: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, key) pairs, by text and key, with counts."""
    order = np.lexsort((key, doc))
    doc, key = doc[order], key[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    return doc[at], key[at], np.diff(np.append(at, len(key)))


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        buf, offsets = B.buffer(batch.column(1))
        for lo, hi in B.chunks(offsets):
            n = hi - lo
            doc, key, count, content = shingles(*B.chunked(buf, offsets, lo, hi))
            bands = B.as_long(np.ascontiguousarray(_bands(signatures(*_weighted(doc, key), n)))).ravel()
            cuts = np.zeros(n + 1, np.int32)
            np.cumsum(np.where(count > 0, BANDS, 0), out=cuts[1:])
            lists = pa.ListArray.from_arrays(pa.array(cuts), pa.array(bands[np.repeat(count > 0, BANDS)]))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, n), pa.array(B.as_long(content), mask=count == 0), lists], names=["doc_id", "node", "bands"])


def _marker(doc_id: np.ndarray, node: np.ndarray) -> np.ndarray:
    return B.as_long(B.mix(B.mix(doc_id.view(np.uint64)) ^ node.view(np.uint64)))


def similarities(pair: np.ndarray, key: np.ndarray, right: np.ndarray, n: int) -> np.ndarray:
    """Probability Jaccard similarity of n pairs of bags, given the pair, key and side of every key with repeats."""
    order = np.lexsort((key, pair))
    pair, key, right = pair[order], key[order], right[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (pair[1:] != pair[:-1])
    at = np.cumsum(new) - 1
    b = np.bincount(at, right, minlength=int(new.sum()))
    a = np.bincount(at, minlength=len(b)) - b
    pair = pair[new]
    with np.errstate(divide="ignore"):
        ratio = b / a
    order = np.lexsort((ratio, pair))
    pair, a, b, ratio = pair[order], a[order], b[order], ratio[order]
    # Of each key in both bags: the keys of its pair with at most its ratio weigh by a, the others by b.
    first = np.searchsorted(pair, np.arange(n + 1))
    last = np.ones(len(pair), bool)
    last[:-1] = (ratio[1:] != ratio[:-1]) | (pair[1:] != pair[:-1])
    upto = np.flatnonzero(last)[np.cumsum(last) - last]
    sum_a, sum_b = (np.concatenate([[0.0], np.cumsum(x)]) for x in (a, b))
    below = sum_a[upto + 1] - sum_a[first[pair]]
    above = sum_b[first[pair + 1]] - sum_b[upto + 1]
    both = (a > 0) & (b > 0)
    return np.bincount(pair[both], 1.0 / (below[both] / a[both] + above[both] / b[both]), minlength=n)


def _compare(least: float):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = [(c.offsets.to_numpy().astype(np.int64), c.values.to_numpy()) for c in (batch.column(2), batch.column(3))]
            sizes = sum(np.diff(o) for o, _ in sides)
            alike = [np.zeros(0)]
            for lo, hi in B.chunks(np.concatenate([[0], np.cumsum(sizes)])):
                held = [(np.diff(o[lo : hi + 1]), v[o[lo] : o[hi]]) for o, v in sides]
                pair = np.concatenate([np.repeat(np.arange(hi - lo), count) for count, _ in held])
                side = np.repeat([0, 1], [len(v) for _, v in held])
                alike.append(similarities(pair, np.concatenate([v for _, v in held]), side, hi - lo))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.concatenate(alike) >= least - 1e-9, pa.bool_())], names=["a", "b", "linked"])

    return run


def _vectors(wanted: DataFrame, nodes: DataFrame, rows: DataFrame, name: str) -> DataFrame:
    """node, vector (sorted shingle hashes with repeats) of the wanted nodes.

    Only texts that pass a bitmap of the wanted nodes' rows send a vector.
    """
    needed = nodes.join(wanted, "node", "left_semi").select("marker")
    table = sieve.build(needed, "marker")

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = B.buffer(batch.column(1))
            ids = batch.column(0).fill_null(-1).to_numpy()
            for lo, hi in B.chunks(offsets):
                doc, key, count, content = shingles(*B.chunked(buf, offsets, lo, hi))
                marker = _marker(ids[lo:hi], B.as_long(content))
                wanted = (count > 0) & sieve.passes(table.value, marker)
                keep = wanted[doc]
                doc, key = doc[keep], key[keep]
                order = np.lexsort((key, doc))
                cuts = np.zeros(int(wanted.sum()) + 1, np.int32)
                np.cumsum(np.bincount(doc, minlength=hi - lo)[wanted], out=cuts[1:])
                yield pa.RecordBatch.from_arrays([pa.array(marker[wanted]), pa.ListArray.from_arrays(pa.array(cuts), pa.array(B.as_long(key[order])))], names=["marker", "vector"])

    held = nodes.join(wanted, "node", "left_semi").select("node", "marker").distinct()
    return stored(held.join(rows.mapInArrow(vectors, "marker long, vector array<long>"), "marker").select("node", "vector"), f"{name}-vectors")[0]


def _verify(pairs: DataFrame, known: DataFrame, least: float, name: str) -> DataFrame:
    """pairs (a, b: nodes) with linked, from the whole shingle vectors of both texts."""
    joined = (
        pairs.join(known.withColumnsRenamed({"node": "a", "vector": "va"}), "a")
        .join(known.withColumnsRenamed({"node": "b", "vector": "vb"}), "b").select("a", "b", "va", "vb")
    )
    return stored(joined.mapInArrow(_compare(least), "a long, b long, linked boolean").distinct(), f"{name}-links")[0]


def _parity(text: np.ndarray, key: np.ndarray, n: int) -> np.ndarray:
    """For each of n texts, `PARITY` longs of bits: the parity of the number of its distinct keys that hash there."""
    bits = np.bincount(text * (64 * PARITY) + (B.mix(key.view(np.uint64)) % np.uint64(64 * PARITY)).astype(np.int64), minlength=n * 64 * PARITY) & 1
    return np.packbits(bits.astype(np.uint8).reshape(n, -1), axis=1, bitorder="little").view(np.int64)


_PARITIES = [f"o{i}" for i in range(PARITY)]
_PARITY_ROWS = "node long, total long, " + ", ".join(f"{x} long" for x in _PARITIES)


def _shingle_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (node, label, vector) as one row for each distinct key; and its number and the total of the text."""
    for batch in batches:
        offsets, values = batch.column(2).offsets.to_numpy().astype(np.int64), batch.column(2).values.to_numpy()
        for lo, hi in B.chunks(offsets):
            size = np.diff(offsets[lo : hi + 1])
            text, key, n = _weighted(np.repeat(np.arange(hi - lo), size), values[offsets[lo] : offsets[hi]])
            own = [batch.column(i).slice(lo, hi - lo).take(pa.array(text)) for i in range(2)]
            yield pa.RecordBatch.from_arrays([*own, pa.array(size[text]), pa.array(key), pa.array(n)], names=["node", "label", "total", "key", "n"])


def _parity_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        offsets, values = batch.column(1).offsets.to_numpy().astype(np.int64), batch.column(1).values.to_numpy()
        for lo, hi in B.chunks(offsets):
            size = np.diff(offsets[lo : hi + 1])
            text, key, _ = _weighted(np.repeat(np.arange(hi - lo), size), values[offsets[lo] : offsets[hi]])
            table = _parity(text, key, hi - lo)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(size), *(pa.array(np.ascontiguousarray(c)) for c in table.T)], names=["node", "total", *_PARITIES])


def _near(least: float) -> Column:
    """Whether total and parity sketch of two bags (the other's columns begin with y_) let them be alike; see `_proposed`."""
    differ = sum((F.bit_count(F.col(x).bitwiseXOR(F.col(f"y_{x}"))) for x in _PARITIES[1:]), F.bit_count(F.col("o0").bitwiseXOR(F.col("y_o0"))))
    return differ <= (1 - least) / (1 + least) * 2 * F.greatest("total", "y_total") + 1e-6


def _undecided(inside: DataFrame, found: DataFrame) -> DataFrame:
    """Rows (bucket, node) of buckets whose nodes lie in several components (found: node, label), with the label."""
    placed = inside.join(found, "node", "left").select("bucket", "node", F.coalesce("label", "node").alias("label"))
    several = placed.groupBy("bucket").agg(F.min("label").alias("l"), F.max("label").alias("m")).where(F.col("l") != F.col("m")).select("bucket")
    return stored(placed.join(several, "bucket", "left_semi"), "near-open")[0]


def _dealt(undecided: DataFrame) -> tuple[DataFrame, DataFrame]:
    """For every bucket a hub in its largest component: its pairs (a, b) with the members of the others, and (bucket, node) without hubs."""
    parts = undecided.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("m"), F.min(F.struct(F.xxhash64("bucket", "node").alias("place"), "node")).alias("first"))
    hubs = parts.groupBy("bucket").agg(F.max(F.struct("m", "first.place", "label", "first.node")).alias("best")).select("bucket", F.col("best.label").alias("own"), F.col("best.node").alias("hub"))
    held = undecided.join(hubs, "bucket")
    pairs = held.where(F.col("label") != F.col("own")).select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()
    return pairs, held.where(F.col("node") != F.col("hub")).select("bucket", "node")


def _proposed(known: DataFrame, placed: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) of known nodes in different components (placed: node, label) that may be alike: every pair at `least` is among them.

    With P and Q the shares of two bags outside each other, the similarity is at most 2 / (f(P) + f(Q)) with
    f(x) = (1 + x) / (1 - x).  Two bounds follow, and a pair has to pass both.

    * Keys are ordered by the pairs that they would propose (in different components), fewest first.  What lies before
      the first common key of two bags in this order is outside the other, so the shares before it bound P and Q; each
      alone is at most 1 - least, which ends a bag's prefix.
    * Bits where two parity sketches differ are keys of one bag only (common keys cancel), so their number D is at most
      P and Q times the sizes, and, as f is convex, at most (1 - least) / (1 + least) times twice the larger size.
    """
    f = lambda x: (1 + x) / (1 - x)
    may = lambda p, q: f(F.col(p)) + f(F.col(q)) <= 2 / least + 1e-6
    keyed, _ = stored(known.join(placed, "node", "left").select("node", F.coalesce("label", "node").alias("label"), "vector").mapInArrow(_shingle_rows, "node long, label long, total long, key long, n long"), "near-keys")
    members = F.col("m").cast("double")
    common = (
        keyed.groupBy("key", "label").agg(F.count(F.lit(1)).alias("m"))
        .groupBy("key").agg((F.sum(members) ** 2 - F.sum(members * members)).alias("cost"), F.count(F.lit(1)).alias("labels")).where("labels > 1")
    )
    node = Window.partitionBy("node")
    before = F.sum("n").over(node.orderBy("cost", "key")) - F.col("n") + F.col("total") - F.sum("n").over(node)
    prefixes = keyed.join(common, "key").withColumn("p", before / F.col("total")).where(F.col("p") <= 1 - least + 1e-6).select("node", "label", "total", "key", "p")
    prefixes, _ = stored(prefixes.join(known.mapInArrow(_parity_rows, _PARITY_ROWS).drop("total"), "node"), "near-prefixes")

    sides = prefixes.groupBy("key", "label").agg(F.min("p").alias("p"), F.count(F.lit(1)).alias("m"))
    others = sides.select("key", F.col("label").alias("other"), F.col("p").alias("q"), F.col("m").alias("k"))
    met = sides.join(others, "key").where(may("p", "q") & (F.struct("m", "label") < F.struct("k", "other"))).select("key", "label", "other")
    reach = prefixes.join(met, ["key", "label"]).drop("label")
    there = prefixes.select("key", F.col("label").alias("other"), F.col("node").alias("y"), F.col("total").alias("y_total"), F.col("p").alias("q"), *[F.col(x).alias(f"y_{x}") for x in _PARITIES])
    both = reach.join(there, ["key", "other"]).where(may("p", "q") & _near(least))
    return both.select(F.least("node", "y").alias("a"), F.greatest("node", "y").alias("b")).distinct()


def _linked(pairs: DataFrame, known: DataFrame, found: DataFrame, least: float) -> tuple[DataFrame, DataFrame, int]:
    """Components (node, label) after the links among pairs, the pairs compared, and the number of links."""
    compared = _verify(pairs, known, least, "near-2")
    fresh = compared.where("linked").select("a", "b")
    n = fresh.count()
    return labels(found.select(F.col("node").alias("a"), F.col("label").alias("b")).unionByName(fresh)) if n else found, compared.select("a", "b"), n


def classes(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """doc_id and class_id for every row of docs."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sketches, _ = stored(rows.mapInArrow(_sketch, "doc_id long, node long, bands array<long>"), "near-sketches")

    # One node for equal words: its first document, and the row that stands for it.
    groups = sketches.where(F.col("node").isNotNull()).groupBy("node").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")
    copies = groups.where(F.col("n") > 1).select("node", "first_id", F.lit(True).alias("copied")).withColumn("salt", salts).hint("merge")
    held = sketches.withColumn("salt", salt).join(copies, ["node", "salt"], "left")
    own = held.where(F.col("node").isNotNull() & (F.col("copied").isNull() | F.col("doc_id").eqNullSafe(F.col("first_id"))))
    nodes, _ = stored(own.select("doc_id", "node", "bands").mapInArrow(_marked, "node long, first_id long, marker long, bands array<long>"), "near-nodes")

    banded = nodes.select("node", F.explode("bands").alias("bucket"))
    hubs = banded.groupBy("bucket").agg(F.min("node").alias("a"), F.max("node").alias("z")).where(F.col("a") != F.col("z")).select("bucket", "a")
    met, _ = stored(banded.join(hubs, "bucket").select("bucket", "a", F.col("node").alias("b")), "near-buckets")
    pairs, _ = stored(met.where(F.col("a") != F.col("b")).select("a", "b").distinct(), "near-pairs")
    paired = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    links = _verify(pairs, _vectors(paired, nodes, rows, "near-1"), least, "near-1")
    found = labels(links.where("linked").select("a", "b"))

    # A bucket whose members but its hubs are in one component is decided; what more hubs leave undecided is all compared.
    undecided = _undecided(met.where(F.col("a") != F.col("b")).select("bucket", F.col("b").alias("node")), found)
    if not undecided.isEmpty():
        known = _vectors(undecided.select("node").distinct(), nodes, rows, "near-2")
        parities, _ = stored(known.mapInArrow(_parity_rows, _PARITY_ROWS), "near-parities")
        ours, theirs = parities.withColumnRenamed("node", "a"), parities.select(F.col("node").alias("b"), *[F.col(x).alias(f"y_{x}") for x in ("total", *_PARITIES)])
        compared, goes_on = links.select("a", "b"), True
        while goes_on:
            many = undecided.select("node").distinct().count()
            dealt, inside = _dealt(undecided)
            more, _ = stored(dealt.join(compared, ["a", "b"], "left_anti").join(ours, "a").join(theirs, "b").where(_near(least)).select("a", "b"), "near-pairs")
            found, fresh, n = _linked(more, known, found, least)
            compared = compared.unionByName(fresh)
            undecided = _undecided(inside, found)
            goes_on = GOES_ON * n >= many and not undecided.isEmpty()
        known = known.join(undecided.select("node").distinct(), "node", "left_semi")
        more, _ = stored(_proposed(known, found, least).join(compared, ["a", "b"], "left_anti"), "near-pairs")
        found, _, _ = _linked(more, known, found, least)

    firsts = nodes.groupBy("node").agg(F.min("first_id").alias("first_id"))
    placed = found.join(firsts, "node").withColumn("salt", F.pmod("node", F.lit(SALTS)).cast("int"))
    heads = placed.groupBy("label").agg(F.min("first_id").alias("class_id")).withColumn("salt", salts).hint("merge")
    of_linked = placed.join(heads, ["label", "salt"]).select("node", "class_id")
    of_copied = groups.where(F.col("n") > 1).join(of_linked, "node", "left_anti").select("node", F.col("first_id").alias("class_id"))
    known = of_linked.unionByName(of_copied).withColumn("salt", salts).hint("merge")
    return (
        sketches.select("doc_id", "node").withColumn("salt", salt).join(known, ["node", "salt"], "left")
        .select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"))
    )


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, node = batch.column(0), batch.column(1)
        marker = _marker(ids.fill_null(-1).to_numpy(), node.to_numpy())
        yield pa.RecordBatch.from_arrays([node, ids, pa.array(marker), batch.column(2)], names=["node", "first_id", "marker", "bands"])


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
