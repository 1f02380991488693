"""Operators across documents: near-duplicates, repeats, revisits, leaks, licences, and the pipeline."""

import hashlib
import math
import random
import textwrap
from collections import Counter
from itertools import combinations

import duckdb
import numpy as np
import pytest
from compare import SMALL, connect, same
from helpers import AWKWARD, awkward, docs, prose
from pyspark.sql import functions as F

from tessera.llm import components, op03_near_duplicates, op04_suffix_dedup, op05_revisits, op07_decontamination, op10_licenses, registry, sieve

# -- op3


def bag(text):
    words = (text or "").encode().lower().split()
    return Counter(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else Counter()


def jaccard(x, y):
    keys = set(x) | set(y)
    return sum(1 / sum(max(x[j] / x[i], y[j] / y[i]) for j in keys) for i in x if i in y)


def changed(text, seed, n):
    pick, words = random.Random(seed), text.split()
    for _ in range(n):
        words[pick.randrange(len(words))] = f"new{pick.randrange(10**6)}"
    return " ".join(words)


def test_classes_equal_brute_force(spark):
    base = [prose(i, 120) for i in range(12)]
    texts = base + [changed(base[i % 6], i, 1 + i % 4) for i in range(40)] + [base[0].upper(), base[1] + "  ", base[2]]
    found = {r.doc_id: r.class_id for r in op03_near_duplicates.classes(docs(spark, texts)).collect()}
    bags = [bag(t) for t in texts]
    parent = list(range(len(texts)))

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in range(len(texts)):
        for b in range(a):
            if jaccard(bags[a], bags[b]) >= 0.8:
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    assert found == {i: root(i) for i in range(len(texts))}


def test_a_family_that_shares_a_template(spark):
    template, texts = prose(900, 130), []
    for i in range(600):
        both = prose(3000 + i, 7, 4000)  # three shingles more than the others share: 129 of 161, not 126 of 164
        texts += [" ".join([template, prose(4000 + 2 * i + k, 12, 4000), both]) for k in (0, 1)]
    bags = [Counter({hash(k): n for k, n in bag(t).items()}) for t in texts]
    like = lambda a, b: similarities([(bags[a], bags[b])])[0]
    assert all(like(k, k + 1) >= 0.8 for k in range(0, 1200, 2)) and all(0.7 < like(k, m) < 0.8 for k in range(0, 1200, 7) for m in range(0, 1200, 11) if k // 2 != m // 2)
    found = {r.doc_id: r.class_id for r in op03_near_duplicates.classes(docs(spark, texts)).collect()}
    assert found == {k: k // 2 * 2 for k in range(1200)}


def test_pairs_of_a_family_of_near_copies_grow_in_proportion(spark, monkeypatch):
    """A third of the copies are alike with few others only; the family is one class without comparing all of them."""
    seen, verify = [], op03_near_duplicates._verify

    def counted(pairs, known, least, name):
        seen.append((name, pairs.count()))
        return verify(pairs, known, least, name)

    monkeypatch.setattr(op03_near_duplicates, "_verify", counted)
    base = prose(70_000, 160, 4000)
    found = op03_near_duplicates.classes(docs(spark, [changed(base, i, 1 + i % 3) for i in range(400)])).collect()
    assert len(found) == 400 and {r.class_id for r in found} == {0}
    assert 0 < sum(n for name, n in seen if name == "near-2") < 400  # all pairs in different components that may be alike: 2,967


def similarities(pairs):
    """Similarities of pairs of counters with whole numbers as keys."""
    sides = [(i, k, side) for i, pair in enumerate(pairs) for side, bag in enumerate(pair) for k in bag.elements()]
    pair, key, side = (np.array(x, np.int64) for x in zip(*sides, strict=True))
    return op03_near_duplicates.similarities(pair, key, side, len(pairs))


def test_recall_by_similarity(spark):
    """Pairs of texts alike from 0.5 to 1: all at 0.8 or more share a class, none below."""
    texts, bands = [], Counter()
    for i in range(700):
        base = prose(20_000 + i, 160, 4000)
        texts += [base, changed(base, i, 1 + i % 14)]
    found = {r.doc_id: r.class_id for r in op03_near_duplicates.classes(docs(spark, texts)).collect()}
    for k in range(0, len(texts), 2):
        alike = jaccard(bag(texts[k]), bag(texts[k + 1]))
        bands[math.floor(alike * 20) / 20] += 1
        assert (found[k] == found[k + 1]) == (alike >= 0.8)
    assert all(bands[b] >= 30 for b in (0.65, 0.7, 0.8, 0.85, 0.9))


def test_proposals_lose_no_pair(spark):
    pick, bags = random.Random(1), []
    for _ in range(40):
        x = Counter(pick.choices(range(120), k=pick.randint(3, 40)))
        bags.append(x)
        for _ in range(4):
            y = x.copy()
            for _ in range(pick.randint(0, 3)):
                y[pick.choice([*y, pick.randrange(200)])] += 1
            bags.append(y)
    known = spark.createDataFrame([(i, sorted(b.elements())) for i, b in enumerate(bags)], "node long, vector array<long>")
    placed = spark.createDataFrame([(i, i // 2 * 2) for i in range(0, len(bags), 2)] + [(i, i - 1) for i in range(1, len(bags), 2)], "node long, label long")
    found = {(r.a, r.b) for r in op03_near_duplicates._proposed(known, placed, 0.8).collect()}
    pairs = [(a, b) for a, b in combinations(range(len(bags)), 2) if a // 2 != b // 2]
    alike = {p for p, s in zip(pairs, similarities([(bags[a], bags[b]) for a, b in pairs]), strict=True) if s >= 0.8}
    assert len(alike) > 100 and alike <= found and all(a // 2 != b // 2 for a, b in found) and len(found) < len(pairs) / 4


def test_similarity_is_the_probability_jaccard():
    pick = random.Random(0)
    pairs = [tuple(Counter(pick.choices(range(12), k=pick.randint(1, 20))) for _ in range(2)) for _ in range(60)]
    assert similarities(pairs) == pytest.approx([jaccard(x, y) for x, y in pairs])


def test_signatures_estimate_it():
    x = {k: 1 + k % 3 for k in range(60)}
    y = {k: 1 + (k + k // 50) % 3 for k in range(15, 75)}
    keys = np.array([*x, *y], np.uint64)
    doc = np.repeat([0, 1], [len(x), len(y)])
    table = op03_near_duplicates.signatures(doc, op03_near_duplicates.B.mix(keys), np.array([*x.values(), *y.values()], float), 2, slots=4096)
    assert (table[0] == table[1]).mean() == pytest.approx(jaccard(Counter(x), Counter(y)), abs=0.03)


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(20)] + [(100, k) for k in range(101, 150)] + [(300, 299), (7, 7)]
    found = {r.node: r.label for r in components.labels(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(21)}, **{k: 100 for k in range(100, 150)}, 299: 299, 300: 299}


def test_near_duplicate_edges(spark):
    found = op03_near_duplicates.classes(awkward(spark)).collect()
    assert len(found) == len(AWKWARD) + 3
    by = {r.doc_id: r.class_id for r in found if r.doc_id is not None}
    assert by[9] == by[10] == 9 and by[0] == 0 and by[1] == 1 and by[2] == 2
    assert op03_near_duplicates.classes(docs(spark, [])).count() == 0


def test_a_sieve_only_lets_more_through(spark):
    keys = spark.range(-50, 50).select((F.col("id") * 7919).alias("k"))
    for most in (7, 27):
        table = sieve.build(keys, "k", most).value
        assert sieve.passes(table, np.arange(-50, 50) * 7919).all() and len(table) == (2 if most == 7 else 1024)
    assert not sieve.passes(table, np.arange(10**6, 10**6 + 1000)).all()


def test_rows_without_keys(spark):
    rows = spark.range(1000).select(F.when(F.col("id") % 100 == 7, None).otherwise(F.col("id")).alias("id"), F.lit("x").alias("_key0"), F.lit([1]).alias("_bits0"))
    gone = spark.range(0, 1000, 3).select(F.xxhash64("id").alias("gone"))
    found = sieve.without(rows, F.when(F.col("id").isNotNull(), F.xxhash64("id")), gone)
    assert found.columns == rows.columns
    assert Counter(r.id for r in found.collect()) == Counter([i for i in range(1000) if i % 3 and i % 100 != 7] + [None] * 10)
    assert sieve.without(rows, F.xxhash64("id"), gone.limit(0)).count() == 1000


# -- op4


def brute(rows):
    seen, out = set(), {}
    for i, text in rows:
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for s in range(len(raw) - 99):
            window = raw[s : s + 100]
            if window in seen:
                gone[s : s + 100] = b"\1" * 100
            seen.add(window)
        kept = bytes(x for x, g in zip(raw, gone, strict=True) if not g)
        runs = sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1]))
        out[i] = (len(raw), sum(gone), runs, hashlib.sha256(kept).hexdigest())
    return out


def repeats(frame):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in op04_suffix_dedup.remove_repeats(frame).collect()}


def test_repeats_equal_brute_force(spark):
    shared = [prose(i, 40) for i in range(4)]
    pick = random.Random(2)
    texts = []
    for i in range(60):
        parts = [prose(100 + i, pick.randint(0, 60)), pick.choice(shared)[pick.randint(0, 80) :], prose(200 + i, 10), pick.choice(shared)[: pick.randint(50, 250)], "é" * pick.randint(0, 90)]
        pick.shuffle(parts)
        texts.append(" ".join(parts))
    texts += ["ab" * 400, "ab" * 60, "x" * 99, "x" * 100, "x" * 101, texts[3], texts[3], texts[5] + "tail"]
    frame = docs(spark, texts).repartition(7)
    assert repeats(frame) == brute(list(enumerate(texts)))


def test_repeats_of_the_table_equal_brute_force(spark):
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    found = {r.doc_id: tuple(r)[1:] for r in op04_suffix_dedup.op4_suffix_dedup(spark, SMALL).collect()}
    assert found == brute([tuple(r) for r in rows])


@pytest.mark.parametrize("hot", [0, 512])
def test_a_sentence_in_a_third_of_the_texts(spark, monkeypatch, hot):
    """72 bytes are common, their neighbours differ: no window repeats, but for a few planted ones; no key has many rows."""
    monkeypatch.setattr(op04_suffix_dedup, "HOT", hot)
    sentence, texts = prose(77, 14)[:72], []
    for i in range(1800):
        tail = prose(5000 + i, 6, 3000) if i % 60 else prose(5000, 30, 3000)
        texts.append(f"{prose(9000 + i, 25, 3000)} {sentence} {tail}" if i % 3 == 0 else prose(9000 + i, 40, 3000))
    frame = docs(spark, texts).repartition(4)
    assert repeats(frame) == brute(list(enumerate(texts)))
    plain = frame.selectExpr("doc_id AS doc", "text")
    dealt = plain.mapInArrow(op04_suffix_dedup._anchor_rows, op04_suffix_dedup._DEALT)
    assert dealt.groupBy("key").count().agg(F.max("count")).first()[0] < 60 < dealt.count() / 200


def test_whole_characters_stay(spark):
    shared = "né " * 60
    texts = ["aé" + shared, "yĩ" + shared, "é\ufffd" + shared + "\ufffdé", shared[1:] + "ü\ufffd", "\ufffd only"]
    found = {r.doc_id: r for r in op04_suffix_dedup.remove_repeats(docs(spark, texts), whole_characters=True).collect()}
    plain = {r.doc_id: r for r in op04_suffix_dedup.remove_repeats(docs(spark, texts)).collect()}
    for i, r in found.items():
        assert r.kept.decode() == plain[i].kept.decode("utf-8", "ignore") and r.n_removed == plain[i].n_removed
    assert found[4].kept.decode() == texts[4] and found[1].kept.decode() == "y" and "\ufffd" in found[2].kept.decode() and any(p.kept.decode("utf-8", "replace") != p.kept.decode("utf-8", "ignore") for p in plain.values())


def test_byte_passes_order_suffixes_by_their_bytes():
    random_bytes = np.random.default_rng(3)
    buf = np.concatenate([random_bytes.integers(0, 2, 3000), np.tile(random_bytes.integers(0, 256, 130), 5)]).astype(np.uint8)
    buf = np.concatenate([buf, buf[100:400], buf[2500:2760]])
    start = np.arange(len(buf) - 99)
    group = start // 1500
    seen, expected = set(), []
    for s in start:
        window = (group[s], buf[s : s + 100].tobytes())
        expected.append(window in seen)
        seen.add(window)
    assert op04_suffix_dedup.repeats(buf, start, group).tolist() == expected


def test_repeat_edges(spark):
    found = op04_suffix_dedup.remove_repeats(awkward(spark), keep=["doc_id", "lang"]).collect()
    assert len(found) == len(AWKWARD) + 3
    by = {r.doc_id: r for r in found if r.doc_id not in (None, 9)}
    assert by[6].n_removed == 5000 - 100 + 99 and by[0].n_bytes == 0 and by[10].n_removed == 0
    text = prose(1, 60)
    twice = spark.createDataFrame([(5, text), (5, text), (None, text), (4, "short")], "doc_id long, text string")
    assert sorted(r.n_removed for r in op04_suffix_dedup.remove_repeats(twice).collect()) == [0, 0, len(text), len(text)]
    assert op04_suffix_dedup.remove_repeats(docs(spark, [])).count() == 0


# -- op5


def test_revisits_equal_sql(spark):
    same(op05_revisits.op5_revisits(spark, SMALL), connect(SMALL), op05_revisits.ORACLE_SQL)


CAPTURE = "record_id long, url string, ts long, kind string, etag string, last_modified string, digest string, headers map<string,string>"


def test_revisits_take_the_latest_earlier_response(spark):
    rows = [
        (1, "http://www.a.org/x/", 10, "response", '"a"', None, "d1", {"Date": "1", "type": "t"}),
        (2, "https://a.org/x?utm_source=f#top", 5000, "response", '"b"', None, "d2", {"date": "2", "type": "u"}),
        (3, "http://a.org:80/x", 5000, "revisit", 'W/"a"', None, None, {"date": "3", "server": "s"}),
        (4, "http://A.org/x", 9000, "revisit", '"b"', None, None, None),
        (5, "http://a.org/x", 9000, "revisit", '"zzz"', None, None, {"date": "5"}),
        (6, "http://a.org/x", 9, "revisit", None, None, None, {}),
        (7, "http://a.org/x", 9999, "revisit", None, None, "d2", {}),
        (8, None, 9999, "revisit", None, None, None, {}),
        (9, "http://a.org/x", None, "revisit", None, None, None, {}),
    ]
    found = {r.record_id: r for r in op05_revisits.resolve(spark.createDataFrame(rows, CAPTURE)).collect()}
    assert {i: (r.target_id, r.verdict) for i, r in found.items()} == {
        3: (1, "resolved"), 4: (2, "resolved"), 5: (2, "mismatch"), 6: (None, "no_response"), 7: (2, "resolved"), 8: (None, "no_response"), 9: (None, "no_response"),
    }
    assert found[3].headers == {"type": "t", "date": "3"} and found[5].headers is None and found[4].payload_digest == "d2"
    assert op05_revisits.resolve(spark.createDataFrame([], CAPTURE)).count() == 0


def test_revisits_equal_brute_force_in_any_unit_of_time(spark):
    pick, rows = random.Random(5), []
    for i in range(600):
        url = pick.choice([None, "http://a.org/x", "http://a.org/y", "https://www.A.org/x/", "http://b.org/"])
        ts = pick.choice([None, pick.randrange(3000), pick.randrange(3000), pick.randrange(3000)])
        big = {f"h{k}": "v" * 3000 for k in range(20)} if i % 100 == 0 else {"Etag": f"e{i}", "x": "1"}
        rows.append((i, url, ts, pick.choice(["response", "revisit", "request"]), None, None, None, pick.choice([None, big])))
    rows += rows[:40]
    key = {None: None, "http://a.org/x": "a.org/x", "http://a.org/y": "a.org/y", "https://www.A.org/x/": "a.org/x", "http://b.org/": "b.org"}
    expected = Counter()
    for r in rows:
        if r[3] == "revisit":
            earlier = [(o[2], o[0]) for o in rows if o[3] == "response" and key[o[1]] == key[r[1]] is not None and o[2] is not None and r[2] is not None and o[2] < r[2]]
            expected[r[0], max(earlier)[1] if earlier else None] += 1
    for factor, block in ((1, 10), (1000, 1000), (10**9, 1000), (1, 10**6)):
        frame = spark.createDataFrame([(*r[:2], r[2] if r[2] is None else r[2] * factor, *r[3:], 1, "x") for r in rows], CAPTURE + ", block int, response string")
        found = op05_revisits.resolve(frame, block=block).collect()
        assert Counter((r.record_id, r.target_id) for r in found) == expected
        assert all(r.verdict == ("no_response" if r.target_id is None else "unvalidated") for r in found)


def test_hot_address_in_many_blocks(spark):
    rows = spark.range(3000).select(F.col("id").alias("record_id"), F.lit("http://hot/").alias("url"), (F.col("id") * 7).alias("ts"), F.when(F.col("id") % 50 == 0, "response").otherwise("revisit").alias("kind"), F.lit(None).cast("string").alias("etag"), F.lit(None).cast("string").alias("last_modified"), F.lit(None).cast("string").alias("digest"), F.create_map().cast("map<string,string>").alias("headers"))
    found = op05_revisits.resolve(rows, block=100).collect()
    assert len(found) == 2940 and all(r.target_id == r.record_id // 50 * 50 for r in found)


# -- op7


def test_leaks_equal_sql(spark):
    same(op07_decontamination.op7_decontamination(spark, SMALL), connect(SMALL), op07_decontamination.ORACLE_SQL)


def test_substituted_and_cut_passages_are_found(spark):
    item = prose(5, 40, 4000).split()
    sub = [("other" if k % 6 == 4 else w) for k, w in enumerate(item)]
    texts = [" ".join(item), "Intro, " + " ".join(sub) + " end.", " ".join(item[10:26]), " ".join(item[:6]) + " x y z", prose(6, 60, 4000), " ".join(item).upper().replace(" ", "; ")]
    benchmark = spark.createDataFrame([(1, " ".join(item), "x"), (2, "too short", "y"), (3, None, "z"), (4, "", "z")], "item_id long, text string, score string")
    for most in (op07_decontamination.MAX_SEEDS, 3):
        found = op07_decontamination.leaks(docs(spark, texts), benchmark, max_seeds=most).collect()
        assert {r.doc_id for r in found} == {0, 1, 2, 5} and {r.item_id for r in found} == {1}
        assert {r.doc_id: r.n_equal for r in found}[0] == 40


def test_masks_hit_whichever_three_of_twelve_tokens_are_substituted():
    for miss in combinations(range(12), 3):
        assert any(all(at + k not in miss for k in m) for m in op07_decontamination.COVER for at in range(12 - m[-1]))
    for n in range(1, 12):
        k = op07_decontamination.run_length(n, 0.75)
        for miss in combinations(range(n), n - -(-3 * n // 4)):
            assert any(not set(range(at, at + k)) & set(miss) for at in range(n - k + 1))


def test_regular_substitutions_and_short_items_are_found(spark):
    item = prose(5, 200, 4000).split()
    texts = [" ".join("other" if i % 4 == phase else w for i, w in enumerate(item)) for phase in range(4)]
    short = {n: [f"s{n}w{k}" for k in range(n)] for n in range(1, 12)}
    texts += ["before " + " ".join(short[n]) + " after" for n in short]
    texts += ["before " + " ".join(short[n][: n // 2] + ["other"] + short[n][n // 2 + 1 :]) + " after" for n in short]
    benchmark = spark.createDataFrame([(0, " ".join(item)), (20, None), (21, ""), (22, "!!!"), *((n, " ".join(w).capitalize() + ".") for n, w in short.items())], "item_id long, text string")
    for most in (op07_decontamination.MAX_SEEDS, 3):
        found = op07_decontamination.leaks(docs(spark, texts), benchmark, max_seeds=most).collect()
        exact, one = {(3 + n, n) for n in short}, {(14 + n, n) for n in short if n >= 4}
        assert {(r.doc_id, r.item_id) for r in found} == {(k, 0) for k in range(4)} | exact | one


def test_leaks_by_row_at_every_size_equal_sql(spark):
    item, other = prose(5, 30, 4000).split(), prose(8, 25, 4000).split()
    held = lambda n: spark.createDataFrame([(i, t) for i, t in n], "doc_id long, text string")
    rows = held([
        (None, " ".join(item)), (None, prose(7, 40)), (None, " ".join(other) + "."), (4, "x " + " ".join(item[:20])), (4, prose(9, 30)), (4, "x " + " ".join(item[:20])),
        (5, None), (6, ""), (7, prose(11, 30_000) + " " + " ".join(w if k % 4 else "zz" for k, w in enumerate(item))), (8, "... " + " ".join(other[:5]) + " ..."), (9, "(tiny one)"),
    ])
    benchmark = spark.createDataFrame([(1, " ".join(item) + " ?"), (1, " ".join(other)), (None, "Tiny, one!"), (3, " ".join(other[:5])), (4, None)], "item_id long, text string")
    con = duckdb.connect()
    for name, frame in (("documents", rows), ("benchmark", benchmark)):
        con.register(name, frame.toArrow())
    for most in (op07_decontamination.MAX_SEEDS, 1):
        same(op07_decontamination.leaks(rows, benchmark, max_seeds=most), con, op07_decontamination.ORACLE_SQL)
    found = {(r.doc_id, r.item_id): r.n_item for r in op07_decontamination.leaks(rows, benchmark).collect()}
    assert found == {(None, 1): 30, (4, 1): 30, (7, 1): 30, (8, 3): 5, (None, 3): 5, (9, None): 2} and not any(map(found.get, [(6, 1), (5, 1)]))


def test_leak_edges(spark):
    benchmark = spark.createDataFrame([(1, prose(5, 20), 0)], "item_id long, text string, score int")
    assert op07_decontamination.leaks(awkward(spark), benchmark).count() == 0
    assert op07_decontamination.leaks(docs(spark, []), benchmark).count() == 0
    assert op07_decontamination.leaks(awkward(spark), benchmark.limit(0)).count() == 0


# -- op10


def test_licences_equal_sql(spark):
    same(op10_licenses.op10_licenses(spark, SMALL), connect(SMALL), op10_licenses.ORACLE_SQL)


def test_nearest_ancestor_speaks(spark):
    rows = [
        (1, "repo/LICENSE", "Released under the MIT License."), (2, "repo/src/a.py", "x = 1"), (3, "repo/vendor/COPYING", "This work is licensed under the GNU General Public License, version 3."),
        (4, "repo/vendor/deep/b.py", "y = 2"), (5, "repo/vendor/c.py", "# SPDX-License-Identifier: Apache-2.0\n" + prose(1, 50)), (6, "else/d.py", ""), (7, None, None), (8, "top.txt", "the license is odd"),
    ]
    found = {r.file: (r.license, r.origin, r.from_directory) for r in op10_licenses.scan(spark.createDataFrame(rows, "file long, path string, text string")).collect()}
    assert found == {
        1: ("MIT", "own", None), 2: ("MIT", "inherited", "repo"), 3: ("GPL-3.0", "own", None), 4: ("GPL-3.0", "inherited", "repo/vendor"),
        5: ("Apache-2.0", "own", None), 6: (None, "none", None), 7: (None, "none", None), 8: (None, "none", None),
    }


def licence_text(name, most=10**6):
    return next(t for n, t in sorted(op10_licenses.TEMPLATES, key=lambda x: -len(x[1])) if n == name and len(t) < most)


def wrapped(text, lead="", width=60):
    return "\n".join(lead + x for x in textwrap.wrap(text, width))


def test_licence_texts_and_wrapped_headers_are_read(spark):
    mit = "MIT License\n\nCopyright (c) 2024 A. Person\n\n" + wrapped(licence_text("MIT").partition("Copyright (c). ")[2].replace(" The above", "\n\nThe above"))
    bsd = wrapped(licence_text("BSD-2-Clause")).replace("met:", "met:\n\n1.").replace("Redistributions in", "\n2. Redistributions in").replace("THIS", "\nTHIS", 1)
    code = "\n\nimport os\n\n" + "\n".join(prose(i, 8) for i in range(30))
    rows = [
        (1, "m/LICENSE", mit), (2, "m/a.py", "x = 1"), (3, "b/LICENSE.txt", bsd), (4, "b/x/y.c", ""), (5, "b/h.js", wrapped(licence_text("MPL-2.0", 500), " * ") + code),
        (6, "b/g.py", wrapped(licence_text("GPL-3.0"), "# ") + code), (7, "o/COPYING", "SPDX-License-Identifier: MIT\n" + prose(3, 200)), (8, "o/n.txt", "none"),
        (9, "q/long.txt", prose(5, 20_000) + "\n\nthe license of\nthis " + prose(6, 60)),
    ]
    found = {r.file: (r.license, r.origin) for r in op10_licenses.scan(spark.createDataFrame(rows, "file long, path string, text string")).collect()}
    assert found == {
        1: ("MIT", "own"), 2: ("MIT", "inherited"), 3: ("BSD-2-Clause", "own"), 4: ("BSD-2-Clause", "inherited"), 5: ("MPL-2.0", "own"), 6: ("GPL-3.0", "own"), 7: ("MIT", "own"), 8: ("MIT", "inherited"), 9: (None, "none"),
    }


def test_rows_that_share_an_id_are_files_of_their_own_as_in_sql(spark):
    mit = "Released under the MIT License."
    texts = [(7, mit, "s"), (7, prose(1, 40), "s"), (7, mit, "s"), (None, mit, "s"), (None, prose(2, 30), None), (8, wrapped(licence_text("MPL-2.0", 500), "// ") + "\n\n" + prose(4, 90), "s"), (9, None, "s"), (10, "", None), (11, mit + "\n\n" + mit, "t")]
    frame = spark.createDataFrame(texts, "doc_id long, text string, source string")
    con = duckdb.connect()
    con.register("documents", frame.toArrow())
    rows = frame.select(F.col("doc_id").alias("file"), op10_licenses.document_path(F.col("doc_id"), F.col("source")).alias("path"), "text")
    same(op10_licenses.scan(rows).withColumnRenamed("file", "doc_id"), con, op10_licenses.ORACLE_SQL)
    found = [(r.file, r.license, r.origin) for r in op10_licenses.scan(rows).collect()]
    assert Counter(found)[(7, "MIT", "own")] == 2 and (7, "MIT", "inherited") in found and (None, "MIT", "own") in found and (None, None, "none") in found and (8, "MPL-2.0", "own") in found


def test_licence_edges(spark):
    files = awkward(spark).select(F.monotonically_increasing_id().alias("file"), F.lit("a/b").alias("path"), "text", "score")
    assert op10_licenses.scan(files).count() == len(AWKWARD) + 3
    assert op10_licenses.scan(files.limit(0)).count() == 0


# -- pipeline and registry


def test_every_operator_is_registered():
    names = list(registry.queries())
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10
    assert set(registry.oracle_sql()) == {"op2_line_rules", "op5_revisits", "op7_decontamination", "op10_licenses"}


def test_pipeline_equals_its_stages_by_brute_force(spark):
    import corpus_pipeline

    rows = {r.doc_id: r for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    docs_frame, kept = spark.read.parquet(f"{SMALL}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        before = docs_frame
        docs_frame = stage(spark, before, SMALL).cache()
        if name != "sentencepiece":
            assert docs_frame.columns == before.columns
        kept.append({r.doc_id: r for r in docs_frame.collect()})
    clean, single, cut, safe, last = kept
    assert set(last) <= set(safe) <= set(cut) == set(single) <= set(clean) <= set(rows) and set(last) == set(safe)
    bags = {i: bag(r.text) for i, r in single.items()}
    assert max(jaccard(bags[a], bags[b]) for a in list(bags)[:60] for b in list(bags)[:60] if a < b and bags[a] and bags[b]) < 0.8
    wanted = brute([(i, single[i].text) for i in sorted(single)])
    for i, r in cut.items():
        if wanted[i][1] == 0:
            assert r.text == single[i].text and r.n_chars == len(r.text)
        else:
            assert len(r.text.encode()) <= wanted[i][0] - wanted[i][1]
    assert all(r.exact for r in last.values())
    whole = {r.doc_id for r in corpus_pipeline.run(spark, SMALL).select("doc_id").collect()}
    assert whole == set(last)


def test_pipeline_stands_awkward_rows(spark, tmp_path):
    import corpus_pipeline

    rows = awkward(spark).withColumn("ids", F.lit("i")).withColumn("n_removed", F.lit(1.5)).withColumn("doc", F.lit("d")).withColumn("class_id", F.lit(0))
    rows.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(12)] + [(3, 0, None)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, prose(3, 20))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    frame = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, frame, str(tmp_path)).dtypes == frame.dtypes, name
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == [c for c in frame.columns if c != "ids"] + ["ids", "n_ids", "decoded_sha256", "exact"]
    assert 0 < out.count() <= len(AWKWARD) + 3
    empty = frame.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, str(tmp_path))
        assert empty.count() == 0


def test_pipeline_decides_by_row(spark, tmp_path):
    """Null and repeated ids: copies go, other texts stay, and leaks go whatever their id."""
    import corpus_pipeline

    texts = {k: prose(700 + k, 60, 4000) for k in range(8)}
    leak = prose(3, 30, 4000)
    rows = [(None, texts[0]), (None, texts[0]), (None, texts[1]), (4, texts[2]), (4, texts[2]), (4, texts[3]), (5, texts[3]), (6, None), (6, None), (None, leak), (7, texts[4] + " " + leak), (7, texts[5]), (8, texts[6] + " \ufffd")]
    frame = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    pairs = lambda f: sorted(((r.doc_id, r.text) for r in f.collect()), key=str)
    single = corpus_pipeline.near_duplicates(spark, frame, str(tmp_path))
    assert pairs(single) == sorted([(None, texts[0]), (None, texts[1]), (4, texts[2]), (4, texts[3]), *rows[7:]], key=str)
    assert pairs(corpus_pipeline.decontamination(spark, frame, str(tmp_path))) == sorted((r for r in rows if leak not in (r[1] or "")), key=str)
