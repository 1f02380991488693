"""Operators with one row for each document: language model, line rules, toxicity, language, pieces."""

import math
import re
import zlib
from collections import Counter
from itertools import combinations, product

import duckdb
import numpy as np
import pytest
from compare import SMALL, connect, same
from helpers import AWKWARD, awkward, docs, prose
from pyspark.sql import functions as F

from tessera.llm import op01_hmm, op02_line_rules, op06_toxicity, op08_sentencepiece, op09_language_id


def crc(i, m):
    return zlib.crc32(str(i).encode()) % m


# -- op1


def tokens(text):
    return [*(text or "").encode().lower().split(), b"\x00end"]


def test_base_score_equals_brute_force(spark):
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    counts = Counter()
    for r in rows:
        if crc(r.doc_id, 10):
            counts.update(tokens(r.text))
    n, v = sum(counts.values()), len(counts)
    found = {r.doc_id: r for r in op01_hmm.op1_hmm(spark, SMALL).collect()}
    assert len(found) == len(rows)
    gain = 0.0
    for r in rows:
        f, words = found[r.doc_id], tokens(r.text)
        base = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words)
        assert f.base_score == pytest.approx(base, rel=1e-9) and f.train_tokens == n
        assert (f.held_out, f.n_tokens, f.n_known) == (crc(r.doc_id, 10) == 0, len(words), sum(counts[w] > 0 for w in words))
        gain += (f.score - f.base_score) * f.held_out
    assert gain > 0


def test_forward_recursion_equals_the_sum_over_all_paths():
    random = np.random.default_rng(0)
    norm = lambda x, axis: x / x.sum(axis, keepdims=True)
    model = op01_hmm.Model(norm(random.random(3), 0), norm(random.random((3, 3)), 1), norm(random.random((5, 3)), 0))
    sequences = [[0, 1, 4], [2], [], [3, 3, 1, 0, 2]]
    symbols = np.array([s for q in sequences for s in q], np.int32)
    offsets = np.concatenate([[0], np.cumsum([len(q) for q in sequences])])
    found = model.log10(symbols, offsets)
    for q, value in zip(sequences, found, strict=True):
        total = 0.0
        for path in product(range(3), repeat=len(q)):
            p = 1.0
            for t, s in enumerate(path):
                p *= (model.start[s] if t == 0 else model.move[path[t - 1], s]) * model.emit[q[t], s]
            total += p
        assert value == pytest.approx(math.log10(total), rel=1e-9, abs=1e-12)


def test_baum_welch_counts_equal_the_posteriors_and_raise_likelihood():
    random = np.random.default_rng(1)
    unigram = np.full(6, 1 / 6)
    model = op01_hmm.Model.initial(unigram, 2)
    symbols = np.concatenate([random.integers(0, 3, 400), random.integers(3, 6, 400)]).astype(np.int32)
    offsets = np.arange(0, 801, 20)
    before = model.log10(symbols, offsets).sum()
    for _ in range(5):
        counts = [np.zeros(2), np.zeros((2, 2)), np.zeros((6, 2))]
        model.expected(symbols, offsets, counts)
        assert counts[0].sum() == pytest.approx(40, rel=1e-4) and counts[2].sum() == pytest.approx(800, rel=1e-4) and counts[1].sum() == pytest.approx(760, rel=1e-4)
        assert counts[2].sum(1) == pytest.approx(np.bincount(symbols, minlength=6), rel=1e-4)
        model = op01_hmm.Model.estimated(*counts, unigram)
    assert model.log10(symbols, offsets).sum() > before


def test_expected_counts_of_whole_texts_equal_the_sum_over_all_paths():
    random = np.random.default_rng(2)
    norm = lambda x, axis: x / x.sum(axis, keepdims=True)
    model = op01_hmm.Model(norm(random.random(2), 0), norm(random.random((2, 2)), 1), norm(random.random((4, 2)), 0))
    sequences = [[0, 1, 3, 2, 2, 0, 1], [2], [], [3, 3, 1, 0, 2], [1, 1, 1]]
    wanted = [np.zeros(2), np.zeros((2, 2)), np.zeros((4, 2))]
    for q in filter(None, sequences):
        paths = list(product(range(2), repeat=len(q)))
        chance = [math.prod((model.start[s] if t == 0 else model.move[path[t - 1], s]) * model.emit[q[t], s] for t, s in enumerate(path)) for path in paths]
        for path, p in zip(paths, np.array(chance) / sum(chance), strict=True):
            wanted[0][path[0]] += p
            for t, s in enumerate(path):
                wanted[2][q[t], s] += p
                if t:
                    wanted[1][path[t - 1], s] += p
    symbols = np.array([s for q in sequences for s in q], np.int32)
    offsets = np.cumsum([0, *map(len, sequences)])
    for cells in (1 << 18, 12, 3, 1):  # in one block, in several, in pieces
        counts = [np.zeros(2), np.zeros((2, 2)), np.zeros((4, 2))]
        model.expected(symbols, offsets, counts, cells)
        for found, expected in zip(counts, wanted, strict=True):
            assert found == pytest.approx(expected, rel=1e-4)


def test_scores_equal_brute_force(spark):
    """The forward recursion in plain floats over words, with the fitted chances."""
    frame = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = frame.select("doc_id", "text").collect()
    counts = Counter(w for r in rows if crc(r.doc_id, 10) for w in tokens(r.text))
    fitted = op01_hmm.fit(frame)
    v, model = fitted.vocabulary, fitted.model
    key = lambda w: op01_hmm._END if w == b"\x00end" else int(op01_hmm._tokens(np.frombuffer(w, np.uint8), np.array([0, len(w)]))[0][0])
    symbol = {w: int(v.read(np.array([key(w)]))[0][0]) for w in {w for r in rows for w in tokens(r.text)}}
    inside = {}
    for w, c in counts.items():
        if v.n_own <= symbol[w] < v.end:
            total, types = inside.get(symbol[w], (0, 0))
            inside[symbol[w]] = total + c, types + 1

    def expected(text):
        now, out = model.start, 0.0
        for t, w in enumerate(tokens(text)):
            total, types = inside.get(symbol[w], (0, 0))
            share = (counts[w] + 0.1) / (total + 0.1 * (types + 1)) if v.n_own <= symbol[w] < v.end else 1.0
            now = (now @ model.move if t else now) * model.emit[symbol[w]] * share
            out += math.log10(now.sum())
            now = now / now.sum()
        return out

    found = {r.doc_id: r.score for r in op01_hmm.op1_hmm(spark, SMALL).collect()}
    assert len(found) == len(rows)
    for r in rows[::5]:
        assert found[r.doc_id] == pytest.approx(expected(r.text), rel=1e-6)


def test_scores_sum_to_one_over_words(spark):
    """The chance of a word given the model: own symbols and buckets are shares of one distribution."""
    frame = docs(spark, [prose(i, 200) for i in range(12)])
    counts, _ = op01_hmm.stored(frame.select("text").mapInArrow(op01_hmm._count, "key long, c long").groupBy("key").agg(F.sum("c").alias("c")), "t")
    v = op01_hmm.Vocabulary(counts)
    assert v.unigram.sum() == pytest.approx(1)
    assert v.n_tokens == 12 * 201


def test_the_alphabet_is_filled_up_at_the_border(spark):
    counts = spark.range(30_000).select(F.xxhash64("id").alias("key"), F.when(F.col("id") < 500, 50).otherwise(2).cast("long").alias("c"))
    for most in (400, 5_000, 29_000):
        v = op01_hmm.Vocabulary(counts, most_known=most, most_own=most // 2)
        assert 0.85 * most < len(v.keys) < 1.15 * most and 0.8 * most < 2 * v.n_own < 1.2 * most
        assert v.unigram.sum() == pytest.approx(1) and v.n_types == 30_000
    assert op01_hmm.Vocabulary(counts).n_own == pytest.approx(op01_hmm.MAX_OWN, rel=0.05)


def test_hmm_edges(spark):
    found = op01_hmm.score(awkward(spark)).collect()
    assert len(found) == len(AWKWARD) + 3 and all(math.isfinite(r.score) and math.isfinite(r.base_score) for r in found)
    assert {r.n_tokens for r in found if r.doc_id in (0, 1, 2)} == {1}
    assert op01_hmm.score(docs(spark, [])).count() == 0


# -- op2


def test_frequent_lines_are_cut_from_texts(spark):
    texts = [f"{prose(i, 60)}\n\nPage {i % 9} of 99\n{prose(100 + i, 10)} é\n  page  {i % 7} of 12" for i in range(25)] + ["page 1 of 22", "a\nb\n", None, ""]
    found = {r.doc_id: r for r in op02_line_rules.cleaned(docs(spark, texts).repartition(3), max_docs=20).collect()}
    assert [found[i].text for i in range(25)] == [f"{prose(i, 60)}\n\n{prose(100 + i, 10)} é" for i in range(25)]
    assert [found[i].text for i in range(25, 29)] == ["", "a\nb\n", None, ""]
    assert all(r.n_lost_words == r.n_words - len((r.text or "").split()) for r in found.values())
    rules = {r.doc_id: r for r in op02_line_rules.line_rules(docs(spark, texts), max_docs=20).collect()}
    assert {i: tuple(r) for i, r in rules.items()} == {i: tuple(r)[:-1] for i, r in found.items()}
    assert op02_line_rules.cleaned(awkward(spark)).count() == len(AWKWARD) + 3


def test_line_rules_equal_sql(spark):
    same(op02_line_rules.op2_line_rules(spark, SMALL), connect(SMALL), op02_line_rules.ORACLE_SQL)


def test_frequent_lines_go_and_depleted_documents_too(spark):
    own = [prose(i, 60) for i in range(30)]
    texts = [f"{own[i]}\nAll  rights reserved 20{i:02d}" for i in range(25)] + [prose(99, 60)] + [f"{own[0][:200]}\n{own[1]}" for _ in range(3)]
    found = {r.doc_id: r for r in op02_line_rules.line_rules(docs(spark, texts), max_docs=20).collect()}
    assert all(found[i].n_lost_words == 4 and found[i].kept for i in range(25)) and found[25].n_lost_words == 0
    strict = {r.doc_id: r for r in op02_line_rules.line_rules(docs(spark, texts), max_docs=20, max_lost=0.05).collect()}
    assert not any(strict[i].kept for i in range(25)) and strict[25].kept
    hosts = docs(spark, texts[:13]).unionByName(docs(spark, texts[13:25], start=13, source="t"))
    assert {r.n_lost_words for r in op02_line_rules.line_rules(hosts, max_docs=20).collect()} == {0}


def test_line_rule_edges(spark):
    found = op02_line_rules.line_rules(awkward(spark), max_docs=1).collect()
    assert len(found) == len(AWKWARD) + 3
    by = {r.doc_id: r for r in found if r.doc_id is not None and r.doc_id != 9}
    assert by[0].n_words == by[1].n_words == by[2].n_words == 0 and by[0].base_failed and not by[0].kept
    assert by[8].n_repeat_words == 3000 and by[4].word_chars == 1
    assert op02_line_rules.line_rules(docs(spark, [])).count() == 0


def test_line_rules_of_null_and_repeated_ids_equal_sql(spark):
    line = "shared line of words"
    rows = [(None, f"{prose(i, 60)}\n{line}", "s") for i in range(25)] + [(3, f"{prose(90, 70)}\nother line here", "t")] * 30 + [(4, None, "t"), (5, f"{line}\n" * 3000, "s"), (6, "", None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    con = duckdb.connect()
    con.register("documents", frame.toArrow())
    same(op02_line_rules.line_rules(frame), con, op02_line_rules.ORACLE_SQL)
    assert Counter(r.n_lost_words for r in op02_line_rules.line_rules(frame).collect()) == {4: 25, 0: 32, 12000: 1}


# -- op6


def test_toxic_terms_and_pairs_are_learned(spark):
    texts, toxic = [], []
    for i in range(400):
        words = prose(1, 400).split()
        pick = np.random.default_rng(i)
        insult, group = i % 2 == 0, i % 4 < 2
        body = list(pick.choice(words, 60)) + ["vermin"] * insult + ["northerners"] * group
        pick.shuffle(body)
        texts.append(" ".join(body))
        toxic.append(int(insult and group))
    frame = docs(spark, texts)
    labels = spark.createDataFrame([(i, 0, t) for i, t in enumerate(toxic)] + [(3, 0, None), (None, 0, 1)], "doc_id long, quality int, toxic int")
    machine = op06_toxicity.train(frame, labels)
    found = {r.doc_id: r.predicted for r in op06_toxicity.score(frame, machine).collect()}
    held = [i for i in range(400) if crc(i, 4) == 2]
    assert np.mean([found[i] == toxic[i] for i in held]) > 0.97


def test_pairs_whose_terms_say_nothing_alone_are_learned(spark):
    texts, toxic, words = [], [], prose(1, 400).split()
    for i in range(1200):
        pick = np.random.default_rng(i)
        insult, group = i // 3 % 2 == 0, i // 3 % 4 < 2
        body = list(pick.choice(words, 60)) + ["vermin"] * insult + ["northerners"] * group
        pick.shuffle(body)
        texts.append(" ".join(body))
        toxic.append(int(insult != group))
    frame = docs(spark, texts)
    machine = op06_toxicity.train(frame, spark.createDataFrame(list(enumerate(toxic)), "doc_id long, toxic int"))
    found = {r.doc_id: r.predicted for r in op06_toxicity.score(frame, machine).collect()}
    held = [i for i in range(1200) if crc(i, 4) == 2]
    assert np.mean([found[i] == toxic[i] for i in held]) > 0.95


def test_toxicity_query_equals_brute_force(spark):
    """Terms by regular expression, buckets by the written hash, log-odds by loops over pairs."""
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    machine = op06_toxicity.train(spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/labels.parquet"))
    codes, multiplier, full = op06_toxicity.B._CODES.tolist(), op06_toxicity.B._MULT, 1 << 64
    mixed = lambda x: int(op06_toxicity.B.mix(np.array([x % full], np.uint64))[0])
    hashed = lambda term: mixed(sum(codes[b] * pow(multiplier, i, full) for i, b in enumerate(term)) + len(term))
    place = {int(b): k for k, b in enumerate(machine.buckets)}
    mask = (1 << op06_toxicity.LOG2_BUCKETS) - 1

    def expected(text):
        bag = []
        for word in re.findall(rb"[0-9a-z\x80-\xff]+", bytes(op06_toxicity.B.LOWER[list((text or "").encode())])):
            bag.append(hashed(word) & mask)
            bag += [mixed(hashed(word[:k])) & mask for k in (6, 7, 8) if len(word) > k]
        has = set(bag) | {mixed(b + (1 << 32)) & mask for b in set(bag) if bag.count(b) > 1}
        features = [place[b] for b in sorted(has) if b in place]
        raw = machine.bias + sum(machine.weights[f] for f in features)
        raw += sum(float(machine.factors[f] @ machine.factors[g]) for f, g in combinations(features, 2))
        return 1 / (1 + np.exp(-raw))

    found = {r.doc_id: r for r in op06_toxicity.op6_toxicity(spark, SMALL).collect()}
    assert len(found) == len(rows) and len(machine.buckets) > 0
    for r in rows[::3]:
        assert found[r.doc_id].score == pytest.approx(expected(r.text), abs=1e-9)
        assert found[r.doc_id].predicted == int(found[r.doc_id].score >= 0.3) and found[r.doc_id].held_out == (crc(r.doc_id, 4) == 2)


def test_repeated_ids_are_learned_from_once(spark):
    frame = docs(spark, ["vermin here"] * 20 + ["good day"] * 20)
    labels = spark.createDataFrame([(i, int(i < 20)) for i in range(40)], "doc_id long, toxic int")
    once = op06_toxicity.train(frame, labels)
    more = op06_toxicity.train(frame.unionByName(frame).unionByName(frame.where("doc_id < 5")), labels)
    assert once.bias == more.bias and (once.weights == more.weights).all() and len(once.buckets)


def test_pair_term_equals_its_definition():
    random = np.random.default_rng(0)
    w, v = random.normal(size=5), random.normal(size=(5, 4))
    machine = op06_toxicity.Machine(np.arange(5), 0.3, w, v)
    doc, feature = np.array([0, 0, 0, 1]), np.array([0, 2, 4, 3])
    wanted = 0.3 + w[[0, 2, 4]].sum() + sum(v[a] @ v[b] for a, b in ((0, 2), (0, 4), (2, 4)))
    assert machine.raw(doc, feature, 3) == pytest.approx([wanted, 0.3 + w[3], 0.3])


def test_toxicity_edges(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    found = op06_toxicity.score(awkward(spark), op06_toxicity.train(awkward(spark), labels)).collect()
    assert len(found) == len(AWKWARD) + 3 and {r.score for r in found} == {0.0}
    one = op06_toxicity.train(awkward(spark), spark.createDataFrame([(i, 0, 1) for i in range(12)], "doc_id long, quality int, toxic int"))
    assert all(0 <= r.score <= 1 for r in op06_toxicity.score(awkward(spark), one).collect())
    assert op06_toxicity.score(docs(spark, []), one).count() == 0


# -- op8


@pytest.fixture(scope="module")
def machine():
    return op08_sentencepiece.Transducer.load(op08_sentencepiece.MODEL_FILE)


def test_ids_equal_the_public_library(machine):
    import random

    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=op08_sentencepiece.MODEL_FILE)
    random.seed(4)
    for k in range(3000):
        text = "".join(random.choices(list("abcdeiou  \n\t.,12éñß業👍_-'▁AES"), k=random.randint(0, 40)))
        assert machine.encode(text).tolist() == library.encode(text), text
        if "▁" not in text:
            assert machine.decode(machine.encode(text)) == text


def test_ids_of_whole_texts_equal_the_public_library(spark, machine):
    import random

    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=op08_sentencepiece.MODEL_FILE)
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    random.seed(6)
    planes = [(32, 127), (160, 880), (0x400, 0x600), (0x4E00, 0x9000), (0x1F300, 0x1FAFF), (1, 32)]
    texts += ["".join(chr(random.randint(*random.choice(planes))) for _ in range(random.randint(1, 60))) for _ in range(1500)]
    assert [machine.encode(t).tolist() for t in texts] == library.encode(texts)


def test_the_normaliser_is_the_models(machine):
    assert machine.normaliser == op08_sentencepiece.Normaliser(prefix=True, squeeze=False, escape=True)
    read = lambda spec: op08_sentencepiece.Normaliser.compiled(b"\x1a" + bytes([len(spec)]) + spec)
    assert read(b"") == op08_sentencepiece.Normaliser(True, True, True)
    assert read(b"\x0a\x02ab\x18\x00\x20\x01\x28\x00") == op08_sentencepiece.Normaliser(False, True, False)
    with pytest.raises(ValueError):
        read(b"\x12\x03abc")
    assert op08_sentencepiece.Normaliser()("  a  b ") == "▁a▁b" and op08_sentencepiece.Normaliser(False, False)(" a") == "▁a"


def test_the_search_from_the_left_asks_for_fewer_neighbours():
    """Neighbours of words of the table and of random strings, some with characters outside the lexicon: the same path, fewer pairs tried."""
    looked = Counter()

    class Counted(dict):
        def get(self, key):
            looked[self.name] += 1
            return dict.get(self, key)

    machine = op08_sentencepiece.Transducer.load(op08_sentencepiece.MODEL_FILE)
    pick = np.random.default_rng(5)
    words = sorted({"▁" + w for w in prose(3, 3000, 4000).split()}) + ["".join(pick.choice(list("aabtheingér日\U0001f9ff0._"), pick.integers(1, 30))) for _ in range(2000)]
    machine.tails = {p[k:]: -1 for p in machine.ids for k in range(len(p))} | machine.ids
    paths = {}
    for name in ("left", "right"):
        machine.forward = name == "left"
        machine.stems.clear()
        machine.allowed = Counted(machine.allowed)
        machine.allowed.name = name
        paths[name] = [machine._shortest(w) for w in words]
    assert paths["left"] == paths["right"] and 0 < looked["left"] < 0.7 * looked["right"]


def test_unigram_weights_take_the_least_path():
    t = op08_sentencepiece.Transducer(["a", "b", "ab", "ba", "aba"], [-1.0, -1.0, -1.5, -1.2, -9.0], [False] * 5, [True] * 5, merges=False)
    assert [t.pieces[i] for i in t._shortest("aba")] == ["a", "ba"]


def test_corpus_round_trip(spark):
    found = op08_sentencepiece.op8_sentencepiece(spark, SMALL).collect()
    assert len(found) == 200 and all(r.exact and len(r.ids) == r.n_ids for r in found)
    back = op08_sentencepiece.decode(op08_sentencepiece.encode(spark.read.parquet(f"{SMALL}/documents.parquet")))
    assert back.join(spark.read.parquet(f"{SMALL}/documents.parquet"), "doc_id").where("decoded_text <> text").count() == 0


def test_piece_edges(spark):
    found = op08_sentencepiece.encode(awkward(spark)).collect()
    assert len(found) == len(AWKWARD) + 3 and all(r.exact for r in found)
    assert {r.n_ids for r in found if r.doc_id in (0, 1)} == {0}
    assert op08_sentencepiece.encode(docs(spark, [])).count() == 0


# -- op9


def test_held_out_languages(spark):
    wanted = {r.doc_id: r.lang for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    found = op09_language_id.op9_language_id(spark, SMALL).collect()
    assert len(found) == len(wanted) and all(0 <= r.score <= 1 for r in found)
    held = [r.lang_pred == wanted[r.doc_id] for r in found if r.held_out]
    assert np.mean(held) > 0.9
    assert all(r.held_out == (crc(r.doc_id, 3) == 1) for r in found)


def plain_gru(network, text, side):
    """States of one direction at each byte, by the definition, one byte at a time."""
    p = {k: v.astype(float) for k, v in network.p.items()}
    sigmoid = lambda v: 1 / (1 + np.exp(-v))
    h, out = np.zeros(network.hidden), []
    for b in text if side == "f" else text[::-1]:
        r, z = (sigmoid(p[f"{side}{g}x"][b] + h @ p[f"{side}{g}h"]) for g in "rz")
        c = np.tanh(p[f"{side}nx"][b] + r * (h @ p[f"{side}nh"]))
        h = (1 - z) * h + z * c
        out.append(h)
    return np.array(out if side == "f" else out[::-1])


def plain_labels(network, text):
    logits = np.concatenate([plain_gru(network, text, "f"), plain_gru(network, text, "b")], 1) @ network.p["out"] + network.p["bias"]
    return (np.exp(logits) / np.exp(logits).sum(1, keepdims=True)).mean(0)


def test_reading_equals_a_plain_network_over_whole_texts():
    random = np.random.default_rng(0)
    network = op09_language_id.Network(["a", "b", "c"])
    texts = [random.integers(0, 256, n).astype(np.uint8) for n in (20, 0, 700, 1, 20, 333, 64, 129)]
    buf, offsets = np.concatenate(texts), np.cumsum([0, *map(len, texts)])
    wanted = np.array([plain_labels(network, t) if len(t) else np.zeros(3) for t in texts])
    for cells, long in ((1 << 19, 4096), (400, 4096), (400, 100), (64, 20), (3, 0)):  # all together, in several blocks, and in pieces
        assert network.read(buf, offsets, cells, long) == pytest.approx(wanted, abs=1e-5)
    forward, _ = network._forward("f", np.stack([texts[0], texts[4]], 1).astype(int))
    assert forward[:, 1] == pytest.approx(plain_gru(network, texts[4], "f"), abs=1e-5)


def test_language_query_equals_a_plain_network(spark):
    frame = spark.read.parquet(f"{SMALL}/documents.parquet")
    network = op09_language_id.train(frame)
    found = {r.doc_id: r for r in op09_language_id.op9_language_id(spark, SMALL).collect()}
    for r in sorted(frame.collect(), key=lambda r: len(r.text or ""))[::17]:
        p = plain_labels(network, np.frombuffer(r.text.encode(), np.uint8))
        assert found[r.doc_id].score == pytest.approx(p.max(), abs=1e-4) and found[r.doc_id].lang_pred == network.languages[p.argmax()]


def test_gradients_match_differences():
    random = np.random.default_rng(0)
    network = op09_language_id.Network(["a", "b"], hidden=3)
    network.p = {k: v.astype(np.float64) for k, v in network.p.items()}
    x = random.integers(0, 256, (6, 4))
    slopes = random.normal(size=(6, 4, 3))
    for side, inside in (("f", None), ("b", None), ("b", (np.arange(6)[:, None] < [6, 4, 6, 5]).astype(float))):
        states, trail = network._forward(side, x, inside)
        g = {k: np.zeros_like(v) for k, v in network.p.items()}
        network._backward(side, x, slopes, trail, g)
        for name, at in ((f"{side}rh", (0, 1)), (f"{side}zh", (2, 0)), (f"{side}nh", (1, 1)), (f"{side}nx", (x[2, 1], 2)), (f"{side}zx", (x[3, 0], 0))):
            values = []
            for step in (1e-3, -1e-3):
                network.p[name][at] += step
                values.append((network._forward(side, x, inside)[0].astype(np.float64) * slopes).sum())
                network.p[name][at] -= step
            assert (values[0] - values[1]) / 2e-3 == pytest.approx(g[name][at], rel=2e-2, abs=2e-3)


def test_language_edges(spark):
    network = op09_language_id.train(docs(spark, [prose(i, 50) for i in range(8)]))
    found = op09_language_id.label(awkward(spark), network).collect()
    assert len(found) == len(AWKWARD) + 3
    by = {r.doc_id: r for r in found if r.doc_id is not None}
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (0, 1, 2, 5, 7)) and by[4].lang_pred == "en"
    assert {r.lang_pred for r in op09_language_id.label(awkward(spark), None).collect()} == {"und"}
    wide = awkward(spark).withColumn("lang_pred", F.lit(5)).withColumn("_text", F.lit("x"))
    assert {r.doc_id: (r.lang_pred, r["_text"]) for r in op09_language_id.label(wide, network, keep=wide.columns).collect() if r.doc_id == 4} == {4: ("en", "x")}
    assert op09_language_id.train(docs(spark, [])) is None and op09_language_id.label(docs(spark, []), network).count() == 0




# -- all: bytes that are not valid UTF-8


def test_invalid_bytes_are_stood(spark):
    frame = spark.sql("SELECT CAST(id AS LONG) AS doc_id, CAST(X'61FF6220C3' AS STRING) AS text, 'en' AS lang, 's' AS source FROM range(12)")
    assert op01_hmm.score(frame).count() == 12
    assert {r.word_chars for r in op02_line_rules.line_rules(frame).collect()} == {4}
    assert op06_toxicity.score(frame, op06_toxicity.train(frame, frame.selectExpr("doc_id", "CAST(doc_id % 2 AS INT) AS toxic"))).count() == 12
    assert {r.n_ids > 0 for r in op08_sentencepiece.encode(frame).collect()} == {True}
    assert op09_language_id.label(frame, op09_language_id.train(frame)).count() == 12
