"""Language identification: a bidirectional gated recurrent network over bytes, trained in numpy.

Texts are read whole: one recurrent unit reads the bytes forwards from the first and another backwards from the last; at
every position the two states give a probability for each language (the position's label), and a document's probabilities
are the mean over all its positions.  Training is backpropagation through time on windows of a bounded sample of
documents (`max_texts`, those with the least hash of doc_id; one window of each, placed by hash).

Scoring is one narrow pass.  Texts of like length advance together, and long ones in pieces of positions: a first pass
backwards keeps the backward states at the ends of the pieces, a second one goes through the pieces forwards with both
directions.  So at most the states of one piece (`_CELLS` bytes of texts) are kept, whatever the length of a text.

Defined cases: a null text or one without a letter is `und` with score 0; null languages are not learned from; without
any learned language every text is `und`; ties go to the first language in order; a null doc_id is not held out; extra
columns are ignored or carried, whatever their names (`lang_pred` and `score` replace kept columns of these names);
repeated rows repeat; training windows shorter than `TRAIN_LENGTH` end there, without padding.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bytesx as B
from tessera.llm.op06_toxicity import held_out
from tessera.llm.shared import carry, least_hashed

HIDDEN = 8
MAX_TEXTS = 3_000
TRAIN_LENGTH = 64
_CODES = 256
_CELLS = 1 << 19
_LONG = 1 << 12
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Network:
    """Two gated recurrent units over byte codes and a softmax over languages at each position."""

    def __init__(self, languages: list[str], hidden: int = HIDDEN, seed: int = 3):
        random = np.random.default_rng(seed)
        self.languages, self.hidden = languages, hidden
        small = lambda *shape: random.normal(0, 0.3, shape).astype(np.float32)
        self.p = {"out": small(2 * hidden, len(languages)), "bias": np.zeros(len(languages), np.float32)}
        for side in "fb":
            for gate in "rzn":
                self.p[f"{side}{gate}x"] = small(_CODES, hidden)
                self.p[f"{side}{gate}h"] = small(hidden, hidden)

    # -- training: all states of a batch are kept for the way back

    def _forward(self, side: str, x: np.ndarray, inside: np.ndarray | None = None) -> tuple[np.ndarray, list]:
        """States at each position (rows of x); outside their text they stay as they are."""
        p, (steps, n) = self.p, x.shape
        h = np.zeros((n, self.hidden), np.float32)
        states, trail = np.zeros((steps, n, self.hidden), np.float32), []
        for t in range(steps) if side == "f" else range(steps - 1, -1, -1):
            r = _sigmoid(p[f"{side}rx"][x[t]] + h @ p[f"{side}rh"])
            z = _sigmoid(p[f"{side}zx"][x[t]] + h @ p[f"{side}zh"])
            if inside is not None:
                z *= inside[t][:, None]
            u = h @ p[f"{side}nh"]
            c = np.tanh(p[f"{side}nx"][x[t]] + r * u)
            trail.append((t, h, r, z, u, c))
            h = h + z * (c - h)
            states[t] = h
        return states, trail

    def _backward(self, side: str, x: np.ndarray, slopes: np.ndarray, trail: list, g: dict[str, np.ndarray]) -> None:
        p, dh = self.p, np.zeros_like(slopes[0])
        at = {gate: [] for gate in "rzn"}
        seen = []
        for t, h, r, z, u, c in reversed(trail):
            dh = dh + slopes[t]
            dc = dh * z * (1 - c * c)
            dz = dh * (c - h) * z * (1 - z)
            dr = dc * u * r * (1 - r)
            du = dc * r
            g[f"{side}rh"] += h.T @ dr
            g[f"{side}zh"] += h.T @ dz
            g[f"{side}nh"] += h.T @ du
            dh = dh * (1 - z) + dr @ p[f"{side}rh"].T + dz @ p[f"{side}zh"].T + du @ p[f"{side}nh"].T
            seen.append(x[t])
            for gate, d in (("r", dr), ("z", dz), ("n", dc)):
                at[gate].append(d)
        code = np.concatenate(seen)
        for gate, parts in at.items():
            d = np.concatenate(parts)
            for k in range(self.hidden):
                g[f"{side}{gate}x"][:, k] += np.bincount(code, d[:, k], _CODES)

    def train(self, x: np.ndarray, size: np.ndarray, y: np.ndarray, steps: int = 240, batch: int = 192, rate: float = 0.02, seed: int = 5) -> None:
        """x: windows by rows of bytes, of which the first `size` count; y: numbers of their languages."""
        random = np.random.default_rng(seed)
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        for step in range(1, steps + 1):
            pick = random.choice(len(x), batch)
            part, label = np.ascontiguousarray(x[pick].T), y[pick]
            inside = (np.arange(len(part))[:, None] < size[pick]).astype(np.float32)
            forward, f_trail = self._forward("f", part, inside)
            backward, b_trail = self._forward("b", part, inside)
            both = np.concatenate([forward, backward], 2)
            logits = both @ self.p["out"] + self.p["bias"]
            slope = np.exp(logits - logits.max(2, keepdims=True))
            slope /= slope.sum(2, keepdims=True)
            slope[:, np.arange(batch), label] -= 1
            slope *= inside[:, :, None] / inside.sum()
            g = {k: np.zeros_like(v) for k, v in self.p.items()}
            g["out"] = both.reshape(-1, 2 * self.hidden).T @ slope.reshape(-1, slope.shape[2])
            g["bias"] = slope.sum((0, 1))
            down = slope @ self.p["out"].T
            self._backward("f", part, down[:, :, : self.hidden], f_trail, g)
            self._backward("b", part, down[:, :, self.hidden :], b_trail, g)
            norm = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
            now = rate * min(1.0, 2 * (1 - step / (steps + 1)))
            for k, v in g.items():
                v = v * min(1.0, 1.0 / (norm + 1e-12))
                first[k] = 0.9 * first[k] + 0.1 * v
                second[k] = 0.99 * second[k] + 0.01 * v * v
                self.p[k] = (self.p[k] - now * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)

    # -- reading: gates of both halves of a sigmoid are folded into the weights

    def _tables(self, side: str) -> tuple[np.ndarray, np.ndarray]:
        """Byte to (reset, update, candidate), state to the same; u of the candidate is halved as its gate is doubled."""
        halves = {"r": 0.5, "z": 0.5, "n": 1.0}
        by_byte = np.stack([self.p[f"{side}{gate}x"] * half for gate, half in halves.items()])
        by_state = np.stack([self.p[f"{side}{gate}h"] * 0.5 for gate in halves])
        return by_byte.astype(np.float32), by_state.astype(np.float32)

    def _states(self, side: str, codes: np.ndarray, active: np.ndarray, h: np.ndarray, kept: np.ndarray | None) -> None:
        """Steps texts (longest first, `active` at each position) through the positions of a piece, changing their states h.

        codes: positions by texts; kept: positions by texts by hidden, gets all states.
        """
        by_byte, by_state = self._tables(side)
        for t in range(len(codes)) if side == "f" else range(len(codes) - 1, -1, -1):
            m = active[t]
            now = h[:m]
            x = by_byte.take(codes[t, :m], 1)
            u = now @ by_state
            gates, c = x[:2], u[2]
            gates += u[:2]
            np.tanh(gates, out=gates)
            gates += 1
            c *= gates[0]
            c += x[2]
            np.tanh(c, out=c)
            c -= now
            gates[1] *= 0.5
            c *= gates[1]
            now += c
            if kept is not None:
                kept[t, :m] = now

    def _summed(self, buf: np.ndarray, start: np.ndarray, size: np.ndarray, cells: int) -> np.ndarray:
        """Sums of the positions' probabilities of texts, longest first."""
        n, longest = len(size), int(size[0])
        active = np.searchsorted(-size, -np.arange(1, longest + 1), "right").tolist()
        steps = max(1, cells // n)
        pieces = [(lo, min(lo + steps, longest)) for lo in range(0, longest, steps)]
        codes = lambda lo, hi: buf[np.minimum(start[: active[lo]] + np.arange(lo, hi)[:, None], len(buf) - 1)]
        h = np.zeros((n, self.hidden), np.float32)
        behind = [h.copy()]
        for lo, hi in pieces[:0:-1]:
            self._states("b", codes(lo, hi), active[lo:hi], h, None)
            behind.append(h.copy())
        ahead, total = np.zeros((n, self.hidden), np.float32), np.zeros((n, len(self.languages)))
        for (lo, hi), back in zip(pieces, behind[::-1], strict=True):
            m, x, on = active[lo], codes(lo, hi), active[lo:hi]
            kept = np.zeros((2, hi - lo, m, self.hidden), np.float32)
            self._states("f", x, on, ahead, kept[0])
            self._states("b", x, on, back, kept[1])
            p = kept[0] @ self.p["out"][: self.hidden]
            p += kept[1] @ self.p["out"][self.hidden :]
            p += self.p["bias"]
            np.exp(p, out=p)
            p *= (np.arange(m) < np.array(on)[:, None])[:, :, None] / (p @ np.ones((p.shape[2], 1), np.float32))
            total[:m] += p.sum(0)
        return total

    def read(self, buf: np.ndarray, offsets: np.ndarray, cells: int = _CELLS, long: int = _LONG) -> np.ndarray:
        """Mean probabilities of each text of a buffer (zeros for an empty one)."""
        lengths = np.diff(offsets)
        total = np.zeros((len(lengths), len(self.languages)))
        order = np.argsort(-lengths, kind="stable")
        n_long, n_filled = int((lengths > long).sum()), int((lengths > 0).sum())
        sums = np.concatenate([[0], np.cumsum(lengths[order[n_long:n_filled]])])
        for lo, hi in [(0, n_long), *((n_long + a, n_long + b) for a, b in B.chunks(sums, cells))]:
            if hi > lo:
                own = order[lo:hi]
                total[own] = self._summed(buf, offsets[own], lengths[own], cells)
        return total / np.maximum(1, lengths)[:, None]


def train(docs: DataFrame, max_texts: int = MAX_TEXTS) -> Network | None:
    """Fit on one window of at most max_texts documents with a language whose crc32 modulo 3 is not 1."""
    span = 2 * TRAIN_LENGTH
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.make_valid_utf8(F.col("text").cast("string")).alias("text"))
    free = F.greatest(F.length("text") - span, F.lit(0)) + 1
    part = F.substring("text", F.pmod(F.xxhash64("doc_id", F.lit(1)), free).cast("int") + 1, F.lit(span))
    known = rows.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), 3, 1)).select("doc_id", "lang", part.alias("part"))
    sample = least_hashed(known, "doc_id", max_texts).select("lang", "part").toArrow()
    pairs = [(a, b.encode()) for a, b in zip(sample["lang"].to_pylist(), sample["part"].to_pylist(), strict=True) if any(map(str.isalpha, b or ""))]
    if not pairs:
        return None
    languages = sorted({a for a, _ in pairs})
    x = np.zeros((len(pairs), TRAIN_LENGTH), np.int64)
    for i, (_, b) in enumerate(pairs):
        x[i, : len(b)] = np.frombuffer(b[:TRAIN_LENGTH], np.uint8)
    network = Network(languages)
    network.train(x, np.array([min(len(b), TRAIN_LENGTH) for _, b in pairs]), np.array([languages.index(a) for a, _ in pairs]))
    return network


def label(docs: DataFrame, network: Network | None, keep: list[str] | None = None) -> DataFrame:
    """Columns `keep` (default: doc_id) of docs, with lang_pred and score."""
    carried, added = carry(docs, keep or ["doc_id"], ["lang_pred", "score"])
    rows = docs.select(*[docs[c].alias(a) for a, c in carried.items()], docs["text"].cast("string").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = B.buffer(batch.column(batch.num_columns - 1))
            n = batch.num_rows
            p = network.read(buf, offsets) if network else np.zeros((n, 1))
            ascii_letters = np.concatenate([[0], np.cumsum(_LETTER[buf])])
            letters = ascii_letters[offsets[1:]] > ascii_letters[offsets[:-1]]
            for i in np.flatnonzero(~letters & (offsets[1:] > offsets[:-1])):
                letters[i] = any(map(str.isalpha, buf[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace")))
            letters &= network is not None
            best = p.argmax(1)
            languages = [network.languages[k] if fine else "und" for k, fine in zip(best.tolist(), letters.tolist(), strict=True)]
            scores = np.where(letters, np.clip(p[np.arange(n), best], 0, 1), 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(languages, pa.string()), pa.array(scores)], names=[*carried, "_lang", "_score"])

    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "_text"]
    found = rows.mapInArrow(run, ", ".join([*kept, "_lang string", "_score double"]))
    return found.select(*[F.col(a).alias(c) for a, c in carried.items()], F.col("_lang").alias(added[0]), F.col("_score").alias(added[1]))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return label(docs, train(docs)).select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "lang_pred", "score")
