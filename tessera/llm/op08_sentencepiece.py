"""SentencePiece encoding and decoding with a weighted finite-state transducer.

The machine is the composition of three parts, compiled once from a public model file:

* the normaliser, as the model's own specification says: perhaps white space at the ends dropped and runs of spaces
  made one, perhaps one space put in front, then every space the word mark.  It is the identity on all other characters; a
  model that maps characters is refused;
* the piece lexicon: one arc for each piece, weighted by the negated score.  For a merge model the lexicon is composed
  with an acceptor of canonical neighbours: a pair of pieces that merging could not leave side by side has infinite
  weight.  For a unigram model that acceptor accepts every pair at no cost;
* byte fallback: a character outside the lexicon becomes its UTF-8 bytes.

Encoding composes the machine with a text and takes the path of least weight in the (min, +) semiring.  No piece holds
a word mark after another character, and (checked when compiling) none mixes letters of the Latin alphabet with other characters, so the
lattice has a single state at each such border, and the path is the chain of the paths of short segments.  Segments
repeat, so their paths are kept in a bounded cache.

Defined cases: a null or empty text has no ids and decodes to the empty text; the word mark itself in a text is read
as a space (as in the public library), so only such texts do not come back exactly; strings that look like control
pieces are ordinary text; bytes that are not valid UTF-8 are read as U+FFFD; extra columns are ignored; rows are independent, so repeated rows repeat.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bytesx as B
from tessera.llm.shared import carry

MARK = "▁"
MODEL_FILE = "/opt/tokenizers/piece_bpe_32k.model"
CACHE = 128_000
STEM = 6
#: Letters of one alphabet: segments also end at its borders if no piece holds such a letter beside a character of another kind.
_LATIN = r"A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u02af\u1e00-\u1eff"


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Numbers and values of the fields of a protocol buffer message (varints and byte strings; others are passed over)."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            value |= (raw[at] & 0x7F) << shift
            at, shift = at + 1, shift + 7
            if raw[at - 1] < 0x80:
                return value, at

    at = 0
    while at < len(raw):
        head, at = varint(at)
        if head & 7 == 0:
            value, at = varint(at)
            yield head >> 3, value
        elif head & 7 == 2:
            size, at = varint(at)
            yield head >> 3, raw[at : at + size]
            at += size
        else:
            at += 8 if head & 7 == 1 else 4


class Normaliser(NamedTuple):
    """What the model's normaliser does; the defaults are those of the format."""

    prefix: bool = True
    squeeze: bool = True
    escape: bool = True

    @classmethod
    def compiled(cls, model: bytes) -> Normaliser:
        """From a model: its specification is field 3; of that 2 maps characters, 3 to 5 are the flags."""
        found = dict(_fields(next((value for number, value in _fields(model) if number == 3), b"")))
        if found.get(2):
            raise ValueError("the model's normaliser maps characters; only models that leave them as they are can be compiled")
        return cls(*(bool(found.get(number, 1)) for number in (3, 4, 5)))

    def __call__(self, text: str) -> str:
        if self.squeeze:
            text = re.sub(" +", " ", text).strip(" ")
        if self.prefix and text:
            text = " " + text
        return text.replace(" ", MARK) if self.escape else text


class Transducer:
    """Normaliser, lexicon and byte fallback, compiled from (piece, score, is_byte, is_text) rows."""

    def __init__(self, pieces: list[str], scores: list[float], is_byte: list[bool], is_text: list[bool], merges: bool = True, normaliser: Normaliser = Normaliser(squeeze=False)):  # noqa: B008
        self.normaliser = normaliser
        self.pieces, self.scores, self.merges = pieces, scores, merges
        self.ids = {p: i for i, p in enumerate(pieces) if is_text[i] and not is_byte[i]}
        self.byte_ids = {int(p[3:5], 16): i for i, p in enumerate(pieces) if is_byte[i]}
        #: A merge model whose pieces consist of characters that are pieces: its only path is found from the left, by the heads of pieces.
        self.forward = merges and all(c in self.ids for p in self.ids for c in p)
        self.heads: dict[str, int] = {p[:k]: -1 for p in self.ids for k in range(1, len(p))} | self.ids if self.forward else {}
        self.tails: dict[str, int] = {} if self.forward else {p[k:]: -1 for p in self.ids for k in range(len(p))} | self.ids
        self.lengths = list(map(len, pieces))
        self.surface = [bytes([int(p[3:5], 16)]) if is_byte[i] else p.replace(MARK, " ").encode() if is_text[i] else b"" for i, p in enumerate(pieces)]
        inner = any(MARK in p.lstrip(MARK) for p in self.ids)
        mixed = any(re.search(f"[{_LATIN}][^{_LATIN}▁]|[^{_LATIN}▁][{_LATIN}]", p) for p in self.ids)
        self.split = re.compile(r"(?s).+" if inner else r"▁*[^▁]+|▁+" if mixed else rf"▁*[{_LATIN}]+|▁*[^{_LATIN}▁]+|▁+")
        self.edges: dict[tuple[int, int], list[tuple[str, float]]] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.allowed: dict[int, bool] = {}
        self.stems: dict[str, tuple[tuple[int, ...], ...]] = {}
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        if merges:
            self._learn_parts()

    @classmethod
    def load(cls, model_file: str) -> Transducer:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = range(sp.get_piece_size())
        scores = [sp.get_score(i) for i in n]
        text = [not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)) for i in n]
        steps = [a - b for a, b in zip(scores, scores[1:], strict=False) if a > b]
        normaliser = Normaliser.compiled(sp.serialized_model_proto())
        return cls([sp.id_to_piece(i) for i in n], scores, [sp.is_byte(i) for i in n], text, merges=bool(steps) and all(float(s).is_integer() for s in steps), normaliser=normaliser)

    # -- canonical neighbours of a merge model

    def _learn_parts(self) -> None:
        """The last merge that makes each piece out of its characters, found by merging the piece itself."""
        for piece, i in self.ids.items():
            if len(piece) > 1:
                parts = list(piece)
                while len(parts) > 2:
                    score, at = max(((self._score(parts[k] + parts[k + 1]), -k) for k in range(len(parts) - 1)))
                    if score == -math.inf:
                        break
                    parts[-at : -at + 2] = [parts[-at] + parts[-at + 1]]
                if len(parts) == 2 and parts[0] in self.ids and parts[1] in self.ids:
                    self.parts[i] = (self.ids[parts[0]], self.ids[parts[1]])

    def _score(self, piece: str) -> float:
        i = self.ids.get(piece)
        return -math.inf if i is None else self.scores[i]

    def canonical(self, left: int, right: int) -> bool:
        """Whether merging leaves this pair: no two pieces that meet at the border on the way join before they are used up."""
        key = left << 24 | right
        known = self.allowed.get(key)
        if known is not None:
            return known
        fits, ids, scores = True, self.ids, self.scores
        b_edge = self._edge(right, 0)
        for a, a_used in self._edge(left, 1):
            for b, b_used in b_edge:
                joined = ids.get(a + b)
                if joined is not None and scores[joined] > a_used and scores[joined] >= b_used:
                    fits = False
                    break
            if not fits:
                break
        if len(self.allowed) > 2 * CACHE:
            self.allowed.clear()
        self.allowed[key] = fits
        return fits

    def _edge(self, piece: int, side: int) -> list[tuple[str, float]]:
        """The pieces that lie at one edge (0: left, 1: right) while a piece is made, each with the score of the merge that uses it up."""
        found = self.edges.get((piece, side))
        if found is None:
            found, used, i = [], -math.inf, piece
            while True:
                found.append((self.pieces[i], used))
                if i not in self.parts:
                    break
                used, i = self.scores[i], self.parts[i][side]
            self.edges[piece, side] = found
        return found

    # -- shortest paths

    def _marks(self, n: int) -> list[int]:
        """A run of word marks: all their merges weigh the same, so the leftmost goes first."""
        stack: list[str] = []
        for _ in range(n):
            stack.append(MARK)
            while len(stack) > 1 and stack[-2] + stack[-1] in self.ids:
                stack[-2:] = [stack[-2] + stack[-1]]
        return [self.ids[p] for p in stack] if MARK in self.ids else [self.byte_ids[b] for _ in range(n) for b in MARK.encode()]

    def path(self, segment: str) -> list[int]:
        """Ids on the path of least weight through one segment of normalised text."""
        ahead = len(segment) - len(segment.lstrip(MARK))
        if self.merges and ahead > 1 or ahead == len(segment):
            if ahead == len(segment):
                return self._marks(ahead)
            rest = self._shortest(segment[ahead - 1 :])
            if self.pieces[rest[0]] == MARK:
                return self._marks(ahead) + rest[1:]
            return self._marks(ahead - 1) + rest
        return self._shortest(segment)

    def _shortest(self, s: str) -> list[int]:
        if self.forward:
            return self._ahead(s)
        best = self._only(s) if self.merges else self._least(s)
        out: list[int] = []
        end = len(s)
        while end:
            last, begin = best[end]
            out += [last] if last >= 0 else [self.byte_ids[b] for b in reversed(s[begin:end].encode())]
            end = begin
        out.reverse()
        return out

    def _least(self, s: str) -> list[tuple[int, int]]:
        """For each end the last arc of the path of least weight to it: piece (-1: bytes) and start."""
        ids, tails, scores = self.ids, self.tails, self.scores
        weights, arcs = [0.0] + [math.inf] * len(s), [(-1, 0)] * (len(s) + 1)
        for end in range(1, len(s) + 1):
            for start in range(end - 1, -1, -1):
                piece = tails.get(s[start:end])
                if piece is None:
                    break
                if piece >= 0 and weights[start] - scores[piece] < weights[end]:
                    weights[end], arcs[end] = weights[start] - scores[piece], (piece, start)
            if weights[end] == math.inf and s[end - 1] not in ids:
                weights[end], arcs[end] = weights[end - 1] + 1e6, (-1, end - 1)
        return arcs

    def _only(self, s: str) -> list[tuple[int, int]]:
        """The same for a merge model, in which all paths but one have a pair of neighbours of infinite weight: no weights to add."""
        ids, tails, allowed, canonical = self.ids, self.tails.get, self.allowed.get, self.canonical
        lasts, begins = [-1], [0]  # -1: start or bytes, -2: no path
        if len(s) > STEM:  # arcs up to a place depend on what is before it only, and many segments begin alike
            stem = s[:STEM]
            arcs = self.stems.get(stem)
            if arcs is None:
                arcs = tuple(zip(*self._only(stem), strict=True))
                if len(self.stems) >= CACHE // 4:
                    self.stems.clear()
                self.stems[stem] = arcs
            lasts, begins = map(list, arcs)
        for end in range(len(lasts), len(s) + 1):
            last, begin, start = -2, end - 1, end
            while start:
                start -= 1
                piece = tails(s[start:end])
                if piece is None:
                    break
                if piece < 0:
                    continue
                prior = lasts[start]
                if prior < 0:
                    fits = prior == -1
                else:
                    fits = allowed(prior << 24 | piece)
                    if fits is None:
                        fits = canonical(prior, piece)
                if fits:
                    last, begin = piece, start
                    break
            if last == -2 and lasts[end - 1] != -2 and s[end - 1] not in ids:
                last = -1
            lasts.append(last)
            begins.append(begin)
        return list(zip(lasts, begins, strict=True))

    def _ahead(self, s: str) -> list[int]:
        """Ids on the only path, depth first and the longest arc first.

        The arcs before a place are the only ones that lead there, so a place from which no arc leads on is dead for all of the search.
        """
        heads, ids, lengths, allowed, canonical = self.heads.get, self.ids, self.lengths, self.allowed.get, self.canonical
        path: list[int] = []  # piece, or -1: the bytes of a character
        waits: list[list[int]] = []  # at the start of each arc of the path: the shorter arcs not yet tried
        dead: set[int] = set()
        at, prior, whole, n = 0, -1, True, len(s)
        while at < n:
            arcs: list[int] = []
            end = at
            while end < n:
                end += 1
                piece = heads(s[at:end])
                if piece is None:
                    break
                if piece >= 0:
                    arcs.append(piece)
            if not arcs and s[at] not in ids:
                path.append(-1)
                waits.append(arcs)
                at, prior, whole = at + 1, -1, False
                continue
            while True:
                fits = False
                while arcs:
                    piece = arcs.pop()
                    if prior >= 0:
                        fits = allowed(prior << 24 | piece)
                        if fits is None:
                            fits = canonical(prior, piece)
                        if not fits:
                            continue
                    if not dead or at + lengths[piece] not in dead:
                        fits = True
                        break
                    fits = False
                if fits:
                    path.append(piece)
                    waits.append(arcs)
                    at, prior = at + lengths[piece], piece
                    break
                dead.add(at)
                at -= lengths[prior] if prior >= 0 else 1
                path.pop()
                arcs, prior = waits.pop(), path[-1] if path else -1
        if whole:
            return path
        out, at = [], 0
        for piece in path:
            out += [piece] if piece >= 0 else [self.byte_ids[b] for b in s[at].encode()]
            at += lengths[piece] if piece >= 0 else 1
        return out

    def packed(self, segment: str) -> bytes:
        """The path as packed 32-bit ids, from a cache of two bounded generations."""
        found = self.cache.get(segment)
        if found is None:
            found = self.older.get(segment)
            if found is None:
                found = np.array(self.path(segment), np.int32).tobytes()
            if len(segment) < 64:
                if len(self.cache) >= CACHE // 2:
                    self.older, self.cache = self.cache, {}
                self.cache[segment] = found
        return found

    def encode(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, np.int32)
        known, packed = self.cache.get, self.packed
        return np.frombuffer(b"".join([known(x) or packed(x) for x in self.split.findall(self.normaliser(text))]), np.int32)

    def decode(self, ids: np.ndarray) -> str:
        if not len(ids):
            return ""
        whole = b"".join(map(self.surface.__getitem__, ids.tolist())).decode("utf-8", "replace")
        return whole.removeprefix(" ") if self.normaliser.prefix else whole

    def __getstate__(self) -> dict:
        return self.__dict__ | {"cache": {}, "older": {}, "stems": {}, "allowed": {}, "edges": {}}


def encode(docs: DataFrame, model_file: str = MODEL_FILE, keep: list[str] | None = None) -> DataFrame:
    """Columns `keep` (default: doc_id) of docs, with ids, n_ids, decoded_sha256 (of the decoded text) and exact.

    exact: decoding gives the text back.  One narrow pass; the model's pieces (bounded by the model file) are broadcast.
    A kept column that has the name of an added one is replaced by it.
    """
    machine = docs.sparkSession.sparkContext.broadcast(Transducer.load(model_file))
    added = {"ids": "array<int>", "n_ids": "int", "decoded_sha256": "string", "exact": "boolean"}
    carried, _ = carry(docs, keep or ["doc_id"], list(added))
    rows = docs.select(*[docs[c].alias(a) for a, c in carried.items()], F.make_valid_utf8(docs["text"].cast("string")).alias("_text"))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "_text"] + [f"{k} {v}" for k, v in added.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fst = machine.value
        for batch in batches:
            B.release()
            size = max(1, min(512, batch.num_rows))
            for lo in range(0, batch.num_rows, size):
                part = batch.slice(lo, size)
                all_ids, sums, exact = [], [], []
                for text in part.column(part.num_columns - 1).to_pylist():
                    ids = fst.encode(text or "")
                    back = fst.decode(ids)
                    all_ids.append(ids)
                    sums.append(hashlib.sha256(back.encode()).hexdigest())
                    exact.append(back == (text or ""))
                counts = [len(x) for x in all_ids]
                offsets = np.zeros(len(counts) + 1, np.int32)
                np.cumsum(counts, out=offsets[1:])
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(all_ids)))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], lists, pa.array(counts, pa.int32()), pa.array(sums, pa.string()), pa.array(exact, pa.bool_())], names=[*carried, *added])

    return rows.mapInArrow(run, schema).select(*[F.col(a).alias(c) for a, c in carried.items()], *added)


def decode(frame: DataFrame, model_file: str = MODEL_FILE) -> DataFrame:
    """doc_id and decoded_text of rows with doc_id and ids (null ids: the empty text)."""
    machine = frame.sparkSession.sparkContext.broadcast(Transducer.load(model_file))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [machine.value.decode(np.array(x or [], np.int32)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "decoded_text"])

    return frame.select("doc_id", "ids").mapInArrow(run, "doc_id long, decoded_text string")


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet"))
