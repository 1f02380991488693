"""Vectorised byte-level helpers shared by the text operators.

Texts arrive as Arrow string columns.  They are viewed as one UTF-8 buffer with offsets, so that hashing words,
lines, shingles or windows costs a few numpy passes over the bytes and no Python work for each token.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 18  # bytes of texts worked on together: a few MB for each array over them
_MULT = 0x9E3779B97F4A7C15 | 1
_INV = pow(_MULT, -1, 1 << 64)
_MASK = (1 << 64) - 1

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def _byte_codes() -> np.ndarray:
    """256 well-spread odd 64-bit codes, one for each byte value."""
    x = np.arange(1, 257, dtype=np.uint64)
    return mix(x * np.uint64(0xD1342543DE82EF95)) | np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (multiply and xor-shift)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


try:
    _LIBC = ctypes.CDLL("libc.so.6")
    _LIBC.malloc_trim  # noqa: B018
except (OSError, AttributeError):  # another C library
    _LIBC = None

_CODES = _byte_codes()
_tables: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_tables.get("up", ())) < n:
        size = max(n, CHUNK + 1)
        for name, base in (("up", _MULT), ("down", _INV)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _tables[name] = np.cumprod(steps, dtype=np.uint64)
    return _tables["up"], _tables["down"]


class Roll:
    """Hashes of any byte range of one buffer: a polynomial modulo 2**64 over coded bytes, then mixed."""

    def __init__(self, buf: np.ndarray):
        up, self.down = _powers(len(buf) + 1)
        self.sums = np.zeros(len(buf) + 1, np.uint64)
        coded = np.take(_CODES, buf)
        coded *= up[: len(buf)]
        np.cumsum(coded, out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))


def release() -> None:
    """Give freed memory back to the system: workers are used again, and what one batch needed would else stay with them."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


def buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its values; nulls count as empty."""
    release()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column) or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of values that together hold at most `limit` bytes; a longer value makes a range of its own."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield lo, hi
        lo = hi


def runs(flag: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of true flags; a run never crosses a cut position."""
    edge = np.zeros(len(flag) + 1, bool)
    if len(flag):
        edge[0], edge[-1] = True, True
        edge[1:-1] = flag[1:] != flag[:-1]
        edge[cuts] = True
    at = np.flatnonzero(edge)
    starts, ends = at[:-1], at[1:]
    keep = flag[starts] if len(starts) else np.zeros(0, bool)
    return starts[keep], ends[keep]


def words(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and text numbers of the maximal runs of bytes other than ASCII white space."""
    starts, ends = runs(~SPACE[buf], offsets[1:-1])
    return starts, ends, owner(starts, offsets)


def owner(positions: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.searchsorted(offsets, positions, "right") - 1


def per_text(values: np.ndarray | None, of: np.ndarray, n: int) -> np.ndarray:
    """Sums (or counts, for None) of values by text number, as longs."""
    if values is None:
        return np.bincount(of, minlength=n).astype(np.int64)
    return np.rint(np.bincount(of, weights=values, minlength=n)).astype(np.int64)


def as_long(x: np.ndarray) -> np.ndarray:
    """Unsigned hashes as the signed longs that Spark stores."""
    return x.view(np.int64)


def chunked(buf: np.ndarray, offsets: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of values lo to hi - 1, and their offsets from 0."""
    return buf[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]


def strings(values: list[bytes]) -> pa.Array:
    return pa.array(values, pa.binary()).cast(pa.string(), safe=False)
