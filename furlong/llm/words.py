"""Whole batches of texts as numpy arrays: word bounds, word hashes, n-gram hashes.

A word is a run of bytes other than 0x20 and 0x09-0x0D, so in UTF-8 it is the regex
``[^\\x20\\x09-\\x0D]+``. Hashes are 64 bits wide and depend on the bytes alone, so they are
the same on every machine and in every run.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa

_MULT = 0x9E3779B97F4A7C15 | 1
_INV = pow(_MULT, -1, 1 << 64)
_GRAM = np.uint64(0xD6E8FEB86659FD93)
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
CHUNK = 1 << 20

_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2 ** 64; kept while n does not grow."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, CHUNK), base, dtype=np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if n <= 2 * CHUNK:
            _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


_LETTERS = mix(np.arange(1, 257, dtype=np.uint64))


def prefix(data: np.ndarray) -> np.ndarray:
    """Sums from which span_hash() gets the hash of any span."""
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_LETTERS[data] * _power(_MULT, len(data)), out=out[1:])
    return out


def span_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The hash of each span; the same bytes give the same hash wherever they stand."""
    raw = (sums[ends] - sums[starts]) * _power(_INV, len(sums))[starts]
    return mix(raw + (ends - starts).astype(np.uint64) * _GRAM)


def hash_rows(rows: np.ndarray) -> np.ndarray:
    """Prefix sums of each row of a byte matrix; sub_hash() reads them."""
    out = np.zeros((rows.shape[0], rows.shape[1] + 1), dtype=np.uint64)
    np.cumsum(_LETTERS[rows] * _power(_MULT, rows.shape[1]), axis=1, out=out[:, 1:])
    return out


def sub_hash(sums: np.ndarray, start: int, end: int) -> np.ndarray:
    raw = (sums[:, end] - sums[:, start]) * _power(_INV, max(end, 1) + 1)[start]
    return mix(raw + np.array([end - start], dtype=np.uint64) * _GRAM)


def span_hashes(sums: np.ndarray, row: np.ndarray, start: np.ndarray, length: int) -> np.ndarray:
    """The hashes of spans of one length, each in its row."""
    raw = (sums[row, start + length] - sums[row, start]) * _power(_INV, sums.shape[1] + 1)[start]
    return mix(raw + np.array([length], dtype=np.uint64) * _GRAM)


def hash_bytes(items: list[bytes]) -> np.ndarray:
    """span_hash of whole byte strings."""
    ends = np.cumsum([len(x) for x in items], dtype=np.int64) if items else np.zeros(0, dtype=np.int64)
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64) if items else ends
    return span_hash(prefix(np.frombuffer(b"".join(items), dtype=np.uint8)), starts, ends)


class Texts:
    """Some consecutive texts: data holds their bytes, text k is data[at[k]:at[k + 1]]."""

    def __init__(self, data: np.ndarray, at: np.ndarray, rows: slice):
        self.data, self.at, self.rows = data, at, rows

    def __len__(self) -> int:
        return len(self.at) - 1

    def words(self) -> Words:
        return Words(self)


class Words:
    """starts and ends of all words, first[k]:first[k + 1] are those of text k."""

    def __init__(self, texts: Texts, keep: np.ndarray | None = None):
        data, at = texts.data, texts.at
        inside = ~SPACE[data] if keep is None else keep
        edge = np.zeros(len(data) + 1, dtype=bool)
        edge[at] = True
        before = np.empty(len(data), dtype=bool)
        after = np.empty(len(data), dtype=bool)
        if len(data):
            before[0], after[-1] = False, False
            before[1:], after[:-1] = inside[:-1], inside[1:]
        self.starts = np.flatnonzero(inside & (~before | edge[:-1]))
        self.ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
        self.first = np.searchsorted(self.starts, at)
        self.counts = np.diff(self.first)
        self.texts = texts
        self._hash: np.ndarray | None = None

    def __len__(self) -> int:
        return len(self.starts)

    @property
    def hash(self) -> np.ndarray:
        if self._hash is None:
            self._hash = span_hash(prefix(self.texts.data), self.starts, self.ends)
        return self._hash

    @property
    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)

    @property
    def left(self) -> np.ndarray:
        """How many words of the same text begin at each word, itself included."""
        return np.repeat(self.first[1:], self.counts) - np.arange(len(self))


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of n consecutive hashes from each place; the last n - 1 places are left out."""
    if len(hashes) < n:
        return np.zeros(0, dtype=np.uint64)
    last = len(hashes) - n + 1
    out = np.zeros(last, dtype=np.uint64)
    for j in range(n):
        out = out * _GRAM + hashes[j : j + last]
    return mix(out)


@cache
def _trim():
    try:
        return ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError):  # another C library
        return None


def give_back() -> None:
    """Return free memory to the system: workers live on between tasks and share a machine's memory."""
    pa.default_memory_pool().release_unused()
    if _trim():
        _trim()(0)


def texts_of(column: pa.Array, limit: int = CHUNK) -> Iterator[Texts]:
    """The texts of a column (null: empty) in groups of about limit bytes; a longer text is alone."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    n = len(column)
    if not n:
        return
    at = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + n + 1]
    body = column.buffers()[2]
    data = np.frombuffer(body, dtype=np.uint8) if body is not None else np.zeros(0, dtype=np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + limit, side="right")) - 1)
        yield Texts(data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo], slice(lo, hi))
        lo = hi
    give_back()


def spans_covered(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Which of n places lie in one of the spans."""
    step = np.zeros(n + 1, dtype=np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, ends, -1)
    return np.cumsum(step[:-1]) > 0
