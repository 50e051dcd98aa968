"""A public SentencePiece model file as lookup tables, and runs of words as padded matrices."""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import cache
from pathlib import Path

import numpy as np

from furlong.llm.words import hash_bytes, hash_rows, span_hashes, sub_hash

SPACE_MARK = "▁".encode()
WIDTHS = (8, 12, 16, 24, 32, 48, 64, 96, 128)


def model_path() -> str:
    """The installed 32k piece model; SENTENCEPIECE_MODEL names another one."""
    return os.environ.get("SENTENCEPIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")


@cache
def read_model(path: str) -> bytes:
    """The file's bytes, read on the driver; tasks get them with their code (half a megabyte)."""
    return Path(path).read_bytes()


class HashTable:
    """64-bit keys to places 0, 1, ...; lookups of whole arrays by linear probing."""

    def __init__(self, keys: np.ndarray):
        if len(np.unique(keys)) != len(keys):
            raise ValueError("keys must be distinct")
        self.bits = max(4, int(4 * len(keys)).bit_length())
        self.mask = np.int64((1 << self.bits) - 1)
        self.keys = np.zeros(1 << self.bits, dtype=np.uint64)
        self.place = np.full(1 << self.bits, -1, dtype=np.int64)
        left, at = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = self.place[at] < 0
            taker = np.unique(at[free], return_index=True)[1]
            put = np.flatnonzero(free)[taker]
            self.place[at[put]], self.keys[at[put]] = left[put], keys[left[put]]
            rest = np.ones(len(left), dtype=bool)
            rest[put] = False
            left, at = left[rest], (at[rest] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, -1 where there is none."""
        at = self._slot(keys)
        out = self.place[at]
        wrong = np.flatnonzero((out >= 0) & (self.keys[at] != keys))
        at = at[wrong]
        while len(wrong):
            at = (at + 1) & self.mask
            found = self.place[at]
            out[wrong] = found
            again = (found >= 0) & (self.keys[at] != keys[wrong])
            wrong, at = wrong[again], at[again]
        return out


class Vocabulary:
    """Pieces as bytes, their scores and kinds, and a table from a piece's hash to its id."""

    def __init__(self, model: bytes):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.size = sp.get_piece_size()
        names = [sp.id_to_piece(i) for i in range(self.size)]
        self.is_byte = np.array([sp.is_byte(i) for i in range(self.size)])
        special = np.array([sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) for i in range(self.size)])
        self.normal = ~self.is_byte & ~special
        self.score = np.array([sp.get_score(i) for i in range(self.size)])
        self.piece = [
            bytes([int(n[3:5], 16)]) if b else b"" if s else n.encode()
            for n, b, s in zip(names, self.is_byte, special, strict=True)
        ]
        self.byte_id = np.full(256, -1, dtype=np.int64)
        for i in np.flatnonzero(self.is_byte):
            self.byte_id[self.piece[i][0]] = i
        if (self.byte_id < 0).any():
            raise ValueError("the model has no byte fallback")
        self.ids = np.flatnonzero(self.normal)
        self.table = HashTable(hash_bytes([self.piece[i] for i in self.ids]))
        self.longest = max(len(self.piece[i]) for i in self.ids)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        at = self.table.get(hashes)
        return np.where(at >= 0, self.ids[at], -1)


def padded(items: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Items of like length together: their places, a byte matrix, its prefix hashes, their lengths.

    Padding stands on the right, so whatever is computed from left to right does not see it. A
    group holds at most about two million bytes, unless one item alone is longer.
    """
    size = np.array([len(x) for x in items], dtype=np.int64)
    low = 0
    longest = int(size.max()) if len(size) else 0
    widths = [w for w in WIDTHS if w < longest]
    while not widths or widths[-1] < longest:
        widths.append(longest if not widths or longest <= 2 * widths[-1] else 2 * widths[-1])
    for width in widths:
        places = np.flatnonzero((size > low) & (size <= width))
        low = width
        step = max(1, (1 << 21) // max(width, 1))
        for k in range(0, len(places), step):
            part = places[k : k + step]
            rows = np.frombuffer(b"".join(items[i].ljust(width, b"\0") for i in part), dtype=np.uint8)
            rows = rows.reshape(len(part), width)
            yield part, rows, hash_rows(rows), size[part]


__all__ = ["SPACE_MARK", "HashTable", "Vocabulary", "model_path", "padded", "read_model", "span_hashes", "sub_hash"]
