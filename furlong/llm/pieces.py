"""SentencePiece encoding and decoding as a weighted finite-state transducer.

Three parts are compiled from the model. The normaliser puts one space mark before a text and
for each of its spaces. The piece automaton has a state for every piece; an arc from the state
of piece x reads the letters of piece y and leads to the state of y. Its weight is 0 if the
model's merges leave x and y side by side, and infinite if they merge across the border first.
Byte fallback adds arcs that read one character the model lacks and write its bytes as pieces.
Composed with an input, that is a graph over (end, last piece); the tropical shortest path is
found from left to right. Exactly one path has finite weight: the one the model's merges give.

A piece holds space marks only at its front or throughout, so a text is encoded in units of a
word with its marks, and equal units of a batch are composed once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from furlong.llm.vocabulary import SPACE_MARK, HashTable, Vocabulary, model_path, padded, read_model, sub_hash
from furlong.llm.words import Texts, Words, mix, texts_of

NAME = "op10_piece_transducer"
SQL = None
_NEVER = np.int64(1 << 40)
_GROUP = 2 << 20
KNOWN_UNITS = 600_000


def _merge_all(symbols: list[int], joined: dict[tuple[int, int], int], rank: np.ndarray) -> list[list[int]]:
    """Merge the best pair, leftmost first, until none is left; every state on the way."""
    states = [symbols]
    while True:
        best = min(
            ((rank[m], k, m) for k, p in enumerate(zip(symbols, symbols[1:], strict=False)) if (m := joined.get(p)) is not None),
            default=None,
        )
        if best is None:
            return states
        symbols = [*symbols[: best[1]], best[2], *symbols[best[1] + 2 :]]
        states.append(symbols)


def _spread(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places begins[k] .. begins[k] + sizes[k] - 1 of all k, one after the other."""
    return np.repeat(begins - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


class Transducer:
    def __init__(self, model: bytes):
        self.vocabulary = v = Vocabulary(model)
        mark = SPACE_MARK.decode()
        name = {v.piece[i].decode(): int(i) for i in v.ids}
        self.marks = {len(s): i for s, i in name.items() if set(s) == {mark}}
        if any(mark in s[1:] and set(s) != {mark} for s in name):
            raise ValueError("a piece holds a space mark inside")
        # single characters exist from the start (rank 0); the other pieces in the order of their merges
        order = sorted((i for s, i in name.items() if len(s) > 1), key=lambda i: (-v.score[i], i))
        self.rank = np.zeros(v.size, dtype=np.int64)
        self.rank[order] = np.arange(1, len(order) + 1)
        joined, runs = {}, {}
        for s, i in name.items():
            into = runs if set(s) == {mark} else joined
            for cut in range(1, len(s)):
                a, b = name.get(s[:cut]), name.get(s[cut:])
                if a is not None and b is not None:
                    into[a, b] = i
        self._runs = runs
        # how each piece is made: its last merge; pieces that merges never make get no arc
        self.left, self.right = np.arange(v.size), np.arange(v.size)
        self.reached = v.normal.copy()
        for s, i in name.items():
            if len(s) == 1 or set(s) == {mark}:
                self.reached[i] = len(s) == 1
                continue
            if any(c not in name for c in s):
                self.reached[i] = False
                continue
            states = _merge_all([name[c] for c in s], joined, self.rank)
            self.reached[i] = states[-1] == [i]
            if self.reached[i]:
                self.left[i], self.right[i] = states[-2]
        self.longest = max(len(v.piece[i]) for i in np.flatnonzero(self.reached))
        self._known = (np.zeros(0, dtype=np.uint64), np.zeros(1, dtype=np.int64), np.zeros(0, dtype=np.int32))
        pairs = np.array(list(joined), dtype=np.int64).reshape(-1, 2)
        self.pair = HashTable(self._key(pairs[:, 0], pairs[:, 1]))
        self.pair_rank = self.rank[list(joined.values())]

    def _key(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mix((a * self.vocabulary.size + b).astype(np.uint64) + np.uint64(1))

    def stay(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether pieces x and y stay as they are side by side.

        Undo the merges inside both, latest first. While a part of x and a part of y stand at the
        border together, a merge of the two must not come before the merges that used them up. At
        equal rank the one further left comes first.
        """
        good = np.ones(len(x), dtype=bool)
        at = np.flatnonzero((x >= 0) & (y >= 0))
        x, y = x[at], y[at]
        until_x, until_y = np.full(len(at), _NEVER), np.full(len(at), _NEVER)
        while len(at):
            place = self.pair.get(self._key(x, y))
            merged = np.where(place >= 0, self.pair_rank[place], _NEVER)
            bad = (merged < until_x) & (merged <= until_y) & (merged < _NEVER)
            good[at[bad]] = False
            rank_x, rank_y = self.rank[x], self.rank[y]
            more = ~bad & ((rank_x > 0) | (rank_y > 0))
            undo_x = rank_x > rank_y
            until_x, until_y = np.where(undo_x, rank_x, until_x), np.where(undo_x, until_y, rank_y)
            x, y = np.where(undo_x, self.right[x], x), np.where(undo_x, y, self.left[y])
            at, x, y, until_x, until_y = at[more], x[more], y[more], until_x[more], until_y[more]
        return good

    def paths(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all units (each a word with one space mark before it), and how many each has."""
        flat, places_of, counts = [], [], np.zeros(len(units), dtype=np.int64)
        for places, rows, sums, size in padded(units):
            n, width = rows.shape
            lead = (rows & 0xC0) != 0x80
            lead = np.hstack([lead, np.ones((n, 1), dtype=bool)])
            # last[:, e]: the piece that ends the path to e, -1 at the start, -2 - c for a character of
            # c bytes that the model lacks, -9 where no path ends
            last = np.full((n, width + 1), -9, dtype=np.int64)
            step = np.zeros((n, width + 1), dtype=np.int64)
            last[:, 0] = -1
            for end in range(1, width + 1):
                live = np.flatnonzero((size >= end) & lead[:, end])
                rows_c, prev_c, next_c, size_c = [], [], [], []
                for length in range(1, min(end, self.longest) + 1):
                    r = live[last[live, end - length] > -9]
                    if not len(r):
                        continue
                    y = self.vocabulary.find(sub_hash(sums[r], end - length, end))
                    y = np.where((y >= 0) & self.reached[y], y, -9)
                    if length <= 4:  # one whole character that is no piece
                        lone = (y == -9) & lead[r, end - length]
                        if length > 1:
                            lone &= ~lead[r, end - length + 1 : end].any(axis=1)
                        y = np.where(lone, -2 - length, y)
                    r, y = r[y > -9], y[y > -9]
                    rows_c.append(r)
                    next_c.append(y)
                    prev_c.append(last[r, end - length])
                    size_c.append(np.full(len(r), length))
                if not rows_c:
                    continue
                r, y, x, length = (np.concatenate(c) for c in (rows_c, next_c, prev_c, size_c))
                ok = self.stay(x, y)
                last[r[ok], end], step[r[ok], end] = y[ok], length[ok]
            ids = self._trace(rows, size, last, step)
            counts[places] = (ids >= 0).sum(axis=1)
            flat.append(ids[ids >= 0])
            places_of.append(places)
        if not flat:
            return np.zeros(0, dtype=np.int32), counts
        done = np.concatenate(places_of)
        begins = np.zeros(len(units), dtype=np.int64)
        begins[done] = np.cumsum(counts[done]) - counts[done]
        return np.concatenate(flat)[_spread(begins, counts)], counts

    def known(self, hashes: np.ndarray, word) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids kept so far, and where those of each unit begin and how many they are.

        word(k) gives the bytes of unit k. Up to KNOWN_UNITS units stay with the worker.
        """
        have, at, flat = self._known
        if len(have) > KNOWN_UNITS:
            have, at, flat = have[:0], at[:1], flat[:0]
        place = np.minimum(np.searchsorted(have, hashes), max(len(have) - 1, 0))
        new = np.flatnonzero(have[place] != hashes) if len(have) else np.arange(len(hashes))
        if len(new):
            ids, counts = self.paths([SPACE_MARK + word(k) for k in new])
            all_hashes = np.concatenate([have, hashes[new]])
            order = np.argsort(all_hashes, kind="stable")
            begins = np.concatenate([at[:-1], len(flat) + np.cumsum(counts) - counts])[order]
            sizes = np.concatenate([np.diff(at), counts])[order]
            flat = np.concatenate([flat, ids])[_spread(begins, sizes)]
            have, at = all_hashes[order], np.concatenate([[0], np.cumsum(sizes)])
            self._known = (have, at, flat)
            place = np.searchsorted(have, hashes)
        return flat, at[place], at[place + 1] - at[place]

    def _trace(self, rows, size, last, step) -> np.ndarray:
        """Walk all paths back from their ends; a missing character gives a piece a byte. Unused places are -1."""
        n, width = rows.shape
        ids = np.full((n, width), -1, dtype=np.int32)
        at, live = size.copy(), np.arange(n)
        while len(live):
            end = at[live]
            piece, back = last[live, end], step[live, end]
            lone = piece < -1
            ids[live[~lone], end[~lone] - 1] = piece[~lone]
            for j in range(1, 5):
                some = live[lone & (back >= j)]
                ids[some, at[some] - j] = self.vocabulary.byte_id[rows[some, at[some] - j]]
            at[live] = end - back
            live = live[at[live] > 0]
        return ids

    def run(self, n: int) -> np.ndarray:
        """The ids of n space marks in a row."""
        marks = [self.marks[1]] * n
        return np.array(_merge_all(marks, self._runs, self.rank)[-1], dtype=np.int32)

    def encode(self, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts and how many each has. A space or a space mark in the text is a mark."""
        parts, begins, total = [], [], 0
        for a, b in zip(texts.at[:-1], texts.at[1:], strict=True):
            begins.append(total)
            if b > a:
                parts.append(b" " + bytes(texts.data[a:b]).replace(SPACE_MARK, b" "))
                total += len(parts[-1])
        data = np.frombuffer(b"".join(parts), dtype=np.uint8)
        at = np.append(np.array(begins, dtype=np.int64), total)
        plain = Texts(data, at, texts.rows)
        units = Words(plain, keep=data != 0x20)
        if not total:
            return np.zeros(0, dtype=np.int32), np.zeros(len(texts), dtype=np.int64)
        # a unit is a word with one mark; marks before that, or without a word, are a run of their own
        hashes, first, which = np.unique(units.hash, return_index=True, return_inverse=True)
        flat, word_at, word_len = self.known(
            hashes, lambda k: data[units.starts[first[k]] : units.ends[first[k]]].tobytes()
        )
        owner = units.text_of
        opens = np.concatenate([[True], owner[1:] != owner[:-1]]) if len(units) else np.zeros(0, dtype=bool)
        before = np.where(opens, at[owner], np.concatenate([[0], units.ends[:-1]])[: len(units)])
        gap = units.starts - before
        tail_from = at[:-1].copy()
        np.maximum.at(tail_from, owner, units.ends)
        tail = at[1:] - tail_from
        alone = flat[word_at] == self.marks[1] if len(flat) else np.zeros(0, dtype=bool)
        joins = alone[which] if len(units) else np.zeros(0, dtype=bool)
        run = np.where(joins & (gap > 1), gap, gap - 1)  # a lone mark merges with the marks before it
        skip = (joins & (gap > 1)).astype(np.int64)
        # interleave: for each unit its run, then its word; for each text its tail
        runs = sorted({int(x) for x in np.unique(np.concatenate([run, tail])) if x > 0})
        run_ids = [self.run(x) if x <= 64 else self._long_run(x) for x in runs]
        run_len = np.array([len(x) for x in run_ids], dtype=np.int64)
        run_at = len(flat) + np.cumsum(run_len) - run_len
        flat = np.concatenate([flat, *run_ids])
        lookup = np.array(runs, dtype=np.int64)

        def run_span(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            if not len(lookup):
                return np.zeros(len(x), dtype=np.int64), np.zeros(len(x), dtype=np.int64)
            k = np.minimum(np.searchsorted(lookup, x), len(lookup) - 1)
            return np.where(x > 0, run_at[k], 0), np.where(x > 0, run_len[k], 0)

        r_at, r_len = run_span(run)
        t_at, t_len = run_span(tail)
        w_at, w_len = word_at[which] + skip, word_len[which] - skip
        place = np.concatenate([2 * np.arange(len(units)), 2 * np.arange(len(units)) + 1, 2 * units.first[1:] - 0.5])
        order = np.argsort(place, kind="stable")
        starts, lens = np.concatenate([r_at, w_at, t_at])[order], np.concatenate([r_len, w_len, t_len])[order]
        owners = np.concatenate([owner, owner, np.arange(len(texts))])[order]
        return flat[_spread(starts, lens)], np.bincount(owners, weights=lens, minlength=len(texts)).astype(np.int64)

    def _long_run(self, n: int) -> np.ndarray:
        """As run(), in passes: equal scores merge from the left, so each pass halves the run."""
        have, out = [(1, n)], []
        size = 1
        while 2 * size in self.marks and have[0][1] > 1:
            pairs, odd = divmod(have[0][1], 2)
            have = [(2 * size, pairs), *([(size, 1)] if odd else []), *have[1:]]
            size *= 2
        for s, k in have:
            out += [self.marks[s]] * k
        return np.array(out, dtype=np.int32)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """The texts: bytes of the pieces, marks as spaces, without the leading one."""
        pieces, out, at = self.vocabulary.piece, [], 0
        for n in counts.tolist():
            text = b"".join([pieces[i] for i in ids[at : at + n].tolist()]).replace(SPACE_MARK, b" ")
            out.append(text[1:] if text[:1] == b" " else text)
            at += n
        return out


@lru_cache(maxsize=2)
def transducer(model: bytes) -> Transducer:
    return Transducer(model)


def _schema(docs: DataFrame, id_col: str) -> str:
    return f"`{id_col}` {docs.select(id_col).schema[0].dataType.simpleString()}"


def encode(docs: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) of every whole text, one row per input row, without a shuffle.

    A null text has null ids, an empty one an empty array. Repeated rows are encoded one by one;
    other columns are not read. A space mark (U+2581) in a text is read as a space.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fst = transducer(model)
        for batch in batches:
            for texts in texts_of(batch.column(1), _GROUP):
                ids, counts = fst.encode(texts)
                key = batch.column(0).slice(texts.rows.start, len(texts))
                null = batch.column(1).slice(texts.rows.start, len(texts)).is_null()
                at = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
                lists = pa.ListArray.from_arrays(at, pa.array(ids, pa.int32()), mask=null if null.true_count else None)
                yield pa.RecordBatch.from_arrays([key, lists], names=[id_col, "ids"])

    return docs.select(id_col, text_col).mapInArrow(work, f"{_schema(docs, id_col)}, ids array<int>")


def decode(encoded: DataFrame, model: bytes, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text) of every row of ids; null ids give a null text, no ids an empty one."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fst = transducer(model)
        for batch in batches:
            rows = batch.column(1).to_pylist()
            texts = [
                None if r is None else fst.decode(np.array(r, dtype=np.int64), np.array([len(r)]))[0].decode("utf-8", "replace")
                for r in rows
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[id_col, "text"])

    return encoded.select(id_col, ids_col).mapInArrow(work, f"{_schema(encoded, id_col)}, text string")


def encode_digest(docs: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_pieces, n_bytes_fallback, ids_sha256, round_trip): encoded, decoded again and compared.

    ids_sha256 is of the ids as little-endian 32-bit integers. round_trip says that decoding gave
    the text back (a space mark in it comes back as a space). A null text counts as empty.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fst = transducer(model)
        for batch in batches:
            for texts in texts_of(batch.column(1), _GROUP):
                ids, counts = fst.encode(texts)
                at = np.concatenate([[0], np.cumsum(counts)])
                raw = memoryview(ids.astype("<i4").tobytes())
                shas = [hashlib.sha256(raw[4 * a : 4 * b]).hexdigest() for a, b in zip(at[:-1], at[1:], strict=True)]
                fallback = np.concatenate([[0], np.cumsum(fst.vocabulary.is_byte[ids])])
                same = [
                    back == bytes(texts.data[a:b]).replace(SPACE_MARK, b" ")
                    for back, a, b in zip(fst.decode(ids, counts), texts.at[:-1], texts.at[1:], strict=True)
                ]
                key = batch.column(0).slice(texts.rows.start, len(texts))
                cols = [key, pa.array(counts), pa.array(fallback[at[1:]] - fallback[at[:-1]]), pa.array(shas, pa.string()), pa.array(same, pa.bool_())]
                yield pa.RecordBatch.from_arrays(cols, names=[id_col, "n_pieces", "n_byte_pieces", "ids_sha256", "round_trip"])

    schema = f"{_schema(docs, id_col)}, n_pieces bigint, n_byte_pieces bigint, ids_sha256 string, round_trip boolean"
    return docs.select(id_col, text_col).mapInArrow(work, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_digest(spark.read.parquet(f"{sf_dir}/documents.parquet"), read_model(model_path()))
