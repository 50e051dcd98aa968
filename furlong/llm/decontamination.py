"""Benchmark decontamination by latent semantic retrieval.

1. Passages are two neighbouring blocks of 32 words, so they overlap by half. Their words are
   hashed into 2 ** 15 terms; document frequencies are counted over all blocks of all documents.
2. A randomised SVD of the TF-IDF matrix of benchmark parts and of all documents gives the latent
   space. Each power pass is one Spark job over all passages that sums A'(A X) by blocks of terms.
3. Every passage of every document is projected and compared by cosine with all benchmark parts.
   The benchmark is the stated query set: it goes to the tasks in groups of at most ITEMS items.
   An item of words that are frequent in the corpus has no weight there, and the more items there are,
   the less of a passage the space keeps. So passages that hold enough of a part's words to pass the
   check are candidates too, whatever their cosine: the search loses nothing that the check accepts.
4. Each candidate is checked by the longest common subsequence of the part and the passage with its
   surroundings, in all and for the answer (the part's last sentence), so that passages that were
   reworded here and there are found. All words count alike, common ones too.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furlong.llm.words import SPACE, Texts, Words, give_back, hash_bytes, mix, texts_of

NAME = "op9_latent_decontamination"
SQL = None
TERMS, RANK, SPARE, POWER_PASSES = 1 << 15, 96, 10, 1
BLOCK, PART, ITEMS = 32, 64, 20_000
COMMON = 0.02
COSINE, SHARE, ANSWER = 0.15, 0.6, 0.5
LEAST = 4
_PAIRS = 1 << 22
_TERM_ROWS = 2048
_GROUPS = 1024  # groups of rows that are added up at once
_LAYERS = 64  # a group of more rows is added up by itself
_FIT_CHUNK = 1 << 20
_SPLITS_OF_SUM = 4  # splits of the input that one task of the fit adds up
_SUMS_AT_ONCE = 64  # partial sums of a block of terms that meet in one group
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_INSIDE = ~SPACE
_INSIDE[[b for b in range(128) if not chr(b).isalnum()]] = False


def lowered_words(texts: Texts) -> Words:
    """Runs of letters and digits (and of bytes above 127), A-Z lowered."""
    low = Texts(_LOWER[texts.data], texts.at, texts.rows)
    return Words(low, keep=_INSIDE[low.data])


def _terms(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - TERMS.bit_length() + 1)).astype(np.int64)


def _blocks(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """First word of each block of 32 words of a text, and the text of each block."""
    per = -(-words.counts // BLOCK)
    text = np.repeat(np.arange(len(per)), per)
    place = np.arange(len(text)) - np.repeat(np.cumsum(per) - per, per)
    return words.first[text] + BLOCK * place, text


# ---- benchmark


@dataclass
class Parts:
    """Benchmark items in parts of at most 64 words: their item, words, and where the answer begins."""

    item: np.ndarray
    words: list[np.ndarray]
    answer: list[int]


def item_parts(rows: Sequence[tuple[int, str | None]]) -> Parts:
    """An item's answer is its last sentence: what follows the last . ? ! : that has words on both sides."""
    parts = Parts(np.zeros(0, dtype=np.int64), [], [])
    owner = []
    for item, text in rows:
        spelled = re.findall(rb"[a-z0-9\x80-\xff]+", _LOWER[np.frombuffer((text or "").encode(), dtype=np.uint8)].tobytes())
        h = hash_bytes(spelled)
        cuts = [m.end() for m in re.finditer(r"[.?!:]\s+(?=\w)", (text or "").rstrip())]
        before = re.findall(rb"[A-Za-z0-9\x80-\xff]+", (text or "")[: cuts[-1]].encode()) if cuts else []
        first = len(before) if 0 < len(before) < len(h) else max(0, len(h) - max(1, len(h) // 4))
        for at in range(0, max(1, len(h) - PART // 2), PART // 2) if len(h) > PART else range(1):
            if len(h):
                own = h[at : at + PART]
                owner.append(item)
                parts.words.append(own)
                parts.answer.append(min(max(first - at, 0), len(own)))
    parts.item = np.array(owner, dtype=np.int64)
    return parts


# ---- latent space


def document_frequencies(docs: DataFrame, text_col: str = "text") -> tuple[np.ndarray, int]:
    """In how many 32-word blocks each term occurs, and the number of blocks, over all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, blocks = np.zeros(TERMS, dtype=np.int64), 0
            for texts in texts_of(batch.column(0)):
                words = lowered_words(texts)
                starts, _ = _blocks(words)
                size = np.diff(np.append(starts, len(words)))
                key = np.sort(np.repeat(np.arange(len(starts)), size) * TERMS + _terms(words.hash))
                key = key[np.concatenate([[True], key[1:] != key[:-1]])] if len(key) else key
                total += np.bincount(key % TERMS, minlength=TERMS)
                blocks += len(starts)
            some = np.append(np.flatnonzero(total), -1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(some), pa.array(np.append(total[some[:-1]], blocks))], names=["term", "n"]
            )

    rows = docs.select(text_col).mapInArrow(count, "term bigint, n bigint")
    got = rows.groupBy("term").agg(F.sum("n").alias("n")).toPandas()  # at most TERMS + 1 rows
    out = np.zeros(TERMS, dtype=np.int64)
    inside = got["term"] >= 0
    out[got["term"][inside]] = got["n"][inside]
    return out, int(got["n"][~inside].sum())


def term_weights(frequency: np.ndarray, blocks: int) -> np.ndarray:
    """Inverse document frequency; terms of more than COMMON of all blocks weigh nothing."""
    idf = np.log((1 + blocks) / (1 + frequency)) + 1
    return np.where(frequency > COMMON * max(blocks, 1 / COMMON), 0.0, idf)


def _passages(text: np.ndarray) -> np.ndarray:
    """The blocks, given with their texts, at which a passage begins."""
    if not len(text):
        return np.zeros(0, dtype=np.int64)
    follows = np.append(text[1:] == text[:-1], False)
    alone = ~follows & np.concatenate([[True], text[1:] != text[:-1]])
    return np.flatnonzero(follows | alone)


def _add_groups(table: np.ndarray, rows: np.ndarray, first: np.ndarray, out: np.ndarray, own: np.ndarray) -> None:
    """out[own[k]] += the sum of table[rows[first[k] : first[k + 1]]]; no group is empty, own has no value twice.

    Groups go by size, so that one row of each of them can be added at a time, to a bounded buffer.
    """
    size = np.diff(np.append(first, len(rows)))
    for k in np.flatnonzero(size > _LAYERS):
        for lo in range(first[k], first[k] + size[k], _GROUPS):
            out[own[k]] += table[rows[lo : min(lo + _GROUPS, first[k] + size[k])]].sum(axis=0, dtype=out.dtype)
    order = np.argsort(-size, kind="stable")
    order = order[np.count_nonzero(size > _LAYERS) :]
    for lo in range(0, len(order), _GROUPS):
        some = order[lo : lo + _GROUPS]
        at, least = first[some], -size[some]
        total = table[rows[at]]
        one = np.empty_like(total)
        for layer in range(1, -least[0]):
            n = np.searchsorted(least, -layer)  # groups with more rows than that
            np.take(table, rows[at[:n] + layer], axis=0, out=one[:n], mode="clip")
            total[:n] += one[:n]
        out[own[some]] += total


def _block_of(starts: np.ndarray, n: int) -> np.ndarray:
    """The block of each of n words."""
    return np.repeat(np.arange(len(starts)), np.diff(np.append(starts, n)))


def _first_of_runs(values: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, dtype=np.int64)


def _distinct(values: np.ndarray) -> np.ndarray:
    values = np.sort(values)
    return values[_first_of_runs(values)]


def _true_cells(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """np.nonzero of a matrix, by way of its flat form, which is faster."""
    return np.divmod(np.flatnonzero(matrix), matrix.shape[1])


def passage_vectors(words: Words, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums of the weight rows of all passages, the first word and the text of each passage.

    A text's last block is no passage of its own unless it is the only one.
    """
    starts, text = _blocks(words)
    block = np.zeros((len(starts), weights.shape[1]), dtype=np.float32)
    terms = _terms(words.hash)
    at = np.flatnonzero(weights[terms, -1])  # the last column is positive where a term counts
    owner = _block_of(starts, len(words))[at]
    new = _first_of_runs(owner)
    _add_groups(weights, terms[at], new, block, owner[new])
    if not len(starts):
        return block, starts, text
    follows = np.append(text[1:] == text[:-1], False)
    block[:-1][follows[:-1]] += block[1:][follows[:-1]]
    keep = _passages(text)
    return block[keep], starts[keep], text[keep]


def fit_space(docs: DataFrame, parts: Parts, idf: np.ndarray, text_col: str = "text", rank: int = RANK) -> np.ndarray:
    """TERMS x (rank + 1): idf-weighted right singular vectors of all passages of docs and the benchmark
    parts, and the squared weights.

    The parts get as much weight in all as the documents, so directions of the benchmark are kept. A task
    keeps one sum of TERMS x width numbers, whatever it reads; the sums of tasks meet in bounded groups.
    """
    last = docs.select(F.spark_partition_id().alias("split")).agg(F.max("split")).first()[0]
    splits = 1 if last is None else last + 1
    tasks = max(min(splits, 12), -(-splits // _SPLITS_OF_SUM))
    rng, width = np.random.default_rng(7), rank + SPARE
    basis = _orthonormal(rng.standard_normal((TERMS, width), dtype=np.float32))
    own = _terms(np.concatenate(parts.words)) if parts.words else np.zeros(0, dtype=np.int64)
    owner = np.repeat(np.arange(len(parts.words)), [len(w) for w in parts.words])

    def gram(terms: np.ndarray, row: np.ndarray, product: np.ndarray, out: np.ndarray) -> None:
        """Adds to each term's row of out the rows of product that hold the term."""
        order = np.argsort(terms.astype(np.uint16), kind="stable")  # TERMS is at most 2 ** 16; short keys sort by radix
        terms, row = terms[order], row[order]
        new = _first_of_runs(terms)
        _add_groups(product, row, new, out, terms[new])

    for turn in range(POWER_PASSES + 1):
        weights = _with_length(basis, idf)

        def partial(batches: Iterator[pa.RecordBatch], weights=weights) -> Iterator[pa.RecordBatch]:
            total, n = np.zeros((TERMS, width)), 0
            counts = idf > 0
            for batch in batches:
                for texts in texts_of(batch.column(0), _FIT_CHUNK):
                    words = lowered_words(texts)
                    vectors, first, text = passage_vectors(words, weights)
                    if not len(first):
                        continue
                    # both blocks of a passage take its vector: each word is added once, not once per passage
                    vectors = vectors[:, :-1] / np.maximum(vectors[:, -1:], 1.0)
                    starts, of = _blocks(words)
                    kept = _passages(of)
                    product = np.zeros((len(starts), width), dtype=np.float32)
                    product[kept] = vectors
                    two = np.append(of[1:] == of[:-1], False)[kept]
                    product[kept[two] + 1] += vectors[two]
                    terms = _terms(words.hash)
                    at = np.flatnonzero(counts[terms])
                    gram(terms[at], _block_of(starts, len(words))[at], product, total)
                    n += len(first)
            total *= idf[:, None]
            blobs = [total[k : k + _TERM_ROWS].astype(np.float32).tobytes() for k in range(0, TERMS, _TERM_ROWS)]
            blocks = pa.array(np.arange(len(blobs)), pa.int32())
            own = pa.array(np.full(len(blobs), TaskContext.get().partitionId()), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [blocks, own, pa.array(np.full(len(blobs), n)), pa.array(blobs, pa.binary())], names=["block", "task", "n", "blob"]
            )

        def add_up(group: pd.DataFrame) -> pd.DataFrame:
            total = sum(np.frombuffer(b, dtype=np.float32).astype(np.float64) for b in group["blob"])
            first = group[["block", "task"]].iloc[:1].reset_index(drop=True)
            return first.assign(n=[group["n"].sum()], blob=[total.astype(np.float32).tobytes()])

        kind = "block int, task int, n bigint, blob binary"
        sums, groups = docs.select(text_col).coalesce(tasks).mapInArrow(partial, kind), tasks
        while groups > _SUMS_AT_ONCE:
            groups = -(-groups // _SUMS_AT_ONCE)
            sums = sums.withColumn("task", F.pmod("task", F.lit(groups))).groupBy("block", "task").applyInPandas(add_up, kind)
        sums = sums.groupBy("block").applyInPandas(add_up, kind).toPandas()
        product = np.zeros((TERMS, width), dtype=np.float32)
        for block, blob in zip(sums["block"], sums["blob"], strict=True):
            rows = np.frombuffer(blob, dtype=np.float32).reshape(-1, width)
            product[block * _TERM_ROWS : block * _TERM_ROWS + len(rows)] = rows
        if len(own):
            vectors = _part_vectors(parts, weights)
            vectors = vectors[:, :-1] / np.maximum(vectors[:, -1:], 1.0)
            share = max(1.0, sums["n"].max() / len(vectors) if len(sums) else 1.0)
            known, place = np.unique(own, return_inverse=True)
            of_parts = np.zeros((len(known), width))
            gram(place, owner, vectors, of_parts)
            for lo in range(0, len(known), _TERM_ROWS):
                some = known[lo : lo + _TERM_ROWS]
                product[some] += share * idf[some, None] * of_parts[lo : lo + _TERM_ROWS]
            del of_parts, vectors
        del sums, weights, partial
        if turn < POWER_PASSES:
            basis = _orthonormal(product)
        give_back()
    # basis' A'A basis: its eigenvectors turn the basis into the leading singular vectors
    pieces = [slice(k, k + _TERM_ROWS) for k in range(0, TERMS, _TERM_ROWS)]
    values, turned = np.linalg.eigh(sum(basis[p].T.astype(np.float64) @ product[p] for p in pieces))
    lead = turned[:, np.argsort(-values)[:rank]].astype(np.float32)
    return _with_length(basis @ lead, idf)


def _orthonormal(columns: np.ndarray) -> np.ndarray:
    """An orthonormal basis of the columns, written over them: QR of pieces of rows, then of what they leave.

    The driver holds the matrix once, not in the several wider copies of a QR of the whole.
    """
    width = columns.shape[1]
    pieces = [slice(k, k + _TERM_ROWS) for k in range(0, len(columns), _TERM_ROWS)]
    rest = []
    for p in pieces:
        columns[p], r = np.linalg.qr(columns[p])
        rest.append(r)
    turned = np.linalg.qr(np.vstack(rest))[0]
    for k, p in enumerate(pieces):
        columns[p] = columns[p] @ turned[k * width : (k + 1) * width]
    return columns


def _part_vectors(parts: Parts, weights: np.ndarray) -> np.ndarray:
    """Sums of the weight rows of all parts."""
    out = np.zeros((len(parts.words), weights.shape[1]), dtype=np.float32)
    starts = np.cumsum([0, *[len(w) for w in parts.words]])[:-1]
    _add_groups(weights, _terms(np.concatenate(parts.words)), starts, out, np.arange(len(out)))
    return out


def _with_length(basis: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """The basis times idf, and as last column what a term adds to the squared length of a passage."""
    out = np.empty((len(basis), basis.shape[1] + 1), dtype=np.float32)
    np.multiply(basis, idf[:, None], out=out[:, :-1], casting="same_kind")
    out[:, -1] = idf**2
    return out


# ---- search and check


def common_subsequence(region: np.ndarray, masks: np.ndarray) -> np.ndarray:
    """Which words of a part (bits) some longest common subsequence with each region uses up to the end:
    the number of zero bits is its length. region only gives the shape; masks[c, k] has the bits of the
    part of candidate c that equal its word k."""
    state = np.full(len(masks), ~np.uint64(0), dtype=np.uint64)
    for k in range(region.shape[1]):
        match = state & masks[:, k]
        state = (state + match) | (state - match)
    return state


def _bits(n: np.ndarray) -> np.ndarray:
    return np.where(n >= 64, ~np.uint64(0), (np.uint64(1) << np.minimum(n, 63).astype(np.uint64)) - np.uint64(1))


class Checker:
    """The word masks of all parts, looked up for many candidates at once."""

    def __init__(self, parts: Parts):
        self.parts = parts
        part = np.repeat(np.arange(len(parts.words)), [len(w) for w in parts.words])
        word = np.concatenate(parts.words)
        place = np.concatenate([np.arange(len(w)) for w in parts.words])
        key = self._key(part, word)
        order = np.argsort(key, kind="stable")
        key = key[order]
        new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        self.keys = key[new]
        self.masks = np.bitwise_or.reduceat(np.uint64(1) << place[order].astype(np.uint64), new)
        self.size = np.array([len(w) for w in parts.words])
        self.answer = np.array(parts.answer)

    @staticmethod
    def _key(part: np.ndarray, word: np.ndarray) -> np.ndarray:
        return mix(word ^ mix(part.astype(np.uint64) + np.uint64(1)))

    def shares(self, part: np.ndarray, region: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each candidate, the shares of the part and of its answer that are in the region, in order."""
        key = self._key(np.repeat(part, region.shape[1]), region.ravel())
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        masks = np.where(self.keys[at] == key, self.masks[at], np.uint64(0)).reshape(region.shape)
        state = common_subsequence(region, masks)
        found = np.bitwise_count(~state & _bits(self.size[part]))
        first = self.answer[part]
        tail = self.size[part] - first
        only = common_subsequence(region, masks >> np.minimum(first, 63).astype(np.uint64)[:, None])
        answered = np.bitwise_count(~only & _bits(tail))
        whole = found / self.size[part]
        return whole, np.where(tail > 0, answered / np.maximum(tail, 1), whole)


class Holders:
    """Which passages can pass the check for a part, from its rarest words.

    The check asks for T of the n words of a part. Then of any n - T + k of them at least k are in the
    region; the n - T + k rarest are indexed, with k = LEAST or T if that is less. Rarity only makes
    candidates few: whatever the frequencies, no pair that the check accepts is left out.
    """

    def __init__(self, parts: Parts, share: float, frequency: np.ndarray):
        size = np.array([len(w) for w in parts.words])
        asked = (np.arange(PART + 1)[:, None] / size < share).sum(axis=0)
        asked = np.maximum(asked, 1)  # a passage without any word of the part is no candidate
        self.need = np.minimum(LEAST, asked)
        part = np.repeat(np.arange(len(size)), size)
        word = np.concatenate(parts.words)
        order = np.lexsort((word, frequency[_terms(word)], part))
        place = np.arange(len(part)) - np.repeat(np.cumsum(size) - size, size)
        order = order[place < np.repeat(size - asked + self.need, size)]
        part, word = part[order], word[order]
        order = np.lexsort((part, word))
        part, word = part[order], word[order]
        new = np.flatnonzero(np.concatenate([[True], (word[1:] != word[:-1]) | (part[1:] != part[:-1])])) if len(word) else np.zeros(0, dtype=np.int64)
        self.times = np.diff(np.append(new, len(word)))
        self.part = part[new]
        self.words, self.at = np.unique(word[new], return_index=True)
        self.at = np.append(self.at, len(new))
        self.terms = np.zeros(TERMS, dtype=bool)
        self.terms[_terms(self.words)] = True

    def candidates(self, words: Words) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(passage, part) by passages, counted as in passage_vectors."""
        starts, text = _blocks(words)
        kept = _passages(text)
        if not len(self.words) or not len(kept):
            return
        at = np.flatnonzero(self.terms[_terms(words.hash)])
        known = np.minimum(np.searchsorted(self.words, words.hash[at]), len(self.words) - 1)
        same = self.words[known] == words.hash[at]
        wide = np.int64(len(self.words))
        key = _distinct(_block_of(starts, len(words))[at[same]] * wide + known[same])
        block, known = key // wide, key % wide
        number = np.full(len(starts), -1)
        number[kept] = np.arange(len(kept))
        # the region of a passage: its two blocks, the one before and the one after
        keys = []
        for shift in (-2, -1, 0, 1):
            first = block + shift
            inside = (first >= 0) & (first < len(starts))
            first, word, own = first[inside], known[inside], block[inside]
            inside = (text[first] == text[own]) & (number[first] >= 0)
            keys.append(number[first[inside]] * wide + word[inside])
        key = _distinct(np.concatenate(keys))
        passage, known = key // wide, key % wide
        size = self.at[known + 1] - self.at[known]
        before = np.concatenate([[0], np.cumsum(size)])
        wide = len(self.need)
        lo = 0
        while lo < len(kept):
            # passages whose pairs with parts, and whose entries in the index, are a bounded number
            a = np.searchsorted(passage, lo)
            b = np.searchsorted(before, before[a] + _PAIRS, side="right") - 1
            hi = passage[b] if b < len(passage) else len(kept)
            hi = max(lo + 1, min(hi, lo + max(1, _PAIRS // wide)))
            b = np.searchsorted(passage, hi)
            entry = np.repeat(self.at[known[a:b]] - (before[a:b] - before[a]), size[a:b]) + np.arange(before[b] - before[a])
            pair = np.repeat(passage[a:b] - lo, size[a:b]) * wide + self.part[entry]
            found = np.bincount(pair, weights=self.times[entry], minlength=(hi - lo) * wide).reshape(-1, wide)
            p, q = _true_cells(found >= self.need)
            if len(p):
                yield lo + p, q
            lo = hi


def _regions(words: Words, first: np.ndarray, text: np.ndarray) -> np.ndarray:
    """The words of each passage with 32 words before and after it; zero where the text has none."""
    at = first[:, None] + np.arange(-BLOCK, 3 * BLOCK)[None, :]
    inside = (at >= words.first[text][:, None]) & (at < words.first[text + 1][:, None])
    return np.where(inside, words.hash[np.clip(at, 0, len(words) - 1)], np.uint64(0))


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    cosine: float = COSINE,
    share: float = SHARE,
    answer: float = ANSWER,
) -> DataFrame:
    """(id, item_id, cosine, lcs_share, answer_share): each document and benchmark item that it holds.

    benchmark has item_id bigint and text. A null or empty text holds nothing and is held by nothing.
    An item that a document holds several times gives one row, with the best values. Repeated rows of
    docs each give their rows. Items with a null id are left out; rows that repeat an item id are parts
    of one item. An empty benchmark gives no rows. Other columns are not read.

    The latent space, the frequencies, the search and the check cover all documents. The benchmark is read
    in groups of ITEMS items, each with its own passes, so what goes to a task is bounded. A pair below cosine is found
    too if enough of the part's words are there (see Holders); its cosine may be 0.
    """
    spark = docs.sparkSession
    ids = docs.select(id_col).schema[0].dataType.simpleString()
    schema = f"`{id_col}` {ids}, item_id bigint, cosine double, lcs_share double, answer_share double"
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text"))
    frequency, blocks = document_frequencies(rows)
    idf = term_weights(frequency, blocks)
    items = benchmark.filter("item_id IS NOT NULL").select("item_id", "text")
    groups = max(1, -(-items.count() // ITEMS))
    out = None
    for g in range(groups):
        own = items.filter(F.pmod(F.xxhash64("item_id"), F.lit(groups)) == g)
        parts = item_parts([(r["item_id"], r["text"]) for r in own.orderBy("item_id", "text").collect()])
        if not parts.words:
            continue
        space = fit_space(rows, parts, idf)
        found = rows.mapInArrow(_searcher(parts, space, frequency, cosine, share, answer, id_col), schema)
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], schema) if out is None else out


def _close(vectors: np.ndarray, queries: np.ndarray, cosine: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(passage, part) of a cosine of at least cosine."""
    for k in range(0, len(vectors), 4096):
        p, q = _true_cells(vectors[k : k + 4096] @ queries.T >= cosine)
        yield k + p, q


def _searcher(parts: Parts, space: np.ndarray, frequency: np.ndarray, cosine: float, share: float, answer: float, id_col: str):
    queries = _part_vectors(parts, space)[:, :-1]
    queries /= np.maximum(np.linalg.norm(queries, axis=1, keepdims=True), 1e-9)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        checker, holders = Checker(parts), Holders(parts, share, frequency)
        for batch in batches:
            for texts in texts_of(batch.column(1)):
                words = lowered_words(texts)
                vectors, first, text = passage_vectors(words, space)
                # the whole length of a passage: what the space leaves out makes it less like any part
                vectors = vectors[:, :-1] / np.sqrt(np.maximum(vectors[:, -1:], 1.0))
                hits = []
                for p, q in itertools.chain(_close(vectors, queries, cosine), holders.candidates(words)):
                    for lo in range(0, len(p), 4096):
                        i, j = p[lo : lo + 4096], q[lo : lo + 4096]
                        whole, told = checker.shares(j, _regions(words, first[i], text[i]))
                        good = (whole >= share) & (told >= answer)
                        i, j = i[good], j[good]
                        hits.append((text[i], parts.item[j], (vectors[i] * queries[j]).sum(axis=1), whole[good], told[good]))
                if not hits:
                    continue
                got = pd.DataFrame({n: np.concatenate([h[c] for h in hits]) for c, n in enumerate("ticlw")})
                got = got.groupby(["t", "i"], as_index=False).max()
                key = batch.column(0).take(pa.array(got["t"].to_numpy() + texts.rows.start))
                yield pa.RecordBatch.from_arrays(
                    [key, *(pa.array(got[n].to_numpy().astype(kind)) for n, kind in zip("iclw", (np.int64, float, float, float), strict=True))],
                    names=[id_col, "item_id", "cosine", "lcs_share", "answer_share"],
                )

    return search


def without_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows whose id holds a benchmark item; rows with a null id stay; all columns stay."""
    leaks = find_leaks(docs, benchmark, id_col, text_col).select(F.col(id_col)).distinct()
    return docs.join(leaks, id_col, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(
        spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    )
