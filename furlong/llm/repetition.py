"""Quality rules: repeated passages inside one text, by suffix array.

The words of each text are sorted as suffixes by prefix doubling. Neighbours in that order
that share at least ``min_words`` words bound the longest-common-prefix intervals, whose
prefixes are the maximal repeats. Their spans are united; a text is rejected when they cover
more than ``max_fraction`` of its words or when one of them is longer than ``max_longest``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furlong.llm.words import Texts, Words, grams, mix, prefix, span_hash, spans_covered, texts_of

NAME = "op7_repetition_rules"
SQL = None
_SYMBOLS = np.zeros(256, dtype=bool)
_SYMBOLS[list(b"#*$%&|<>")] = True


def _tied(order: np.ndarray) -> np.ndarray:
    """Which entries of a sorted array have an equal neighbour."""
    same = order[1:] == order[:-1]
    return np.concatenate([[False], same]) | np.concatenate([same, [False]])


def suffix_levels(words: Words) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffix array of all texts, text by text, and the ranks by the first 1, 2, 4, ... words.

    Equal ranks of level k mean equal first 2 ** k words in the same text. Only suffixes that
    are still tied are sorted again.
    """
    n, ends = len(words), np.repeat(words.first[1:], words.counts)
    key = mix(words.hash ^ mix(words.text_of.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(key, kind="stable")
    sorted_key = key[order]
    new = np.concatenate([[True], sorted_key[1:] != sorted_key[:-1]]) if n else np.zeros(0, dtype=bool)
    start = np.maximum.accumulate(np.where(new, np.arange(n), 0)) if n else np.zeros(0, dtype=np.int64)
    rank = np.empty(n, dtype=np.int64)
    rank[order] = start
    levels, h = [rank], 1
    slots = np.flatnonzero(_tied(start)) if n else np.zeros(0, dtype=np.int64)
    while len(slots):
        at, group = order[slots], start[slots]
        beyond = at + h
        second = np.where(beyond < ends[at], rank[np.minimum(beyond, n - 1)], -1)
        by = np.lexsort((second, group))
        at, second = at[by], second[by]
        new = np.concatenate([[True], (group[1:] != group[:-1]) | (second[1:] != second[:-1])])
        start, order = start.copy(), order.copy()
        order[slots] = at
        start[slots] = np.maximum.accumulate(np.where(new, slots, 0))
        rank = rank.copy()
        rank[at] = start[slots]
        levels.append(rank)
        slots = slots[_tied(start[slots])]
        h *= 2
    return order, levels


def repeats(words: Words, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths, in words, of the longest repeat that begins at a word, if min_words long."""
    order, levels = suffix_levels(words)
    low = min(min_words.bit_length() - 1, len(levels) - 1)
    if len(words) < 2 or 1 << low > min_words:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    ends = np.repeat(words.first[1:], words.counts)
    near = np.flatnonzero(levels[low][order[1:]] == levels[low][order[:-1]])
    a, b = order[near], order[near + 1]
    shared = np.zeros(len(a), dtype=np.int64)
    for k in range(len(levels) - 1, -1, -1):
        i, j = a + shared, b + shared
        inside = np.maximum(i, j) < np.minimum(ends[a], ends[b])
        same = inside & (levels[k][np.where(inside, i, 0)] == levels[k][np.where(inside, j, 0)])
        same &= np.maximum(i, j) + (1 << k) <= ends[a]
        shared += same.astype(np.int64) << k
    longest = np.zeros(len(words), dtype=np.int64)
    np.maximum.at(longest, a, shared)
    np.maximum.at(longest, b, shared)
    at = np.flatnonzero(longest >= min_words)
    return at, longest[at]


def _per_text(flags: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[first[1:]] - total[first[:-1]]


def _repeated_windows(words: Words, n: int) -> np.ndarray:
    """Which words lie in an n-word window that is found twice or more in its text."""
    whole = np.flatnonzero(words.left >= n)
    key = mix(grams(words.hash, n)[whole] ^ mix(words.text_of[whole].astype(np.uint64) + np.uint64(1)))
    order = np.argsort(key, kind="stable")
    twice = whole[order[_tied(key[order])]] if len(key) else whole
    return spans_covered(twice, twice + n, len(words))


def _dup_lines(texts: Texts, words: Words) -> np.ndarray:
    """Per text, how many lines with a word are equal to an earlier line."""
    breaks = np.flatnonzero(texts.data == 0x0A)
    starts = np.union1d(breaks + 1, texts.at[:-1])
    starts = starts[starts < len(texts.data)]
    line_text = np.searchsorted(texts.at, starts, side="right") - 1
    # a line ends before the next break, the last one of a text where the text ends
    ends = np.append(breaks, len(texts.data))[np.searchsorted(breaks, starts)]
    ends = np.minimum(ends, texts.at[line_text + 1])
    has_word = np.searchsorted(words.starts, ends) > np.searchsorted(words.starts, starts)
    keep = has_word & (starts < ends)
    starts, ends, line_text = starts[keep], ends[keep], line_text[keep]
    key = mix(span_hash(prefix(texts.data), starts, ends) ^ mix(line_text.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(key, kind="stable")
    later = order[1:][key[order][1:] == key[order][:-1]]
    return np.bincount(line_text[later], minlength=len(texts))


def rule_columns(texts: Texts, min_words: int, max_fraction: float, max_longest: int) -> dict[str, np.ndarray]:
    words = texts.words()
    n = words.counts
    letters = (texts.data & 0xC0) != 0x80
    length = np.concatenate([[0], np.cumsum(letters, dtype=np.int64)])
    word_chars = np.concatenate([[0], np.cumsum(length[words.ends] - length[words.starts])])
    at, size = repeats(words, min_words)
    covered = _per_text(spans_covered(at, at + size, len(words)), words.first)
    longest = np.zeros(len(texts), dtype=np.int64)
    np.maximum.at(longest, words.text_of[at], size)
    again = _per_text(_repeated_windows(words, 3), words.first)
    base_failed = (n < 50) | (100 * again > 50 * n)
    return {
        "n_words": n,
        "word_chars": word_chars[words.first[1:]] - word_chars[words.first[:-1]],
        "n_symbols": _per_text(_SYMBOLS[texts.data], texts.at),
        "n_dup_lines": _dup_lines(texts, words),
        "n_repeat_words": again,
        "base_failed": base_failed,
        "n_covered": covered,
        "longest_repeat": longest,
        "kept": ~base_failed & (covered <= max_fraction * n) & (longest <= max_longest),
    }


def repetition_rules(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_words: int = 10,
    max_fraction: float = 0.3,
    max_longest: int = 300,
) -> DataFrame:
    """Counts and verdict of every text, one row per input row.

    A null or empty text has zeros, fails the base rule (fewer than 50 words) and is not kept.
    Repeated rows are judged one by one; a null id is returned as null; other columns are not read.
    No row depends on another one, so there is no shuffle.
    """
    fields = "n_words word_chars n_symbols n_dup_lines n_repeat_words n_covered longest_repeat".split()
    ids = docs.select(id_col).schema[0].dataType.simpleString()
    schema = f"`{id_col}` {ids}, " + ", ".join(f"{f} bigint" for f in fields) + ", base_failed boolean, kept boolean"
    names = [id_col, *fields, "base_failed", "kept"]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in texts_of(batch.column(1)):
                got = rule_columns(texts, min_words, max_fraction, max_longest)
                key = batch.column(0).slice(texts.rows.start, len(texts))
                cols = [key, *(pa.array(got[f].astype(np.int64)) for f in fields)]
                cols += [pa.array(got["base_failed"]), pa.array(got["kept"])]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(judge, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))
