"""Substring deduplication by seed and extend.

Seeds are winnowed anchors: of every nine consecutive 5-word hashes the least one is kept, so two
documents that share 13 consecutive words share the anchor inside them. Documents are joined on
their anchors. Around each shared anchor the match is extended left and right to the 13-word
windows that chose it, and these are compared between documents; the union of the windows that an
earlier document has too is the set of maximal repeats of 13 words or more.

The join on anchors and the join on windows are one operation, ``met_elsewhere``: hashes travel
packed, about ten bytes each. Equal hashes of a batch are settled where they are and send one
entry on, so a hash that a third of all documents hold costs its bucket one entry a batch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furlong.llm.words import Texts, Words, grams, mix, texts_of

NAME = "op3_repeated_passages"
WINDOW, SEED = 13, 5
_CHOICES = WINDOW - SEED + 1


# ---- hashes that several documents hold


def _pack(doc: np.ndarray, h: np.ndarray) -> bytes:
    """Documents (rising) as steps, in two bytes if they fit, and their hashes."""
    step = np.diff(doc, prepend=doc[:1])
    wide = int(len(step) and step.max() > 0xFFFF)
    head = np.array([len(doc), doc[0] if len(doc) else 0, wide], dtype=np.int64)
    return head.tobytes() + step.astype(np.int64 if wide else np.uint16).tobytes() + h.astype(np.uint64).tobytes()


def _unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, first, wide = np.frombuffer(blob, dtype=np.int64, count=3).tolist()
    kind = np.dtype(np.int64 if wide else np.uint16)
    step = np.frombuffer(blob, dtype=kind, count=n, offset=24).astype(np.int64)
    return first + np.cumsum(step), np.frombuffer(blob, dtype=np.uint64, offset=24 + n * kind.itemsize)


def _first_of_each(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Entries by hash, then document, each pair once; the least document of each hash, and whether
    a hash has several documents."""
    order = np.lexsort((doc, h))
    h, doc = h[order], doc[order]
    once = np.ones(len(h), dtype=bool)
    once[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc = h[once], doc[once]
    new = np.ones(len(h), dtype=bool)
    new[1:] = h[1:] != h[:-1]
    at = np.flatnonzero(new)
    size = np.diff(np.append(at, len(h)))
    return h, doc, np.repeat(doc[at], size), np.repeat(size > 1, size)


def _sorted_rows(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(doc, kind="stable")
    return doc[order], h[order]


class Sender:
    """Packs the (document, hash) entries of a task into rows (bucket, settled, blob)."""

    def __init__(self, buckets: int, earlier_only: bool):
        self.buckets, self.earlier_only = buckets, earlier_only
        self.turn = TaskContext.get().partitionId()

    def send(self, doc: np.ndarray, h: np.ndarray) -> Iterator[pa.RecordBatch]:
        h, doc, least, several = _first_of_each(h, doc)
        later = doc > least
        settled = later if self.earlier_only else several
        rows: list[tuple[int, bool, bytes]] = []
        if settled.any():
            self.turn += 1
            rows.append((self.turn % self.buckets, True, _pack(*_sorted_rows(h[settled], doc[settled]))))
        # what other batches must know: the least document of each hash
        h, doc, several = h[~later], doc[~later], several[~later]
        bucket = (h % np.uint64(self.buckets)).astype(np.int64)
        order = np.lexsort((doc, bucket))
        cuts = np.searchsorted(bucket[order], np.arange(self.buckets + 1))
        for b in np.flatnonzero(np.diff(cuts)):
            part = order[cuts[b] : cuts[b + 1]]
            rows.append((int(b), False, _pack(doc[part], h[part])))
        if rows:
            cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.bool_(), pa.binary()), strict=True)]
            yield pa.RecordBatch.from_arrays(cols, names=["bucket", "settled", "blob"])


_SENT = "bucket int, settled boolean, blob binary"


def met_elsewhere(sent: DataFrame, earlier_only: bool) -> DataFrame:
    """(doc, h): the entries whose hash another document has, or one with a smaller id.

    Not all settled entries come out of their own batch: with earlier_only, a batch settles what its
    own smaller ids show, the bucket settles the least document of each batch.
    """

    def settle(group: pd.DataFrame) -> pd.DataFrame:
        done = [_unpack(b) for b in group["blob"][group["settled"]]]
        open_ = [_unpack(b) for b in group["blob"][~group["settled"]]]
        docs, hashes = [d for d, _ in done], [h for _, h in done]
        if open_:
            doc, h = (np.concatenate([x[k] for x in open_]) for k in (0, 1))
            h, doc, least, several = _first_of_each(h, doc)
            hit = doc > least if earlier_only else several
            docs.append(doc[hit])
            hashes.append(h[hit])
        return pd.DataFrame({"doc": np.concatenate(docs), "h": np.concatenate(hashes).view(np.int64)})

    return sent.groupBy("bucket").applyInPandas(settle, "doc bigint, h bigint")


# ---- anchors and windows of texts


def _anchors(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all windows that lie in one text, and the hash of the anchor that each chooses."""
    seeds = grams(words.hash, SEED)
    if len(seeds) < _CHOICES:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    starts = np.flatnonzero(words.left[: len(seeds) - _CHOICES + 1] >= WINDOW)
    return starts, sliding_window_view(seeds, _CHOICES).min(axis=1)[starts]


def _salted(row: np.ndarray, h: np.ndarray) -> np.ndarray:
    return mix(h ^ mix(row.astype(np.uint64) + np.uint64(1)))


def _listed(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row number and hash of every entry of a list column."""
    sizes = np.array([0 if x is None else x for x in lists.value_lengths().to_pylist()], dtype=np.int64)
    return np.repeat(np.arange(len(sizes)), sizes), lists.flatten().to_numpy().view(np.uint64)


def _marked(texts: Texts, words: Words, lists: pa.Array) -> np.ndarray:
    """Which windows have an anchor in the list of their row."""
    starts, anchor = _anchors(words)
    row, h = _listed(lists.slice(texts.rows.start, len(texts)))
    return starts[np.isin(_salted(words.text_of[starts], anchor), _salted(row, h))]


def _kept_digests(texts: Texts, words: Words, keep: np.ndarray) -> list[str]:
    """sha256 of the kept words of each text, joined by one space."""
    data = np.append(texts.data, np.uint8(0x20))
    starts, ends = words.starts[keep], words.ends[keep]
    size = ends - starts + 1
    after = np.cumsum(size)
    at = np.repeat(starts - (after - size), size) + np.arange(after[-1] if len(after) else 0)
    at[after - 1] = len(texts.data)
    body = memoryview(data[at].tobytes())
    counts = np.concatenate([[0], np.cumsum(keep)])[words.first]
    cuts = np.concatenate([[0], after])[counts]
    return [
        hashlib.sha256(body[a : max(a, b - 1)]).hexdigest() for a, b in zip(cuts[:-1], cuts[1:], strict=True)
    ]


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_removed, kept_sha256), one row per row of docs. The id must be a bigint.

    A word goes if a 13-word window that covers it also starts in a document with a smaller id; all
    windows are judged on the input. Rows with one id are one document in that comparison, and each
    gives a row. A row with a null id keeps all its words and is nobody's earlier document. A null
    text has no words (the digest is that of the empty text). Other columns are not read.
    """
    spark = docs.sparkSession
    buckets = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts_only = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))

    def ids_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        return column.fill_null(0).to_numpy(), ~column.is_null().to_numpy(zero_copy_only=False)

    def send_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sender = Sender(buckets, earlier_only=False)
        for batch in batches:
            ids, known = ids_of(batch.column(0))
            parts = []
            for texts in texts_of(batch.column(1)):
                words = texts.words()
                starts, anchor = _anchors(words)
                text = words.text_of[starts]
                new = np.ones(len(starts), dtype=bool)
                # also where a text begins: it may begin with the anchor on which the one before it ends
                new[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])
                row = texts.rows.start + text[new]
                parts.append((ids[row][known[row]], anchor[new][known[row]]))
            if parts:
                yield from sender.send(*(np.concatenate([p[k] for p in parts]) for k in (0, 1)))

    def send_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sender = Sender(buckets, earlier_only=True)
        for batch in batches:
            ids, known = ids_of(batch.column(0))
            parts = []
            for texts in texts_of(batch.column(1)):
                if batch.column(2).slice(texts.rows.start, len(texts)).null_count == len(texts):
                    continue
                words = texts.words()
                starts = _marked(texts, words, batch.column(2))
                row = texts.rows.start + words.text_of[starts]
                parts.append((ids[row][known[row]], grams(words.hash, WINDOW)[starts][known[row]]))
            if parts:
                yield from sender.send(*(np.concatenate([p[k] for p in parts]) for k in (0, 1)))

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in texts_of(batch.column(1)):
                words = texts.words()
                row, h = _listed(batch.column(2).slice(texts.rows.start, len(texts)))
                whole = np.flatnonzero(words.left >= WINDOW) if len(h) else np.zeros(0, dtype=np.int64)
                key = _salted(words.text_of[whole], grams(words.hash, WINDOW)[whole]) if len(whole) else h[:0]
                hit = whole[np.isin(key, _salted(row, h))]
                step = np.bincount(hit, minlength=len(words) + 1) - np.bincount(
                    np.minimum(hit + WINDOW, len(words)), minlength=len(words) + 1
                )
                gone = np.cumsum(step[: len(words)]) > 0
                total = np.concatenate([[0], np.cumsum(gone)])[words.first]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(texts.rows.start, len(texts)),
                        pa.array(words.counts.astype(np.int64)),
                        pa.array(np.diff(total).astype(np.int64)),
                        pa.array(_kept_digests(texts, words, ~gone), pa.string()),
                    ],
                    names=[id_col, "n_words", "n_removed", "kept_sha256"],
                )

    def with_lists(met: DataFrame) -> DataFrame:
        """Every document with its list of hashes; the texts are shuffled alike both times."""
        lists = met.groupBy("doc").agg(F.collect_list("h").alias("hashes"))
        return texts_only.join(lists, F.col("_id") == F.col("doc"), "left").select("_id", "_text", "hashes")

    shared = met_elsewhere(texts_only.mapInArrow(send_anchors, _SENT), earlier_only=False)
    again = met_elsewhere(with_lists(shared).mapInArrow(send_windows, _SENT), earlier_only=True)
    ids = docs.select(id_col).schema[0].dataType.simpleString()
    schema = f"`{id_col}` {ids}, n_words bigint, n_removed bigint, kept_sha256 string"
    return with_lists(again).mapInArrow(remove, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH texts AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
word AS (SELECT doc_id, unnest(words) AS w, generate_subscripts(words, 1) AS i, len(words) AS n FROM texts),
windows AS (
    SELECT doc_id, w, i, CASE WHEN i + 12 <= n THEN string_agg(w, ' ') OVER (
        PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING) END AS s FROM word),
first AS (SELECT s, min(doc_id) AS d FROM windows WHERE s IS NOT NULL GROUP BY s),
hits AS (
    SELECT doc_id, w, i, coalesce(first.d < doc_id, false) AS hit FROM windows LEFT JOIN first USING (s)),
judged AS (
    SELECT doc_id, w, i, bool_or(hit) OVER (
        PARTITION BY doc_id ORDER BY i ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) AS gone FROM hits),
sums AS (
    SELECT doc_id, count(*) FILTER (gone) AS n_removed, string_agg(w, ' ' ORDER BY i) FILTER (NOT gone) AS kept
    FROM judged GROUP BY doc_id)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_removed, 0) AS n_removed,
    sha256(coalesce(kept, '')) AS kept_sha256
FROM texts LEFT JOIN sums USING (doc_id)
"""
