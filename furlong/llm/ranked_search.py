"""Ranked lexical search: the best documents of each item of a query table, exactly.

1. One pass counts the documents with a term (N) and all terms (L).
2. Each task cuts its documents into shards and writes one index row per shard: the terms, their
   document frequencies, and the impact quadtree of ``treap`` over its terms x documents. The index
   holds every document and knows nothing of the queries.
3. For a group of items the shards' frequencies of the items' terms are added up; they give the
   weights.
4. Each task searches its shards one after the other, all items of the group together. The k-th
   best score so far bounds what later shards must offer. The best k of the tasks meet in one
   window per item, after a cut to k in every task.

A term is a run of characters other than ASCII non-alphanumerics, A-Z lower-cased; the score of a
document is the sum over the item's distinct terms of w * ((SCALE * tf) div (1000 * tf + 8 * m)).
Null and empty texts, of documents or items, have no term: they count nowhere and find nothing.
Repeated rows and null ids are documents of their own; equal scores come by ascending id, null first,
then by the text's place in the input. An item without a matching document has no row; items with
equal ids are one item with the terms of both. Texts are read whole. Other columns are not read.

A shard is a row of a few MB. Parquet counts the size of a row group only every hundred rows and Spark
reads a whole group at once, and it sends ten thousand rows to Python in one batch; so the index is
written in groups of a few shards and read in batches of as many, whatever a task or a file holds.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import LongType, StructField, StructType

from furlong.llm.treap import pack, search, unpack
from furlong.llm.words import give_back
from furlong.session import shared_dir

NAME = "op11_ranked_search"
TERM = re.compile(rb"[0-9a-z\x80-\xff]+")
SCALE = 1_000_000_000
SHARD_POINTS = 1 << 19  # a shard ends with the text that reaches so many points
SHARD_DOCS = 1 << 13
GROUP_BYTES = 4 << 20  # text of the items that are searched together
TOGETHER = 8  # items of one search; bounds a task's memory
GROUP_OF_SHARDS = 4 << 20  # bytes of a row group of the index, looked at after each row
SHARDS_AT_ONCE = 2  # shards of one batch to Python
TEXTS_AT_ONCE = 1000  # texts of one batch to Python
BATCH_KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"
INDEX = (
    "docs binary, nulls binary, place binary, terms binary, ends binary, df binary, "
    "height int, bits binary, drops binary, greatest bigint"
)


@contextmanager
def rows_at_once(spark: SparkSession, most: int):
    """Jobs that run inside send at most so many rows to Python at once; the session's setting comes back."""
    was = spark.conf.get(BATCH_KEY)
    if 0 < int(was) < most:
        most = int(was)
    spark.conf.set(BATCH_KEY, str(most))
    try:
        yield
    finally:
        spark.conf.set(BATCH_KEY, was)


def terms_of(text: str | bytes | None) -> list[bytes]:
    text = text.encode() if isinstance(text, str) else text or b""
    return TERM.findall(text.lower())


def count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow: texts to (documents with a term, terms) of the task."""
    docs = total = 0
    for batch in batches:
        texts = batch.column(0).cast(pa.large_binary())
        for k in range(len(texts)):
            n = len(terms_of(texts[k].as_py()))
            docs, total = docs + (n > 0), total + n
    yield pa.RecordBatch.from_pydict({"docs": [docs], "terms": [total]})


def index_rows(n_docs: int, n_terms: int, shard_docs: int, shard_points: int):
    """For mapInArrow: (id, text, place) to rows of INDEX. n_docs and n_terms are N and L."""

    def shard(ids, places, lengths, columns, rows, counts, vocabulary) -> pa.RecordBatch:
        column = np.repeat(np.arange(len(ids)), columns)
        row, tf = np.concatenate(rows), np.concatenate(counts)
        # Python integers: 90 * n * N may not fit in 64 bits on the way
        m = np.array([100 - 90 + (90 * n * n_docs) // n_terms for n in lengths], dtype=np.int64)
        impact = (SCALE * tf) // (1000 * tf + 8 * m[column])
        df = np.bincount(row, minlength=len(vocabulary))
        words = list(vocabulary)
        # frequent terms side by side, so that nodes join rows of like impact
        order = np.lexsort((np.arange(len(words)), -df))
        at = np.empty(len(words), dtype=np.int64)
        at[order] = np.arange(len(words))
        some = impact > 0
        height, bits, drops, greatest = (
            pack(at[row[some]], column[some], impact[some]) if some.any() else (0, b"", b"", 0)
        )
        words = [words[i] for i in order]
        known = np.array([i is not None for i in ids])
        values = {
            "docs": np.array([i or 0 for i in ids], dtype="<i8").tobytes(),
            "nulls": np.packbits(~known).tobytes(),
            "place": np.array(places, dtype="<i8").tobytes(),
            "terms": b"".join(words),
            "ends": np.cumsum([len(w) for w in words], dtype="<i8").tobytes(),
            "df": df[order].astype("<i4").tobytes(),
            "height": height,
            "bits": bits,
            "drops": drops,
            "greatest": greatest,
        }
        kinds = {"height": pa.int32(), "greatest": pa.int64()}
        return pa.RecordBatch.from_arrays(
            [pa.array([v], kinds.get(k, pa.binary())) for k, v in values.items()], names=list(values)
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def fresh():
            words: defaultdict[bytes, int] = defaultdict()
            words.default_factory = words.__len__
            return [], [], [], [], [], [], words

        held, points = fresh(), 0
        for batch in batches:
            texts = batch.column(1).cast(pa.large_binary())
            for i, (key, place) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                counts = Counter(terms_of(texts[i].as_py()))
                if not counts:
                    continue
                ids, places, lengths, columns, rows, tfs, words = held
                ids.append(key)
                places.append(place)
                columns.append(len(counts))
                rows.append(np.fromiter(map(words.__getitem__, counts), dtype=np.int64, count=len(counts)))
                tfs.append(np.fromiter(counts.values(), dtype=np.int64, count=len(counts)))
                lengths.append(int(tfs[-1].sum()))
                points += len(counts)
                if points >= shard_points or len(ids) >= shard_docs:
                    yield shard(*held)
                    held, points = fresh(), 0
            del texts
            give_back()
        if held[0]:
            yield shard(*held)

    return run


def build_index(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shard_docs: int = SHARD_DOCS,
    shard_points: int = SHARD_POINTS,
) -> tuple[DataFrame, int]:
    """(index, N): the written index of all documents, and how many of them have a term."""
    spark = docs.sparkSession
    counted = docs.select(text_col).mapInArrow(count_terms, "docs bigint, terms bigint")
    with rows_at_once(spark, TEXTS_AT_ONCE):
        n_docs, n_terms = (x or 0 for x in counted.agg(F.sum("docs"), F.sum("terms")).first())
    path = shared_dir(spark, "search-index")
    rows = docs.select(F.col(id_col).cast("bigint"), F.col(text_col), F.monotonically_increasing_id().alias("place"))
    index = rows.mapInArrow(index_rows(n_docs, n_terms, shard_docs, shard_points), INDEX)
    sizes = {"parquet.block.size": GROUP_OF_SHARDS, "parquet.page.size.row.check.min": 1, "parquet.page.size.row.check.max": 1}
    with rows_at_once(spark, TEXTS_AT_ONCE):
        index.write.options(compression="zstd", **sizes).parquet(path)
    return spark.read.schema(INDEX).parquet(path), n_docs


def _shards(batch: pa.RecordBatch) -> Iterator[dict]:
    for i in range(batch.num_rows):
        yield {name: batch.column(k)[i].as_py() for k, name in enumerate(batch.schema.names)}


def _lookup(shard: dict, wanted: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers in wanted and rows of the shard's terms that are wanted."""
    ends = np.frombuffer(shard["ends"], dtype="<i8").tolist()
    data, start, number, row = shard["terms"], 0, [], []
    for k, end in enumerate(ends):
        at = wanted.get(data[start:end])
        if at is not None:
            number.append(at)
            row.append(k)
        start = end
    return np.array(number, dtype=np.int64), np.array(row, dtype=np.int64)


def frequencies(wanted: dict[bytes, int]):
    """For mapInArrow: (terms, ends, df) to (number, df), summed over the task's shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(wanted), dtype=np.int64)
        for batch in batches:
            for shard in _shards(batch):
                number, row = _lookup(shard, wanted)
                total[number] += np.frombuffer(shard["df"], dtype="<i4")[row]
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["number", "df"])

    return run


def best_of(
    names: list, kind: pa.DataType, items: list[list[int]], wanted: dict[bytes, int], weights: np.ndarray, k: int, together: int
):
    """For mapInArrow: rows of INDEX to (item, id, place, score), the best k of the task per item.

    names are the items' ids, of Arrow type kind; items has the numbers of each item's terms.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owner = np.repeat(np.arange(len(items)), [len(x) for x in items])
        number = np.array([t for x in items for t in x], dtype=np.int64)
        best: list[list[tuple]] = [[] for _ in items]
        floor = np.zeros(len(items), dtype=np.int64)
        for batch in batches:
            for shard in _shards(batch):
                if not shard["height"]:
                    continue
                have, row = _lookup(shard, wanted)
                row_of = np.full(len(wanted), -1, dtype=np.int64)
                row_of[have] = row
                there = row_of[number] >= 0
                q, rows, w = owner[there], row_of[number[there]], weights[number[there]]
                tree = unpack(shard["height"], shard["bits"], shard["drops"], shard["greatest"])
                ids = np.frombuffer(shard["docs"], dtype="<i8")
                null = np.unpackbits(np.frombuffer(shard["nulls"], dtype=np.uint8))[: len(ids)].astype(bool)
                place = np.frombuffer(shard["place"], dtype="<i8")
                rank = np.empty(len(ids), dtype=np.int64)
                rank[np.lexsort((place, ids, ~null))] = np.arange(len(ids))
                for lo in range(0, len(items), together):
                    part = (q >= lo) & (q < lo + together)
                    size = min(together, len(items) - lo)
                    got = search(
                        tree, q[part] - lo, rows[part], w[part], size, k, floor[lo : lo + size].copy(), rank
                    )
                    for item, column, score in zip(*(x.tolist() for x in got), strict=True):
                        key = (not null[column], int(ids[column]), int(place[column]))
                        best[lo + item].append((-score, *key))
                    for item in np.unique(got[0]).tolist():
                        mine = best[lo + item]
                        mine.sort()
                        del mine[k:]
                        if len(mine) == k:
                            floor[lo + item] = -mine[-1][0]
        found = [(name, x[2] if x[1] else None, x[3], -x[0]) for name, mine in zip(names, best, strict=True) for x in mine]
        cols = list(zip(*found, strict=True)) if found else [()] * 4
        kinds = [kind, pa.int64(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(c), t) for c, t in zip(cols, kinds, strict=True)], names=["item", "id", "place", "score"]
        )

    return run


def _groups(items: DataFrame, id_col: str, text_col: str, limit: int) -> Iterator[dict]:
    """The terms of the items, by id, in groups of about limit bytes of text."""
    held: dict = {}
    size = 0
    for item, text in items.select(id_col, text_col).orderBy(id_col).toLocalIterator():
        if size >= limit and item not in held:
            yield held
            held, size = {}, 0
        held.setdefault(item, {}).update(dict.fromkeys(terms_of(text)))
        size += len(text or "")
    if held:
        yield held


def top_documents(
    index: DataFrame,
    n_docs: int,
    items: DataFrame,
    k: int = 10,
    item_col: str = "item_id",
    text_col: str = "text",
    out_col: str = "doc_id",
    group_bytes: int = GROUP_BYTES,
    together: int = TOGETHER,
) -> DataFrame:
    """(item, rank, id, score): each item's k best documents with a score above 0."""
    spark, path = index.sparkSession, shared_dir(index.sparkSession, "search-results")
    kind = items.schema[item_col].dataType
    empty = spark.createDataFrame([], StructType([StructField("item", kind)])).selectExpr(
        "item", "cast(null as int) as rank", "cast(null as bigint) as id", "cast(null as bigint) as score"
    )
    empty.write.parquet(path)
    for group in _groups(items, item_col, text_col, group_bytes):
        wanted = {t: k for k, t in enumerate(dict.fromkeys(t for terms in group.values() for t in terms))}
        counts = index.select("terms", "ends", "df").mapInArrow(frequencies(wanted), "number bigint, df bigint")
        df = np.zeros(len(wanted), dtype=np.int64)
        with rows_at_once(spark, SHARDS_AT_ONCE):
            found = counts.groupBy("number").agg(F.sum("df")).collect()  # a row for each term of the group
        for number, count in found:
            df[number] = count
        weights = [math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(x) + 1))) for x in df]
        numbers = [[wanted[t] for t in terms] for terms in group.values()]
        search_shards = best_of(
            list(group), to_arrow_type(kind), numbers, wanted, np.array(weights, dtype=np.int64), k, together
        )
        schema = StructType([StructField("item", kind), *(StructField(c, LongType()) for c in ("id", "place", "score"))])
        order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_first("id"), "place")
        ranked = index.mapInArrow(search_shards, schema).withColumn("rank", F.row_number().over(order))
        with rows_at_once(spark, SHARDS_AT_ONCE):
            ranked.filter(F.col("rank") <= k).select("item", "rank", "id", "score").write.mode("append").parquet(path)
    return spark.read.schema(empty.schema).parquet(path).select(
        F.col("item").alias(item_col), "rank", F.col("id").alias(out_col), "score"
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, n_docs = build_index(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return top_documents(index, n_docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


SQL = r"""
WITH words AS (
  SELECT d, doc_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM (SELECT row_number() OVER () AS d, doc_id, text FROM documents)),
asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark),
totals AS (SELECT count(DISTINCT d)::HUGEINT AS n_docs, count(*)::HUGEINT AS n_terms FROM words),
lengths AS (
  SELECT d, any_value(doc_id) AS doc_id, 100 - 90 + (90 * count(*)::HUGEINT * any_value(n_docs)) // any_value(n_terms) AS m
  FROM words, totals GROUP BY d),
tf AS (SELECT d, term, count(*)::HUGEINT AS tf FROM words GROUP BY d, term),
w AS (
  SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::HUGEINT AS w
  FROM tf, totals GROUP BY term),
scores AS (
  SELECT a.item_id, l.doc_id, l.d, sum(w.w * ((1000000000 * tf.tf) // (1000 * tf.tf + 8 * l.m)))::BIGINT AS score
  FROM asked a JOIN tf USING (term) JOIN w USING (term) JOIN lengths l ON l.d = tf.d GROUP BY a.item_id, l.doc_id, l.d),
ranked AS (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id, d)::INT AS rank, doc_id, score
  FROM scores WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""
