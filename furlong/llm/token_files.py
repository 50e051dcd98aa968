"""Token ids of documents in compressed binary files, and reading them back.

encode_files() sorts the documents by id over the whole table, turns every text into ids and writes
them, each document followed by the end id, to files of about ``file_tokens`` ids. Files in the order
of their names hold the documents in order. decode_files() reads them back. A file is

    8 bytes   magic "FTOKENS1"
    4 + 4     length and crc32 of the header as stored
    header    zlib: ids per block, documents, ids, distinct ids, blocks (5 x uint64); the distinct ids by
              falling frequency (uint32); document ids (int64), their null flags (bits), ids per document
              (uint64); for each block its 16-bit digits (uint32) and crc32 (uint32)
    blocks    the digits of each block, see context_mixing; each is decoded by itself

all little endian. A damaged header or block raises ValueError.

Tasks write through pyarrow's file systems (local and shared mounts, HDFS, S3, GCS) below the folder
of spark.checkpoint.dir. Every attempt writes files of its own; the manifest, a Parquet table that
Spark commits, names those that count, so lost executors and repeated tasks leave no trace.

Null and empty texts have the end id alone. Null ids come first; rows with equal ids (or copies of
a row) stay documents of their own, in the order of the input. A text of any length is one document
of one file. An empty table has no file. Other columns are not read.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from furlong.llm import context_mixing
from furlong.session import shared_dir

NAME = "op12_token_files"
SQL = None
MAGIC = b"FTOKENS1"
END_ID = 2
BLOCK_TOKENS = 2048
FILE_TOKENS = 1 << 23
LANES = 4096  # blocks that are coded side by side; bounds a task's memory
PIECES_HELD = 400_000
TEXT_BYTES = 1 << 21  # texts that are looked up together
#: A space after which and before which stands no white space: no pretoken of a byte-level model crosses its left side.
BORDER = re.compile(r" (?=\S)(?<=\S )")


def tokenizer_path() -> str:
    """The installed byte-level model; TOKENIZER_FILE names another one."""
    import public_tokenizers

    return os.environ.get("TOKENIZER_FILE") or str(public_tokenizers.path("byte_bpe_50k.json"))


@cache
def read_tokenizer(path: str) -> str:
    return Path(path).read_text()


class TextEncoder:
    """Ids of whole texts, as the tokenizers library gives them.

    Byte-level models work on pretokens. Where the model's own settings say that a word border is a
    border of pretokens, each distinct word goes to the library once and its ids are kept (at most
    PIECES_HELD); any other model gets whole texts.
    """

    def __init__(self, model: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.library = Tokenizer.from_str(model)
        pre = json.loads(model).get("pre_tokenizer") or {}
        plain = json.loads(model).get("normalizer") is None and not any(
            " " in t["content"] or t["lstrip"] or t["rstrip"] or t["single_word"]
            for t in json.loads(model).get("added_tokens", [])
        )
        byte_level = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
        self.by_word = bool(plain and byte_level)
        self.after_space: dict[str, bytes] = {}
        # a byte-level piece has a letter for each byte, an added token stands for itself
        added = {t["id"]: len(t["content"].encode()) for t in json.loads(model).get("added_tokens", [])}
        sizes = {i: len(t) for t, i in self.library.get_vocab(with_added_tokens=True).items()} | added
        self.width = np.zeros(max(sizes, default=0) + 1, dtype=np.int64)
        self.width[list(sizes)] = list(sizes.values())

    def _encode(self, texts: list[str]) -> list[bytes]:
        found = self.library.encode_batch(texts, add_special_tokens=False)
        return [np.array(x.ids, dtype="<u4").tobytes() for x in found]

    def _words(self, words: list[str]) -> Iterator[bytes]:
        """The ids of each word after a space. Many words go to the library as one text; as none of its
        tokens crosses a border of words, the tokens' bytes tell where each word ends."""
        for lo in range(0, len(words), 20_000):
            some = words[lo : lo + 20_000]
            groups = [some[k : k + 500] for k in range(0, len(some), 500)]
            for group, ids in zip(groups, self._encode([" " + " ".join(g) for g in groups]), strict=True):
                ends = np.cumsum(self.width[np.frombuffer(ids, dtype="<u4")])
                sizes = np.cumsum([len(w.encode()) + 1 for w in group])
                cuts = (4 * np.searchsorted(ends, sizes, side="left") + 4).tolist()
                yield from (ids[a:b] for a, b in zip([0, *cuts[:-1]], cuts, strict=True))

    def many(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        if not self.by_word:
            return self._encode(texts)
        split = [BORDER.split(t) for t in texts]
        known = self.after_space
        if len(known) > PIECES_HELD:
            known.clear()
        new = list({w for words in split for w in words[1:]} - known.keys())
        known.update(zip(new, self._words(new), strict=True))
        first = self._encode([words[0] for words in split])
        return [
            start + b"".join(map(known.__getitem__, words[1:])) if len(words) > 1 else start
            for start, words in zip(first, split, strict=True)
        ]


_ENCODERS: dict[int, TextEncoder] = {}


def _encoder(model: str) -> TextEncoder:
    """One for each worker and model: its words serve all tasks of the worker."""
    key = hash(model)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = TextEncoder(model)
    return _ENCODERS[key]


def pack_file(docs: list, counts: list[int], ids: np.ndarray, block: int) -> bytes:
    """The bytes of a file of documents with so many ids each."""
    if len(ids) and ids.max() < 1 << 20:
        times = np.bincount(ids)
        values = np.flatnonzero(times)
        order = np.argsort(-times[values], kind="stable")
        number = np.zeros(len(times), dtype=np.int32)
        number[values[order]] = np.arange(len(values))
        numbers = number[ids]
    else:
        values, place, times = np.unique(ids, return_inverse=True, return_counts=True)
        order = np.argsort(-times, kind="stable")
        number = np.empty(len(values), dtype=np.int32)
        number[order] = np.arange(len(values))
        numbers = number[place.reshape(-1)]
    digits, sizes, sums = [], [], []
    for lo in range(0, len(numbers), block * LANES):
        got, count = context_mixing.encode(numbers[lo : lo + block * LANES], block, len(values))
        digits.append(got)
        sizes.append(count)
        ends = np.cumsum(count)
        sums += [zlib.crc32(got[e - c : e].tobytes()) for e, c in zip(ends.tolist(), count.tolist(), strict=True)]
    null = np.array([d is None for d in docs], dtype=bool)
    header = b"".join(
        [
            struct.pack("<5Q", block, len(docs), len(ids), len(values), len(sums)),
            values[order].astype("<u4").tobytes(),
            np.array([d or 0 for d in docs], dtype="<i8").tobytes(),
            np.packbits(null).tobytes(),
            np.array(counts, dtype="<u8").tobytes(),
            (np.concatenate(sizes) if sizes else np.zeros(0)).astype("<u4").tobytes(),
            np.array(sums, dtype="<u4").tobytes(),
        ]
    )
    header = zlib.compress(header)
    return b"".join([MAGIC, struct.pack("<II", len(header), zlib.crc32(header)), header, *(d.tobytes() for d in digits)])


class TokenFile:
    """A file's documents and blocks; ids() decodes any run of blocks."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC or len(data) < 16:
            raise ValueError("not a token file")
        size, check = struct.unpack_from("<II", data, 8)
        stored = data[16 : 16 + size]
        if len(stored) != size or zlib.crc32(stored) != check:
            raise ValueError("damaged header")
        header = zlib.decompress(stored)
        self.block, n_docs, self.n_ids, n_values, n_blocks = struct.unpack_from("<5Q", header)
        at = 40

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(header, dtype=kind, count=n, offset=at)
            at += out.nbytes
            return out

        self.values = take("<u4", n_values)
        ids = take("<i8", n_docs)
        null = np.unpackbits(take("u1", -(-n_docs // 8)))[:n_docs]
        self.docs = [None if x else int(i) for i, x in zip(ids, null, strict=True)]
        self.counts = take("<u8", n_docs).astype(np.int64)
        self.sizes, self.sums = take("<u4", n_blocks).astype(np.int64), take("<u4", n_blocks)
        self.body = data[16 + size :]
        self.at = 2 * (np.cumsum(self.sizes) - self.sizes)

    def ids(self, first: int = 0, last: int | None = None) -> np.ndarray:
        """The ids of blocks first to last - 1."""
        last = len(self.sizes) if last is None else min(last, len(self.sizes))
        out = []
        for lo in range(first, last, LANES):
            hi = min(last, lo + LANES)
            for k in range(lo, hi):
                if zlib.crc32(self.body[self.at[k] : self.at[k] + 2 * self.sizes[k]]) != self.sums[k]:
                    raise ValueError(f"damaged block {k}")
            digits = np.frombuffer(self.body, "<u2", int(self.sizes[lo:hi].sum()), int(self.at[lo]))
            lengths = np.full(hi - lo, self.block, dtype=np.int64)
            if hi == len(self.sizes):
                lengths[-1] = self.n_ids - (hi - 1) * self.block
            out.append(self.values[context_mixing.decode(digits, self.sizes[lo:hi], lengths, len(self.values))])
        return np.concatenate(out) if out else np.zeros(0, dtype="<u4")


def _writer(folder: str, model: str, end_id: int | None, block: int, file_tokens: int):
    """For mapInArrow: (id, text), in order, to one manifest row per written file."""
    end = b"" if end_id is None else struct.pack("<I", end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, attempt = _encoder(model), TaskContext.get().partitionId(), uuid.uuid4().hex[:8]
        files, root = pyarrow.fs.FileSystem.from_uri(folder)
        docs: list = []
        ids: list[bytes] = []
        held = number = 0

        def write() -> pa.RecordBatch:
            nonlocal docs, ids, held, number
            name = f"{part:07d}-{number:05d}-{attempt}.ids"
            data = pack_file(docs, [len(x) // 4 for x in ids], np.frombuffer(b"".join(ids), dtype="<u4"), block)
            with files.open_output_stream(f"{root}/{name}") as out:
                out.write(data)
            row = pa.RecordBatch.from_pydict({"file": [name], "docs": [len(docs)], "ids": [held], "bytes": [len(data)]})
            docs, ids, held, number = [], [], 0, number + 1
            return row

        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            keys = batch.column(0).to_pylist()
            lo = 0
            while lo < len(texts):
                hi, size = lo, 0
                while hi < len(texts) and (hi == lo or size + len(texts[hi]) <= TEXT_BYTES):
                    size += len(texts[hi])
                    hi += 1
                for key, some in zip(keys[lo:hi], encoder.many(texts[lo:hi]), strict=True):
                    docs.append(key)
                    ids.append(some + end)
                    held += len(ids[-1]) // 4
                    if held >= file_tokens:
                        yield write()
                lo = hi
        if docs:
            yield write()

    return run


def encode_files(
    docs: DataFrame,
    model: str,
    folder: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int | None = END_ID,
    block_tokens: int = BLOCK_TOKENS,
    file_tokens: int = FILE_TOKENS,
) -> str:
    """Write the files and their manifest; returns the folder. model is the JSON text of a tokenizer."""
    folder = folder or shared_dir(docs.sparkSession, "tokens")
    files, root = pyarrow.fs.FileSystem.from_uri(folder)
    files.create_dir(f"{root}/files", recursive=True)
    order = [F.asc_nulls_first("id"), F.asc("row")]
    rows = docs.select(
        F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("row")
    )
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("id", "text")
    write = _writer(f"{folder}/files", model, end_id, block_tokens, file_tokens)
    ordered.mapInArrow(write, "file string, docs bigint, ids bigint, bytes bigint").write.parquet(f"{folder}/manifest")
    return folder


def _reader(folder: str):
    """For mapInArrow: (file, start) to (id, start, n, crc32) of each document of the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = pyarrow.fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with files.open_input_stream(f"{root}/{name}") as source:
                    found = TokenFile(source.read())
                ids = found.ids().tobytes()
                ends = np.cumsum(found.counts)
                begins = ends - found.counts
                sums = [zlib.crc32(ids[4 * b : 4 * e]) for b, e in zip(begins.tolist(), ends.tolist(), strict=True)]
                cols = [pa.array(found.docs, pa.int64()), pa.array(begins + start)]
                cols += [pa.array(found.counts), pa.array(sums, pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, names=["id", "start", "n", "sum"])

    return run


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """(file, docs, ids, bytes, start): the files in order, start the ids of all files before."""
    rows = spark.read.parquet(f"{folder}/manifest")
    # a row per file: the sums over the writing tasks go through one window, those inside a task through its own
    task = F.substring("file", 1, 7)
    tasks = rows.groupBy(task.alias("task")).agg(F.sum("ids").alias("of_task"))
    before = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    tasks = tasks.select("task", F.coalesce(F.sum("of_task").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("task").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("task", task).withColumn("_inside", F.coalesce(F.sum("ids").over(inside), F.lit(0)))
    return placed.join(tasks, "task").select(*rows.columns, (F.col("_before") + F.col("_inside")).alias("start"))


def decode_files(spark: SparkSession, folder: str, id_col: str = "doc_id") -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of every document, from the files alone."""
    listed = manifest(spark, folder).select("file", "start")
    # as many tasks as files: the rows are few and small, the work behind each is not
    spread = listed.repartition(max(1, spark.read.parquet(f"{folder}/manifest").count()))
    return spread.mapInArrow(_reader(f"{folder}/files"), "id bigint, start bigint, n bigint, sum bigint").select(
        F.col("id").alias(id_col), "start", F.col("n").alias("n_tokens"), F.col("sum").alias("ids_crc32")
    )


def read_ids(spark: SparkSession, folder: str, id_col: str = "doc_id") -> DataFrame:
    """(id, ids) of every document."""
    place = f"{folder}/files"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = pyarrow.fs.FileSystem.from_uri(place)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with files.open_input_stream(f"{root}/{name}") as source:
                    found = TokenFile(source.read())
                ends = np.append(0, np.cumsum(found.counts))
                ids = pa.LargeListArray.from_arrays(pa.array(ends), pa.array(found.ids().astype(np.int32)))
                for lo in range(0, len(found.docs), 1000):
                    part = ids.slice(lo, 1000).cast(pa.list_(pa.int32()))
                    yield pa.RecordBatch.from_arrays([pa.array(found.docs[lo : lo + 1000], pa.int64()), part], names=["id", "ids"])

    listed = spark.read.parquet(f"{folder}/manifest").select("file")
    return listed.repartition(max(1, listed.count())).mapInArrow(run, "id bigint, ids array<int>").withColumnRenamed("id", id_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = encode_files(spark.read.parquet(f"{sf_dir}/documents.parquet"), read_tokenizer(tokenizer_path()))
    return decode_files(spark, folder)
