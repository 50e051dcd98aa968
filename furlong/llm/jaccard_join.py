"""N-gram Jaccard self-join with Bayesian pruning of candidates, and classes of near copies.

1. Each text becomes a set of five-word shingles (a shorter text is one shingle) and 128 MinHash
   values of 16 bits. Texts with equal sets are one representative with a number of copies.
2. Representatives that agree on four consecutive values (one of 32 bands) share a bucket. At a
   similarity of 0.8 a pair shares none with a chance of 5e-8.
3. Pairs of a bucket are compared in blocks, 16 values at a time. A pair is dropped once the
   posterior probability that its similarity reaches the threshold is below the tolerance. The
   task returns a spanning forest of the pairs that are left, never the pairs.
4. Components of that forest are verified exactly, again in blocks: the sizes of all
   intersections of two blocks are one matrix product. Tasks return the number of links of each
   representative and a spanning forest of its links, whose components are the classes.

A bucket or component of n members is cut into ceil(n / block) parts, and each pair of parts is a
task row group of its own, so a hot one spreads over the cluster.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furlong.llm.words import Texts, grams, mix, texts_of
from furlong.session import shared_dir

NAME = "op2_jaccard_join"
SQL = None
SHINGLE, THRESHOLD, TOLERANCE = 5, 0.8, 1e-6
HASHES, BAND, STEP = 128, 4, 16
BUCKET_BLOCK, VERIFY_BLOCK = 256, 128
EDGES_A_TASK = 100_000


# ---- signatures


@cache
def _seeds() -> tuple[np.ndarray, np.ndarray]:
    k = np.arange(1, HASHES + 1, dtype=np.uint64)
    return mix(k) | np.uint64(1), mix(k + np.uint64(7919))


def shingles(texts: Texts, size: int = SHINGLE) -> list[np.ndarray]:
    """The sorted shingle hashes of each text; none for a text without a word."""
    words = texts.words()
    whole = grams(words.hash, size)
    out = []
    for a, b in zip(words.first[:-1], words.first[1:], strict=True):
        if b - a >= size:
            out.append(np.unique(whole[a : b - size + 1]))
        else:
            out.append(grams(words.hash[a:b], b - a) + np.uint64(b - a) if b > a else np.zeros(0, dtype=np.uint64))
    return out


def signature(shingle_set: np.ndarray) -> np.ndarray:
    """128 values of 16 bits; two sets agree on a value with a chance of their similarity, plus 1 in 65,536."""
    a, b = _seeds()
    least = np.full(HASHES, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(shingle_set), 4096):
        part = shingle_set[at : at + 4096]
        np.minimum(least, (part[None, :] * a[:, None] + b[:, None]).min(axis=1), out=least)
    return (mix(least) >> np.uint64(48)).astype(np.uint16)


def set_key(shingle_set: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set."""
    salted = mix(shingle_set + np.uint64(0x5BD1E995))
    first, second = mix(shingle_set).sum(dtype=np.uint64), np.bitwise_xor.reduce(salted) + salted.sum(dtype=np.uint64)
    return int(np.int64(first.view(np.int64))), int(np.int64(second.view(np.int64)))


def signatures(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(_id, _text, k1, k2, n, sig): hash of the text, set key, size and signature of each row; k1 is null
    for a text without a word."""
    ids = docs.select(id_col).schema[0].dataType.simpleString()

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in texts_of(batch.column(1)):
                sets = shingles(texts)
                keys = [set_key(s) if len(s) else (None, None) for s in sets]
                cols = [
                    batch.column(0).slice(texts.rows.start, len(texts)),
                    batch.column(2).slice(texts.rows.start, len(texts)),
                    pa.array([k[0] for k in keys], pa.int64()),
                    pa.array([k[1] for k in keys], pa.int64()),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([signature(s).tobytes() if len(s) else None for s in sets], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(cols, names=["_id", "_text", "k1", "k2", "n", "sig"])

    rows = docs.select(id_col, text_col, F.xxhash64(text_col))
    return rows.mapInArrow(sign, f"_id {ids}, _text bigint, k1 bigint, k2 bigint, n bigint, sig binary")


# ---- pruning


@cache
def least_matches(threshold: float, tolerance: float) -> tuple[int, ...]:
    """For 16, 32, ... values compared: the fewest matches with which a pair goes on.

    The prior of the similarity is uniform, so after m matches of n the posterior is
    Beta(m + 1, n - m + 1); its mass above the threshold is summed on a fine grid.
    """
    grid = (np.arange(20_000) + 0.5) / 20_000
    out = []
    for n in range(STEP, HASHES + 1, STEP):
        for m in range(n + 1):
            logs = m * np.log(grid) + (n - m) * np.log1p(-grid)
            mass = np.exp(logs - logs.max())
            if mass[grid >= threshold].sum() / mass.sum() >= tolerance:
                break
        out.append(m)
    return tuple(out)


def surviving(a: np.ndarray, b: np.ndarray, least: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row of a, row of b) whose signatures pass every step."""
    matches = np.zeros((len(a), len(b)), dtype=np.int16)
    for j in range(STEP):
        matches += a[:, None, j] == b[None, :, j]
    i, j = np.nonzero(matches >= least[0])
    count = matches[i, j].astype(np.int64)
    for step in range(1, len(least)):
        if not len(i):
            break
        at = slice(step * STEP, (step + 1) * STEP)
        count += (a[i, at] == b[j, at]).sum(axis=1)
        keep = count >= least[step]
        i, j, count = i[keep], j[keep], count[keep]
    return i, j


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n places, the least place of its component under the links (i, j)."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


# ---- blocks


def _in_blocks(rows: DataFrame, group: list[str], size_col: str, block: int, member: str) -> DataFrame:
    """Each row once for every pair of parts that its part is in: columns lo, hi, part."""
    parts = F.ceil(F.col(size_col) / block).cast("int")
    part = F.pmod(F.xxhash64(member, *group), parts).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))
    return (
        rows.withColumn("_parts", parts)
        .withColumn("part", part)
        .withColumn("_other", other)
        .withColumn("lo", F.least("part", "_other"))
        .withColumn("hi", F.greatest("part", "_other"))
        .drop("_parts", "_other")
    )


def candidate_edges(reps: DataFrame, threshold: float, tolerance: float, block: int = BUCKET_BLOCK) -> DataFrame:
    """(a, b): spanning forests of the pairs that share a bucket and survive the pruning."""
    least = least_matches(threshold, tolerance)

    def bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=np.uint16).reshape(-1, HASHES)
            keys = np.ascontiguousarray(sig).view(np.int64)
            n = keys.shape[1]
            # the band goes into the key, so a bucket is one 64-bit value
            keys = mix(mix(keys.view(np.uint64)) + np.arange(1, n + 1, dtype=np.uint64)[None, :]).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(batch.column(0).to_numpy(), n)), pa.array(keys.ravel())], names=["rep", "bucket"]
            )

    def edges_of(rep: np.ndarray, left: np.ndarray, sig: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The edges of the groups that begin at the places at (the last place is the end)."""
        a, b = [], []
        two = at[:-1][np.diff(at) == 2]  # most groups are one pair
        keep = two
        count = np.zeros(len(two), dtype=np.int64)
        for step, fewest in enumerate(least):
            part = slice(step * STEP, (step + 1) * STEP)
            count = count + (sig[keep, part] == sig[keep + 1, part]).sum(axis=1)
            good = count >= fewest
            keep, count = keep[good], count[good]
        a.append(np.maximum(rep[keep], rep[keep + 1]))
        b.append(np.minimum(rep[keep], rep[keep + 1]))
        for lo, hi in zip(at[:-1][np.diff(at) > 2], at[1:][np.diff(at) > 2], strict=True):
            order = lo + np.argsort(~left[lo:hi], kind="stable")
            own, k = sig[order], int(left[lo:hi].sum())
            alone = k == hi - lo
            i, j = surviving(own[:k], own if alone else own[k:], least)
            root = forest(hi - lo, i, j if alone else j + k)
            some = np.flatnonzero(root != np.arange(hi - lo))
            a.append(rep[order[some]])
            b.append(rep[order[root[some]]])
        return np.concatenate(a), np.concatenate(b)

    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by group; the last group of a batch waits for the next one."""
        rest: pa.Table | None = None
        for batch in itertools.chain(batches, [None]):
            table = rest if batch is None else pa.Table.from_batches([batch])
            if batch is not None and rest is not None:
                table = pa.concat_tables([rest, table])
            if table is None or not len(table):
                continue
            bucket, lo, hi, part, rep = (table.column(k).to_numpy() for k in range(5))
            new = (bucket[1:] != bucket[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])
            at = np.concatenate([[0], np.flatnonzero(new) + 1, [len(table)]])
            if batch is not None:
                rest = table.slice(at[-2])
                at = at[:-1]
            if len(at) < 2:
                continue
            sig = np.frombuffer(b"".join(table.column(5).to_pylist()), dtype=np.uint16).reshape(-1, HASHES)
            a, b = edges_of(rep, part == lo, sig, at)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    members = reps.select("rep", "sig").mapInArrow(bands, "rep bigint, bucket bigint")
    shared = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    rows = members.join(shared, "bucket").join(reps.select("rep", "sig"), "rep")
    rows = _in_blocks(rows, ["bucket"], "size", block, "rep")
    rows = rows.select("bucket", "lo", "hi", "part", "rep", "sig").repartition("bucket", "lo", "hi")
    rows = rows.sortWithinPartitions("bucket", "lo", "hi")
    return rows.mapInArrow(prune, "a bigint, b bigint").distinct()


def components(edges: DataFrame, purpose: str) -> DataFrame:
    """(member, root): the least member of each component, for all members of an edge.

    Rounds of the two star steps: every member links its larger neighbours to its least one, then
    its smaller ones. A hub's neighbours are never gathered: the minimum is joined back, and as both
    sides of that join are read from the shared folder, adaptive execution splits a hub's rows. Rounds
    end when no edge changes.
    """
    spark = edges.sparkSession
    folder = shared_dir(spark, purpose)

    tasks = None  # of a round

    def kept(df: DataFrame, name: str) -> DataFrame:
        (df.coalesce(tasks) if tasks else df).write.parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    edges = kept(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "0")
    seen, step = None, 0
    while seen != (now := state(edges)):
        seen, step, tasks = now, step + 1, 1 + now[0] // EDGES_A_TASK
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = kept(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low")), f"{step}c")
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        large = kept(large.filter("a <> b").distinct(), f"{step}a")
        low = kept(large.groupBy("a").agg(F.min("b").alias("low")), f"{step}d")
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).filter("a <> b")
        edges = kept(small.union(low.select("a", F.col("low").alias("b"))).distinct(), f"{step}b")
    return edges.select(F.col("a").alias("member"), F.col("b").alias("root")).union(
        edges.select(F.col("b").alias("member"), F.col("b").alias("root")).distinct()
    )


def verified(texts: DataFrame, threshold: float, block: int = VERIFY_BLOCK) -> DataFrame:
    """Exact links inside the components: (a, b, links), where b is a's least linked member of a block
    pair (or a) and links the number of input rows that a is linked to there.

    texts: (rep, root, size, copies, text), one row per representative in a component.
    """

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in texts_of(batch.column(4)):
                blobs = pa.array([s.tobytes() for s in shingles(texts)], pa.binary())
                at, n = texts.rows.start, len(texts)
                cols = [*(batch.column(k).slice(at, n) for k in range(4)), blobs]
                yield pa.RecordBatch.from_arrays(cols, names=["rep", "root", "size", "copies", "set"])

    def check(group: pd.DataFrame) -> pd.DataFrame:
        left = (group["part"] == group["lo"]).to_numpy()
        order = np.concatenate([np.flatnonzero(left), np.flatnonzero(~left)])
        members, copies = group["rep"].to_numpy()[order], group["copies"].to_numpy()[order]
        own = [np.frombuffer(group["set"].iat[k], dtype=np.uint64) for k in order]
        size = np.array([len(s) for s in own], dtype=np.float64)
        k = int(left.sum()) if not left.all() else len(own)
        shared = _overlaps(own, k)
        rows, cols = (slice(0, k), slice(k, None)) if k < len(own) else (slice(None), slice(None))
        either = size[rows][:, None] + size[cols][None, :] - shared
        linked = shared >= threshold * either - 1e-9
        if k == len(own):
            np.fill_diagonal(linked, False)
        i, j = np.nonzero(linked)
        links = np.zeros(len(own), dtype=np.int64)
        links[rows] += linked @ copies[cols]
        if k < len(own):
            links[cols] += linked.T @ copies[rows]
        root = forest(len(own), i, j + (k if k < len(own) else 0))
        return pd.DataFrame({"a": members, "b": members[root], "links": links})[links > 0]

    rows = texts.select("rep", "root", "size", "copies", "text").mapInArrow(
        sets, "rep bigint, root bigint, size bigint, copies bigint, set binary"
    )
    rows = _in_blocks(rows, ["root"], "size", block, "rep")
    return rows.groupBy("root", "lo", "hi").applyInPandas(check, "a bigint, b bigint, links bigint")


def _overlaps(own: list[np.ndarray], k: int) -> np.ndarray:
    """Sizes of the intersections of the first k sets with the others (with each other if k is all)."""
    names, place = np.unique(np.concatenate(own), return_inverse=True)
    row = np.repeat(np.arange(len(own)), [len(s) for s in own])
    order = np.argsort(place, kind="stable")
    place, row = place[order], row[order]
    total = np.zeros((k, len(own) - k if k < len(own) else k), dtype=np.float32)
    width = 8192
    for at in range(0, len(names), width):
        a, b = np.searchsorted(place, [at, at + width])
        ones = np.zeros((len(own), min(width, len(names) - at)), dtype=np.float32)
        ones[row[a:b], place[a:b] - at] = 1
        total += ones[:k] @ (ones[k:] if k < len(own) else ones).T
    return total


def classified(docs: DataFrame, id_col: str, text_col: str, threshold: float, tolerance: float) -> DataFrame:
    """(_id, _text, head, links, copies), one row per row of docs: id and hash of the text, and of its class the
    id and hash of the first row (no_id, _id, _text; null without a word), links and copies as in near_copies."""
    spark = docs.sparkSession
    folder = shared_dir(spark, "copies")
    signatures(docs, id_col, text_col).write.parquet(f"{folder}/signed")
    signed = spark.read.parquet(f"{folder}/signed")
    row = F.struct(F.col("_id").isNull().alias("no_id"), "_id", "_text")
    # the members of the join are the distinct sets, numbered; an id may have several of them
    copies = (
        signed.filter("k1 IS NOT NULL")
        .groupBy("k1", "k2")
        .agg(F.min(row).alias("first"), F.count(F.lit(1)).alias("copies"), F.max("sig").alias("sig"))
        .withColumn("rep", F.monotonically_increasing_id())
    )
    copies.write.parquet(f"{folder}/copies")
    copies = spark.read.parquet(f"{folder}/copies")
    near = components(candidate_edges(copies.select("rep", "sig"), threshold, tolerance), "candidates")
    sizes = near.groupBy("root").agg(F.count(F.lit(1)).alias("size"))
    near = near.join(sizes, "root").select(F.col("member").alias("rep"), "root", "size")
    near = near.join(copies.select("rep", "copies", "first._id", "first._text"), "rep")
    text = docs.select(F.col(id_col).alias("_own"), F.xxhash64(text_col).alias("_hash"), F.col(text_col).alias("text"))
    near = near.join(text, near["_id"].eqNullSafe(text["_own"]) & (near["_text"] == text["_hash"]))
    near = near.groupBy("rep", "root", "size", "copies").agg(F.max("text").alias("text"))
    verified(near, threshold).write.parquet(f"{folder}/links")
    links = spark.read.parquet(f"{folder}/links")
    classes = components(links.select("a", "b"), "classes").select(F.col("member").alias("rep"), "root")
    heads = classes.join(copies.select("rep", "first"), "rep").groupBy("root").agg(F.min("first").alias("head"))
    per_rep = links.groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    linked = per_rep.join(classes, "rep").join(heads, "root").select("rep", "links", "head")
    known = copies.join(linked, "rep", "left").select(
        "k1", "k2", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("head", "first").alias("head")
    )
    columns = ["_id", "_text", "head", "links", "copies"]
    placed = signed.filter("k1 IS NOT NULL").join(known, ["k1", "k2"]).select(*columns)
    wordless = signed.filter("k1 IS NULL").select(
        "_id", "_text", F.lit(None).cast(known.schema["head"].dataType).alias("head"),
        F.lit(0).cast("bigint").alias("links"), F.lit(1).cast("bigint").alias("copies"),
    )
    return placed.unionByName(wordless)


def near_copies(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    threshold: float = THRESHOLD,
    tolerance: float = TOLERANCE,
) -> DataFrame:
    """(id, class_id, n_links, n_copies): one row per row of docs. The id must be a bigint.

    Two rows are linked if the Jaccard similarity of their shingle sets is threshold or more; equal
    sets are always linked. class_id is the least id that links lead to, n_links the number of other
    rows linked to this one, n_copies the number of rows with the same set, itself included.

    A null or empty text, or one of spaces only, has no shingles, no link, no copies and its own id
    as class. Repeated rows are copies of each other; different texts under one id are rows of their own,
    each in the class of its text. So are rows with a null id; a class in which no row has an id is null.
    Other columns are not read.
    """
    found = classified(docs, id_col, text_col, threshold, tolerance)
    return found.select(
        F.col("_id").alias(id_col),
        F.when(F.col("head").isNull(), F.col("_id")).otherwise(F.col("head._id")).alias("class_id"),
        (F.col("copies") - 1 + F.col("links")).alias("n_links"),
        F.col("copies").alias("n_copies"),
    )


def one_per_class(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row of docs for each class, all columns as they are: the one with the least id (null last), of several
    texts under that id the one with the least hash, of equal rows any. Rows without a word all stay.
    """
    found = classified(docs, id_col, text_col, threshold, TOLERANCE)
    mine = F.struct(F.col("_id").isNull().alias("no_id"), "_id", "_text")
    gone = found.filter(F.col("head").isNotNull() & ~mine.eqNullSafe(F.col("head")))
    gone = gone.select(F.col("_id").alias("_own"), F.col("_text").alias("_hash")).distinct()
    rows = docs.withColumn("_of_text", F.xxhash64(text_col))

    def same(other: DataFrame):
        return rows[id_col].eqNullSafe(other["_own"]) & (rows["_of_text"] == other["_hash"])

    rows = rows.join(gone, same(gone), "left_anti")
    worded = rows.filter(F.col(text_col).rlike(r"[^\x20\x09-\x0D]"))
    often = worded.groupBy(F.col(id_col).alias("_own"), F.col("_of_text").alias("_hash")).agg(F.count(F.lit(1)).alias("_n"))
    often = often.filter("_n > 1").select("_own", "_hash")
    once = rows.join(often, same(often), "left_semi").dropDuplicates([id_col, "_of_text"])
    return rows.join(often, same(often), "left_anti").unionByName(once).select(*[F.col(f"`{c}`") for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies(spark.read.parquet(f"{sf_dir}/documents.parquet"))
