"""Source divergence audit: how the words of each source of a language differ from the other sources.

Strings are materialised late. A task counts the terms of its documents in dictionaries, which
compare whole strings, and writes one row per (lang, term): the string, its documents and its
occurrences in each source. What is summed over tasks is shuffled by a 64-bit digest of the term:

1. Per (lang, digest), the least and the greatest string. Where these two differ, several terms
   share the digest; such terms are numbered (``part`` 1, 2, ...; 0 for a digest with one term).
2. Per (lang, digest, part), documents and occurrences per source, merged in sorted order. Strings
   take part in this only for shared digests. Terms in too few documents go.
3. One pass over the kept terms, each with its whole vector of sources, adds up the pairs of sources
   and collects the most divergent terms of each source; a task holds sums and lists, no terms.
   What a term adds against a source without it depends on its count only, so that comes from the
   histogram of counts, and the pass forms pairs only of sources that both have the term.
4. For the terms of the lists the strings are joined back.

All arithmetic is on integers. Null text, lang and source are read as ''. Repeated rows and ids
count as documents of their own; the id is not read. A text without a letter has no term; a
language without a kept term has its groups all the same (pairs of value 0, no terms). Ties have
the rank of the UTF-8 order of their item. Other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from furlong.llm.words import hash_bytes
from furlong.session import shared_dir

NAME = "op13_source_divergence"
TERM = re.compile(rb"[a-z\x80-\xff]+")
SCALE = 1_000_000_000
HELD = 600_000  # (source, term) counts that a task holds before it writes them
SLICE = 1 << 22  # bytes of a text that are cut into terms at once
GROUPS_SENT = 100_000  # most groups whose totals go to the tasks as an array; beyond, they are joined
SUMS_HELD = 1 << 20  # sums of pairs that a task holds before it hands them on
PARTS = "lang string, term binary, docs bigint, sources array<bigint>, ns array<bigint>"
MERGED = "lang string, digest bigint, part int, docs bigint, sources array<bigint>, ns array<bigint>"


def slices(text: bytes) -> Iterator[bytes]:
    """The text in pieces of about SLICE bytes, cut only where a term ends."""
    at = 0
    while at < len(text):
        end = at + SLICE
        while end < len(text) and (text[end - 1 : end].isalpha() or text[end - 1] >= 0x80):
            end += 1
        yield text[at:end]
        at = end


def source_number(source: str) -> int:
    """A 63-bit number of the source's name; source_divergence() makes sure that no two names share one."""
    return int(hash_bytes([source.encode()])[0] >> np.uint64(1))


def lists(flat: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.astype(np.int64)))


def count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow: (text, lang, source) to rows of PARTS, summed over about HELD counts."""
    held: dict[str, tuple[dict[int, Counter], Counter]] = {}
    numbers: dict[str, int] = {}

    def rows() -> Iterator[pa.RecordBatch]:
        for lang, (by_source, docs) in held.items():
            place = {t: k for k, t in enumerate(docs)}
            row = [np.fromiter(map(place.__getitem__, c), np.int64, len(c)) for c in by_source.values()]
            n = [np.fromiter(c.values(), np.int64, len(c)) for c in by_source.values()]
            source = np.repeat(np.fromiter(by_source, np.int64, len(by_source)), [len(x) for x in row])
            if not place:
                continue
            row, n = np.concatenate(row), np.concatenate(n)
            order = np.argsort(row, kind="stable")
            sizes = np.bincount(row, minlength=len(place))
            table = pa.RecordBatch.from_arrays(
                [
                    pa.array([lang] * len(place), pa.string()),
                    pa.array(list(place), pa.binary()),
                    pa.array(np.fromiter(docs.values(), np.int64, len(docs))),
                    lists(source[order], sizes),
                    lists(n[order], sizes),
                ],
                names=["lang", "term", "docs", "sources", "ns"],
            )
            for k in range(0, len(place), 50_000):
                yield table.slice(k, 50_000)

    size = 0
    for batch in batches:
        texts = batch.column(0).cast(pa.large_binary())
        langs, sources = batch.column(1).to_pylist(), batch.column(2).to_pylist()
        for k, (lang, source) in enumerate(zip(langs, sources, strict=True)):
            if source not in numbers:
                numbers[source] = source_number(source)
            by_source, docs = held.setdefault(lang, ({}, Counter()))
            times = by_source.setdefault(numbers[source], Counter())
            seen: set[bytes] = set()
            size -= len(times)
            for piece in slices(texts[k].as_py().lower()):
                terms = TERM.findall(piece)
                times.update(terms)
                seen.update(terms)
            docs.update(seen)
            size += len(times)
            if size > HELD:
                yield from rows()
                held, size = {}, 0
    yield from rows()


def merge_sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow: rows of MERGED in order of (lang, digest, part) to one row for each of these keys."""

    def summed(rows: pa.RecordBatch) -> pa.RecordBatch:
        lang, digest, part, docs, sources, ns = rows.columns
        code = lang.dictionary_encode()
        keys = [x.to_numpy(zero_copy_only=False) for x in (code.indices, digest, part)]
        new = np.concatenate([[True], np.any([k[1:] != k[:-1] for k in keys], axis=0)])
        first = np.flatnonzero(new)
        size = np.diff(sources.offsets.to_numpy())
        owner = np.repeat(np.cumsum(new) - 1, size)
        source, n = sources.flatten().to_numpy(), ns.flatten().to_numpy()
        order = np.lexsort((source, owner))
        owner, source, n = owner[order], source[order], n[order]
        edge = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (source[1:] != source[:-1])]))
        sizes = np.bincount(owner[edge], minlength=len(first))
        out = [lang.take(first), digest.take(first), part.take(first)]
        out += [pa.array(np.add.reduceat(docs.to_numpy(), first))]
        out += [lists(source[edge], sizes), lists(np.add.reduceat(n, edge), sizes)]
        return pa.RecordBatch.from_arrays(out, names=rows.schema.names)

    rest: pa.RecordBatch | None = None  # the last key, which may go on; always one row
    for batch in batches:
        if not batch.num_rows:
            continue
        if rest is not None:
            batch = pa.Table.from_batches([rest, batch.cast(rest.schema)]).combine_chunks().to_batches()[0]
        got = summed(batch)
        if got.num_rows > 1:
            yield got.slice(0, got.num_rows - 1)
        rest = got.slice(got.num_rows - 1).take(pa.array([0]))
    if rest is not None:
        yield rest


def share(count: Column, total: Column, terms: Column) -> Column:
    """p = 1 + floor(SCALE * (count + 1) / (total + terms)), exact for any count."""
    small = F.when(count < 9_000_000_000, count).otherwise(0)
    over = count >= 9_000_000_000
    n, d = count.cast("decimal(20,0)") + 1, (total + terms).cast("decimal(20,0)")
    large = F.call_function("div", F.when(over, n * F.lit(SCALE).cast("decimal(10,0)")), d)
    return 1 + F.when(over, large).otherwise(F.call_function("div", (small + 1) * F.lit(SCALE), total + terms))


def shares(count: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """share() of arrays; whole is total + terms."""
    out = 1 + (np.minimum(count, 9_000_000_000) + 1) * SCALE // whole
    for k in np.flatnonzero(count >= 9_000_000_000):
        out[k] = 1 + (int(count[k]) + 1) * SCALE // int(whole[k])
    return out


def distance(p, q):
    """f = floor((p - q) ** 2 / q); both are below 2 ** 31, so the square is a long."""
    if isinstance(p, Column):
        return F.call_function("div", (p - q) * (p - q), q)
    return (p - q) * (p - q) // q


def merged_terms(parts: DataFrame, min_docs: int, folder: str) -> tuple[DataFrame, DataFrame]:
    """(kept terms as rows of MERGED, (lang, digest, part, term) of the shared digests); both written."""
    spark = parts.sparkSession
    # one sort serves both halves of the aggregate: a task has each term about once, so nothing combines before
    strings = parts.select("lang", "digest", "term").repartition("lang", "digest")
    shared = strings.groupBy("lang", "digest").agg(F.min("term").alias("least"), F.max("term").alias("most"))
    shared = shared.filter(F.col("least") != F.col("most")).select("lang", "digest")
    number = Window.partitionBy("lang", "digest").orderBy("term")
    shared.write.parquet(f"{folder}/shared")
    shared = spark.read.parquet(f"{folder}/shared")
    named = parts.join(shared, ["lang", "digest"]).select("lang", "digest", "term").distinct()
    named.withColumn("part", F.row_number().over(number)).write.parquet(f"{folder}/named")
    named = spark.read.parquet(f"{folder}/named")
    columns = ["lang", "digest", "part", "docs", "sources", "ns"]
    alone = parts.join(shared, ["lang", "digest"], "left_anti").withColumn("part", F.lit(0)).select(*columns)
    split = parts.join(named, ["lang", "digest", "term"]).select(*columns)
    (
        alone.unionByName(split)
        .repartition("lang", "digest", "part")
        .sortWithinPartitions("lang", "digest", "part")
        .mapInArrow(merge_sorted, MERGED)
        .filter(F.col("docs") >= min_docs)
        .write.parquet(f"{folder}/kept")
    )
    return spark.read.schema(MERGED).parquet(f"{folder}/kept"), named


def audit(totals: dict[str, tuple[np.ndarray, np.ndarray]] | None, top: int):
    """For mapInArrow: kept terms to sums of pairs and lists of terms.

    Rows are (lang, digest, part, occurrences, kept terms and occurrences of the language, sources, ns
    and, if totals is None, the total of each source); totals has numbers and totals of a language's
    sources. A row without digest is the sum of a pair over terms that both sources have: f(s, t) -
    f(s, absent in t) - f(absent in s, t) + f(absent in both). A row with one is a term of the first
    source's list: the task's top values, with all that equal the last one.
    """

    def compact(held: list[list[np.ndarray]]) -> list[np.ndarray]:
        s, t, v = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((t, s))
        s, t, v = s[order], t[order], v[order]
        edge = np.flatnonzero(np.concatenate([[True], (s[1:] != s[:-1]) | (t[1:] != t[:-1])]))
        return [s[edge], t[edge], np.add.reduceat(v, edge)]

    def best(held: list[list[np.ndarray]]) -> list[np.ndarray]:
        source, value, digest, part = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((-value, source))
        source, value, digest, part = source[order], value[order], digest[order], part[order]
        lead = np.flatnonzero(np.concatenate([[True], source[1:] != source[:-1]]))
        size = np.diff(np.append(lead, len(source)))
        last = value[lead + np.minimum(size, top) - 1]
        keep = value >= np.repeat(last, size)
        return [source[keep], value[keep], digest[keep], part[keep]]

    def common(first: np.ndarray, size: np.ndarray, who, p, none) -> Iterator[list[np.ndarray]]:
        """Pairs of the sources of each term; a slice of a term's left sides at a time."""
        left_of = np.arange(int(size.sum())) + np.repeat(first - np.concatenate([[0], np.cumsum(size)[:-1]]), size)
        many = np.repeat(size, size)  # partners of each left side
        lead = np.repeat(first, size)
        done, cost = 0, np.cumsum(many)
        while done < len(left_of):
            past = cost[done - 1] if done else 0
            upto = max(done + 1, int(np.searchsorted(cost, past + (1 << 18), side="right")))
            n = many[done:upto]
            a = np.repeat(left_of[done:upto], n)
            b = np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lead[done:upto], n)
            apart = a != b
            a, b = a[apart], b[apart]
            value = distance(p[a], p[b]) - distance(p[a], none[b]) - distance(none[a], p[b]) + distance(none[a], none[b])
            if len(a):
                yield compact([[who[a], who[b], value]])
            done = upto

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, list] = {}
        tops: dict[str, list] = {}

        def pairs_out(lang: str, rows: list[np.ndarray]) -> pa.RecordBatch:
            n = len(rows[0])
            return pa.RecordBatch.from_arrays(
                [pa.array([lang] * n, pa.string()), *(pa.array(x) for x in rows), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32())],
                names=["lang", "s", "t", "value", "digest", "part"],
            )

        for batch in batches:
            langs = batch.column(0).dictionary_encode()
            code = langs.indices.to_numpy()
            digest, part, n, terms, total = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(1, 6))
            for c, lang in enumerate(langs.dictionary.to_pylist()):
                rows = np.flatnonzero(code == c)
                flat = batch.column(6).take(pa.array(rows))
                size = np.diff(flat.offsets.to_numpy())
                who = flat.flatten().to_numpy()
                count = batch.column(7).take(pa.array(rows)).flatten().to_numpy()
                if totals is None:
                    mine = batch.column(8).take(pa.array(rows)).flatten().to_numpy()
                else:
                    known, of = totals[lang]
                    mine = of[np.searchsorted(known, who)]
                whole = mine + np.repeat(terms[rows], size)
                p, none = shares(count, whole), 1 + SCALE // whole
                q = np.repeat(shares(n[rows], total[rows] + terms[rows]), size)
                up = np.flatnonzero(p > q)
                if len(up):
                    row = np.repeat(rows, size)[up]
                    held = tops.setdefault(lang, [])
                    held.append([who[up], distance(p[up], q[up]), digest[row], part[row]])
                    if sum(len(x[0]) for x in held) > SUMS_HELD:
                        tops[lang] = [best(held)]
                held = sums.setdefault(lang, [])
                held.extend(common(np.cumsum(size) - size, size, who, p, none))
                if sum(len(x[0]) for x in held) > SUMS_HELD:
                    held[:] = [compact(held)]
                    if len(held[0][0]) > SUMS_HELD // 2:
                        yield pairs_out(lang, held.pop())
        for lang, held in sums.items():
            if held:
                yield pairs_out(lang, compact(held))
        for lang, held in tops.items():
            source, value, digest, part = best(held)
            names = [pa.array([lang] * len(source), pa.string()), pa.array(source), pa.nulls(len(source), pa.int64())]
            yield pa.RecordBatch.from_arrays(
                [*names, pa.array(value), pa.array(digest), pa.array(part)], names=["lang", "s", "t", "value", "digest", "part"]
            )

    return run


def pair_values(often: DataFrame, common: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value) of each source with each other source of its language."""
    me = groups.select("lang", "source", "id", "total", "terms", "own", "none")
    s = me.select("lang", *[F.col(c).alias(f"s_{c}") for c in me.columns[1:]])
    t = me.select("lang", *[F.col(c).alias(f"t_{c}") for c in me.columns[1:]])
    # a term of one source against its absence in another: by the term's p
    often = often.join(me, ["lang", "id"]).withColumn("p", share(F.col("n"), F.col("total"), F.col("terms")))
    often = often.groupBy("lang", "id", "p").agg(F.sum("times").alias("times"))
    other = me.select("lang", F.col("id").alias("other"), F.col("none").alias("absent"))
    alone = (
        often.join(other, "lang")
        .filter("id <> other")
        .groupBy("lang", "id", "other")
        .agg(
            F.sum(F.col("times") * distance(F.col("p"), F.col("absent"))).alias("as_s"),
            F.sum(F.col("times") * distance(F.col("absent"), F.col("p"))).alias("as_t"),
        )
    )
    both = common.groupBy("lang", F.col("s").alias("s_id"), F.col("t").alias("t_id")).agg(F.sum("value").alias("both"))
    first = alone.select("lang", F.col("id").alias("s_id"), F.col("other").alias("t_id"), "as_s")
    second = alone.select("lang", F.col("other").alias("s_id"), F.col("id").alias("t_id"), "as_t")
    key = ["lang", "s_id", "t_id"]
    sums = s.join(t, "lang").filter("s_id <> t_id")
    sums = sums.join(first, key, "left").join(second, key, "left").join(both, key, "left").na.fill(0)
    # own terms of either, less those of both, leave the terms that neither has
    neither = (F.col("s_terms") - F.col("s_own") - F.col("t_own")) * distance(F.col("s_none"), F.col("t_none"))
    return sums.select(
        "lang",
        F.col("s_source").alias("source"),
        F.col("t_source").alias("item"),
        (F.col("as_s") + F.col("as_t") + F.col("both") + neither).cast("bigint").alias("value"),
    )


def occurrences(kept: DataFrame) -> DataFrame:
    """(lang, digest, part, id, n): a row for each kept term and source with it."""
    both = F.explode(F.arrays_zip("sources", "ns")).alias("_x")
    return kept.select("lang", "digest", "part", both).select(
        "lang", "digest", "part", F.col("_x.sources").alias("id"), F.col("_x.ns").alias("n")
    )


def count_histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow: (lang, sources, ns) to (lang, id, n, times): how many terms a source has n times."""
    held: dict[str, Counter] = {}
    for batch in batches:
        langs = batch.column(0).dictionary_encode()
        code = langs.indices.to_numpy()
        for c, lang in enumerate(langs.dictionary.to_pylist()):
            rows = pa.array(np.flatnonzero(code == c))
            cells = np.stack([batch.column(k).take(rows).flatten().to_numpy() for k in (1, 2)], axis=1)
            cells = cells[np.lexsort((cells[:, 1], cells[:, 0]))]
            edge = np.flatnonzero(np.concatenate([[True], (cells[1:] != cells[:-1]).any(axis=1)]))
            times = np.diff(np.append(edge, len(cells))).tolist()
            held.setdefault(lang, Counter()).update(dict(zip(map(tuple, cells[edge].tolist()), times, strict=True)))
        if sum(map(len, held.values())) > SUMS_HELD:
            yield from _histogram_rows(held)
            held = {}
    yield from _histogram_rows(held)


def _histogram_rows(held: dict[str, Counter]) -> Iterator[pa.RecordBatch]:
    for lang, cells in held.items():
        cols = [[lang] * len(cells), [k[0] for k in cells], [k[1] for k in cells], list(cells.values())]
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["lang", "id", "n", "times"]
        )


def source_divergence(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
    min_docs: int = 3,
    top: int = 200,
    digest_bits: int = 64,
    groups_sent: int = GROUPS_SENT,
) -> DataFrame:
    """(lang, source, part, item, value, rank) as described above; part is "pair" or "term".

    digest_bits and groups_sent never change the result; tests make them small to force shared digests
    and the way without sent totals.
    """
    spark, folder = docs.sparkSession, shared_dir(docs.sparkSession, "divergence")
    read = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(n) for c, n in
                         ((text_col, "text"), (lang_col, "lang"), (source_col, "source"))])
    read.mapInArrow(count_terms, PARTS).write.parquet(f"{folder}/parts")
    digest = F.shiftrightunsigned(F.xxhash64("term"), 64 - digest_bits) if digest_bits < 64 else F.xxhash64("term")
    parts = spark.read.schema(PARTS).parquet(f"{folder}/parts").withColumn("digest", digest)
    kept, named = merged_terms(parts, min_docs, folder)

    often = kept.select("lang", "sources", "ns").mapInArrow(count_histogram, "lang string, id bigint, n bigint, times bigint")
    often.groupBy("lang", "id", "n").agg(F.sum("times").alias("times")).write.parquet(f"{folder}/often")
    often = spark.read.parquet(f"{folder}/often")
    own = often.groupBy("lang", "id").agg(F.sum(F.col("n") * F.col("times")).alias("total"), F.sum("times").alias("own"))
    size = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"))
    found = read.select("lang", "source").distinct()

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number = pa.array([source_number(x) for x in batch.column(1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, number], names=["lang", "source", "id"])

    groups = (
        found.mapInArrow(numbered, "lang string, source string, id bigint")
        .join(own, ["lang", "id"], "left")
        .join(size, "lang", "left")
        .na.fill(0, ["total", "own", "terms"])
        .withColumn("none", F.when(F.col("terms") > 0, share(F.lit(0), F.col("total"), F.col("terms"))).otherwise(1))
    )
    groups.write.parquet(f"{folder}/groups")
    groups = spark.read.parquet(f"{folder}/groups")
    n_groups = groups.count()
    if groups.select("lang", "id").distinct().count() < n_groups:
        raise ValueError("two sources of a language share a 63-bit number")

    langs = groups.groupBy("lang").agg(F.max("terms").alias("terms"), F.sum("total").alias("lang_total"))
    whole = F.aggregate("ns", F.lit(0).cast("bigint"), lambda a, x: a + x)
    terms = kept.join(langs, "lang").select(
        "lang", "digest", "part", whole.alias("n"), "terms", "lang_total", "sources", "ns"
    )
    totals = None
    if n_groups <= groups_sent:
        totals = {}
        for r in groups.orderBy("lang", "id").select("lang", "id", "total").collect():  # at most groups_sent rows
            totals.setdefault(r.lang, []).append((r.id, r.total))
        totals = {k: tuple(np.array(x, dtype=np.int64) for x in zip(*v, strict=True)) for k, v in totals.items()}
    else:
        key = ["lang", "digest", "part"]
        cell = F.sort_array(F.collect_list(F.struct("id", "n", "total")))
        again = occurrences(kept).join(groups.select("lang", "id", "total"), ["lang", "id"]).groupBy(*key).agg(cell.alias("c"))
        terms = terms.drop("sources", "ns").join(again, key).select(
            *terms.columns[:6], F.col("c.id").alias("sources"), F.col("c.n").alias("ns"), F.col("c.total").alias("totals")
        )
    terms.mapInArrow(audit(totals, top), "lang string, s bigint, t bigint, value bigint, digest bigint, part int").write.parquet(
        f"{folder}/audit"
    )
    result = spark.read.parquet(f"{folder}/audit")

    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pair_values(often, result.filter("digest IS NULL"), groups).withColumn("rank", F.row_number().over(order))
    lists_of = result.filter("digest IS NOT NULL").withColumn(
        "_least", F.rank().over(Window.partitionBy("lang", "s").orderBy(F.desc("value")))
    )
    lists_of = lists_of.filter(F.col("_least") <= top).select("lang", F.col("s").alias("id"), "value", "digest", "part")
    lists_of.write.parquet(f"{folder}/lists")
    lists_of = spark.read.parquet(f"{folder}/lists")
    wanted = lists_of.select("lang", "digest").distinct()
    strings = parts.select("lang", "digest", "term").join(wanted, ["lang", "digest"]).distinct()
    strings = strings.join(named, ["lang", "digest", "term"], "left").select(
        "lang", "digest", F.coalesce("part", F.lit(0)).alias("part"), F.col("term").cast("string").alias("item")
    )
    listed = (
        lists_of.join(strings, ["lang", "digest", "part"])
        .join(groups.select("lang", "id", "source"), ["lang", "id"])
        .withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= top)
    )
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return (
        pairs.withColumn("part", F.lit("pair")).select(*columns)
        .unionByName(listed.withColumn("part", F.lit("term")).select(*columns))
        .withColumn("rank", F.col("rank").cast("int"))
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS d, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source
  FROM documents),
words AS (
  SELECT d, lang, source, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM docs),
kept AS (SELECT lang, term, count(*)::HUGEINT AS n FROM words GROUP BY lang, term HAVING count(DISTINCT d) >= 3),
langs AS (SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS total FROM kept GROUP BY lang),
counts AS (
  SELECT w.lang, w.source, w.term, count(*)::HUGEINT AS n FROM words w JOIN kept USING (lang, term) GROUP BY ALL),
totals AS (SELECT lang, source, sum(n)::HUGEINT AS total FROM counts GROUP BY lang, source),
groups AS (SELECT DISTINCT lang, source FROM docs),
p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, k.n AS lang_n, l.v, l.total AS lang_total,
    1 + (1000000000 * (coalesce(c.n, 0) + 1)) // (coalesce(t.total, 0) + l.v) AS p
  FROM groups g JOIN langs l USING (lang) JOIN kept k USING (lang)
  LEFT JOIN totals t ON t.lang = g.lang AND t.source = g.source
  LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
pair_sums AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pair_sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
against AS (
  SELECT lang, source, term AS item, p, 1 + (1000000000 * (lang_n + 1)) // (lang_total + v) AS q FROM p WHERE n > 0),
terms AS (SELECT lang, source, item, (((p - q) * (p - q)) // q)::BIGINT AS value FROM against WHERE p > q),
both_parts AS (
  SELECT lang, source, 'pair' AS part, item, value FROM pairs
  UNION ALL SELECT lang, source, 'term' AS part, item, value FROM terms),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM both_parts)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""
