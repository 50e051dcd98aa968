"""Language identification by rank-order profiles of letter n-grams.

A profile is the list of a language's most frequent n-grams. A text gets the language whose
profile has the least out-of-place distance to the list of the text's own n-grams.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from furlong.llm.words import Texts, texts_of

NAME = "op6_language_profiles"
SQL = None
TOP = 300
SALTS = 64


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), dtype=bool, count=sys.maxunicode + 1)


def _symbols(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case letters with one space between words and around each text, and the text of each."""
    parts = [
        b"".join(
            (b" \0\0\0", bytes(texts.data[a:b]).decode("utf-8", "replace").lower().encode("utf-32-le"), b" \0\0\0")
        )
        for a, b in zip(texts.at[:-1], texts.at[1:], strict=True)
    ]
    codes = np.frombuffer(b"".join(parts), dtype=np.uint32)
    text = np.repeat(np.arange(len(parts)), [len(p) // 4 for p in parts])
    codes = np.where(_letters()[codes], codes, np.uint32(32))
    gap = codes == 32
    again = np.concatenate([[False], gap[1:] & gap[:-1] & (text[1:] == text[:-1])])
    return codes[~again], text[~again]


def gram_counts(texts: Texts, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct n-grams of 1 to 3 symbols in each group of texts (-1: left out): group, code, size of the
    code's sort key, count. A code has 21 bits a symbol, so codes order n-grams alike in every batch."""
    codes, text = _symbols(texts)
    alphabet, small = np.unique(codes, return_inverse=True)
    small, group, gap = small.astype(np.uint64) + np.uint64(1), groups[text], codes == 32
    bits = np.uint64(int(len(alphabet)).bit_length())
    keys = []
    for n in (1, 2, 3):
        last = max(len(small) - n + 1, 0)
        ok = (group[:last] >= 0) & (text[:last] == text[n - 1 :][:last])
        if n == 1:
            ok &= ~gap[:last]
        elif n == 3:
            ok &= ~gap[1 : last + 1]
        key = group[:last].astype(np.uint64) & np.uint64(0xFFFFFFFF)
        for j in range(3):
            key = (key << bits) | (small[j : j + last] if j < n else np.uint64(0))
        keys.append(key[ok])
    keys = np.sort(np.concatenate(keys))
    new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, dtype=int)
    count = np.diff(np.append(new, len(keys)))
    keys = keys[new]
    mask, wide = (np.uint64(1) << bits) - np.uint64(1), np.concatenate([[0], alphabet]).astype(np.int64)
    code = np.zeros(len(keys), dtype=np.int64)
    for j in (2, 1, 0):
        code = (code << 21) | wide[((keys >> (bits * np.uint64(j))) & mask).astype(np.int64)]
    return (keys >> (bits * np.uint64(3))).astype(np.int64), code, keys, count


def learn_profiles(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", top: int = TOP) -> DataFrame:
    """(lang, code, rank): the top n-grams of each language over all rows with a language.

    Batches are counted before the shuffle. The ranking first cuts salted parts of a language to
    their top entries, so no task sorts all n-grams of one. Ties go to the smaller code.
    """
    kind = docs.select(lang_col).schema[0].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known = batch.column(0).dictionary_encode()
            groups = known.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            parts = [gram_counts(t, groups[t.rows]) for t in texts_of(batch.column(1))]
            if not parts:
                continue
            lang, code, n = (np.concatenate([p[i] for p in parts]) for i in (0, 1, 3))
            order = np.lexsort((code, lang))
            lang, code, n = lang[order], code[order], n[order]
            if len(lang):
                new = np.flatnonzero(np.concatenate([[True], (lang[1:] != lang[:-1]) | (code[1:] != code[:-1])]))
                lang, code, n = lang[new], code[new], np.add.reduceat(n, new)
            names = known.dictionary.take(pa.array(lang))
            yield pa.RecordBatch.from_arrays([names, pa.array(code), pa.array(n)], names=["lang", "code", "n"])

    known = docs.filter(F.col(lang_col).isNotNull()).select(lang_col, text_col)
    sums = known.mapInArrow(count, f"lang {kind}, code bigint, n bigint").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    salt = F.pmod(F.xxhash64("code"), F.lit(SALTS))
    part = Window.partitionBy("lang", salt).orderBy(F.desc("n"), "code")
    whole = Window.partitionBy("lang").orderBy(F.desc("n"), "code")
    return (
        sums.withColumn("_part", F.row_number().over(part))
        .filter(F.col("_part") <= top)
        .withColumn("rank", F.row_number().over(whole))
        .filter(F.col("rank") <= top)
        .select("lang", "code", "rank")
    )


class Profiles:
    """The profiles as arrays: ranks[i, j] is the rank of codes[i] in languages[j], or top + 1."""

    def __init__(self, rows: list[tuple[str, int, int]], top: int):
        self.top = top
        self.languages = sorted({r[0] for r in rows})
        self.codes = np.array(sorted({r[1] for r in rows}), dtype=np.int64)
        place = {c: i for i, c in enumerate(self.codes.tolist())}
        column = {x: j for j, x in enumerate(self.languages)}
        self.ranks = np.full((len(self.codes) + 1, max(len(self.languages), 1)), 0, dtype=np.int32)
        for lang, code, rank in rows:
            self.ranks[place[code], column[lang]] = rank

    def predict(self, texts: Texts) -> tuple[list[str], np.ndarray]:
        """Language and score of each text; ties go to the first language by name."""
        if not self.languages:
            return ["und"] * len(texts), np.zeros(len(texts))
        doc, code, _, count = gram_counts(texts, np.arange(len(texts)))
        order = np.lexsort((code, -count, doc))
        doc, code = doc[order], code[order]
        begins = np.searchsorted(doc, np.arange(len(texts) + 1))
        rank = np.arange(len(doc)) - begins[doc] + 1
        keep = rank <= self.top
        doc, code, rank = doc[keep], code[keep], rank[keep]
        at = np.searchsorted(self.codes, code)
        at = np.where((at < len(self.codes)) & (self.codes[np.minimum(at, len(self.codes) - 1)] == code), at, len(self.codes))
        n = np.bincount(doc, minlength=len(texts))
        best, label = np.full(len(texts), np.inf), np.full(len(texts), -1)
        for j in range(len(self.languages)):
            theirs = self.ranks[at, j]
            far = np.where(theirs > 0, np.abs(theirs - rank), self.top)
            total = np.bincount(doc, weights=far, minlength=len(texts))
            better = (total < best) & (n > 0)
            best[better], label[better] = total[better], j
        score = np.where(label >= 0, 1 - np.where(label >= 0, best, 0) / (np.maximum(n, 1) * self.top), 0.0)
        return ["und" if k < 0 else self.languages[k] for k in label], np.clip(score, 0.0, 1.0)


def fit(train: DataFrame, lang_col: str = "lang", text_col: str = "text", top: int = TOP) -> Profiles:
    """Profiles from all rows with a language; top rows per language reach the driver."""
    rows = learn_profiles(train, lang_col, text_col, top).collect()
    return Profiles([(r["lang"], r["code"], r["rank"]) for r in rows], top)


def identify(docs: DataFrame, profiles: Profiles, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score), one row per input row, without a shuffle.

    A null text and a text without a letter give "und" and score 0, as does every text if nothing
    was learned. The score is 1 less the distance as a share of the largest possible one. Repeated
    rows are judged one by one; columns other than the two named are not read.
    """
    ids = docs.select(id_col).schema[0].dataType.simpleString()

    def tag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in texts_of(batch.column(1)):
                label, score = profiles.predict(texts)
                key = batch.column(0).slice(texts.rows.start, len(texts))
                yield pa.RecordBatch.from_arrays(
                    [key, pa.array(label, pa.string()), pa.array(score, pa.float64())], names=[id_col, "lang_pred", "score"]
                )

    return docs.select(id_col, text_col).mapInArrow(tag, f"`{id_col}` {ids}, lang_pred string, score double")


def tagged(docs: DataFrame, profiles: Profiles, text_col: str = "text") -> DataFrame:
    """All columns of docs, with _lang_pred and _score as in identify; row by row, so ids play no part."""
    names = [*docs.columns, "_lang_pred", "_score"]
    schema = StructType([*docs.schema.fields, StructField("_lang_pred", StringType()), StructField("_score", DoubleType())])
    at = docs.columns.index(text_col)

    def tag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in texts_of(batch.column(at)):
                label, score = profiles.predict(texts)
                rows = batch.slice(texts.rows.start, len(texts))
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(label, pa.string()), pa.array(score, pa.float64())], names=names)

    return docs.mapInArrow(tag, schema)


def fold(id_col: str = "doc_id"):
    """crc32 of the id as text, modulo 5; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5


def training_rows(docs: DataFrame) -> DataFrame:
    return docs.filter(fold() != 0)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    tagged = identify(docs, fit(training_rows(docs)))
    return tagged.select("doc_id", (fold() == 0).alias("held_out"), "lang_pred", "score")
