"""Language-model scores: a counted word model and the marginal likelihood of a piece lattice.

A text is its words, upper-case A-Z lowered, and then one end token. The base score is a smoothed
word unigram model counted over the training rows. The lattice score takes the unigram scores of an
existing piece vocabulary as weights of all ways to cut a word into pieces: log-space forward
recursion over the bytes of each word gives the probability of the word summed over its cuts. The
text's probability is the product over its words, each times the learned probability that the text
goes on, and of the learned probability that it ends.

The weights are learned from the training rows by forward-backward over the lattices of their distinct
words. A word of the training rows is an arc of its lattice too, from end to end, weighted by its count
less a discount; the paths over pieces share what the discounts leave, so any word has a probability and
those of all words sum to 1.

A vocabulary file that keeps merge ranks instead of log-probabilities (all scores whole numbers
down to minus its size) gets log-probabilities from the ranks by Zipf's law. Bytes can always stand
alone, as byte pieces, so every word has a finite score. Those are the weights that learning starts from.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furlong.llm.vocabulary import SPACE_MARK, HashTable, Vocabulary, model_path, padded, read_model, span_hashes
from furlong.llm.words import Texts, hash_bytes, texts_of
from furlong.session import shared_dir

NAME = "op8_lattice_likelihood"
SQL = None
HOT_WORDS = 300_000
FIT_PASSES = 3
PRIOR = 1000.0
_CELLS = 1 << 18
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOG10 = 1 / np.log(10)


class Lattice:
    """log10 probabilities of words under the weighted pieces; logp replaces the weights of the file."""

    def __init__(self, model: bytes, logp: np.ndarray | None = None):
        self.vocabulary = v = Vocabulary(model)
        # a file of merge ranks has whole scores only; characters and marks come last there
        ranks = (v.score[v.normal] == np.round(v.score[v.normal])).all()
        if ranks:
            place = np.where(v.normal, np.clip(-v.score, 0, v.size), float(v.size))
            weight = -np.log(place + 2.0)
        else:
            weight = np.where(v.normal, v.score, v.score[v.normal].min())
        self.usable = v.normal | v.is_byte
        total = np.log(np.exp(weight[self.usable]).sum())
        self.logp = weight - total if logp is None else logp
        self.byte_logp = self.logp[v.byte_id]
        self.longest = max(len(v.piece[i]) for i in v.ids)
        self.lengths = sorted({len(v.piece[i]) for i in v.ids})

    def _arcs(self, sums: np.ndarray, size: np.ndarray) -> dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]:
        """(end, length) to the rows that have a piece there, and the pieces."""
        out, width = {}, sums.shape[1] - 1
        for length in self.lengths:
            if length > width:
                break
            inside = np.arange(width - length + 1)[:, None] + length <= size[None, :]
            start, row = np.nonzero(inside)
            piece = self.vocabulary.find(span_hashes(sums, row, start, length))
            hit = np.flatnonzero(piece >= 0)
            start, row, piece = start[hit], row[hit], piece[hit]
            cuts = np.flatnonzero(np.concatenate([[True], start[1:] != start[:-1]])) if len(start) else start
            for lo, hi in zip(cuts.tolist(), [*cuts[1:].tolist(), len(start)], strict=False):
                out[int(start[lo]) + length, length] = row[lo:hi], piece[lo:hi]
        return out

    def _forward(self, rows: np.ndarray, size: np.ndarray, arcs: dict) -> np.ndarray:
        n, width = rows.shape
        alpha = np.full((width + 1, n), -np.inf)
        alpha[0] = 0.0
        for end in range(1, width + 1):
            total = np.where(size >= end, alpha[end - 1] + self.byte_logp[rows[:, end - 1]], -np.inf)
            for length in self.lengths:
                if length > end:
                    break
                if (end, length) in arcs:
                    some, piece = arcs[end, length]
                    total[some] = np.logaddexp(total[some], alpha[end - length, some] + self.logp[piece])
            alpha[end] = total
        return alpha

    def _groups(self, words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        for places, rows, sums, size in padded([SPACE_MARK + w for w in words]):
            step = max(1, _CELLS // rows.shape[1])
            for lo in range(0, len(places), step):
                yield tuple(x[lo : lo + step] for x in (places, rows, sums, size))

    def words(self, words: list[bytes]) -> np.ndarray:
        """log10 of the marginal probability of each word with a space mark before it."""
        out = np.zeros(len(words))
        for places, rows, sums, size in self._groups(words):
            alpha = self._forward(rows, size, self._arcs(sums, size))
            out[places] = alpha[size, np.arange(len(size))] * _LOG10
        return out

    def expected(self, words: list[bytes]) -> np.ndarray:
        """How often each piece is used in the words, expected over all their cuts."""
        out = np.zeros(self.vocabulary.size)
        for _, rows, sums, size in self._groups(words):
            n, width = rows.shape
            arcs = self._arcs(sums, size)
            alpha = self._forward(rows, size, arcs)
            whole = alpha[size, np.arange(n)]
            beta = np.full((width + 1, n), -np.inf)
            beta[size, np.arange(n)] = 0.0
            for end in range(width, 0, -1):
                live = np.flatnonzero(size >= end)
                of = rows[live, end - 1]
                after = beta[end, live] + self.byte_logp[of]
                used = np.exp(alpha[end - 1, live] + after - whole[live])
                out += np.bincount(self.vocabulary.byte_id[of], weights=used, minlength=len(out))
                beta[end - 1, live] = np.logaddexp(beta[end - 1, live], after)
                for length in self.lengths:
                    if length > end:
                        break
                    if (end, length) in arcs:
                        some, piece = arcs[end, length]
                        after = beta[end, some] + self.logp[piece]
                        used = np.exp(alpha[end - length, some] + after - whole[some])
                        out += np.bincount(piece, weights=used, minlength=len(out))
                        beta[end - length, some] = np.logaddexp(beta[end - length, some], after)
        return out

    def fitted(self, used: np.ndarray) -> np.ndarray:
        """Log-probabilities from expected uses; the present ones count as PRIOR uses in all, so none is 0."""
        prior = np.where(self.usable, np.exp(self.logp), 0.0)
        p = np.where(self.usable, used, 0.0) + PRIOR * prior / prior.sum()
        with np.errstate(divide="ignore"):
            return np.where(self.usable, np.log(p / p.sum()), self.logp)


@lru_cache(maxsize=2)
def lattice(model: bytes, logp: bytes | None = None) -> Lattice:
    return Lattice(model, None if logp is None else np.frombuffer(logp))


def _lowered(batch_column: pa.Array) -> Iterator[Texts]:
    for texts in texts_of(batch_column):
        yield Texts(_LOWER[texts.data], texts.at, texts.rows)


def word_counts(docs: DataFrame, train_col: str, text_col: str = "text") -> DataFrame:
    """(word, c): all words of all rows, and how often each occurs in rows where train_col holds.

    Words are counted per batch before the shuffle.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            train = np.asarray(batch.column(0).fill_null(False).to_numpy(zero_copy_only=False), dtype=bool)
            keys, words, counts = [], [], []
            for texts in _lowered(batch.column(1)):
                w = texts.words()
                if not len(w):
                    continue
                key, first, which = np.unique(w.hash, return_index=True, return_inverse=True)
                keys.append(key)
                counts.append(np.bincount(which, weights=train[texts.rows][w.text_of], minlength=len(key)))
                words += [texts.data[a:b].tobytes() for a, b in zip(w.starts[first], w.ends[first], strict=True)]
            if not keys:
                continue
            key, first, which = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
            c = np.bincount(which, weights=np.concatenate(counts), minlength=len(key)).astype(np.int64)
            names = pa.array([words[i] for i in first], pa.binary())
            yield pa.RecordBatch.from_arrays([names, pa.array(c)], names=["word", "c"])

    rows = docs.select(F.col(train_col), F.col(text_col)).mapInArrow(count, "word binary, c bigint")
    return rows.groupBy("word").agg(F.sum("c").alias("c"))


def fit_weights(words: DataFrame, model: bytes, passes: int = FIT_PASSES) -> bytes:
    """Log-probabilities of the pieces after so many passes of forward-backward over all distinct words.

    Each word counts once, as the pieces are there for words that are rare or were not seen; what goes to
    the driver is a number per piece.
    """
    logp = None
    for _ in range(passes):

        def expect(batches: Iterator[pa.RecordBatch], logp=logp) -> Iterator[pa.RecordBatch]:
            lat = lattice(model, logp)
            used = np.zeros(lat.vocabulary.size)
            for batch in batches:
                used += lat.expected(batch.column(0).to_pylist())
            some = np.flatnonzero(used)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(used[some])], names=["piece", "n"])

        rows = words.select("word").mapInArrow(expect, "piece bigint, n double")
        got = rows.groupBy("piece").agg(F.sum("n").alias("n")).toPandas()  # at most one row for each piece
        lat = lattice(model, logp)
        used = np.zeros(lat.vocabulary.size)
        used[got["piece"].to_numpy(dtype=np.int64)] = got["n"].to_numpy(dtype=float)
        logp = lat.fitted(used).tobytes()
    return logp


def weigh_words(
    counts: DataFrame, model: bytes, logp: bytes | None = None, discount: float = 0.0, spelled: float = 1.0, total: int = 0
) -> DataFrame:
    """(h, c, lp): hash of the word, its count, log10 of its lattice probability.

    With a total, a training word is an arc of its own from its mark to its end, with its count less
    discount as share of the total; the paths over pieces share the rest, spelled.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lat = lattice(model, logp)
        for batch in batches:
            words = batch.column(0).to_pylist()
            h, lp = hash_bytes(words).view(np.int64), lat.words(words)
            if total:
                own = np.maximum(batch.column(1).to_numpy() - discount, 0.0) / total
                with np.errstate(divide="ignore"):
                    lp = np.logaddexp(np.log(own), lp / _LOG10 + np.log(spelled)) * _LOG10
            yield pa.RecordBatch.from_arrays([pa.array(h), batch.column(1), pa.array(lp)], names=["h", "c", "lp"])

    return counts.mapInArrow(work, "h bigint, c bigint, lp double")


def learned_words(counts: DataFrame, model: bytes, passes: int) -> DataFrame:
    """weigh_words with piece weights, word arcs and their discount learned from the words of training rows."""
    folder = shared_dir(counts.sparkSession, "counts")
    counts.write.parquet(folder)
    counts = counts.sparkSession.read.parquet(folder)
    known = counts.filter("c > 0")
    n = known.agg(
        F.count(F.lit(1)).alias("types"), F.coalesce(F.sum("c"), F.lit(0)).alias("tokens"),
        F.count(F.when(F.col("c") == 1, 1)).alias("once"), F.count(F.when(F.col("c") == 2, 1)).alias("twice"),
    ).first()
    if not n["tokens"]:
        return weigh_words(counts, model)
    # what words found once tell of the words not seen (absolute discounting); some stays for those in any case
    discount = min(max(n["once"], 1) / max(n["once"] + 2 * n["twice"], 2), 0.9)
    spelled = discount * n["types"] / n["tokens"]
    return weigh_words(counts, model, fit_weights(known, model, passes), discount, spelled, n["tokens"])


def score_texts(
    docs: DataFrame,
    train_col: str,
    model: bytes,
    id_col: str = "doc_id",
    text_col: str = "text",
    hot_words: int = HOT_WORDS,
    passes: int = 0,
) -> DataFrame:
    """(id, train, n_tokens, n_known, train_tokens, base_score, score), one row per input row.

    Counts and the lattice values of all words are written once to the shared folder. At most
    hot_words of the most frequent words go to the tasks as an array and cover most tokens where
    they stand; all other words meet their values in a join, so every token is scored.

    Without passes the pieces keep the weights of the file. With them the weights are learned from the
    distinct words of the training rows, so many passes of forward-backward, and those words are arcs too.

    A null or empty text is the end token alone. Without a training row all counts are 0. A null
    train value counts as false. Repeated rows are scored (and counted) one by one; columns other
    than the three named are not read.
    """
    spark = docs.sparkSession
    docs = docs.select(
        F.col(id_col).alias("_id"), F.coalesce(F.col(train_col), F.lit(False)).alias("_train"), F.col(text_col).alias("_text")
    )
    folder = shared_dir(spark, "words")
    counts = word_counts(docs, "_train", "_text")
    (learned_words(counts, model, passes) if passes else weigh_words(counts, model)).write.parquet(folder)
    values = spark.read.parquet(folder)
    ends = docs.filter("_train").count()
    sizes = (
        values.filter("c > 0")
        .groupBy(F.floor(F.log2(F.col("c"))).cast("int").alias("size"))
        .agg(F.count(F.lit(1)).alias("n"), F.sum("c").alias("total"))
        .collect()
    )  # one row for each doubling of the count
    tokens = int(sum(r["total"] for r in sizes)) + ends
    distinct = int(sum(r["n"] for r in sizes)) + (ends > 0)
    least, held = 0, 0
    for r in sorted(sizes, key=lambda r: -r["size"]):
        if held + r["n"] > hot_words:
            break
        held, least = held + r["n"], 1 << r["size"]
    low = np.log10(tokens + 0.5 * (distinct + 1))
    hot = values.filter(F.col("c") >= least).select("h", "c", "lp").toPandas() if least else None
    hot_h = np.zeros(0, dtype=np.uint64) if hot is None else hot["h"].to_numpy(dtype=np.int64).view(np.uint64)
    hot_base = np.zeros(0) if hot is None else np.log10(hot["c"].to_numpy(dtype=float) + 0.5) - low
    hot_lp = np.zeros(0) if hot is None else hot["lp"].to_numpy(dtype=float)
    stop = (ends + 0.5) / (tokens + 1.0)
    go_on, stop, end_base = float(np.log10(1 - stop)), float(np.log10(stop)), float(np.log10(ends + 0.5) - low)
    ids = docs.schema["_id"].dataType.simpleString()
    schema = f"row bigint, h bigint, n bigint, _id {ids}, train boolean, n_tokens bigint, known bigint, base double, lp double"

    def heads_and_tails(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, row = HashTable(hot_h), TaskContext.get().partitionId() << 36
        for batch in batches:
            for texts in _lowered(batch.column(2)):
                w = texts.words()
                owner, k = w.text_of, len(texts)
                place = table.get(w.hash)
                near = place >= 0
                base = np.bincount(owner[near], weights=hot_base[place[near]], minlength=k) + end_base
                lp = np.bincount(owner[near], weights=hot_lp[place[near]], minlength=k) + w.counts * go_on + stop
                known = np.bincount(owner[near], minlength=k) + (ends > 0)
                # words that the task does not hold: one row for each distinct one of a text
                far_owner, far_hash = owner[~near], w.hash[~near]
                order = np.lexsort((far_hash, far_owner))
                far_owner, far_hash = far_owner[order], far_hash[order]
                new = np.concatenate([[True], (far_owner[1:] != far_owner[:-1]) | (far_hash[1:] != far_hash[:-1])])
                at = np.flatnonzero(new[: len(far_owner)])
                n = np.diff(np.append(at, len(far_owner)))
                rows = row + np.arange(k)
                row += k
                m = len(at)
                head, key = slice(texts.rows.start, texts.rows.stop), rows[far_owner[at]]
                # a head row has n = 0, so whatever word has its hash adds nothing to it
                join = lambda a, kind: pa.concat_arrays([a, pa.nulls(m, kind)])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([rows, key])),
                        pa.array(np.concatenate([rows * np.int64(0x5851F42D4C957F2D), far_hash[at].view(np.int64)])),
                        pa.array(np.concatenate([np.zeros(k, dtype=np.int64), n])),
                        join(batch.column(0).slice(head.start, k), batch.column(0).type),
                        join(batch.column(1).slice(head.start, k), pa.bool_()),
                        join(pa.array(w.counts + 1), pa.int64()),
                        pa.array(np.concatenate([known, np.zeros(m, dtype=np.int64)])),
                        pa.array(np.concatenate([base, np.zeros(m)])),
                        pa.array(np.concatenate([lp, np.zeros(m)])),
                    ],
                    names=["row", "h", "n", "_id", "train", "n_tokens", "known", "base", "lp"],
                )

    parts = docs.mapInArrow(heads_and_tails, schema)
    far = values.filter((F.col("c") < least) if least else F.lit(True)).select("h", "c", F.col("lp").alias("word_lp"))
    n, c = F.col("n"), F.coalesce(F.col("c"), F.lit(0))
    return (
        parts.join(far, "h", "left")
        .groupBy("row")
        .agg(
            F.max("_id").alias(id_col),
            F.max("train").alias("train"),
            F.max("n_tokens").alias("n_tokens"),
            F.sum(F.col("known") + F.when(c > 0, n).otherwise(0)).alias("n_known"),
            F.sum(F.col("base") + n * (F.log10(c + 0.5) - F.lit(float(low)))).alias("base_score"),
            F.sum(F.col("lp") + n * F.coalesce(F.col("word_lp"), F.lit(0.0))).alias("score"),
        )
        .select(
            id_col, "train", "n_tokens", "n_known", F.lit(tokens).cast("bigint").alias("train_tokens"), "base_score", "score"
        )
    )


def held_out(id_col: str = "doc_id"):
    """Rows kept from learning: crc32 of the id as text, modulo 5, is 1."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 1


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", (~held_out()).alias("train"))
    scored = score_texts(docs, "train", read_model(model_path()), passes=FIT_PASSES)
    return scored.select(
        "doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )
