"""Learned piece weights: expected uses against all cuts written out, and scores of rows that were held out."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from furlong.llm import lattice_lm
from furlong.llm.vocabulary import model_path, read_model

WORDS = [b"the", b"ab", "né".encode(), b"x", b"qqq"]


@pytest.fixture(scope="module")
def model():
    return read_model(model_path())


def test_expected_uses(model):
    lat = lattice_lm.lattice(model)
    v = lat.vocabulary
    want = np.zeros(v.size)
    for word in WORDS:
        # a byte piece beside a normal piece of the same byte is an arc of its own
        normal = {v.piece[i]: int(i) for i in v.ids}
        paths = []

        def walk(data, used, total=paths):
            if not data:
                total.append(used)
                return
            walk(data[1:], [*used, int(v.byte_id[data[0]])])
            for n in range(1, len(data) + 1):
                if data[:n] in normal:
                    walk(data[n:], [*used, normal[data[:n]]])

        walk("▁".encode() + word, [])
        weight = np.array([math.exp(sum(lat.logp[i] for i in path)) for path in paths])
        for path, w in zip(paths, weight / weight.sum(), strict=True):
            np.add.at(want, path, w)
    assert np.allclose(lat.expected(WORDS), want, atol=1e-9)
    learned = lattice_lm.Lattice(model, lat.fitted(lat.expected(WORDS)))
    assert np.isclose(np.exp(learned.logp[learned.usable]).sum(), 1) and np.isfinite(learned.logp[learned.usable]).all()


def test_scores_of_rows_held_out(spark, model):
    rng = random.Random(5)
    parts = ["zor", "quam", "elth", "ivi", "ou"]
    texts = [" ".join("".join(rng.choices(parts, k=rng.choice([1, 2, 2, 3]))) for _ in range(200)) for _ in range(40)]
    texts += [None, "", "日本 " + "z" * 300, "A" * 3]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").withColumn("train", F.col("doc_id") % 4 != 1)
    plain = {r["doc_id"]: r for r in lattice_lm.score_texts(docs, "train", model).collect()}
    got = {r["doc_id"]: r for r in lattice_lm.score_texts(docs, "train", model, passes=2).collect()}
    assert got.keys() == plain.keys() and all(math.isfinite(r["score"]) for r in got.values())
    assert all(got[k]["base_score"] == pytest.approx(plain[k]["base_score"]) for k in got)
    held = [got[k] for k in range(1, 40, 4)]
    assert sum(r["score"] for r in held) > 1.05 * sum(r["base_score"] for r in held)
    assert sum(plain[r["doc_id"]]["score"] for r in held) < 2 * sum(r["base_score"] for r in held)


def test_without_training_rows(spark, model):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id bigint, text string").withColumn("train", F.lit(False))
    got = lattice_lm.score_texts(docs, "train", model, passes=2).collect()
    assert len(got) == 2 and all(math.isfinite(r["score"]) and r["n_known"] == 0 for r in got)
