"""Ranked search against scoring every document; the quadtree against its points."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from furlong.llm import ranked_search
from furlong.llm.ranked_search import build_index, top_documents
from furlong.llm.treap import pack, search, unpack

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
DOCS = "doc_id bigint, text string, lang string, source string, place bigint, terms string, df int, score int"


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k):
    counts = [(d[0], Counter(terms(d[1]))) for d in docs]
    counts = [(i, c) for i, c in counts if c]
    n_docs, n_terms = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    asked = {}
    for item, text, *_ in items:
        asked.setdefault(item, set()).update(terms(text))
    out = set()
    for item, query in asked.items():
        scored = []
        for i, c in counts:
            n = sum(c.values())
            m = 100 - 90 + (90 * n * n_docs) // n_terms
            score = 0
            for t in query:
                if t in c:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    score += w * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m))
            if score > 0:
                scored.append((-score, i is not None, i or 0))
        scored.sort()
        out |= {(item, r, x[2] if x[1] else None, -x[0]) for r, x in enumerate(scored[:k], 1)}
    return out


def corpus(n=400, seed=2):
    rng = random.Random(seed)
    bag = [f"w{k}" for k in range(60)] + ["Éa", "日本", "A1", "it's", "x_y", "café"]
    weights = [1 / (k + 1) for k in range(len(bag))]
    rows = [(k, " ".join(rng.choices(bag, weights, k=rng.choice([0, 1, 3, 20, 60]))), "en", "s", 1, "t", 2, 3) for k in range(n)]
    rows += [(n + k, "copied text w1 w2 w50", "en", "s", 1, "t", 2, 3) for k in range(n // 2)]  # a third are copies
    rows += [(5, "w1 w2", "en", "s", 1, "t", 2, 3)] * 2  # repeated rows
    rows += [(None, "w50 w51", None, None, None, None, None, None), (None, None, None, None, None, None, None, None)]
    rows.append((9_999, "w3 " * 30_000 + "\n\x01 日本", "en", "s", 1, "t", 2, 3))
    return rows


ITEMS = [
    (1, "w1 w2 w50"), (2, "W59 日本 café"), (3, "none of these"), (4, None), (5, ""), (6, "w3"), (7, "w0 w0 w0 w1"),
    (8, "copied text"), (8, "w58"), (9, " ".join(f"w{k}" for k in range(60))), (None, "w50 w51 A1"),
]


@pytest.mark.parametrize(("shard_docs", "group_bytes", "k"), [(8192, 1 << 22, 10), (16, 8, 3), (1, 1, 1)])
def test_equals_scoring_every_document(spark, shard_docs, group_bytes, k):
    rows = corpus()
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    items = spark.createDataFrame([(*x, 1, 2) for x in ITEMS], "item_id bigint, text string, item int, score int")
    index, n = build_index(docs, shard_docs=shard_docs)
    got = [tuple(r) for r in top_documents(index, n, items, k, group_bytes=group_bytes, together=4).collect()]
    assert sorted(got, key=str) == sorted(brute(rows, ITEMS, k), key=str)


def test_a_row_group_of_the_index_holds_few_shards_whatever_a_file_holds(spark, monkeypatch, tmp_path):
    folder = f"{tmp_path}/index"
    monkeypatch.setattr(ranked_search, "GROUP_OF_SHARDS", 1, raising=False)
    monkeypatch.setattr(ranked_search, "shared_dir", lambda spark, purpose: folder)
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    index, _ = build_index(spark.createDataFrame(corpus(200), DOCS).coalesce(1), shard_docs=10)
    files = [pq.ParquetFile(f).metadata for f in sorted(map(str, tmp_path.glob("index/*.parquet")))]
    assert sum(m.num_rows for m in files) == index.count() > 20
    assert [m.num_row_groups for m in files] == [m.num_rows for m in files]
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == was


def test_empty_tables(spark):
    docs = spark.createDataFrame(corpus(20), DOCS)
    items = spark.createDataFrame([("a", "w1"), ("b", "w2")], "item_id string, text string")
    index, n = build_index(docs.limit(0))
    assert n == 0 and top_documents(index, n, items).collect() == []
    index, n = build_index(docs)
    assert top_documents(index, n, items.limit(0)).collect() == []
    assert {r.item_id for r in top_documents(index, n, items).collect()} == {"a", "b"}


def test_hot_term_in_every_document_weighs_nothing_alone(spark):
    rows = [(k, "all " + "x" * (k % 3 + 1), "en", "s", 1, "t", 2, 3) for k in range(600)]
    items = [(1, "all"), (2, "all xx")]
    index, n = build_index(spark.createDataFrame(rows, DOCS), shard_docs=50)
    got = {tuple(r) for r in top_documents(index, n, spark.createDataFrame(items, "item_id bigint, text string")).collect()}
    assert got == brute(rows, items, 10) and {g[0] for g in got} == {2}


points = st.dictionaries(st.tuples(st.integers(0, 40), st.integers(0, 70)), st.integers(1, 10**6), min_size=1, max_size=200)


@settings(max_examples=60, deadline=None)
@given(points, st.integers(1, 5), st.integers(1, 4), st.data())
def test_search_equals_all_columns(cells, k, opened, data):
    rows, columns, impacts = (np.array(x) for x in zip(*((r, c, v) for (r, c), v in cells.items())))
    height, bits, drops, top = pack(rows, columns, impacts)
    tree = unpack(height, bits, drops, top)
    assert sorted(tree.best[-len(cells):].tolist()) == sorted(impacts.tolist())
    queries = data.draw(st.lists(st.dictionaries(st.integers(0, 40), st.integers(0, 50), min_size=1), min_size=1, max_size=3))
    entries = [(q, r, w) for q, x in enumerate(queries) for r, w in x.items() if r in set(rows.tolist())]
    q, r, w = (np.array(x, dtype=np.int64) for x in (zip(*entries) if entries else ([], [], [])))
    keys = np.random.default_rng(0).permutation(71)
    got = search(tree, q, r, w, len(queries), k, np.zeros(len(queries), dtype=np.int64), keys, opened)
    want = []
    for n, x in enumerate(queries):
        score = Counter()
        for (row, column), v in cells.items():
            score[column] += x.get(row, 0) * v
        best = sorted((-s, keys[c], c) for c, s in score.items() if s)
        want += [(n, c, -s) for s, _, c in best[:k]]
    assert list(zip(*(x.tolist() for x in got))) == want
