"""The latent space of op9 against dense products over every passage of every document."""

import numpy as np

from furlong.llm import decontamination as D
from furlong.llm.words import hash_bytes


def test_the_space_is_fitted_on_the_passages_of_all_documents(spark):
    rng = np.random.default_rng(3)
    words = [f"w{k}" for k in range(4000)]
    texts = [" ".join(rng.choice(words, size=rng.integers(1, 90))) for _ in range(1200)] + ["", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(7)
    parts = D.item_parts([(1, " ".join(words[:40])), (2, " ".join(words[100:130]))])
    idf = D.term_weights(*D.document_frequencies(docs))
    space = D.fit_space(docs, parts, idf)

    passages = []
    for text in texts:
        h = hash_bytes([w.encode() for w in (text or "").split()])
        passages += [h[k : k + 2 * D.BLOCK] for k in range(0, max(len(h) - D.BLOCK, 1), D.BLOCK) if len(h)]
    counts = np.array([np.bincount(D._terms(h), minlength=D.TERMS) for h in passages + parts.words], dtype=np.float32)
    seen = np.flatnonzero(counts.sum(axis=0) * idf)
    a = counts[:, seen] * idf[seen] / np.sqrt(np.maximum(counts @ idf**2, 1.0))[:, None]
    a[len(passages) :] *= np.sqrt(len(passages) / len(parts.words))
    start = np.random.default_rng(7).standard_normal((D.TERMS, D.RANK + D.SPARE), dtype=np.float32)
    basis = np.linalg.qr(a.T @ (a @ np.linalg.qr(start)[0][seen]))[0]
    values, turned = np.linalg.eigh(basis.T @ (a.T @ (a @ basis)))
    lead = basis @ turned[:, np.argsort(-values)[:4]] * idf[seen][:, None]
    assert len(passages) > 1200 and np.abs(lead).max() > 0.1
    assert np.allclose(np.abs(space[seen, :4]), np.abs(lead), atol=0.01 * np.abs(lead).max())
