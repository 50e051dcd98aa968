"""Sums of groups of rows, and the basis of the latent space, against plain numpy."""

import tracemalloc

import numpy as np

from furlong.llm import decontamination as D


def test_sums_of_groups_equal_single_sums():
    rng = np.random.default_rng(1)
    size = np.concatenate([rng.integers(1, 40, 3000), [D._LAYERS, D._LAYERS + 1, 3 * D._GROUPS + 5], np.ones(7, dtype=int)])
    rng.shuffle(size)
    first = np.cumsum(size) - size
    table = rng.standard_normal((500, 9)).astype(np.float32)
    rows = rng.integers(0, 500, size.sum())
    own = rng.permutation(len(size) + 10)[: len(size)]
    out = np.ones((len(size) + 10, 9))
    D._add_groups(table, rows, first, out, own)
    expected = np.ones_like(out)
    for k, at in enumerate(first):
        expected[own[k]] += table[rows[at : at + size[k]]].astype(float).sum(axis=0)
    assert np.allclose(out, expected, atol=1e-3)
    D._add_groups(table, rows[:0], first[:0], out, own[:0])
    assert np.allclose(out, expected, atol=1e-3)


def test_the_basis_is_worked_out_without_wide_copies_of_the_matrix():
    matrix = np.random.default_rng(2).standard_normal((D.TERMS, D.RANK + D.SPARE)).astype(np.float32)
    before = matrix.copy()
    tracemalloc.start()
    basis = D._orthonormal(matrix)
    weights = D._with_length(basis, np.full(D.TERMS, 2.0))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 2 * before.nbytes
    assert np.allclose(basis.T @ basis, np.eye(basis.shape[1]), atol=1e-4)
    assert np.allclose(basis @ (basis.T @ before), before, atol=1e-3)
    assert np.allclose(weights[:, :-1], 2 * basis) and (weights[:, -1] == 4).all()
