"""Analysis and factorization kernels against dense computations."""

from __future__ import annotations

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from lattica.plans import kernels as K, local

ORDERS = ("natural", "mmd_at_plus_a", "mmd_ata", "colamd", "nested_dissection")


def made(n: int, density: float, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    return (rng.random((n, n)) < density) * rng.normal(size=(n, n)) + np.diag(3 + rng.random(n))


def fill(pattern: np.ndarray) -> np.ndarray:
    s = pattern | np.eye(len(pattern), dtype=bool)
    for k in range(len(s)):
        later = np.arange(len(s)) > k
        s |= np.outer(s[:, k] & later, s[k] & later)
    return s


@pytest.mark.parametrize("how", ORDERS)
@pytest.mark.parametrize(("n", "density"), [(1, 1.0), (2, 0.5), (30, 0.1), (90, 0.03)])
def test_order_tree_factor_solve(n, density, how):
    a = made(n, density, n)
    i, j = np.nonzero(a)
    perm = K.order_columns(n, i, j, how)
    assert sorted(perm) == list(range(n))
    for relax in (1, 8):
        an = local.analyse(n, i, j, np.abs(a[i, j]), local.Options(row_perm="none", col_perm=how, relax=relax, maxsup=16))
        p, q = an.row_to[i], an.col_to[j]
        b = np.zeros((n, n))
        b[p, q] = a[i, j]
        assert (K.symmetric_tree(K.symmetric_columns(n, p, q)) == an.tree).all() and (K.postorder(an.tree) == np.arange(n)).all()
        assert an.owner.shape == (n,) and (an.fronts.last - an.fronts.first < 16).all()
        blocks, left, tiny, info = K.eliminate(np.arange(len(an.fronts.first)), an.fronts, an.owner, p, q, b[p, q])
        assert not left and not tiny and not info
        x = rhs = np.random.default_rng(1).normal(size=(n, 2))
        x = rhs.copy()
        K.forward(blocks, x)
        K.backward(blocks, x)
        assert np.allclose(b @ x, rhs)
        x = rhs.copy()
        K.backward_transposed(blocks, x)
        assert np.allclose(b.T @ x, rhs)


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 14), st.floats(0, 0.6), st.integers(0, 10**6))
def test_symbolic_and_trees(n, density, seed):
    a = made(n, density, seed)
    i, j = np.nonzero(a)
    s = fill(a != 0)
    low, up = K.symbolic(n, i, j)
    for c in range(n):
        assert list(low[c]) == list(np.flatnonzero(s[:, c] & (np.arange(n) >= c)))
        assert list(up[c]) == list(np.flatnonzero(s[:c, c]))
    sym = fill((a != 0) | (a != 0).T)
    tree = K.symmetric_tree(K.symmetric_columns(n, i, j))
    for c in range(n):
        under = np.flatnonzero(sym[:, c] & (np.arange(n) > c))
        assert tree[c] == (under[0] if len(under) else n)
    assert (K.column_tree(n, K.columns(n, i, j), n) == K.symmetric_tree(K.gram_columns(n, i, j))).all()
    post = K.postorder(tree)
    assert sorted(post) == list(range(n)) and all(p == n or post[c] < post[p] for c, p in enumerate(tree))


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 9), st.integers(0, 10**6))
def test_matching(n, seed):
    from itertools import permutations

    rng = np.random.default_rng(seed)
    a = (rng.random((n, n)) < 0.6) * rng.choice([0.01, 0.5, 1.0, 3.0, 40.0], (n, n))
    if n > 6:
        a += np.diag(rng.random(n) + 0.1)
    i, j = np.nonzero(np.ones_like(a))  # explicit zeros are stored too
    got = K.match_rows(n, i, j, a[i, j], 5)
    if n <= 6:
        best = max(np.prod([a[r, c] for r, c in enumerate(p)]) for p in permutations(range(n)))
        assert (got.info == 1) == (best == 0)
        if got.info:
            assert (got.perm == np.arange(n)).all()
            return
        assert np.isclose(np.prod(a[np.arange(n), got.perm]), best)
        least = max(min(a[r, c] for r, c in enumerate(p)) for p in permutations(range(n)))
        assert np.isclose(a[np.arange(n), K.match_rows(n, i, j, a[i, j], 2).perm].min(), least)
        total = max(sum(a[r, c] for r, c in enumerate(p)) for p in permutations(range(n)) if all(a[r, c] for r, c in enumerate(p)))
        assert np.isclose(a[np.arange(n), K.match_rows(n, i, j, a[i, j], 4).perm].sum(), total)
    scaled = a * np.exp(got.u[:, None] + got.v[None, :])
    assert (scaled <= 1 + 1e-9).all() and np.allclose(scaled[np.arange(n), got.perm], 1)


def test_tiny_and_zero_pivots():
    a = np.array([[0.0, 1.0], [1.0, 1.0]])
    assert K.dense_lu(a.copy(), 0.0, 5) == (0, 6)
    b = a.copy()
    assert K.dense_lu(b, 1e-3, 0)[0] == 1 and b[0, 0] == 1e-3
    c = np.array([[-1e-9, 1.0], [1.0, 1.0]])
    K.dense_lu(c, 1e-3, 0)
    assert c[0, 0] == -1e-3  # the sign stays


def test_subtrees_divide_the_work():
    k = 14
    at = np.arange(k * k).reshape(k, k)
    pairs = [(at[:-1].ravel(), at[1:].ravel()), (at[:, :-1].ravel(), at[:, 1:].ravel())]
    i = np.concatenate([at.ravel()] + [x for p, q in pairs for x in (p, q)])
    j = np.concatenate([at.ravel()] + [x for p, q in pairs for x in (q, p)])
    an = local.analyse(k * k, i, j, np.ones(len(i)), local.Options(row_perm="none", col_perm="nested_dissection", relax=4, maxsup=8))
    task = K.subtree_tasks(an.fronts, 4)
    assert set(task) > {0, 1}
    for s, up in enumerate(an.fronts.parent):
        if up < len(task) and task[up] >= 0:
            assert task[s] == task[up]  # whole subtrees


def test_permutation_sign():
    assert K.permutation_sign(np.array([1, 0, 2])) == -1 and K.permutation_sign(np.array([1, 2, 0])) == 1


def test_ilu_and_triangular():
    a = np.array([[4.0, 1, 0, 1], [1, 4, 1, 0], [0, 1, 4, 1], [1, 0, 1, 4]])
    i, j = np.nonzero(a)
    v = local.ilu0(4, i, j, a[i, j])
    got = np.zeros((4, 4))
    got[i, j] = v
    product = (np.tril(got, -1) + np.eye(4)) @ np.triu(got)
    assert np.allclose(product[i, j], a[i, j])
    b = np.arange(8.0).reshape(4, 2)
    for lower in (True, False):
        t = np.tril(a) if lower else np.triu(a)
        for trans in (False, True):
            x = local.triangular(4, i, j, a[i, j], b, lower, False, trans)
            assert np.allclose((t.T if trans else t) @ x, b)


@pytest.mark.parametrize("trans", [False, True])
def test_local_solve_with_logdet(trans):
    spread = np.logspace(-6, 6, 40)
    a = made(40, 0.1, 3) * (spread[None, :] if trans else spread[:, None])  # a spread of right-hand sides, not of unknowns
    i, j = np.nonzero(a)
    x = np.random.default_rng(0).normal(size=(40, 3))
    got = local.solve(40, i, j, a[i, j], (a.T if trans else a) @ x, local.Options(trans=trans))
    sign, logdet = np.linalg.slogdet(a)
    assert np.allclose(got.x, x) and np.isclose(got.logdet, logdet) and np.isclose(got.sign, sign) and (got.berr < 1e-15).all()
    zero_row = a.copy()
    zero_row[7] = 0
    assert local.solve(40, *np.nonzero(zero_row), zero_row[np.nonzero(zero_row)], x, local.Options()).info == 8
    zero_col = a.copy()
    zero_col[:, 9] = 0
    assert local.solve(40, *np.nonzero(zero_col), zero_col[np.nonzero(zero_col)], x, local.Options()).info == 50
