"""Sparse products by strips."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from lattica.operators import products as P
from lattica.sources import tables as T


def test_a_strip_is_summed_before_it_is_sent(monkeypatch):
    """64 neighbours that all meet in the same four places leave four sums, not 256 products; parts of any size give the same."""
    left = pd.DataFrame({"i": np.tile([3, 9], 64), "l": np.repeat(np.arange(64), 2), "vre": 1.0, "vim": 0.0})
    right = pd.DataFrame({"m": np.repeat(np.arange(64), 2), "c": np.tile([1, 5], 64), "wre": np.arange(128.0), "wim": 0.0})
    for held in (1, 7, 1 << 20):
        monkeypatch.setattr(P, "HELD_PRODUCTS", held)
        got = P._strip_products(False)(left, right)
        assert sorted(zip(got["i"], got["j"], got["re"], strict=True)) == [(3, 1, 4032.0), (3, 5, 4096.0), (9, 1, 4032.0), (9, 5, 4096.0)]


@pytest.mark.parametrize("most", [0, 200, 1 << 23])
def test_strips_and_plain_join_agree(spark, monkeypatch, most):
    """Every strip by the join, some of them, none: the same product."""
    monkeypatch.setattr(P, "STRIP_PRODUCTS", most)
    monkeypatch.setattr(P, "STRIP_BITS", 3)
    rng = np.random.default_rng(1)
    a = np.where(rng.random((20, 30)) < 0.3, rng.integers(1, 9, (20, 30)), 0).astype(float)
    a[:, 9] = 1.0
    frame = lambda m: spark.createDataFrame([(int(i), int(j), float(m[i, j])) for i, j in zip(*np.nonzero(m), strict=True)], T.MATRIX)
    want = a @ a.T
    got = {(r.i, r.j): r.v for r in P.matmul(frame(a), frame(a.T)).collect()}
    assert got == {(i, j): want[i, j] for i, j in zip(*np.nonzero(want), strict=True)}
