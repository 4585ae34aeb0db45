"""Matching by joins against the one-task kernel."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.operators import analysis as N, elementwise as E, matching as M
from lattica.plans import kernels as K
from lattica.sources import tables as T


@pytest.mark.parametrize("seed", range(4))
def test_product_matching(spark, seed):
    """The kernel's product and bounds, where rows get a column at once, where they don't, and where there is none."""
    rng = np.random.default_rng(seed)
    n = 30
    cells = {(int(p), k): 1.0 + rng.random() for k, p in enumerate(rng.permutation(n))}
    for i, j in rng.integers(0, n, (25 * seed, 2)).tolist():
        cells[i, j] = 4 * rng.random() + 0.01
    i, j, v = (np.array(x) for x in zip(*[(a, b, c) for (a, b), c in cells.items()], strict=True))
    a = spark.createDataFrame(list(zip(i.tolist(), j.tolist(), v.tolist(), strict=True)), T.MATRIX)
    got = M.product_matching(a, n).orderBy("src").toPandas()
    own, want = got["dst"].to_numpy(), K.match_rows(n, i, j, v).perm
    assert sorted(own) == list(range(n)) and (got["info"] == 0).all()
    total = lambda to: sum(np.log(cells[r, c]) for r, c in enumerate(to.tolist()))
    assert total(own) == pytest.approx(total(want), abs=1e-9)
    u, w = got["u"].to_numpy(), got["v"].to_numpy()
    assert (v * np.exp(u[i] + w[j]) < 1 + 1e-9).all()
    assert np.allclose([cells[r, c] * np.exp(u[r] + w[c]) for r, c in enumerate(own.tolist())], 1)
    none = M.product_matching(a.filter(F.col("i") != int(i[0])), n)
    assert none.filter("info = 1 and src = dst").count() == n


def test_match_rows_of_many_rows_is_no_single_task(spark, monkeypatch):
    monkeypatch.setattr(N.G, "PIECE", 10)
    monkeypatch.setattr(N, "_per", None)
    turn = E.permute(T.laplacian(spark, 4), spark.range(16).selectExpr("id as src", "(id + 3) % 16 as dst"))
    assert N.match_rows(turn, 16).filter("dst = (src + 13) % 16 and info = 0").count() == 16
