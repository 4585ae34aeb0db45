"""Triangles, ILU(0) and exact patterns by ranges of rows against dense elimination and the block engine."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.operators import analysis as N, blocks as B, ranges as L
from lattica.plans import kernels as K, local
from lattica.sources import tables as T
from tests.test_blocks import cells_of, random_system


@pytest.mark.parametrize("size", [7, 100])
def test_no_fill_by_ranges(spark, size):
    n = 40
    m = random_system(4, n, 0.12)
    i, j = np.nonzero(m)
    want = dict(zip(zip(i.tolist(), j.tolist(), strict=True), local.ilu0(n, i, j, m[i, j]), strict=True))
    got = {(r.i, r.j): r.v for r in L.eliminate_rows(cells_of(spark, m), n, False, size).collect()}
    assert set(got) == set(want) and max(abs(got[k] - want[k]) for k in want) < 1e-12


def test_complex_no_fill_and_repeated_entries(spark):
    n = 12
    m = random_system(5, n, 0.2, True)
    whole = cells_of(spark, m)
    half = whole.select("i", "j", F.struct((F.col("v.re") / 2).alias("re"), (F.col("v.im") / 2).alias("im")).alias("v"))
    i, j = np.nonzero(m)
    want = dict(zip(zip(i.tolist(), j.tolist(), strict=True), local.ilu0(n, i, j, m[i, j]), strict=True))
    got = {(r.i, r.j): complex(r.v.re, r.v.im) for r in L.eliminate_rows(half.unionByName(half), n, False, 5).collect()}
    assert set(got) == set(want) and max(abs(got[k] - want[k]) for k in want) < 1e-12


@pytest.mark.parametrize("size", [6, 100])
def test_patterns_by_ranges(spark, size):
    n = 40
    m = random_system(6, n, 0.07)
    m[3, 3] = m[11, 11] = 0.0  # the diagonal counts as there
    i, j = np.nonzero(m)
    low, up = K.symbolic(n, i, j)
    want = {(int(r), c) for c, x in enumerate(low) for r in x} | {(int(r), c) for c, x in enumerate(up) for r in x}
    got = [(r.i, r.j) for r in L.eliminate_rows(cells_of(spark, m), n, True, size).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_wide_ranges_take_few_rounds(spark, monkeypatch):
    """A chain of n rows took n / 256 rounds; neither a chain nor its factors make blocks now."""
    n = 3000
    ids = spark.range(n).select(F.col("id").alias("i"))
    a = ids.select("i", F.col("i").alias("j"), F.lit(2.0).alias("v")).unionByName(ids.filter("i > 0").select("i", (F.col("i") - 1).alias("j"), F.lit(1.0).alias("v")))
    rounds = []
    due = L._due
    monkeypatch.setattr(L, "_due", lambda scratch, path: rounds.append(path) or due(scratch, path))
    monkeypatch.setattr(B, "_packed", lambda *_: pytest.fail("a dense block"))
    x = N.triangular_solve(a, T.ones(spark, n), lower=True).filter(f"i = {n - 1}").first().x
    assert abs(x - 1 / 3) < 1e-9 and len(rounds) < 8
    rounds.clear()
    assert N.incomplete_lu(a, n).count() == 2 * n - 1 and len(rounds) < 8
    assert N.symbolic_parallel(a, n).count() == 3 * n - 1


def test_rows_that_fill_in_too_much_go_by_blocks(spark):
    n = 50
    a = cells_of(spark, random_system(7, n, 0.2))
    entries = L.envelope(a)
    assert entries > n and L.patterns_fit(n, entries)
    assert not L.patterns_fit(10**6, 4000 * 10**6) and L.range_rows(10**6, 5 * 10**6) == L.RANGE


def test_zero_pivots_and_nothing(spark):
    a = spark.createDataFrame([(0, 1, 1.0), (1, 0, 3.0), (2, 2, 1.0)], T.MATRIX)
    assert {(r.i, r.j, r.v) for r in L.eliminate_rows(a, 3, False, 1).collect()} == {(0, 1, 1.0), (1, 0, 3.0), (2, 2, 1.0)}
    assert L.eliminate_rows(a.limit(0), 0, False).count() == 0
    b = T.ones(spark, 3)
    up = {r.i: r.x for r in L.solve_triangle(a.filter("i <= j"), b, 3, False, 2).collect()}
    assert up[2] == 1.0 and np.isinf(up[1]) and set(up) == {0, 1, 2}
    assert L.solve_triangle(a, b.limit(0), 3, True).count() == 0
