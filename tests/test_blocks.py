"""Separator trees, block factors and their solves against the one-task kernels and NumPy."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.functions import complexnum as C
from lattica.operators import analysis as N, blocks as B, dissection as D, products as P
from lattica.plans import kernels as K, local
from lattica.plans.scratch import Scratch
from lattica.sources import tables as T


def frame(spark, cells):
    return spark.createDataFrame([(int(i), int(j), float(v)) for i, j, v in cells], T.MATRIX)


def fill(n, i, j, perm):
    return sum(len(c) for c in K.symbolic(n, perm[i], perm[j])[0])


def places(d, n):
    perm = np.full(n, -1)
    o = d.order.toPandas()
    perm[o["i"]] = o["pos"]
    assert sorted(perm) == list(range(n))
    return perm, dict(zip(o["i"], zip(o["height"], o["node"], strict=True), strict=True))


def check_separated(home, pairs):
    for x, y in pairs:
        (h, low), (up, high) = sorted([home[x], home[y]])
        assert low >> (up - h) == high


@pytest.fixture(scope="module")
def grid(spark):
    return T.laplacian(spark, 18).cache(), 324


def test_dissection_of_a_grid(grid):
    a, n = grid
    d = D.dissect(a, n, leaf=45, coarse=120)
    perm, home = places(d, n)
    p = a.toPandas()
    i, j = p["i"].to_numpy(), p["j"].to_numpy()
    check_separated(home, zip(i, j, strict=True))
    tree = d.tree.toPandas()
    assert tree["size"].sum() == n and tree.loc[tree["height"] == 0, "size"].max() <= 60
    firsts = tree.sort_values("first")
    assert (firsts["first"].to_numpy() == np.concatenate(([0], np.cumsum(firsts["size"])[:-1]))).all()
    kernel = K.nested_dissection(K.symmetric_columns(n, i, j))
    mine = fill(n, i, j, perm)
    assert mine < fill(n, i, j, np.arange(n)) and mine < 2 * fill(n, i, j, kernel)


@pytest.mark.parametrize("kind", ["star", "apart", "clique", "none"])
def test_dissection_of_odd_graphs(spark, kind):
    n = 150
    cells = {
        "star": [(0, k, 1) for k in range(1, n)],
        "apart": [(k, k + 1, 1) for k in range(n - 1) if k % 3 != 2],
        "clique": [(a, b, 1) for a in range(40) for b in range(a)],
        "none": [(0, 0, 1)],
    }[kind]
    d = D.dissect(frame(spark, cells), n, leaf=80, coarse=40 if kind == "star" else 200)
    _, home = places(d, n)
    check_separated(home, [(x, y) for x, y, _ in cells])
    if kind == "star":
        assert sum(h > 0 for h, _ in home.values()) == 1


@pytest.mark.parametrize("mixed", [False, True])
def test_dissection_by_pieces(spark, mixed):
    """Ranges of a grid are halved by number, mixed numbers by coarsening; a part is cut to the end by one task."""
    k = 24
    n = k * k
    cells = [(x, y, 1) for x in range(n) for y in (x + 1, x + k) if y < n and (y != x + 1 or y % k)]
    if mixed:
        to = np.random.default_rng(3).permutation(n)
        cells = [(to[x], to[y], 1) for x, y, _ in cells]
    d = D.dissect(frame(spark, cells), n, leaf=40, coarse=60, piece=140)
    perm, home = places(d, n)
    check_separated(home, [(int(x), int(y)) for x, y, _ in cells])
    i, j = np.array([c[0] for c in cells]), np.array([c[1] for c in cells])
    i, j = np.concatenate((i, j)), np.concatenate((j, i))
    kernel = K.nested_dissection(K.symmetric_columns(n, i, j))
    assert fill(n, i, j, perm) < 1.5 * fill(n, i, j, kernel)


def test_dissection_of_a_band_writes_few_tables(spark, monkeypatch):
    """Depth costs no rounds of joins where numbers tell who is near whom."""
    written = []
    keep = Scratch.keep
    monkeypatch.setattr(Scratch, "keep", lambda self, df, *rest: written.append(1) or keep(self, df, *rest))
    n = 3000
    d = D.dissect(frame(spark, [(x, x + s, 1) for x in range(n - 2) for s in (1, 2)]), n, leaf=20, piece=500)
    _, home = places(d, n)
    check_separated(home, [(x, x + 1) for x in range(n - 2)])
    assert d.depth >= 7 and len(written) <= 8


@pytest.mark.parametrize("size", [37, 1000])
def test_factor_entries_are_counted(grid, spark, size):
    """As many as the one-task kernel lists, in natural, mixed and dissected orders, by ranges of any width."""
    a, n = grid
    p = a.toPandas()
    i, j = p["i"].to_numpy(), p["j"].to_numpy()
    mixed = np.random.default_rng(5).permutation(n)
    kernel = K.nested_dissection(K.symmetric_columns(n, i, j))
    assert N.factor_entries(a, n, size=size) == fill(n, i, j, np.arange(n))
    for perm in (mixed, kernel):
        order = spark.createDataFrame([(k, int(x)) for k, x in enumerate(perm)], "src long, dst long")
        assert N.factor_entries(a, n, order, size) == fill(n, i, j, perm)
    assert N.factor_entries(a.filter("i = j"), n, size=size) == n


def test_entries_of_blocks_do_not_go_through_the_driver(grid):
    a, n = grid
    plan = B._entries(a, B.in_order(a, n, 64))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_small_split_is_even():
    n = 64
    u = np.arange(n - 1)
    part = D.split_small(np.ones(n), np.concatenate((u, u + 1)), np.concatenate((u + 1, u)), np.ones(2 * n - 2), 2)
    assert np.bincount(part).tolist() == [16] * 4
    assert (np.diff(part) != 0).sum() == 3  # a path is cut thrice


def random_system(seed, n, share, wide=False):
    rng = np.random.default_rng(seed)
    m = np.where(rng.random((n, n)) < share, rng.standard_normal((n, n)), 0.0)
    m = m + 1j * np.where(m != 0, rng.standard_normal((n, n)), 0) if wide else m
    m[np.arange(n), np.arange(n)] = np.abs(m).sum(1) + 1
    return m


def cells_of(spark, m):
    i, j = np.nonzero(m)
    if np.iscomplexobj(m):
        rows = [(int(x), int(y), float(m[x, y].real), float(m[x, y].imag)) for x, y in zip(i, j, strict=True)]
        return spark.createDataFrame(rows, "i long, j long, re double, im double").select("i", "j", C.make(F.col("re"), F.col("im")).alias("v"))
    return frame(spark, [(x, y, m[x, y]) for x, y in zip(i, j, strict=True)])


@pytest.mark.parametrize(("wide", "size"), [(False, 16), (True, 7)])
def test_values_by_blocks(spark, wide, size):
    n = 45
    m = random_system(3, n, 0.06, wide)
    a = cells_of(spark, m)
    f = B.factorize_blocks(a, n, B.in_order(a, n, size))
    e = f.entries()
    value = F.col("v.re") if wide else F.col("v")
    imag = F.col("v.im") if wide else F.lit(0.0)
    p = e.select("part", "i", "j", value.alias("re"), imag.alias("im")).toPandas()
    low, up = np.zeros((n, n), complex), np.zeros((n, n), complex)
    for part, i, j, re, im in p.itertuples(index=False):
        (low if part == "L" else up)[i, j] = re + 1j * im
    assert np.allclose(low @ up, m) and np.allclose(low, np.tril(low)) and np.allclose(up, np.triu(up))
    x = T.true_solution(spark, n, 2)
    got = f.solve(P.spmv(a, x)).join(x.select("i", "k", F.col("x").alias("t")), ["i", "k"])
    off = F.abs(C.widen(F.col("x"), wide)["re"] - F.col("t")) + F.abs(C.widen(F.col("x"), wide)["im"])
    r = got.agg(F.count("k").alias("n"), F.max(off).alias("off")).first()
    assert r.n == 2 * n and r.off < 1e-9


def test_tree_layout_patterns_and_no_fill(grid):
    a, n = grid
    d = D.dissect(a, n, leaf=60, coarse=120)
    perm, _ = places(d, n)
    layout = B.by_tree(d, 16)
    p = a.toPandas()
    i, j = perm[p["i"]], perm[p["j"]]
    low, up = K.symbolic(n, i, j)
    want = {("L", int(r), c) for c, x in enumerate(low) for r in x} | {("U", int(r), c) for c, x in enumerate(up) for r in x} | {("U", c, c) for c in range(n)}
    got = B.factorize_blocks(a, n, layout, B.Pattern()).entries().toPandas()
    assert {(part, int(perm[r]), int(perm[c])) for part, r, c in zip(got["part"], got["i"], got["j"], strict=True)} == want
    ilu = dict(zip(zip(p["i"], p["j"], strict=True), local.ilu0(n, i, j, p["v"].to_numpy()), strict=True))
    e = B.factorize_blocks(a, n, layout, B.NoFill()).entries().toPandas()
    mine = {(r, c): v for part, r, c, v in zip(e["part"], e["i"], e["j"], e["v"], strict=True) if not (part == "L" and r == c)}
    assert set(mine) == set(ilu) and max(abs(mine[k] - ilu[k]) for k in ilu) < 1e-12


def test_zero_pivot_and_nothing(spark):
    a = frame(spark, [(0, 1, 1.0), (1, 0, 1.0), (2, 2, 1.0)])
    f = B.factorize_blocks(a, 3, B.in_order(a, 3, 2))
    assert f.info == 1
    assert B.factorize_blocks(a, 3, B.in_order(a, 3, 2), B.Values(threshold=1e-8)).tiny == 1
    none = a.limit(0)
    empty = B.factorize_blocks(none, 0, B.in_order(none, 0, 4))
    assert empty.solve(T.ones(spark, 1).limit(0)).count() == 0


def test_levels_by_need(spark):
    a = frame(spark, [(k, k, 2.0) for k in range(12)] + [(9, 0, 1.0), (6, 3, 1.0), (11, 6, 1.0)])
    layout = B.by_need(a, 12, 3)
    levels = {r.block: r.level for r in layout.places.collect()}
    assert levels == {0: 0, 3: 0, 6: 1, 9: 2} and layout.levels == 3


@pytest.mark.parametrize(("lower", "unit", "trans", "wide"), [(True, True, False, False), (False, False, False, False), (True, False, True, True), (False, True, True, False)])
def test_triangles_of_several_blocks(spark, lower, unit, trans, wide):
    n = 40
    m = random_system(9, n, 0.15, wide)
    t = np.tril(m) if lower else np.triu(m)
    if unit:
        np.fill_diagonal(t, 1.0)
        t = np.where(np.eye(n) == 1, t, t / 20)
    a = cells_of(spark, t)
    full = t.conj().T if trans and wide else t.T if trans else t
    x = np.where(np.arange(n) % 2 == 1, 1.0, -1.0)
    b = full @ x
    kind = "i long, k int, re double, im double"
    rhs = spark.createDataFrame([(i, 0, float(v.real), float(v.imag)) for i, v in enumerate(b)], kind)
    rhs = rhs.select("i", "k", C.make(F.col("re"), F.col("im")).alias("x")) if wide else rhs.select("i", "k", F.col("re").alias("x"))
    got = N.triangular_solve(a, rhs, lower, unit, trans, conj=wide, size=8)
    p = got.select("i", C.widen(F.col("x"), wide)["re"].alias("re"), C.widen(F.col("x"), wide)["im"].alias("im")).toPandas().sort_values("i")
    assert len(p) == n and np.allclose(p["re"], x) and np.allclose(p["im"], 0.0)


@pytest.mark.parametrize("wide", [False, True])
def test_gap_of_factors_by_blocks(spark, wide, monkeypatch):
    """L U - A block by block: nothing for the matrix itself, what was changed for another; no entry is sent by itself."""
    n = 45
    m = random_system(3, n, 0.06, wide)
    a = cells_of(spark, m)
    f = B.factorize_blocks(a, n, B.in_order(a, n, 16))
    m[40, 2] += 0.5
    monkeypatch.setattr(B.BlockFactor, "entries", lambda *_: pytest.fail("entries"))
    assert f.worst_gap(a).first().worst < 1e-9
    assert abs(f.worst_gap(cells_of(spark, m)).first().worst - 0.5) < 1e-9


def test_what_waited_for_a_level_is_deleted(spark):
    n = 45
    a = cells_of(spark, random_system(3, n, 0.06))
    f = B.factorize_blocks(a, n, B.in_order(a, n, 16))
    assert B._due(f.scratch, f"{f.path}/pieces/round=*/level=0") is None and f.blocks().count() == 9
