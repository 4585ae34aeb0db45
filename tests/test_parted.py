"""Factors by parts of the separator tree, against NumPy."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.functions import complexnum as C
from lattica.operators import parted, products as P, solver as S
from lattica.plans.local import Options
from lattica.sources import tables as T

SIDE = 12


@pytest.fixture(scope="module")
def turned(spark):
    """A grid with unequal values and rows turned by 5, and its dense form."""
    n = SIDE * SIDE
    a = T.laplacian(spark, SIDE).selectExpr(f"(i + 5) % {n} as i", "j", "v * (1 + j % 3) + case when i < j then 0.25 when i = j then i % 7 else 0 end as v")
    a = spark.createDataFrame(a.collect(), T.MATRIX).cache()
    return a, dense(a, n)


def dense(a, n):
    d = np.zeros((n, n), complex)
    for r in a.collect():
        d[r.i, r.j] = r.v if not hasattr(r.v, "re") else complex(r.v.re, r.v.im)
    return d


def worst(got, want):
    return got.join(want.select("i", "k", F.col("x").alias("t")), ["i", "k"]).agg(F.count("k"), F.max(F.abs(F.col("x") - F.col("t")))).first()


@pytest.mark.parametrize("top_rows", [1, 30, 1000])
def test_parts_factor_and_solve(spark, turned, top_rows):
    a, d = turned
    n = len(d)
    f = parted.factorize_parts(a, n, Options(relax=4, maxsup=8), part_rows=20, top_rows=top_rows)
    assert f.info == 0 and len(f.owned) > 4 and (top_rows > 1 or f.steps.max() > 1)
    at = f.tables()[0].collect()
    want = np.zeros((n, n))
    r, c, rs, cs = (np.array([x[k] for x in sorted(at)]) for k in ("r", "c", "rs", "cs"))
    want[np.ix_(r, c)] = d.real * rs[:, None] * cs[None, :]
    low, up = dense(f.triangle(True), n).real, dense(f.triangle(False), n).real
    assert (np.triu(low, 1) == 0).all() and (np.tril(up, -1) == 0).all()
    assert abs(low @ up - want).max() < 1e-12
    x = T.true_solution(spark, n, 2)
    for trans in (False, True):
        off = worst(f.solve(P.spmv(a, x, trans=trans), trans), x)
        assert off[0] == 2 * n and off[1] < 1e-10
    sign, size = f.logdet()
    assert (sign, pytest.approx(size)) == tuple(np.linalg.slogdet(d.real))


def test_parts_are_kept_and_saved(spark, turned, tmp_path):
    a, d = turned
    n, x = len(d), T.true_solution(spark, len(d), 2)
    o = Options(part_entries=100)
    with S.Solver(a, n, o) as solver:
        first = solver.factor
        assert isinstance(first, parted.PartedFactor)
        other = a.withColumn("v", F.col("v") * F.when(F.col("j") % 2 == 0, 2.0).otherwise(3.0))
        for same_rows in (False, True):
            solver.refactor(other, same_rows)
            assert solver.factor.order is first.order
            assert worst(solver.solve(P.spmv(other, x)).x, x)[1] < 1e-10
    parted.factorize_parts(a, n, o, part_rows=30).save(f"{tmp_path}/factor")
    assert worst(S.load_factor(spark, f"{tmp_path}/factor").solve(P.spmv(a, x)), x)[1] < 1e-10


def test_large_systems_go_by_parts(spark, turned, monkeypatch):
    """No pattern of more than ``part_entries`` is analysed in one place."""
    monkeypatch.setattr(S.local, "analyse", None)
    a, d = turned
    n = len(d)
    z = a.select("i", "j", C.make(F.col("v"), F.col("v") / (F.col("j") + 2)).alias("v"))
    for m, o in ((a, Options(part_entries=100, trans=True)), (a, Options(part_entries=100, col_perm="parallel_dissection")), (z, Options(part_entries=100))):
        x = T.ones(spark, n)
        got = S.solve(m, P.spmv(m, x, trans=o.trans), n, o)
        assert isinstance(got.factor, parted.PartedFactor) and got.meta.first().info == 0
        value = got.x.withColumn("x", F.col("x.re")) if m is z else got.x
        assert tuple(worst(value, x))[0] == n and worst(value, x)[1] < 1e-10
    x, bounds = S.mixed_precision(a, P.spmv(a, T.ones(spark, n)), n, Options(part_entries=100))
    assert worst(x, T.ones(spark, n))[1] < 1e-10 and bounds.first().berr < 1e-14
    bad = S.solve(a.filter("j != 7"), T.ones(spark, n), n, Options(part_entries=100))
    assert bad.meta.first().info == n + 8 and bad.x.filter("x is null").count() == n
