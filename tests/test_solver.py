"""End-to-end solves, option grid, files."""

from __future__ import annotations

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.operators import analysis as N, elementwise as E, products as P, solver as S
from lattica.plans.local import Options
from lattica.sources import files, tables as T

FIVE = np.array([[19.0, 0, 21, 21, 0], [12, 21, 0, 0, 0], [0, 12, 16, 0, 0], [0, 0, 0, 5, 21], [12, 12, 0, 0, 18]])


def frame(spark, a):
    i, j = np.nonzero(a)
    return spark.createDataFrame(list(zip(i.tolist(), j.tolist(), a[i, j].tolist(), strict=True)), T.MATRIX)


def dense(x, n, nrhs=1):
    out = np.full((n, nrhs), np.nan)
    for r in x.collect():
        out[r.i, r.k] = np.nan if r.x is None else r.x
    return out


@pytest.fixture(scope="module")
def grid(spark):
    """An unsymmetric grid matrix of order 100 and its dense form."""
    a = T.laplacian(spark, 10).withColumn("v", F.expr("v + case when i < j then 0.25 when i = j then i % 7 else 0 end"))
    a = spark.createDataFrame(a.collect(), T.MATRIX).cache()
    d = np.zeros((100, 100))
    for r in a.collect():
        d[r.i, r.j] = r.v
    return a, d


def test_small_known_system(spark):
    a = frame(spark, FIVE)
    for o in (Options(), Options(row_perm="none", col_perm="natural"), Options(equilibrate=False, refine="none")):
        s = S.solve(a, T.ones(spark, 5), 5, o)
        assert np.allclose(FIVE @ dense(s.x, 5), 1)
    sign, logdet = S.factorize(a, 5).logdet()
    assert np.allclose([sign, logdet], np.linalg.slogdet(FIVE))


CASES = [(equed, fact, equil) for equed, facts in (("N", ("factored", "dofact", "same_pattern", "same_pattern_same_row_perm")), ("R", ("factored",)), ("C", ("factored",)), ("B", ("factored",))) for fact in facts for equil in (False, True)]


@pytest.mark.parametrize(("equed", "fact", "equil"), CASES)
def test_reuse_modes_meet_the_residual_criterion(spark, grid, equed, fact, equil):
    a, _ = grid
    ids = spark.range(100).withColumnRenamed("id", "i")
    rows = ids.withColumn("s", F.pow(F.lit(10.0), F.col("i") % 5)) if equed in "RB" else None
    cols = ids.withColumn("s", F.pow(F.lit(10.0), -(F.col("i") % 4))) if equed in "CB" else None
    a = E.scale(a, rows, cols)
    o = Options(equilibrate=equil, fact=fact)
    previous = None if fact == "dofact" else S.factorize(a if fact == "factored" else E.scale_add_identity(a, 1.5), 100, o.but(fact="dofact"))
    b = P.spmv(a, T.true_solution(spark, 100))
    s = S.solve(a, b, 100, o, previous)
    assert P.normalised_residual(a, s.x, b) < 20 and s.meta.first().info == 0
    if fact.startswith("same_pattern"):
        assert (s.factor.analysis.col_perm == previous.analysis.col_perm).all()
    if fact == "same_pattern_same_row_perm":
        assert s.factor.analysis is previous.analysis and s.factor.rows is previous.rows


@pytest.mark.parametrize(("trans", "rows", "nrhs"), list(itertools.product((False, True), (4000, 8), (1, 3))))
def test_one_task_and_subtrees_agree(spark, grid, trans, rows, nrhs):
    a, d = grid
    b = P.spmv(a, T.true_solution(spark, 100, nrhs), trans=trans)
    s = S.solve(a, b, 100, Options(trans=trans, task_rows=rows, relax=4, maxsup=8, refine="none"))
    assert np.allclose(dense(s.x, 100, nrhs), np.where(np.arange(100) % 2, 1.0, -1.0)[:, None])
    assert (s.factor.tasks > 1) == (rows == 8)
    assert np.allclose(s.factor.logdet(), np.linalg.slogdet(d))


def test_factors_multiply_to_the_permuted_matrix(spark, grid):
    a, d = grid
    f = S.factorize(a, 100, Options(task_rows=8, relax=4, maxsup=8))
    low, up = np.zeros((100, 100)), np.zeros((100, 100))
    for part, m in ((f.triangle(True), low), (f.triangle(False), up)):
        for r in part.collect():
            m[r.i, r.j] = r.v
    want = np.zeros((100, 100))
    want[np.ix_(f.analysis.row_to, f.analysis.col_to)] = d * f.rows[:, None] * f.cols[None, :]
    assert np.allclose(low @ up, want) and np.allclose(np.diag(low), 1)
    for lower, m in ((True, low), (False, up)):
        inverse = f.diagonal_inverses(lower).toPandas()
        assert set(inverse.i) == set(range(100))
        for _, block in inverse.groupby("s"):
            own = np.unique(block.i)
            got = np.zeros((100, 100))
            got[block.i, block.j] = block.v
            assert np.allclose(m[np.ix_(own, own)] @ got[np.ix_(own, own)], np.eye(len(own)))
    assert f.nonzeros()[0] >= (low != 0).sum() and [p for p, _ in f.stats] == ["EQUIL", "ANALYSIS", "FACT"]


def test_singular_systems_report_info(spark):
    a = FIVE.copy()
    a[2] = 0
    s = S.solve(frame(spark, a), T.ones(spark, 5), 5)
    assert s.factor.info == 3 and s.x.filter("x is not null").count() == 0
    a = FIVE.copy()
    a[:, 1] = 0
    assert S.factorize(frame(spark, a), 5).info == 7
    same = np.ones((3, 3))
    plain = Options(row_perm="none", col_perm="natural", equilibrate=False)
    assert S.factorize(frame(spark, same), 3, plain).info == 2
    assert S.factorize(frame(spark, same), 3, plain.but(replace_tiny_pivot=True)).tiny == 2
    gap = np.array([[1.0, 1, 0], [1, 1, 0], [1, 1, 0]])
    assert S.factorize(frame(spark, gap), 3, Options(equilibrate=False)).info == 4


def test_options_are_checked(spark):
    for bad in ({"relax": 300}, {"col_perm": "zoltan"}, {"fact": "x"}, {"match_job": 9}):
        with pytest.raises(ValueError):
            Options(**bad)
    with pytest.raises(ValueError):
        S.factorize(frame(spark, FIVE), 5, Options(fact="factored"))
    with pytest.raises(ValueError):
        S.factorize(frame(spark, FIVE), 5, Options(analysis_entries=3))


def test_given_permutations(spark):
    flip = spark.createDataFrame([(i, 4 - i) for i in range(5)], "src long, dst long")
    same = spark.createDataFrame([(i, i) for i in range(5)], "src long, dst long")
    s = S.solve(frame(spark, FIVE), T.ones(spark, 5), 5, Options(row_perm="given", col_perm="given"), row_perm=same, col_perm=flip)
    assert np.allclose(FIVE @ dense(s.x, 5), 1)


def test_mixed_precision_bounds(spark, grid):
    a, _ = grid
    true = T.true_solution(spark, 100, 2)
    x, bounds = S.mixed_precision(a, P.spmv(a, true), 100)
    err = {r.k: r for r in P.error_norms(x, true).collect()}
    for r in bounds.collect():
        assert err[r.k].err_norm <= r.norm_bound < 1e-13 and err[r.k].err_comp <= r.comp_bound < 1e-13 and r.berr < 1e-15


def test_batch_and_components(spark, grid):
    a, d = grid
    two = T.batch_from([a, frame(spark, FIVE)])
    rhs = spark.createDataFrame([(0, i, 0, 1.0) for i in range(100)] + [(1, i, k, 1.0 + k) for i in range(5) for k in (0, 1)], "batch_id long, i long, k int, x double")
    got = S.solve_batch(two, rhs).collect()
    small = {(r.i, r.k): r.x for r in got if r.batch_id == 1}
    assert np.allclose(FIVE @ [small[i, 1] for i in range(5)], 2) and sum(r.batch_id == 0 for r in got) == 100
    assert np.allclose([r.logdet for r in S.logdet_batch(two).orderBy("batch_id").collect()], [np.linalg.slogdet(m)[1] for m in (d, FIVE)])
    big = T.block_diagonal(frame(spark, FIVE), 5, 3)
    x = S.solve_components(big, T.ones(spark, 15)).collect()
    assert len(x) == 15 and np.allclose([r.x for r in sorted(x, key=lambda r: r.i)], np.tile(np.linalg.solve(FIVE, np.ones(5)), 3))


def test_triangular_tables(spark):
    a = frame(spark, FIVE)
    b = T.ones(spark, 5)
    low = dense(N.triangular_solve(a, b, lower=True), 5)
    assert np.allclose(np.tril(FIVE) @ low, 1)
    assert {r.part for r in N.symbolic(a).collect()} == {"L", "U"}


def test_scaling_products_and_errors(spark):
    a = frame(spark, FIVE)
    assert [P.norm(a, k) for k in "M1I"] == [21.0, 45.0, 61.0] and P.norm(a.limit(0), "1") == 0
    with pytest.raises(ValueError):
        P.norm(a, "2")
    e = P.equilibrate(a, 5, 5)
    r = {x.i: x.s for x in e.rows.collect()}
    assert r == {i: 1 / FIVE[i].max() for i in range(5)} and e.info == 0 and e.amax == 21
    assert P.equilibrate(a, 6, 6).info == 6 and P.equilibrate(a, 5, 6).info == 5 + 6
    assert {x.i: x.s for x in P.equilibrate(a, 5, 5, radix=True).rows.collect()} == {0: 1 / 16, 1: 1 / 16, 2: 1 / 16, 3: 1 / 16, 4: 1 / 16}
    assert [P.equilibration_kind(*x) for x in ((1, 1, 1), (0.01, 1, 1), (1, 0.01, 1), (0.01, 0.01, 1), (1, 1, 1e-300))] == ["N", "R", "C", "B", "R"]
    with pytest.raises(Exception, match="patterns differ"):
        E.scale_add(a, a.filter("i = 0"), 1.0).collect()
    assert P.normalised_residual(a.limit(0), T.ones(spark, 0), T.ones(spark, 0)) == 0
    y = P.spmv(a, T.ones(spark, 5), rows=7).orderBy("i").collect()
    assert [v.x for v in y] == [61, 33, 28, 26, 42, 0, 0]
    csc = T.from_csc(spark, [0, 1, 3], [1, 0, 1], [5.0, 6.0, 7.0])
    assert {(x.i, x.j, x.v) for x in csc.collect()} == {(1, 0, 5.0), (0, 1, 6.0), (1, 1, 7.0)}


def cells(df):
    return {(r.i, r.j): (complex(r.v.re, r.v.im) if hasattr(r.v, "re") else r.v) for r in df.collect()}


def test_text_files(spark, tmp_path):
    p = tmp_path / "a.mtx"
    p.write_text("%%MatrixMarket matrix coordinate real symmetric\n% note\n3 3 3\n1 1 2.0\n2 1 -1D0\n3 3 4\n")
    assert cells(files.read_matrix(spark, str(p))) == {(0, 0): 2.0, (1, 0): -1.0, (0, 1): -1.0, (2, 2): 4.0}
    assert cells(files.read_unit_lower(spark, str(p))) == {(0, 0): 1.0, (1, 0): -1.0, (2, 2): 1.0}
    p = tmp_path / "h.mtx"
    p.write_text("%%MatrixMarket matrix coordinate complex hermitian\n2 2 2\n1 1 2 0\n2 1 1 3\n")
    assert cells(files.read_matrix(spark, str(p), True)) == {(0, 0): 2, (1, 0): 1 + 3j, (0, 1): 1 - 3j}
    for name, head in (("r.mtx", "real general\n2 3 1\n1 1 1\n"), ("p.mtx", "pattern general\n2 2 1\n1 1\n"), ("o.mtx", "real general\n2 2 1\n1 5 1\n"), ("c.mtx", "complex general\n1 1 1\n1 1 1 1\n")):
        (tmp_path / name).write_text("%%MatrixMarket matrix coordinate " + head)
        with pytest.raises(ValueError):
            files.read_matrix(spark, str(tmp_path / name))
    (tmp_path / "t.dat").write_text("2 2 3\n0 0 1.5\n1 0 2\n1 1 3\n")
    (tmp_path / "t.datnh").write_text("1 1 1.5\n2 1 2\n2 2 3\n")
    want = {(0, 0): 1.5, (1, 0): 2.0, (1, 1): 3.0}
    assert cells(files.read_matrix(spark, str(tmp_path / "t.dat"))) == want == cells(files.read_matrix(spark, str(tmp_path / "t.datnh")))
    (tmp_path / "b.rhs").write_text("1.5\n-2\n 3e1\n")
    assert [(r.i, r.x) for r in files.read_rhs(spark, str(tmp_path / "b.rhs")).orderBy("i").collect()] == [(0, 1.5), (1, -2.0), (2, 30.0)]
    with pytest.raises(ValueError):
        files.read_matrix(spark, "x.unknown")


def boeing(kind, ptr, ind, values, rutherford=False):
    cards = lambda xs, per, width: ["".join(str(x).rjust(width) for x in xs[k : k + per]) for k in range(0, len(xs), per)]
    body = [cards(ptr, 10, 8), cards(ind, 10, 8), cards([f"{v:.10E}" for v in values], 4, 20)]
    counts = [len(c) for c in body]
    lines = ["title".ljust(72) + "key", "".join(str(x).rjust(14) for x in [sum(counts), *counts] + ([] if rutherford else [0]))]
    lines += [kind.ljust(14) + "".join(str(x).rjust(14) for x in (len(ptr) - 1, len(ptr) - 1, len(ind), 0)), "(10I8)".ljust(16) + "(10I8)".ljust(16) + "(1P,4E20.10)".ljust(20)]
    return "\n".join(lines + [x for c in body for x in c]) + "\n"


def test_fixed_column_files(spark, tmp_path):
    (tmp_path / "a.rua").write_text(boeing("RUA", [1, 3, 4, 6], [1, 3, 2, 1, 3], [1.5, -2, 3, 4, 5]))
    want = {(0, 0): 1.5, (2, 0): -2.0, (1, 1): 3.0, (0, 2): 4.0, (2, 2): 5.0}
    assert cells(files.read_matrix(spark, str(tmp_path / "a.rua"))) == want
    (tmp_path / "a.rb").write_text(boeing("rsa", [1, 3, 4, 4], [1, 3, 2], [1, 2, 3], True))
    assert cells(files.read_matrix(spark, str(tmp_path / "a.rb"))) == {(0, 0): 1.0, (2, 0): 2.0, (0, 2): 2.0, (1, 1): 3.0}
    (tmp_path / "a.cua").write_text(boeing("CUA", [1, 2, 3], [1, 2], [1, 2, 3, -4]))
    assert cells(files.read_matrix(spark, str(tmp_path / "a.cua"), True)) == {(0, 0): 1 + 2j, (1, 1): 3 - 4j}
    with pytest.raises(ValueError):
        files.decode_cards(boeing("PUA", [1, 2], [1], []), False)


def test_binary_and_written_files(spark, tmp_path):
    (tmp_path / "m.bin").write_bytes(files.encode_binary(2, [0, 1, 3], [1, 0, 1], [5.0, 6.0, 7.0]))
    a = files.read_matrix(spark, str(tmp_path / "m.bin"))
    assert cells(a) == {(1, 0): 5.0, (0, 1): 6.0, (1, 1): 7.0}
    files.write_matrix(a, str(tmp_path / "m.parquet"))
    files.write_matrix(a, str(tmp_path / "m.datnh"), "triplets")
    assert cells(files.read_matrix(spark, str(tmp_path / "m.parquet"))) == cells(a) == cells(files.read_matrix(spark, str(tmp_path / "m.datnh")))


def test_entry_queries_have_matching_names(spark):
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert set(entry.oracle_sql()) <= names and len([n for n in names if not n.startswith("op")]) > 60


def complex_frame(spark, a):
    i, j = np.nonzero(a)
    return spark.createDataFrame([(int(p), int(q), (float(z.real), float(z.imag))) for p, q, z in zip(i, j, a[i, j], strict=True)], files.COMPLEX)


ZFIVE = FIVE + 1j * np.tril(FIVE, -1) / 3


def complex_sides(spark, b):
    return spark.createDataFrame([(i, k, (float(z.real), float(z.imag))) for (i, k), z in np.ndenumerate(b)], "i long, k int, x struct<re:double,im:double>")


def complex_dense(x, n, nrhs=1):
    out = np.zeros((n, nrhs), complex)
    for r in x.collect():
        out[r.i, r.k] = complex(r.x.re, r.x.im)
    return out


def test_complex_products_and_norms(spark):
    a, x = complex_frame(spark, ZFIVE), np.arange(10).reshape(5, 2) * (1 - 2j) + 1
    v = complex_sides(spark, x)
    assert np.allclose(complex_dense(P.spmv(a, v), 5, 2), ZFIVE @ x)
    assert np.allclose(complex_dense(P.spmv(a, v, trans=True, conj=True), 5, 2), ZFIVE.conj().T @ x)
    assert np.allclose(complex_dense(P.spmv(a, T.ones(spark, 5)), 5), ZFIVE @ np.ones((5, 1)))
    assert np.allclose(complex_dense(P.gemv(a, v, T.ones(spark, 5, 2), 2.0, -1.0), 5, 2), 2 * ZFIVE @ x - 1)
    assert np.allclose(complex_dense(P.gemv(a, v, v, 2.0, -1.0, trans=True, conj=True), 5, 2), 2 * ZFIVE.conj().T @ x - x)
    turned = ZFIVE * (1 + 2j)
    left = turned - np.outer(turned[:, 0], turned[0]) / turned[0, 0]
    got = cells(P.schur_step(complex_frame(spark, turned), 0))
    assert np.allclose([got.get((i, j), 0) for i in range(1, 5) for j in range(1, 5)], left[1:, 1:].ravel())
    assert np.allclose([P.norm(a, k) for k in "M1IF"], [abs(ZFIVE).max(), *(np.linalg.norm(ZFIVE, o) for o in (1, np.inf, "fro"))])
    assert np.allclose([cells(P.matmul(a, frame(spark, FIVE))).get((i, j), 0) for i in range(5) for j in range(5)], (ZFIVE @ FIVE).ravel())
    e = P.error_norms(v, complex_sides(spark, x + 0.5j)).orderBy("k").collect()
    assert np.allclose([r.err_norm for r in e], 0.5 / abs(x).max(axis=0)) and np.allclose([r.err_comp for r in e], 0.5 / abs(x).min(axis=0))


def test_complex_solves(spark):
    a, b = complex_frame(spark, ZFIVE), np.array([[1 + 1j], [2], [3j], [0], [-1]])
    s = S.solve(a, complex_sides(spark, b), 5)
    assert np.allclose(ZFIVE @ complex_dense(s.x, 5), b) and s.meta.first().berr < 1e-15
    assert np.allclose(FIVE @ complex_dense(S.solve(frame(spark, FIVE), complex_sides(spark, b), 5).x, 5), b)
    one = lambda df: df.withColumn("batch_id", F.lit(3).cast("long"))
    x = S.solve_batch(one(a), one(complex_sides(spark, b)))
    assert np.allclose(ZFIVE @ complex_dense(x, 5), b) and {r.batch_id for r in x.collect()} == {3}
    got = S.logdet_batch(one(a)).first()
    assert np.allclose([complex(got.sign.re, got.sign.im), got.logdet], np.linalg.slogdet(ZFIVE))
    assert np.allclose(ZFIVE @ complex_dense(S.solve_components(a, complex_sides(spark, b)), 5), b)
    low = N.triangular_solve(a, complex_sides(spark, b), trans=True, conj=True)
    assert np.allclose(np.tril(ZFIVE).conj().T @ complex_dense(low, 5), b)


def test_solver_keeps_and_frees_its_factors(spark):
    with S.Solver(frame(spark, FIVE), 5) as solver:
        assert np.allclose(FIVE @ dense(solver.solve(T.ones(spark, 5)).x, 5), 1)
        assert np.allclose(solver.logdet(), np.linalg.slogdet(FIVE))
        for same_rows in (False, True):
            solver.refactor(frame(spark, 3 * FIVE), same_rows)
            assert np.allclose(3 * FIVE @ dense(solver.solve(T.ones(spark, 5)).x, 5), 1)
        low, up = solver.factor.extremes()
        assert low >= 1 and up > 0 and solver.factor.memory().first().value_bytes > 0
    with pytest.raises(ValueError):
        solver.solve(T.ones(spark, 5))


def test_storage_and_schedules(spark):
    a = frame(spark, np.array([[2.0, 0, 1], [0, 0, 3], [4, 5, 6]]))
    msr = [(r.at, r.val, r.bindx) for r in E.to_msr(a, 3).orderBy("at").collect()]
    assert msr == [(0, 2.0, 4), (1, 0.0, 5), (2, 6.0, 6), (3, None, 8), (4, 1.0, 2), (5, 3.0, 2), (6, 4.0, 0), (7, 5.0, 1)]
    wide = E.to_msr(complex_frame(spark, np.array([[2j, 1 + 1j], [0, 0]])), 2).orderBy("at").collect()
    assert [(r.at, r.val and (r.val.re, r.val.im), r.bindx) for r in wide] == [(0, (0.0, 2.0), 3), (1, (0.0, 0.0), 4), (2, None, 4), (3, (1.0, 1.0), 1)]
    for perm in itertools.permutations(range(4)):
        odd = round(np.linalg.det(np.eye(4)[list(perm)]))
        if perm in ((0, 1, 2, 3), (1, 0, 2, 3), (1, 2, 0, 3), (1, 2, 3, 0)):
            assert E.permutation_sign(spark.createDataFrame(list(enumerate(perm)), "src long, dst long"), 4) == odd
    assert [r.level for r in N.level_sets(frame(spark, FIVE), 5).orderBy("node").collect()] == [0, 1, 2, 0, 2]
    work = spark.createDataFrame([(0, 3.0), (1, 5.0), (2, 4.0), (3, 1.0)], "item long, load double")
    assert [r.part for r in N.static_partition(work, 2).orderBy("item").collect()] == [1, 0, 1, 0]


def test_matrix_market_is_written_and_read(spark, tmp_path):
    files.write_matrix(frame(spark, FIVE), str(tmp_path / "a.mtx"), "market", 5)
    files.write_matrix(complex_frame(spark, ZFIVE), str(tmp_path / "z.mtx"), "market", 5)
    assert cells(files.read_matrix(spark, str(tmp_path / "a.mtx"))) == cells(frame(spark, FIVE))
    assert cells(files.read_matrix(spark, str(tmp_path / "z.mtx"), True)) == cells(complex_frame(spark, ZFIVE))
    for bad in ({"kind": "market"}, {"kind": "x"}):
        with pytest.raises(ValueError):
            files.write_matrix(frame(spark, FIVE), str(tmp_path / "b"), **bad)


def test_level_sets_beyond_eight(spark, tmp_path):
    import __spark_entry__ as entry

    rng = np.random.default_rng(11)
    n = 60
    cells = [(i, j, 1.0) for i in range(n) for j in range(max(0, i - 2), i + 1) if i == j or rng.random() < 0.7]
    want = [0] * n
    for i, j, _ in sorted(cells):
        if j < i:
            want[i] = max(want[i], want[j] + 1)
    got = {r.node: r.level for r in N.level_sets(spark.createDataFrame(cells, "i long, j long, v double"), n).collect()}
    assert got == dict(enumerate(want)) and max(want) > 20
    lines = [(k % 50, k % 7, 0.5) for k in range(400)]
    spark.createDataFrame(lines, "l_partkey long, l_suppkey long, l_discount double").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(50).withColumnRenamed("id", "p_partkey").write.parquet(f"{tmp_path}/part.parquet")
    assert max(r.lev for r in entry.queries()["level_sets"](spark, str(tmp_path)).collect()) > 8


def greedy(cells):
    rows, cols, out = set(), set(), set()
    for i, j, _ in sorted(cells, key=lambda c: (-c[2], c[0], c[1])):
        if i not in rows and j not in cols:
            rows.add(i)
            cols.add(j)
            out.add((i, j))
    return out


@pytest.mark.parametrize("max_rounds", [50, 2])
def test_heavy_matching_takes_every_entry(spark, max_rounds):
    n = 56 if max_rounds == 50 else 300
    chain = [(i, i, 2.0 * i + 1) for i in range(n)] + [(i, i + 1, 2.0 * i + 2) for i in range(n - 1)]
    rng = np.random.default_rng(12)
    ties = [(i, j, float(rng.integers(1, 4))) for i in range(40) for j in range(40) if rng.random() < 0.2]
    for cells in [chain] if max_rounds == 50 else [chain, ties]:
        got = N.heavy_matching(spark.createDataFrame(cells, "i long, j long, v double"), max_rounds)
        assert {tuple(r) for r in got.collect()} == greedy(cells)


def test_saved_factor_is_checked(spark, tmp_path):
    a = T.laplacian(spark, 6)
    f = S.factorize(a, 36, Options(task_rows=8))
    f.save(str(tmp_path / "factor"))
    again = S.load_factor(spark, str(tmp_path / "factor"))
    b = P.spmv(a, T.true_solution(spark, 36))
    assert {(r.i, round(r.x, 9)) for r in again.solve(b).collect()} == {(i, 1.0 if i % 2 else -1.0) for i in range(36)}
    assert again.logdet() == f.logdet() and again.options == f.options
    f.blocks.limit(1).write.mode("overwrite").parquet(str(tmp_path / "factor" / "blocks"))
    with pytest.raises(ValueError):
        S.load_factor(spark, str(tmp_path / "factor"))


@pytest.mark.parametrize(("kind", "suffix"), [("boeing", "rua"), ("rutherford", "rb"), ("sized_triplets", "dat")])
def test_headed_files_keep_every_bit(spark, tmp_path, kind, suffix):
    cells = [(0, 0, 1 / 3), (3, 0, -2.5e-300), (1, 1, 7.0), (0, 2, 1e17 / 3), (2, 2, -0.1), (3, 3, 5e-9)]
    a = spark.createDataFrame(cells, "i long, j long, v double")
    path = str(tmp_path / f"m.{suffix}")
    files.write_matrix(a, path, kind, 4)
    assert sorted(map(tuple, files.read_matrix(spark, path).collect())) == sorted(cells)
    if kind != "sized_triplets":
        with pytest.raises(ValueError):
            files.write_matrix(a, path, kind)


@pytest.mark.parametrize("trans", [False, True])
def test_steps_of_a_chain(spark, monkeypatch, trans):
    """In natural order a band is one chain: its tasks follow each other in steps, none holds much more than its share of rows."""
    monkeypatch.setattr(S, "STEP_ROWS", 100)
    n = 400
    cells = [(int(a), int(a + d), 20.0 if d == 0 else 1.0 + (a * 7 + d) % 3) for a in range(n) for d in (-2, -1, 0, 1, 2) if 0 <= a + d < n]
    a = spark.createDataFrame(cells, T.MATRIX)
    x = T.true_solution(spark, n, 2)
    o = Options(task_rows=10, col_perm="natural", row_perm="none", equilibrate=False, refine="none", relax=4, trans=trans)
    f = S.factorize(a, n, o)
    rows = {r.task: r.p for r in f.blocks.groupBy("task").agg(F.sum("p").alias("p")).collect()}
    assert sum(rows.values()) == n and max(rows.values()) <= 150 and len(f.ranges()) >= 3
    got = {(r.i, r.k): r.x for r in f.solve(P.spmv(a, x, trans=trans), trans).collect()}
    assert len(got) == 2 * n and max(abs(got[r.i, r.k] - r.x) for r in x.collect()) < 1e-9
    low, up = (f.triangle(lower).count() for lower in (True, False))
    assert low == up == 3 * n - 3


def test_analysis_is_not_sent_whole_to_tasks(spark, monkeypatch):
    """Tasks read their own part of written tables: nothing is broadcast from the driver's Python."""
    sent = []
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda self, value: sent.append(value))
    n = 60
    a = T.laplacian(spark, 8).filter(f"i < {n} and j < {n}")
    got = S.solve(a, P.spmv(a, T.true_solution(spark, n)), n, Options(task_rows=10))
    assert got.x.count() == n and not sent
