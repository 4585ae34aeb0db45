"""Trees by rounds of joins against the one-task kernels; matchings; the way by blocks as a whole."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.operators import analysis as N, blocks as B, matching as M, products as P, solver as S, trees as R
from lattica.plans import kernels as K
from lattica.plans.local import Options
from lattica.sources import tables as T


def frame(spark, cells):
    return spark.createDataFrame([(int(i), int(j), float(v)) for i, j, v in cells], T.MATRIX)


def random_cells(seed, n, count):
    rng = np.random.default_rng(seed)
    return list({(int(i), int(j), 1.0) for i, j in rng.integers(0, n, (count, 2))})


@pytest.mark.parametrize(("kind", "size"), [("symmetric", 17), ("column", 50), ("symmetric", 200)])
def test_trees_equal_the_kernels(spark, kind, size):
    n = 120
    cells = random_cells(5, n, 130)
    a = frame(spark, cells)
    got = R.elimination_tree(a, n, kind, B.in_order(a, n, size)).toPandas().sort_values("node").reset_index(drop=True)
    want = N.elimination_tree(a, n, kind).toPandas().sort_values("node").reset_index(drop=True)
    assert (got[want.columns] == want).all().all()


def test_tree_of_a_star_a_chain_and_nothing(spark):
    n = 40
    star = frame(spark, [(0, k, 1) for k in range(1, n)])
    got = R.elimination_tree(star, n, layout=B.in_order(star, n, 7)).orderBy("node").toPandas()
    assert got["parent"].tolist() == list(range(1, n + 1)) and got["level"].tolist() == list(range(n)) and got["post"].tolist() == list(range(n))
    none = R.elimination_tree(star.limit(0), 3).orderBy("node").toPandas()
    assert none["parent"].tolist() == [3, 3, 3] and none["post"].tolist() == [0, 1, 2] and none["descendants"].tolist() == [0, 0, 0]


def log_weight(cells, pairs):
    size = {(i, j): np.log(abs(v)) for i, j, v in cells}
    return sum(size[p] for p in pairs)


@pytest.mark.parametrize("kind", ["greedy fails", "random", "singular"])
def test_perfect_matching(spark, kind):
    rng = np.random.default_rng(1)
    if kind == "greedy fails":
        n, cells = 6, [(0, 0, 9), (0, 1, 1), (1, 0, 2), (2, 2, 1), (2, 3, 8), (3, 3, 1), (3, 4, 8), (4, 4, 1), (4, 5, 8), (5, 5, 0.5)]
        assert N.heavy_matching(frame(spark, cells)).count() < n
    elif kind == "random":
        n = 60
        found = {(k, int(c)): float(rng.lognormal() * 0.2) for k, c in enumerate(rng.permutation(n))}
        found |= {(int(i), int(j)): float(rng.lognormal()) for i, j in rng.integers(0, n, (220, 2))}
        cells = [(i, j, v) for (i, j), v in found.items()]
    else:
        n, cells = 4, [(0, 0, 1), (1, 0, 1), (2, 1, 1), (2, 2, 3), (3, 3, -1), (3, 1, 0)]
    m = M.heavy_perfect_matching(frame(spark, cells), n)
    pairs = [(r.src, r.dst) for r in m.pairs.collect()]
    assert len({s for s, _ in pairs}) == len({d for _, d in pairs}) == len(pairs) == n - m.missing
    assert m.missing == (kind == "singular")
    if not m.missing:
        c = np.array(cells)
        best = K.match_rows(n, c[:, 0].astype(int), c[:, 1].astype(int), np.abs(c[:, 2]), 5)
        most = log_weight(cells, enumerate(int(x) for x in best.perm))
        assert log_weight(cells, pairs) >= most - 0.25 * abs(most)  # no less than three quarters in logarithms


def test_heavy_weight_permutes_rows_in_the_solver(spark):
    n = 30
    cells = [(k, (k + 1) % n, 5.0) for k in range(n)] + [(k, k, 0.3) for k in range(n)]
    a, x = frame(spark, cells), T.true_solution(spark, n)
    got = S.solve(a, P.spmv(a, x), n, Options(row_perm="heavy_weight"))
    off = got.x.join(x.select("i", "k", F.col("x").alias("t")), ["i", "k"]).agg(F.max(F.abs(F.col("x") - F.col("t")))).first()[0]
    assert off < 1e-10


def test_solve_by_blocks_beyond_one_place(spark):
    """More entries than may be analysed in one place go by blocks, also transposed; singular systems are told."""
    n = 60
    rng = np.random.default_rng(2)
    cells = [(int(p), k, 8.0 + k % 3) for k, p in enumerate(rng.permutation(n))] + [(int(i), int(j), float(v)) for (i, j), v in zip(rng.integers(0, n, (90, 2)), rng.random(90), strict=True)]
    a = T.merge_duplicates(frame(spark, cells))
    x = T.true_solution(spark, n, 2)
    for trans in (False, True):
        got = S.solve(a, P.spmv(a, x, trans=trans), n, Options(analysis_entries=10, trans=trans))
        off = got.x.join(x.select("i", "k", F.col("x").alias("t")), ["i", "k"]).agg(F.count("k"), F.max(F.abs(F.col("x") - F.col("t")))).first()
        assert off[0] == 2 * n and off[1] < 1e-9
        assert got.meta.filter("berr < 1e-14 and info = 0").count() == 2
    bad = S.solve(frame(spark, [(0, 0, 1.0), (1, 0, 1.0), (2, 1, 1.0), (2, 2, 1.0)]), T.ones(spark, 3), 3, Options(col_perm="parallel_dissection", equilibrate=False))
    assert bad.meta.first().info == 4 and bad.x.filter("x is null").count() == 3


@pytest.mark.parametrize("shape", ["random", "chain", "star", "forest of singles", "no load", "empty"])
def test_forest_partition(spark, shape):
    rng = np.random.default_rng(6)
    n, parts, pieces = {"empty": 0}.get(shape, 90), 3, 2
    up = {"random": lambda k: int(rng.integers(k + 1, n + 1)), "chain": lambda k: k + 1, "star": lambda k: n - 1 if k < n - 1 else n}.get(shape, lambda k: n)
    parent = [up(k) for k in range(n)]
    load = [0 if shape == "no load" else int(x) for x in rng.integers(0, 9, n)]
    parents = spark.createDataFrame(list(enumerate(parent)), "node long, parent long")
    loads = spark.createDataFrame([(k, x) for k, x in enumerate(load) if x], "node long, load long")
    got = R.forest_partition(parents, n, loads, parts, pieces).orderBy("node").collect()
    assert [(r.node, r.parent, r.load) for r in got] == list(zip(range(n), parent, load, strict=True))
    total = load.copy()
    for k in range(n):  # parents come after their children
        if parent[k] < n:
            total[parent[k]] += total[k]
    assert [r.total for r in got] == total
    most, task = sum(load) // (pieces * parts), [r.task for r in got]
    held = [0] * parts
    for k in range(n):
        assert (task[k] == -1) == (total[k] > most)
        if task[k] >= 0:
            held[task[k]] += load[k]
            above = task[parent[k]] if parent[k] < n else -1
            assert above in (-1, task[k])  # nothing below another task
    assert max(held) <= sum(held) / parts + most


def test_trees_are_not_broadcast(spark):
    """Tables of a row a node are merged, however small they are written."""
    edges = spark.createDataFrame([(k, k + 1) for k in range(20)], "i long, j long")
    parents = R.elimination_parents(edges, 21)
    plan = parents._jdf.queryExecution().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    assert {(r.node, r.parent) for r in parents.collect()} == {(k, k + 1) for k in range(21)}
