"""Minimum degree by rounds: fill against the one-task kernel and natural order, forests without fill, edge cases."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.operators import degree as G
from lattica.plans import kernels as K
from lattica.sources import tables as T


def frame(spark, cells):
    return spark.createDataFrame([(int(i), int(j), 1.0) for i, j in cells], T.MATRIX)


def places(order, n):
    got = order.toPandas().sort_values("src")
    assert got["src"].tolist() == list(range(n)) and sorted(got["dst"]) == list(range(n))
    return got["dst"].to_numpy()


def fill(near, at):
    """Entries of L below the diagonal when nodes go in the order ``at`` (by elimination on sets)."""
    left, total = [set(s) for s in near], 0
    for k in np.argsort(at):
        own = left[k]
        total += len(own)
        for x in own:
            left[x] |= own
            left[x] -= {x, int(k)}
    return total


def neighbours(n, groups):
    near = [set() for _ in range(n)]
    for g in groups:
        for x in g:
            near[x] |= set(g) - {x}
    return near


def kernel_fill(near):
    return fill(near, K.minimum_degree([np.array(sorted(s), np.int64) for s in near]))


@pytest.mark.parametrize("tail", [0, 40])
def test_fill_of_a_grid(spark, tail):
    k = 9
    a = T.laplacian(spark, k)
    pairs = [(r.i, r.j) for r in a.collect() if r.i != r.j]
    near = neighbours(k * k, pairs)
    got = fill(near, places(G.minimum_degree(a, k * k, tail=tail), k * k))
    assert got < fill(near, np.arange(k * k)) and got <= 1.3 * kernel_fill(near)


def test_fill_of_columns_without_their_product(spark):
    rng = np.random.default_rng(3)
    n = 60
    groups = [sorted({int(x) % n for x in (k + rng.integers(0, 6, 3))}) for k in range(n)] + [list(range(n))[::2]]
    cells = [(r, c) for r, g in enumerate(groups) for c in g]
    near = neighbours(n, groups)
    got = fill(near, places(G.minimum_degree(frame(spark, cells), n, "column", tail=10), n))
    assert got <= 1.3 * kernel_fill(near)


@pytest.mark.parametrize("kind", ["symmetric", "column"])
def test_a_forest_makes_no_fill(spark, kind):
    rng = np.random.default_rng(4)
    n = 80
    up = [(k, int(rng.integers(0, max(1, k // 3)))) for k in range(1, n - 5)]  # hubs near 0, five rows alone
    cells = [(k, p) for k, p in up] + ([(k, k) for k, _ in up] if kind == "column" else [])
    got = places(G.minimum_degree(frame(spark, cells), n, kind, tail=0), n)
    assert fill(neighbours(n, up), got) == len(up)


def test_nothing_repeats_and_wide_rows(spark):
    none = frame(spark, [(0, 0)]).limit(0)
    assert places(G.minimum_degree(none, 3), 3).tolist() == [0, 1, 2]
    assert places(G.minimum_degree(frame(spark, [(1, 1), (1, 1)]), 2), 2).tolist() == [0, 1]
    twice = frame(spark, [(0, 1), (0, 1), (1, 0), (1, 2)])
    once = frame(spark, [(0, 1), (1, 2)])
    assert (places(G.minimum_degree(twice, 3, tail=0), 3) == places(G.minimum_degree(once, 3, tail=0), 3)).all()
    n = 150  # one row of all columns makes no element, so pairs are as if it were not there
    pairs = [(k, c) for k in range(0, n, 2) for c in (k, k + 1)]
    wide = frame(spark, pairs + [(n, c) for c in range(n)])
    assert (places(G.minimum_degree(wide, n, "column"), n) == places(G.minimum_degree(frame(spark, pairs), n, "column"), n)).all()
    clique = frame(spark, [(0, c) for c in range(9)])
    places(G.minimum_degree(clique, 9, "column", tail=0), 9)
    with pytest.raises(ValueError):
        G.minimum_degree(once, 3, "rows")


def test_stars_on_a_hub_meet_in_no_square_and_make_no_fill(spark):
    """Stars of 9 leaves on one of 3 hubs, and the hubs on a root that is lighter than the stars' centres: hubs come before the root."""
    centres, hubs = 60, 3
    cells = [(100 + c * 9 + k, 10 + c, 1.0) for c in range(centres) for k in range(9)]
    cells += [(10 + c, 1 + c % hubs, 1.0) for c in range(centres)] + [(1 + h, 0, 1.0) for h in range(hubs)]
    n = 100 + centres * 9
    a = spark.createDataFrame(cells, T.MATRIX)
    for kind, given in (("symmetric", a), ("column", a.unionByName(a.select("i", F.col("i").alias("j"), "v")))):
        at = {r.src: r.dst for r in G.minimum_degree(given, n, kind, tail=0).collect()}
        later = [min(at[i], at[j]) for i, j, _ in cells]
        assert len(set(later)) == len(later), kind  # none has two neighbours after it


def test_lone_elements_are_counted_not_compared(spark):
    """Of many one-variable elements at a variable one stays, or none beside a wider one."""
    e = lambda p, q: {"p": p, "q": q}
    rows = [(e(k, -2), 7) for k in range(50)] + [(e(60, 61), 8), (e(60, 61), 9), (e(70, -2), 8), (e(71, -1), 5)]
    now = spark.createDataFrame(rows, "e struct<p: long, q: long>, v long")
    gone = sorted((r.e.p, r.e.q) for r in G._absorbed(now, -2).collect())
    assert gone == [(k, -2) for k in range(1, 50)] + [(70, -2)]


def test_a_round_without_fill_needs_no_bounds(spark, tmp_path):
    """Variables of one element go; of one-variable elements left at a variable one stays, or none beside a wider one."""
    e = lambda p: {"p": p, "q": -1}
    rows = [(e(k), v) for k in range(20) for v in (100 + k, 7)] + [(e(50), 7), (e(50), 8), (e(51), 8), (e(51), 151)]
    rows += [(e(k), v) for k in range(60, 64) for v in (200 + k, 9)] + [(e(70), 10), (e(70), 11), (e(71), 10), (e(71), 11)]
    now = spark.createDataFrame(rows, "e struct<p: long, q: long>, v long")
    alone = now.groupBy("v").count().filter("count = 1").select("v")
    left = sorted((r.e.p, r.v) for r in G._peeled(G.Scratch(spark), now, alone).collect())
    assert left == [(50, 7), (50, 8), (60, 9), (70, 10), (70, 11), (71, 10), (71, 11)]


@pytest.mark.parametrize("kind", ["symmetric", "column"])
def test_pieces_keep_to_their_rows_and_make_little_fill(spark, kind):
    """Ranges of 16 rows of a band and of 27 of a grid of 9 by 9: fill near the kernel's, and the same in one piece."""
    rng = np.random.default_rng(5)
    n, k = 90, 9
    banded = [(r, r + d) for r in range(n - 6) for d in (0, 1, 2) if rng.random() < 0.7]
    grid = [(r.i, r.j) for r in T.laplacian(spark, k).collect()]
    for cells, rows, piece in ((banded, n, 16), (grid, k * k, 27)):
        sets = [{r, c} for r, c in cells] if kind == "symmetric" else [{c for r, c in cells if r == k} for k in range(rows)]
        near = neighbours(rows, sets)
        got = places(G.minimum_degree_by_pieces(frame(spark, cells), rows, kind, piece=piece), rows)
        whole = places(G.minimum_degree_by_pieces(frame(spark, cells), rows, kind, piece=rows), rows)
        assert fill(near, got) <= 1.5 * kernel_fill(near) and fill(near, whole) <= 1.1 * kernel_fill(near)


def test_what_a_piece_leaves_stands_for_what_it_ordered():
    """A path 0-1-2-3-4 with both ends held leaves them linked; held nodes are never ordered or merged."""
    near = [np.array(x, np.int64) for x in ([1], [0, 2], [1, 3], [2, 4], [3])]
    order, cliques, edges = K.partial_minimum_degree(near, np.array([True, False, False, False, True]))
    assert sorted(order) == [1, 2, 3] and {0, 4} in cliques.values() and not edges[0] and not edges[4]


def test_dense_boundaries_between_pieces_need_no_degrees(spark):
    """Rows between ranges go after both, boundary after boundary, with less fill than in natural order."""
    k = 16
    n = k * k
    cells = [(x, y) for x in range(n) for y in (x + 1, x + k) if y < n and (y != x + 1 or y % k)]
    at = places(G.minimum_degree_by_pieces(frame(spark, cells), n, piece=64, dense=0), n)
    near = [set() for _ in range(n)]
    for x, y in cells:
        near[x].add(y)
        near[y].add(x)
    assert fill(near, at) < fill(near, np.arange(n))
    between = [x for x in range(n) if any(x // 64 != y // 64 for y in near[x])]
    assert at[between].min() == n - len(between)
