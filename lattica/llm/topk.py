"""Exact top-k by inner product with a pivot-distance index.

With M the largest norm, a candidate x gains the component sqrt(M^2 - |x|^2) and
a query q gains 0; then |q - x|^2 = |q|^2 + M^2 - 2 q.x, so the highest scores
are the nearest points. Every candidate is keyed by its nearest pivot and its
distance to it; the key order is dealt into blocks, each an annulus of one pivot.
A query first searches the annulus next to its own place under its nearest
pivot. Its k-th score there is a radius, and by the triangle inequality only
annuli that meet [d(q, p) - radius, d(q, p) + radius] can hold better ones: these
alone are searched, and of an annulus only the part within the bounds. Scores
are exact integer products.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from lattica.plans.scratch import Scratch

PIVOTS = 32
#: Candidates in an annulus block, queries searched with a block at once.
BLOCK_ROWS, QUERY_ROWS = 1024, 2048
#: Radii are widened by this share and amount against rounding.
SLACK = 1e-6

POINTS = "vec_id long, dim int, norm double, ints binary"


def quantised(vectors: DataFrame) -> DataFrame:
    """``(vec_id, dim, norm, ints)``: floor(256 x) of every usable vector as int64 bytes; norm is the squared length."""
    x = F.col("embedding")
    plain = x.isNotNull() & F.col("vec_id").isNotNull() & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, dim, norm, raw = batch.column(0).cast(pa.int64()), [], [], []
            for v in batch.column(1):
                ints = np.floor(256 * np.asarray(v.values, dtype=np.float64)).astype(np.int64)
                dim.append(len(ints))
                norm.append(float((ints * ints).sum()))
                raw.append(ints.tobytes())
            yield pa.RecordBatch.from_arrays([ids, pa.array(dim, pa.int32()), pa.array(norm, pa.float64()), pa.array(raw, pa.binary())], ["vec_id", "dim", "norm", "ints"])

    return vectors.filter(plain).select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).mapInArrow(work, POINTS)


def _rows(column: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.int64).reshape(-1, dim).astype(np.float64)


class Pivots:
    """Pivots of each dimension, with the extra component of candidates."""

    def __init__(self, found: list, most: dict[int, float]):
        self.most = most
        self.at: dict[int, np.ndarray] = {}
        for dim in most:
            own = [np.frombuffer(r.ints, np.int64).astype(np.float64) for r in found if r.dim == dim]
            points = np.unique(np.array(own).reshape(len(own), dim), axis=0)
            self.at[dim] = np.hstack([points, np.sqrt(np.maximum(0, most[dim] - (points**2).sum(axis=1)))[:, None]])

    def distances(self, points: np.ndarray, lifted: bool) -> np.ndarray:
        """From each point to each pivot; candidates are lifted to the sphere, queries are not."""
        dim = points.shape[1]
        extra = np.sqrt(np.maximum(0, self.most[dim] - (points**2).sum(axis=1))) if lifted else np.zeros(len(points))
        full = np.hstack([points, extra[:, None]])
        p = self.at[dim]
        return np.sqrt(np.maximum(0, (full**2).sum(axis=1)[:, None] + (p**2).sum(axis=1)[None, :] - 2 * full @ p.T))


def _by_dim(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    dims = batch.column("dim").to_numpy(zero_copy_only=False)
    for d in np.unique(dims):
        yield int(d), np.flatnonzero(dims == d)


def build_index(points: DataFrame, pivots, parts: int, rows: int = BLOCK_ROWS) -> DataFrame:
    """Blocks ``(block, dim, pivot, low, high, n, ids, distances, vectors)`` of candidates in key order."""

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, at in _by_dim(batch):
                own = batch.take(pa.array(at))
                d = pivots.value.distances(_rows(own.column("ints"), dim), True)
                near = d.argmin(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [own.column("vec_id"), own.column("dim"), pa.array(near.astype(np.int32)), pa.array(d[np.arange(len(at)), near]), own.column("ints")],
                    ["vec_id", "dim", "pivot", "distance", "ints"],
                )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        have, last = 0, None

        def block() -> pa.RecordBatch:
            t = pa.Table.from_batches(held)
            ids, dist = t.column("vec_id").to_numpy(), t.column("distance").to_numpy()
            one = [last[0], last[1], float(dist.min()), float(dist.max()), len(ids), ids.tobytes(), dist.tobytes(), b"".join(t.column("ints").to_pylist())]
            types = [pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(one, types, strict=True)], ["dim", "pivot", "low", "high", "n", "ids", "distances", "vectors"])

        for batch in batches:
            dim, pivot = batch.column("dim").to_numpy(), batch.column("pivot").to_numpy()
            edges = np.append(np.flatnonzero(np.append(True, (dim[1:] != dim[:-1]) | (pivot[1:] != pivot[:-1]))), len(batch)) if len(batch) else []
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if held and last != (int(dim[a]), int(pivot[a])):
                    yield block()
                    held, have = [], 0
                last = int(dim[a]), int(pivot[a])
                while a < b:
                    n = min(b - a, rows - have)
                    held.append(batch.slice(a, n))
                    have, a = have + n, a + n
                    if have == rows:
                        yield block()
                        held, have = [], 0
        if held:
            yield block()

    keyed = points.mapInArrow(key, "vec_id long, dim int, pivot int, distance double, ints binary")
    order = ["dim", "pivot", "distance", "vec_id"]
    dealt = keyed.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    packed = dealt.mapInArrow(pack, "dim int, pivot int, low double, high double, n int, ids binary, distances binary, vectors binary")
    return packed.withColumn("block", F.monotonically_increasing_id())


def _search(pairs: DataFrame, queries: DataFrame, index: DataFrame, k: int, n_queries: int, scratch: Scratch) -> DataFrame:
    """Best k of each of ``pairs(block, query_row, near, far)``, within these distances to the pivot: ``(query_id, vec_id, score)``.

    A block is sent to each turn of queries that visits it, and to no other.
    """
    turns = 1 + n_queries // QUERY_ROWS
    turn = F.pmod(F.xxhash64("query_row"), F.lit(turns)).cast("int")
    pairs = scratch.keep(pairs.select("block", turn.alias("turn"), "query_row", "near", "far"), "visits")
    left = pairs.join(queries.select("query_row", "query_id", "ints"), "query_row").select("block", "turn", "query_id", "near", "far", "ints")
    seen = pairs.select("block", "turn").distinct()
    right = index.join(seen, "block").select(F.col("block").alias("_block"), F.col("turn").alias("_turn"), "dim", "ids", "distances", "vectors")

    def work(q: pa.Table, x: pa.Table) -> pa.Table:
        names = ["query_id", "vec_id", "score"]
        if not len(q) or not len(x):
            return pa.table([pa.array([], pa.int64())] * 3, names)
        dim = x.column("dim")[0].as_py()
        dist = np.frombuffer(x.column("distances")[0].as_py(), np.float64)
        a = int(np.searchsorted(dist, q.column("near").to_numpy().min()))
        b = int(np.searchsorted(dist, q.column("far").to_numpy().max(), "right"))
        ids = np.frombuffer(x.column("ids")[0].as_py(), np.int64)[a:b]
        order = np.argsort(ids, kind="stable")
        ids = ids[order]
        vectors = np.frombuffer(x.column("vectors")[0].as_py(), np.int64).reshape(-1, dim)[a:b][order]
        own = q.column("query_id").to_numpy()
        points = np.frombuffer(b"".join(q.column("ints").to_pylist()), np.int64).reshape(-1, dim)
        large = float(np.abs(points).max(initial=0)) * float(np.abs(vectors).max(initial=0)) * dim >= 2.0**52
        score = points @ vectors.T if large else (points.astype(np.float64) @ vectors.T.astype(np.float64)).astype(np.int64)
        own_row = -np.iinfo(np.int64).max  # its negative exists, so it sorts last
        score = np.where(own[:, None] == ids[None, :], own_row, score)
        best = np.argsort(-score, axis=1, kind="stable")[:, : min(k, len(ids))]  # ids ascend, so ties go to the smaller
        got = np.take_along_axis(score, best, 1).ravel()
        rows = [np.repeat(own, best.shape[1]), ids[best].ravel(), got]
        real = got != own_row
        return pa.table([pa.array(r[real]) for r in rows], names)

    both = left.groupBy("block", "turn").cogroup(right.groupBy("_block", "_turn"))
    return both.applyInArrow(work, "query_id long, vec_id long, score long")


def _best(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, n_pivots: int = PIVOTS) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: each query's k highest integer inner products with the rows of other ids.

    ``vectors(vec_id, embedding)``; ``is_query`` marks queries by vec_id. Ties go
    to the smaller vec_id. Vectors that are null or hold null or non-finite
    components, and null ids, take no part; vectors of another length are not
    comparable. Rows that share an id are all candidates of other ids, each for
    itself; if they are queries, the k best of all their vectors are given. An
    empty table, or one without queries, gives no rows; other columns are ignored.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    names = ["query_id", "rank", "vec_id", "score"]
    points = scratch.keep(quantised(vectors), "points")
    most = {r.dim: r.most for r in points.groupBy("dim").agg(F.max("norm").alias("most")).collect() if r.dim}
    if not most:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    found = []
    for dim in sorted(most):
        found += points.filter(F.col("dim") == dim).orderBy(F.xxhash64("vec_id", F.lit(3)), "vec_id").limit(n_pivots).collect()
    pivots = spark.sparkContext.broadcast(Pivots(found, most))
    points = points.filter(F.col("dim") > 0)
    index = scratch.keep(build_index(points, pivots, parts), "index")
    queries = points.filter(is_query).select(F.col("vec_id").alias("query_id"), "dim", "norm", "ints")
    queries = scratch.keep(queries.withColumn("query_row", F.monotonically_increasing_id()), "queries")
    n_queries = queries.count()

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, at in _by_dim(batch):
                own = batch.take(pa.array(at))
                d = pivots.value.distances(_rows(own.column("ints"), dim), False)
                n, p = d.shape
                ids = np.repeat(own.column("query_row").to_numpy(), p)
                home = np.zeros((n, p), bool)
                home[np.arange(n), d.argmin(axis=1)] = True
                cols = [ids, np.full(n * p, dim, np.int32), np.tile(np.arange(p, dtype=np.int32), n), d.ravel(), home.ravel()]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["query_row", "dim", "pivot", "d", "home"])

    reached = queries.select("query_row", "dim", "ints").mapInArrow(reach, "query_row long, dim int, pivot int, d double, home boolean")
    annuli = index.select("block", "dim", "pivot", "low", "high")
    gap = F.greatest(F.col("low") - F.col("d"), F.col("d") - F.col("high"), F.lit(0.0))
    near = reached.filter("home").join(annuli, ["dim", "pivot"]).groupBy("query_row").agg(F.min_by("block", F.struct(gap, "block")).alias("block"))
    near = near.select("block", "query_row", F.lit(float("-inf")).alias("near"), F.lit(float("inf")).alias("far"))
    first = _best(_search(near, queries, index, k, n_queries, scratch), k)
    limit = first.groupBy("query_id").agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("have"))

    ball = F.create_map(*[x for d, m in most.items() for x in (F.lit(d), F.lit(float(m)))])
    radius = F.sqrt(F.greatest(F.lit(0.0), F.col("norm") + ball[F.col("dim")] - 2.0 * F.col("least")))
    radius = F.when(F.col("have") >= k, radius * (1 + SLACK) + SLACK * F.sqrt(ball[F.col("dim")]) + SLACK).otherwise(F.lit(float("inf")))
    bounds = scratch.keep(queries.join(limit, "query_id", "left").select("query_row", F.coalesce(radius, F.lit(float("inf"))).alias("radius")), "radius")
    near, far = (F.col("d") - F.col("radius")).alias("near"), (F.col("d") + F.col("radius")).alias("far")
    visits = reached.join(bounds, "query_row").select("query_row", "dim", "pivot", near, far).join(annuli, ["dim", "pivot"])
    visits = visits.filter("low <= far and high >= near").select("block", "query_row", "near", "far")
    return _best(_search(visits, queries, index, k, n_queries, scratch), k).select(*names)
