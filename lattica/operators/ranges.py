"""Work that must go in the natural order, by ranges of neighbouring rows: triangles, ILU(0) and exact patterns.

Where each row needs the one before it, the number of rounds is the number of ranges, so ranges are wide (``RANGE``
rows, fewer where rows are full) and their entries stay sparse: no dense block is made. A task holds one range. What a
finished range means for later ones goes to them as entries in files, written once and read once.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from lattica.functions import complexnum as C
from lattica.operators.blocks import BLOCK, _due, needed_levels
from lattica.plans.scratch import Scratch

#: Rows of a range at most.
RANGE = 1 << 18
#: Entries of a range on average at most, those that may fill in counted.
ENTRIES = 1 << 21

CELL = "i long, j long, re double, im double"


def range_rows(n: int, entries: int) -> int:
    """Rows of a range for a matrix of n rows with so many entries."""
    return max(1, min(RANGE, ENTRIES * n // max(entries, 1)))


def envelope(a: DataFrame) -> int:
    """Places that L and U can fill in: from a row's (a column's) first entry to the diagonal."""
    total = 0
    for x, y in (("i", "j"), ("j", "i")):
        first = a.groupBy(x).agg(F.min(y).alias("first"))
        total += first.agg(F.sum(F.greatest(F.col(x) - F.col("first"), F.lit(0)) + 1)).first()[0] or 0
    return int(total)


def _cells(a: DataFrame, wide: bool) -> DataFrame:
    v = C.widen(F.col("v"), wide)
    return a.select("i", "j", v["re"].cast("double").alias("re"), v["im"].cast("double").alias("im"))


def _values(frame: pd.DataFrame, wide: bool) -> np.ndarray:
    return frame["re"].to_numpy(float) + 1j * frame["im"].to_numpy(float) if wide else frame["re"].to_numpy(float)


# --- triangles ------------------------------------------------------------------------------------------------------


def _range_solved(n: int, size: int, ks: list[int], lower: bool, wide: bool) -> Callable:
    """Rows of one range: its entries within the range, its sides less what earlier ranges took."""

    def work(key: tuple, cells: pd.DataFrame, sides: pd.DataFrame) -> pd.DataFrame:
        base = key[0] * size
        rows = min(size, n - base)
        x = np.zeros((len(ks), rows), complex if wide else float)
        np.add.at(x, (np.searchsorted(ks, sides["k"].to_numpy()), sides["i"].to_numpy() - base), _values(sides, wide))
        i, j, v = cells["i"].to_numpy() - base, cells["j"].to_numpy() - base, _values(cells, wide)
        diag = None
        if not lower:
            diag = np.zeros(rows, v.dtype)
            np.add.at(diag, i[i == j], v[i == j])
            diag = diag.tolist()
        off = i > j if lower else i < j
        order = np.argsort(i[off], kind="stable")
        start = np.searchsorted(i[off][order], np.arange(rows + 1)).tolist()
        at, by = j[off][order].tolist(), v[off][order].tolist()
        for p in range(len(ks)):
            own = x[p].tolist()
            for r in range(rows) if lower else range(rows - 1, -1, -1):
                s = own[r]
                for q in range(start[r], start[r + 1]):
                    s -= by[q] * own[at[q]]
                if diag is not None:
                    s = s / diag[r] if diag[r] else s * float("inf")
                own[r] = s
            x[p] = own
        return pd.DataFrame({"i": np.tile(np.arange(base, base + rows), len(ks)), "k": np.repeat(np.array(ks, np.int32), rows), "re": np.real(x).ravel(), "im": np.imag(x).ravel()})

    return work


def solve_triangle(t: DataFrame, b: DataFrame, n: int, lower: bool, size: int | None = None) -> DataFrame:
    """X of T X = B for all n rows and the sides of ``b(i, k, x)``: a lower T counts as unit lower, an upper one has its own diagonal.

    Ranges that need nothing of each other are solved side by side; a chain takes n / ``RANGE`` rounds.
    """
    spark = t.sparkSession
    scratch = Scratch(spark)
    wide_b = C.is_complex(b, "x")
    wide = C.is_complex(t, "v") or wide_b
    ks = sorted(r.k for r in b.select("k").distinct().collect())  # right-hand sides, not rows
    x = C.widen(F.col("x"), wide_b)
    if not ks or not n:
        return b.limit(0).select("i", "k", x.alias("x") if wide else "x")
    t = scratch.keep(_cells(t, C.is_complex(t, "v")), "triangle")
    size = size or range_rows(n, t.count())
    level, levels = needed_levels(t, n, size, upper=not lower)
    block = lambda c: F.expr(f"{c} div {size}")
    level = F.broadcast(level.select(F.expr(f"block div {size}").alias("r"), "level"))  # one row a range
    cells = t.withColumn("r", block("i")).withColumn("of", block("j")).join(level, "r")
    own = cells.filter("r = of").drop("of")
    own.repartition("r").write.partitionBy("level").parquet(f"{scratch.path}/own")
    outer = cells.filter("r != of").withColumnRenamed("level", "due").join(level.withColumnRenamed("r", "of"), "of").drop("of")
    outer.repartition("level", "r").write.partitionBy("level").parquet(f"{scratch.path}/outer")
    sides = b.select("i", F.col("k").cast("int").alias("k"), x["re"].alias("re"), x["im"].alias("im")).filter(f"i >= 0 and i < {n}")
    zero = spark.range(-(-n // size)).select((F.col("id") * size).alias("i"), F.lit(ks[0]).cast("int").alias("k"), F.lit(0.0).alias("re"), F.lit(0.0).alias("im"))
    sides = sides.unionByName(zero).withColumn("r", block("i")).join(level, "r")  # every range has a row at least
    sides.repartition("r").write.partitionBy("level").parquet(f"{scratch.path}/sides/round=0")
    none = spark.createDataFrame([], CELL + ", r long")
    for step, at in enumerate(range(levels) if lower else range(levels - 1, -1, -1)):
        inner = _due(scratch, f"{scratch.path}/own/level={at}")
        due = _due(scratch, f"{scratch.path}/sides/round=*/level={at}")
        if due is None:
            continue
        inner = none if inner is None else inner.select(*none.columns)
        solved = inner.groupBy("r").cogroup(due.select("i", "k", "re", "im", "r").groupBy("r")).applyInPandas(_range_solved(n, size, ks, lower, wide), "i long, k int, re double, im double")
        solved.write.parquet(f"{scratch.path}/solved/level={at}")
        later = _due(scratch, f"{scratch.path}/outer/level={at}")
        if later is None:
            continue
        done = spark.read.parquet(f"{scratch.path}/solved/level={at}").select(F.col("i").alias("j"), "k", F.col("re").alias("xr"), F.col("im").alias("xi"))
        sent = later.join(done, "j").select("i", "k", "r", F.col("due").alias("level"), (F.col("im") * F.col("xi") - F.col("re") * F.col("xr")).alias("re"), (-F.col("re") * F.col("xi") - F.col("im") * F.col("xr")).alias("im"))
        sent = sent.groupBy("i", "k", "r", "level").agg(F.sum("re").alias("re"), F.sum("im").alias("im"))
        sent.write.partitionBy("level").parquet(f"{scratch.path}/sides/round={step + 1}")
    out = _due(scratch, f"{scratch.path}/solved/level=*")
    return out.select("i", "k", (C.make(F.col("re"), F.col("im")) if wide else F.col("re")).alias("x"))


# --- factors row by row ---------------------------------------------------------------------------------------------


def _no_fill(row: dict, end: int, upper: Callable) -> None:
    """A row of ILU(0) after its columns below ``end``; a zero pivot is passed over."""
    for k in sorted(c for c in row if c < end):
        u = upper(k)
        pivot = u.get(k, 0.0)
        if pivot == 0:
            continue
        row[k] = f = row[k] / pivot
        for c, v in u.items():
            if c > k and c in row:
                row[c] -= f * v


def _filled(row: dict, end: int, upper: Callable) -> None:
    """The pattern of a row of L and U after its columns below ``end``."""
    todo = [c for c in row if c < end]
    heapq.heapify(todo)
    while todo:
        k = heapq.heappop(todo)
        for c in upper(k).keys() - row.keys():
            row[c] = 1.0
            if k < c < end:
                heapq.heappush(todo, c)


def _table(frame: pd.DataFrame, wide: bool) -> tuple[np.ndarray, np.ndarray, list, list]:
    """Distinct rows, where each starts, columns and values."""
    frame = frame.sort_values("i", kind="stable")
    ids, start = np.unique(frame["i"].to_numpy(), return_index=True)
    return ids, np.append(start, len(frame)), frame["j"].to_numpy().tolist(), _values(frame, wide).tolist()


def _row(start: int, end: int, at: list, by: list) -> dict:
    row: dict = {}
    for c, v in zip(at[start:end], by[start:end], strict=True):
        row[c] = row[c] + v if c in row else v
    return row


def _listed(rows: list[tuple[int, dict]]) -> pd.DataFrame:
    at = np.repeat(np.array([i for i, _ in rows], np.int64), [len(row) for _, row in rows])
    v = np.array([x for _, row in rows for x in row.values()])
    return pd.DataFrame({"i": at, "j": np.array([c for _, row in rows for c in row], np.int64), "re": np.real(v).astype(float), "im": np.imag(v).astype(float)})


def _own_rows(step: Callable, wide: bool) -> Callable:
    """Rows of one range with nothing left of it: finished one after another."""

    def work(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        ids, start, at, by = _table(frame, wide)
        done: dict[int, dict] = {}
        upper: dict[int, dict] = {}
        for p, i in enumerate(ids.tolist()):
            row = _row(start[p], start[p + 1], at, by)
            if step is _filled:
                row[i] = 1.0
            step(row, i, lambda k: upper.get(k) or {})
            done[i], upper[i] = row, {c: v for c, v in row.items() if c >= i}
        return _listed(list(done.items()))

    return work


def _later_rows(step: Callable, wide: bool, end: int, size: int) -> Callable:
    """Rows of a later range after the columns of the finished one, which ends before ``end``; ``level`` is the range that is due next, -1 for finished entries."""

    def work(key: tuple, frame: pd.DataFrame, finished: pd.DataFrame) -> pd.DataFrame:
        ids, start, at, by = _table(frame, wide)
        ks, first, cols, values = _table(finished, wide)
        known: dict[int, dict] = {}

        def upper(k: int) -> dict:
            if k not in known:
                p = np.searchsorted(ks, k)
                known[k] = _row(first[p], first[p + 1], cols, values) if p < len(ks) and ks[p] == k else {}
            return known[k]

        out, level = [], []
        for p, i in enumerate(ids.tolist()):
            row = _row(start[p], start[p + 1], at, by)
            step(row, end, upper)
            due = min(min((c for c in row if c >= end), default=i), i) // size
            out.append((i, row))
            level += [-1 if c < end else due for c in row]
        return _listed(out).assign(r=key[0], level=level)

    return work


def eliminate_rows(a: DataFrame, n: int, pattern: bool, size: int | None = None) -> DataFrame:
    """``(i, j, v)`` of L (units not stored) and U of n rows in natural order: of ILU(0), or with ``pattern`` 1 at each place of the exact factors, the diagonal included.

    Range after range: a finished range is applied to the rows of later ones that have entries in its columns, and these
    wait for the next range they have entries in. Entries at one place are summed.
    """
    spark = a.sparkSession
    scratch = Scratch(spark)
    wide = C.is_complex(a, "v") and not pattern
    step = _filled if pattern else _no_fill
    cells = _cells(a, C.is_complex(a, "v")) if not pattern else a.select("i", "j", F.lit(1.0).alias("re"), F.lit(0.0).alias("im"))
    if pattern:
        ids = spark.range(n).select(F.col("id").alias("i"), F.col("id").alias("j"), F.lit(1.0).alias("re"), F.lit(0.0).alias("im"))
        cells = cells.unionByName(ids)
    cells = scratch.keep(cells, "cells")
    size = size or range_rows(n, cells.count())
    first = cells.groupBy("i").agg(F.expr(f"least(min(j), i) div {size}").alias("level"))
    given = cells.join(first, "i").withColumn("r", F.expr(f"i div {size}")).select("i", "j", "re", "im", "r", "level")
    own = lambda df: df.withColumn("own", F.col("r") == F.col("level"))
    own(given).repartition("level", "r").write.partitionBy("level", "own").parquet(f"{scratch.path}/due/round=0")
    for r in range(-(-n // size)):
        due = _due(scratch, f"{scratch.path}/due/round=*/level={r}/own=true")
        if due is None:
            continue
        done = due.select("i", "j", "re", "im", "r").groupBy("r").applyInPandas(_own_rows(step, wide), CELL)
        done.write.parquet(f"{scratch.path}/done/round={2 * r}")
        wait = _due(scratch, f"{scratch.path}/due/round=*/level={r}/own=false")
        if wait is None:
            continue
        wait = wait.select("i", "j", "re", "im", "r")
        upper = spark.read.parquet(f"{scratch.path}/done/round={2 * r}").filter("j >= i")
        upper = upper.crossJoin(F.broadcast(wait.select(F.col("r").alias("to")).distinct()))  # the ranges that wait
        later = wait.groupBy("r").cogroup(upper.groupBy("to")).applyInPandas(_later_rows(step, wide, (r + 1) * size, size), CELL + ", r long, level long")
        later = scratch.keep(later, "later")
        later.filter("level < 0").select("i", "j", "re", "im").write.parquet(f"{scratch.path}/done/round={2 * r + 1}")
        own(later.filter("level >= 0")).write.partitionBy("level", "own").parquet(f"{scratch.path}/due/round={r + 1}")
        scratch.drop(later)
    out = _due(scratch, f"{scratch.path}/done/round=*")
    if out is None:
        return a.limit(0).select("i", "j", "v")
    return out.select("i", "j", (C.make(F.col("re"), F.col("im")) if wide else F.col("re")).alias("v"))


def patterns_fit(n: int, entries: int) -> bool:
    """Whether ranges are wide enough to go by rows; else dense blocks serve better."""
    return range_rows(n, entries) >= min(n, 4 * BLOCK)
