"""The whole way from A X = B to X without a step in one task: matching, separators, factors by blocks, refinement."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from lattica.functions import complexnum as C
from lattica.functions.machine import TINY_SHARE
from lattica.operators import blocks as B, elementwise as E, products as P
from lattica.operators.dissection import Dissection, dissect
from lattica.operators.matching import heavy_perfect_matching
from lattica.plans.local import Options
from lattica.plans.scratch import Scratch


@dataclass
class BlockSystem:
    """Factors of the scaled and permuted matrix with what leads from B to X; ``solve`` can be called again and again."""

    n: int
    rows: DataFrame | None  # scale factors (i, s)
    cols: DataFrame | None
    row_to: DataFrame | None  # (src, dst), where rows were matched
    tree: Dissection | None
    factor: B.BlockFactor | None
    info: int

    def solve(self, b: DataFrame, trans: bool = False) -> DataFrame:
        """X for ``b(i, k, x)``."""
        if trans:
            raise ValueError("solve_blocks factors the transposed matrix itself")
        wide = C.is_complex(b, "x")
        if self.rows is not None:
            b = b.join(self.rows.hint("merge"), "i", "left").select("i", "k", C.times(F.col("x"), F.coalesce("s", F.lit(1.0)), wide).alias("x"))
        if self.row_to is not None:
            b = E.permute_vector(b, self.row_to)
        x = self.factor.solve(b)
        if self.cols is not None:
            x = x.join(self.cols.hint("merge"), "i", "left").select("i", "k", C.times(F.col("x"), F.coalesce("s", F.lit(1.0)), C.is_complex(x, "x")).alias("x"))
        return x


def factorize_system(a: DataFrame, n: int, options: Options | None = None, leaf: int = B.BLOCK, size: int = B.BLOCK) -> BlockSystem:
    """Equilibration, heavy matching of rows, separator tree and factors by blocks of the n by n matrix ``a``.

    ``info``: i + 1 for a zero row, n + j + 1 for a zero column, n + 1 for a structurally singular matrix, or that of
    ``factorize_blocks``. ``options`` are those of ``solver.solve``; orders other than "natural" are the separator tree's.
    """
    o = options or Options()
    scratch = Scratch(a.sparkSession)
    rows = cols = None
    work = a
    if o.equilibrate:
        e = P.equilibrate(a, n, n)
        if e.info:
            return BlockSystem(n, None, None, None, None, None, e.info)
        kind = P.equilibration_kind(e.rowcnd, e.colcnd, e.amax)
        rows, cols = scratch.keep(e.rows, "rows") if kind in "RB" else None, scratch.keep(e.cols, "cols") if kind in "CB" else None
        work = E.scale(a, rows, cols) if kind != "N" else a
    row_to = None
    if o.row_perm != "none":
        found = heavy_perfect_matching(work, n)
        if found.missing:
            return BlockSystem(n, rows, cols, None, None, None, n + 1)
        row_to = found.pairs
        work = E.permute(work, row_to)
    work = scratch.keep(work, "work")
    tree = dissect(work, n, leaf) if o.col_perm != "natural" else None
    layout = B.by_tree(tree, size) if tree is not None else B.in_order(work, n, size)
    threshold = TINY_SHARE * P.norm(work, "1") if o.replace_tiny_pivot else 0.0
    f = B.factorize_blocks(work, n, layout, B.Values("complex128" if C.is_complex(a, "v") else "float64", threshold))
    return BlockSystem(n, rows, cols, row_to, tree, f, f.info)
