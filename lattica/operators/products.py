"""Products, patterns, norms, equilibration and error measures, as joins and aggregations."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from lattica.functions import complexnum as C
from lattica.functions.machine import EPS, RADIX, SAFE_MIN
from lattica.plans.scratch import Scratch

#: Neighbouring inner indices of a strip, whose products one task sums, as a power of 2.
STRIP_BITS = 13
#: Products of a strip at most; a strip with more goes by a plain join.
STRIP_PRODUCTS = 1 << 23
#: Products that a task holds at once.
HELD_PRODUCTS = 1 << 21


def _terms(a: DataFrame, x: DataFrame, trans: bool = False, conj: bool = False) -> tuple[DataFrame, bool]:
    """``(i, k, p, d)``: each entry's product and its absolute value (by |re| + |im|), and whether p is complex."""
    i, j = ("j", "i") if trans else ("i", "j")
    va, vx = C.is_complex(a, "v"), C.is_complex(x, "x")
    value = (C.conjugate(F.col("v")) if conj else F.col("v")) if va else F.col("v").cast("double")
    both = a.select(F.col(i).alias("r"), F.col(j).alias("i"), value.alias("v")).join(x, "i")
    v, u = F.col("v"), F.col("x")
    if va and vx:
        product = C.multiply(v, u)
    elif va or vx:
        product = C.times(v, u, True) if va else C.times(u, v, True)
    else:
        product = v * u
    return both.select(F.col("r").alias("i"), "k", product.alias("p"), (C.size1(v, va) * C.size1(u, vx)).alias("d")), va or vx


def spmv(a: DataFrame, x: DataFrame, trans: bool = False, absolute: bool = False, rows: int | None = None, conj: bool = False) -> DataFrame:
    """A x (or A' x, with ``conj`` of conjugated entries, or |A| |x|) for every right-hand side, summed in double precision.

    Rows without entries are missing, or 0 if ``rows`` gives their number. Complex
    entries or vectors give a complex result, but |A| |x| is real and takes |re| + |im|.
    """
    terms, wide = _terms(a, x, trans, conj)
    wide = wide and not absolute
    out = terms.groupBy("i", "k").agg(C.total(F.col("d" if absolute else "p"), wide).alias("x"))
    if rows is None:
        return out
    every = a.sparkSession.range(rows).withColumnRenamed("id", "i").crossJoin(F.broadcast(x.select("k").distinct()))
    return every.join(out, ["i", "k"], "left").select("i", "k", F.coalesce("x", C.widen(F.lit(0.0), not wide)).alias("x"))


def gemv(a: DataFrame, x: DataFrame, y: DataFrame, alpha: float = 1.0, beta: float = 0.0, trans: bool = False, conj: bool = False) -> DataFrame:
    """alpha A x + beta y, with A' or conjugated entries as in ``spmv``; also for several right-hand sides."""
    product = spmv(a, x, trans, conj=conj)
    product = product.select("i", "k", C.times(F.col("x"), F.lit(alpha), C.is_complex(product, "x")).alias("x"))
    return add_vectors(product, y.select("i", "k", C.times(F.col("x"), F.lit(beta), C.is_complex(y, "x")).alias("x")))


def add_vectors(x: DataFrame, y: DataFrame) -> DataFrame:
    """x + y; complex if either is."""
    wx, wy = C.is_complex(x, "x"), C.is_complex(y, "x")
    if wx != wy:
        x, y = (d.select("i", "k", C.widen(F.col("x"), w).alias("x")) for d, w in ((x, wx), (y, wy)))
    return x.unionByName(y).groupBy("i", "k").agg(C.total(F.col("x"), wx or wy).alias("x"))


def _strip_products(wide: bool) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """Sums of one strip's products by place, made and added up a part at a time."""

    def value(frame: pd.DataFrame, name: str) -> np.ndarray:
        return frame[f"{name}re"].to_numpy(float) + 1j * frame[f"{name}im"].to_numpy(float) if wide else frame[f"{name}re"].to_numpy(float)

    def summed(key: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(key, kind="stable")
        key, p = key[order], p[order]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
        return key[first], np.add.reduceat(p, first) if len(key) else p

    def work(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        rows, row = np.unique(left["i"].to_numpy(), return_inverse=True)
        cols, col = np.unique(right["c"].to_numpy(), return_inverse=True)
        order = np.argsort(right["m"].to_numpy(), kind="stable")
        mid, col, w = right["m"].to_numpy()[order], col[order], value(right, "w")[order]
        inner, v = left["l"].to_numpy(), value(left, "v")
        low, high = np.searchsorted(mid, inner, "left"), np.searchsorted(mid, inner, "right")
        ends = np.cumsum(high - low)
        keys, sums = np.zeros(0, np.int64), np.zeros(0, v.dtype)
        at, done = 0, 0
        while at < len(ends):
            to = max(at + 1, int(np.searchsorted(ends, done + HELD_PRODUCTS, "right")))
            count = (high - low)[at:to]
            a = np.repeat(np.arange(at, to), count)
            b = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low[at:to], count)
            some = summed(row[a] * len(cols) + col[b], v[a] * w[b])
            keys, sums = summed(np.concatenate([keys, some[0]]), np.concatenate([sums, some[1]]))
            at, done = to, int(ends[to - 1])
        return pd.DataFrame({"i": rows[keys // max(1, len(cols))], "j": cols[keys % max(1, len(cols))], "re": np.real(sums), "im": np.imag(sums)})

    return work


def matmul(a: DataFrame, b: DataFrame) -> DataFrame:
    """Sparse product A B.

    A task takes a strip of neighbouring inner indices and sums its products by place before they are sent on, so
    where neighbours meet in the same places few are; strips of too many products go product by product.
    """
    scratch = Scratch(a.sparkSession)
    va, vb = C.is_complex(a, "v"), C.is_complex(b, "v")
    wide = va or vb
    v, w = C.widen(F.col("v"), va), C.widen(F.col("v"), vb)
    left = a.dropna().select("i", F.col("j").alias("l"), v["re"].cast("double").alias("vre"), v["im"].cast("double").alias("vim"), F.shiftright("j", STRIP_BITS).alias("strip"))
    right = b.dropna().select(F.col("i").alias("m"), F.col("j").alias("c"), w["re"].cast("double").alias("wre"), w["im"].cast("double").alias("wim"), F.shiftright("i", STRIP_BITS).alias("other"))
    left, right = scratch.keep(left, "left"), scratch.keep(right, "right")
    many = left.groupBy("strip", "l").agg(F.count(F.lit(1)).alias("x")).join(right.groupBy("m").agg(F.count(F.lit(1)).alias("y")).hint("merge"), F.col("l") == F.col("m"))
    full = F.broadcast(many.groupBy("strip").agg(F.sum(F.col("x") * F.col("y")).alias("products")).filter(F.col("products") > STRIP_PRODUCTS).select("strip"))  # one row a strip
    other = full.withColumnRenamed("strip", "other")
    cells = "i long, j long, re double, im double"
    near = left.join(full, "strip", "left_anti").groupBy("strip").cogroup(right.join(other, "other", "left_anti").groupBy("other")).applyInPandas(_strip_products(wide), cells)
    re, im = F.col("vre") * F.col("wre"), F.lit(0.0)
    if wide:
        re, im = re - F.col("vim") * F.col("wim"), F.col("vre") * F.col("wim") + F.col("vim") * F.col("wre")
    pairs = left.join(full, "strip").join(right, F.col("l") == F.col("m")).select("i", F.col("c").alias("j"), re.alias("re"), im.alias("im"))
    value = C.make(F.sum("re"), F.sum("im")) if wide else F.sum("re")
    return near.unionByName(pairs).groupBy("i", "j").agg(value.alias("v"))


def schur_step(a: DataFrame, k: int) -> DataFrame:
    """What is left of A after pivot ``k`` is eliminated: A_ij - A_ik A_kj / A_kk for i, j other than k."""
    pivot = a.filter((F.col("i") == k) & (F.col("j") == k)).select(F.col("v").alias("p"))
    left = a.filter((F.col("j") == k) & (F.col("i") != k)).select("i", F.col("v").alias("l"))
    right = a.filter((F.col("i") == k) & (F.col("j") != k)).select("j", F.col("v").alias("u"))
    # one column by one row of the matrix and the one pivot
    wide = C.is_complex(a, "v")
    taken = C.divide(C.multiply(F.col("l"), F.col("u")), F.col("p")) if wide else F.col("l") * F.col("u") / F.col("p")
    update = left.crossJoin(right).crossJoin(pivot).select("i", "j", C.times(taken, F.lit(-1.0), wide).alias("v"))
    return a.filter((F.col("i") != k) & (F.col("j") != k)).unionByName(update).groupBy("i", "j").agg(C.total(F.col("v"), wide).alias("v"))


def a_plus_at_pattern(a: DataFrame) -> DataFrame:
    """``(i, j)`` of A + A' without the diagonal."""
    both = a.select("i", "j").unionByName(a.select(F.col("j").alias("i"), F.col("i").alias("j")))
    return both.filter("i != j").distinct()


def ata_pattern(a: DataFrame) -> DataFrame:
    """``(i, j)`` of A' A without the diagonal; each row of A is a clique of its columns."""
    left, right = a.select(F.col("i").alias("r"), F.col("j").alias("i")), a.select(F.col("i").alias("r"), "j")
    return left.join(right, "r").filter("i != j").select("i", "j").distinct()


def norm(a: DataFrame, kind: str) -> float:
    """'M' greatest entry, '1' or 'O' greatest column sum, 'I' greatest row sum, 'F' root of squares; 0 if empty."""
    size = C.size(F.col("v"), C.is_complex(a, "v"))
    if kind == "M":
        got = a.agg(F.max(size).alias("n"))
    elif kind in ("1", "O", "I"):
        got = a.groupBy("i" if kind == "I" else "j").agg(F.sum(size).alias("s")).agg(F.max("s").alias("n"))
    elif kind == "F":
        got = a.agg(F.sqrt(F.sum(size * size)).alias("n"))
    else:
        raise ValueError(f"no norm {kind!r}")
    return float(got.first()["n"] or 0.0)


@dataclass
class Equilibration:
    rows: DataFrame  # (i, s)
    cols: DataFrame
    rowcnd: float
    colcnd: float
    amax: float
    info: int  # i + 1 for a zero row i, m + j + 1 for a zero column j, else 0


def _rounded(c: Column, radix: bool) -> Column:
    """The power of the radix by truncating the logarithm toward zero."""
    if not radix:
        return c
    power = F.log(c) / F.log(F.lit(RADIX))
    near = F.rint(power)
    exact = F.when(F.abs(power - near) < 1e-9, near).otherwise(power)
    return F.pow(F.lit(RADIX), F.when(exact >= 0, F.floor(exact)).otherwise(F.ceil(exact)))


def equilibrate(a: DataFrame, m: int, n: int, radix: bool = False, precision: str = "double") -> Equilibration:
    """Row and column factors that bring each greatest entry to 1 (or a power of the radix near it).

    A complex entry counts as |re| + |im|.
    """
    entry = C.size1(F.col("v"), C.is_complex(a, "v"))
    small = SAFE_MIN[precision]
    clamp = lambda c: F.least(F.greatest(c, F.lit(small)), F.lit(1 / small))
    spark = a.sparkSession

    def side(entries: DataFrame, key: str, size: int) -> tuple[DataFrame, float, float, int]:
        top = entries.groupBy(F.col(key).alias("i")).agg(F.max("t").alias("top")).filter("top > 0").withColumn("top", _rounded(F.col("top"), radix))
        got = top.agg(F.min("top").alias("a"), F.max("top").alias("b"), F.count(F.lit(1)).alias("n")).first()
        info = 0
        if (got["n"] or 0) < size:
            gap = spark.range(size).withColumnRenamed("id", "i").join(top, "i", "left_anti").agg(F.min("i")).first()[0]
            info = gap + 1
        factors = top.select("i", (F.lit(1.0) / clamp(F.col("top"))).alias("s"))
        cnd = 1.0 if not size else max(got["a"] or 0.0, small) / min(got["b"] or small, 1 / small)
        return factors, cnd, float(got["b"] or 0.0), info

    rows, rowcnd, top, info = side(a.withColumn("t", entry), "i", m)
    amax = float(a.agg(F.max(entry)).first()[0] or 0.0) if radix else top
    if info:
        return Equilibration(rows, rows.limit(0), rowcnd, 1.0, amax, info)
    scaled = a.join(rows, "i").withColumn("t", entry * F.col("s"))
    cols, colcnd, _, info = side(scaled, "j", n)
    return Equilibration(rows, cols, rowcnd, colcnd, amax, m + info if info else 0)


def equilibration_kind(rowcnd: float, colcnd: float, amax: float, precision: str = "double") -> str:
    """'N', 'R', 'C' or 'B': which factors are worth applying."""
    small = SAFE_MIN[precision] / (2 * EPS[precision])
    rows_fine = rowcnd >= 0.1 and small <= amax <= 1 / small
    cols_fine = colcnd >= 0.1
    return {(True, True): "N", (True, False): "C", (False, True): "R", (False, False): "B"}[rows_fine, cols_fine]


def residual_vector(a: DataFrame, x: DataFrame, b: DataFrame) -> DataFrame:
    """b - A x."""
    return gemv(a, x, b, -1.0, 1.0)


def residual_rows(a: DataFrame, x: DataFrame, b: DataFrame) -> DataFrame:
    """``(i, k, x, d)``: b - A x, and |A| |x| + |b| to measure it by, from one join and one aggregation."""
    terms, wide = _terms(a, x)
    wb = C.is_complex(b, "x")
    either = wide or wb
    less = C.times(F.col("p"), F.lit(-1.0), wide)
    terms = terms.select("i", "k", (C.widen(less, wide) if either else less).alias("p"), "d")
    given = b.select("i", "k", (C.widen(F.col("x"), wb) if either else F.col("x")).alias("p"), C.size1(F.col("x"), wb).alias("d"))
    return terms.unionByName(given).groupBy("i", "k").agg(C.total(F.col("p"), either).alias("x"), F.sum("d").alias("d"))


def worst_ratio(rows: DataFrame, n: int, precision: str = "double") -> DataFrame:
    """``(k, berr)`` of ``residual_rows``: greatest ratio by component, guarded where the divisor is tiny; rows of 0 / 0 are left out."""
    safe1 = (n + 1) * SAFE_MIN[precision]
    safe2 = safe1 / EPS[precision]
    r, d = C.size1(F.col("x"), C.is_complex(rows, "x")), F.col("d")
    ratio = F.when(d > safe2, F.try_divide(r, d)).when(d > 0, (r + safe1) / (d + safe1))
    return rows.groupBy("k").agg(F.coalesce(F.max(ratio), F.lit(0.0)).alias("berr"))


def backward_error(a: DataFrame, x: DataFrame, b: DataFrame, n: int, precision: str = "double") -> DataFrame:
    """``(k, berr)``: greatest |r| / (|A| |x| + |b|) by component."""
    return worst_ratio(residual_rows(a, x, b), n, precision)


def normalised_residual(a: DataFrame, x: DataFrame, b: DataFrame, precision: str = "double") -> float:
    """Greatest over right-hand sides of |B - A X| / (|A| |X| eps) in 1-norms; 0 for no rows, 1 / eps for a zero matrix."""
    if a.isEmpty() and b.isEmpty():
        return 0.0
    size = norm(a, "1")
    if size == 0:
        return 1 / EPS[precision]
    rest = residual_vector(a, x, b)
    r = rest.groupBy("k").agg(F.sum(C.size(F.col("x"), C.is_complex(rest, "x"))).alias("r"))
    s = x.groupBy("k").agg(F.sum(C.size(F.col("x"), C.is_complex(x, "x"))).alias("s"))
    value = F.when(F.col("s") == 0, F.lit(1 / EPS[precision])).otherwise(F.try_divide(F.col("r"), F.col("s")) / size / EPS[precision])
    return float(r.join(s, "k").agg(F.max(value)).first()[0] or 0.0)


def error_norms(x: DataFrame, true: DataFrame) -> DataFrame:
    """``(k, err_norm, err_comp)``: greatest |x - t| over greatest |x|, and greatest |x - t| / |x| by component."""
    wx, wt = C.is_complex(x, "x"), C.is_complex(true, "x")
    wide = wx or wt
    both = x.join(true.select("i", "k", F.col("x").alias("t")), ["i", "k"])
    gap = C.subtract(C.widen(F.col("x"), wx), C.widen(F.col("t"), wt)) if wide else F.col("x") - F.col("t")
    both = both.select("k", C.size(gap, wide).alias("off"), C.size(F.col("x"), wx).alias("x"))
    return both.groupBy("k").agg(F.try_divide(F.max("off"), F.max("x")).alias("err_norm"), F.max(F.try_divide("off", "x")).alias("err_comp"))
