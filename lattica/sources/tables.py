"""Matrices and vectors made from tables, arrays and generators.

A matrix is ``(i, j, v)``, a vector ``(i, k, x)`` with right-hand side k; indices
are 0-based, and a missing row is a structural zero.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from lattica.functions import complexnum as C

MATRIX = "i long, j long, v double"
VECTOR = "i long, k int, x double"


def from_table(df: DataFrame, row: str, col: str, value: str) -> DataFrame:
    """Sum ``value`` by (row, col); each may be an SQL expression."""
    cells = df.select(F.expr(row).cast("long").alias("i"), F.expr(col).cast("long").alias("j"), F.expr(value).cast("double").alias("v"))
    return merge_duplicates(cells.dropna())


def merge_duplicates(matrix: DataFrame) -> DataFrame:
    return matrix.groupBy("i", "j").agg(C.total(F.col("v"), C.is_complex(matrix, "v")).alias("v"))


def from_csc(spark: SparkSession, colptr, rowind, values) -> DataFrame:
    cols = np.repeat(np.arange(len(colptr) - 1), np.diff(colptr))
    rows = list(zip(np.asarray(rowind).tolist(), cols.tolist(), np.asarray(values, float).tolist(), strict=True))
    return spark.createDataFrame(rows, MATRIX)


def from_csr(spark: SparkSession, rowptr, colind, values) -> DataFrame:
    return from_csc(spark, rowptr, colind, values).select(F.col("j").alias("i"), F.col("i").alias("j"), "v")


def laplacian(spark: SparkSession, k: int) -> DataFrame:
    """Five-point stencil on a k by k grid; made on the executors."""
    at = spark.range(k * k).select(F.col("id").alias("i"), F.expr(f"id div {k}").alias("r"), F.expr(f"id % {k}").alias("c"))
    steps = [(0, 0, 4.0), (-1, 0, -1.0), (1, 0, -1.0), (0, -1, -1.0), (0, 1, -1.0)]
    near = F.explode(F.array(*[F.struct(F.lit(r).alias("dr"), F.lit(c).alias("dc"), F.lit(v).alias("v")) for r, c, v in steps]))
    cells = at.withColumn("n", near).select("i", (F.col("r") + F.col("n.dr")).alias("r"), (F.col("c") + F.col("n.dc")).alias("c"), F.col("n.v").alias("v"))
    inside = cells.filter(f"r >= 0 and r < {k} and c >= 0 and c < {k}")
    return inside.select("i", (F.col("r") * k + F.col("c")).alias("j"), "v")


def lattice(spark: SparkSession, dims: tuple[int, int, int, int], block: int, mass: float = 4.5) -> DataFrame:
    """Complex block matrix of a periodic 4-D lattice: ``(i, j, v struct<re, im>)``.

    Each site couples with its eight neighbours through a block whose phases
    follow from the site; the diagonal block is the mass.
    """
    sites = int(np.prod(dims))
    strides = [int(np.prod(dims[d + 1 :])) for d in range(4)]
    hops = [F.struct(F.col("id").alias("to"), F.lit(0).alias("dir"))]
    for d in range(4):
        at = F.expr(f"(id div {strides[d]}) % {dims[d]}")
        for step in (1, dims[d] - 1):
            to = F.col("id") + (F.pmod(at + step, F.lit(dims[d])) - at) * strides[d]
            hops.append(F.struct(to.cast("long").alias("to"), F.lit(2 * d + (1 if step == 1 else 2)).alias("dir")))
    links = spark.range(sites).select("id", F.explode(F.array(*hops)).alias("h")).select("id", "h.*")
    part = F.explode(F.sequence(F.lit(0), F.lit(block - 1)))
    cells = links.withColumn("a", part).withColumn("b", part).filter("dir > 0 or a = b")
    turn = F.pmod(F.col("id") * 7 + F.col("dir") * 3 + F.col("a") * 5 + F.col("b"), F.lit(16)) * (2 * np.pi / 16)
    re = F.when(F.col("dir") == 0, F.lit(mass)).otherwise(-0.5 * F.cos(turn) / block)
    im = F.when(F.col("dir") == 0, F.lit(0.0)).otherwise(-0.5 * F.sin(turn) / block)
    cells = cells.select((F.col("id") * block + F.col("a")).alias("i"), (F.col("to") * block + F.col("b")).alias("j"), re.alias("re"), im.alias("im"))
    summed = cells.groupBy("i", "j").agg(F.sum("re").alias("re"), F.sum("im").alias("im"))
    return summed.select("i", "j", F.struct("re", "im").alias("v"))


def perturbed(matrix: DataFrame) -> DataFrame:
    """The first entry in column order times 0.01, the last times 1e-4 (a lone entry gets both)."""
    ends = matrix.agg(F.min(F.struct("j", "i")).alias("a"), F.max(F.struct("j", "i")).alias("b"))
    at, wide = F.struct("j", "i"), C.is_complex(matrix, "v")
    factor = F.when(at == F.col("a"), F.lit(0.01)).otherwise(F.lit(1.0)) * F.when(at == F.col("b"), F.lit(1e-4)).otherwise(F.lit(1.0))
    return matrix.crossJoin(F.broadcast(ends)).select("i", "j", C.times(F.col("v"), factor, wide).alias("v"))  # one row


def block_diagonal(matrix: DataFrame, n: int, copies: int) -> DataFrame:
    """``copies`` of an n by n matrix along the diagonal."""
    b = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(copies - 1).cast("long")))
    return matrix.withColumn("b", b).select((F.col("i") + F.col("b") * n).alias("i"), (F.col("j") + F.col("b") * n).alias("j"), "v")


def batch_of(matrix: DataFrame, copies: int) -> DataFrame:
    """The same system ``copies`` times, under ``batch_id``."""
    return matrix.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(copies - 1).cast("long"))).alias("batch_id"), *matrix.columns)


def batch_from(matrices: list[DataFrame]) -> DataFrame:
    """Different systems as one batch, numbered in order."""
    out = None
    for b, m in enumerate(matrices):
        one = m.select(F.lit(b).cast("long").alias("batch_id"), *m.columns)
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("a batch needs a system")
    return out


def true_solution(spark: SparkSession, n: int, nrhs: int = 1) -> DataFrame:
    """-1 at even and +1 at odd indices, for every right-hand side."""
    k = F.explode(F.sequence(F.lit(0), F.lit(nrhs - 1)))
    return spark.range(n).select(F.col("id").alias("i"), k.alias("k"), F.when(F.col("id") % 2 == 1, 1.0).otherwise(-1.0).alias("x"))


def ones(spark: SparkSession, n: int, nrhs: int = 1) -> DataFrame:
    return true_solution(spark, n, nrhs).withColumn("x", F.lit(1.0))


def pointers(matrix: DataFrame, by: str, n: int) -> DataFrame:
    """``(p, start, count)`` of compressed storage along ``by``; every index has a row.

    Running sums go over counts, per block of indices and then over blocks, so no
    task sorts them all.
    """
    spark = matrix.sparkSession
    counts = matrix.groupBy(F.col(by).alias("p")).agg(F.count(F.lit(1)).alias("count"))
    every = spark.range(n).withColumnRenamed("id", "p").join(counts, "p", "left").select("p", F.coalesce("count", F.lit(0)).cast("long").alias("count"))
    every = every.withColumn("b", F.expr("p div 65536"))
    inner = Window.partitionBy("b").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    blocks = every.groupBy("b").agg(F.sum("count").alias("total"))
    outer = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    before = blocks.select("b", F.coalesce(F.sum("total").over(outer), F.lit(0)).alias("before"))
    own = every.withColumn("within", F.coalesce(F.sum("count").over(inner), F.lit(0)))
    return own.join(before, "b").select("p", (F.col("before") + F.col("within")).alias("start"), "count")
