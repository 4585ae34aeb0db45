"""Queries of the linear-algebra engine on the star schema, and their SQL."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from lattica.functions import complexnum as C
from lattica.operators import analysis as N, blocks as B, degree as G, dissection as D, elementwise as E, matching as M, products as P, solver as S, trees as R
from lattica.plans.local import Options
from lattica.plans.scratch import Scratch
from lattica.sources import files, tables as T

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def _read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def orders_parts(spark: SparkSession, d: str) -> DataFrame:
    return T.from_table(_read(spark, d, "lineitem"), "l_orderkey", "l_partkey", "l_quantity")


def parts_suppliers(spark: SparkSession, d: str) -> DataFrame:
    return T.from_table(_read(spark, d, "lineitem"), "l_partkey", "l_suppkey", "l_quantity")


def n_parts(spark: SparkSession, d: str) -> int:
    return _read(spark, d, "part").count()


def band(spark: SparkSession, d: str) -> DataFrame:
    """Banded, diagonally dominant matrix of parts, half-bandwidth 2."""
    n = n_parts(spark, d)
    off = T.from_table(_read(spark, d, "lineitem"), "l_partkey", "l_partkey + (l_suppkey % 5) - 2", "l_discount")
    off = off.filter(f"i != j and j >= 0 and j < {n}").withColumn("v", F.col("v") + 0.01)
    sums = off.groupBy("i").agg(F.sum(F.abs("v")).alias("s"))
    diag = spark.range(n).withColumnRenamed("id", "i").join(sums, "i", "left")
    return off.unionByName(diag.select("i", F.col("i").alias("j"), (F.lit(1.0) + F.coalesce("s", F.lit(0.0))).alias("v")))


M1_SQL = "m1 AS (SELECT l_orderkey i, l_partkey j, sum(l_quantity) v FROM lineitem GROUP BY 1, 2)"
M2_SQL = "m2 AS (SELECT l_partkey i, l_suppkey j, sum(l_quantity) v FROM lineitem GROUP BY 1, 2)"
BAND_SQL = """n AS (SELECT count(*) n FROM part),
off AS (SELECT i, j, v FROM (SELECT l_partkey i, l_partkey + (l_suppkey % 5) - 2 j, sum(l_discount) + 0.01 v FROM lineitem GROUP BY 1, 2), n WHERE i <> j AND j >= 0 AND j < n),
a AS (SELECT i, j, v FROM off UNION ALL SELECT p_partkey, p_partkey, 1 + coalesce(s, 0) FROM part LEFT JOIN (SELECT i, sum(abs(v)) s FROM off GROUP BY 1) ON i = p_partkey),
xt AS (SELECT p_partkey i, CASE WHEN p_partkey % 2 = 1 THEN 1.0 ELSE -1.0 END x FROM part)"""


def add(name: str, sql: str | None = None, ctes: str = "") -> Callable[[Query], Query]:
    """Register a query and its SQL, ``ctes`` in front."""

    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = (f"WITH {ctes} " if ctes else "") + sql
        return fn

    return register


def _r(c: str) -> Column:
    return (F.round(c, 6) + 0.0).alias(c)


def _cells(a: DataFrame) -> DataFrame:
    return a.select("i", "j", _r("v"))


def _vector(x: DataFrame) -> DataFrame:
    return x.select("i", "k", _r("x"))


def _one(spark: SparkSession, schema: str, *rows: tuple) -> DataFrame:
    return spark.createDataFrame(list(rows), schema)


CELLS = "SELECT i, j, round(v, 6) + 0.0 v FROM "


# --- sources and elementwise ----------------------------------------------------------------------------------------

add("matrix_from_table", CELLS + "m1", M1_SQL)(lambda s, d: _cells(orders_parts(s, d)))
add("matrix_band", CELLS + "a", BAND_SQL)(lambda s, d: _cells(band(s, d)))
add("transpose", "SELECT j i, i j, round(v, 6) + 0.0 v FROM m2", M2_SQL)(lambda s, d: _cells(E.transpose(parts_suppliers(s, d))))
add("structure_zero", "SELECT i, j, 0.0::DOUBLE v FROM m2", M2_SQL)(lambda s, d: E.zero(parts_suppliers(s, d)))
add("scale_add_identity", "SELECT i, j, round(2.5 * v + CASE WHEN i = j THEN 1 ELSE 0 END, 6) + 0.0 v FROM a", BAND_SQL)(lambda s, d: _cells(E.scale_add_identity(band(s, d), 2.5)))
add("scale_add", "SELECT i, j, round(3 * v + v, 6) + 0.0 v FROM m2", M2_SQL)(lambda s, d: _cells(E.scale_add(parts_suppliers(s, d), parts_suppliers(s, d), 3.0)))
add("unit_lower", "SELECT i, j, CASE WHEN i = j THEN 1.0 ELSE round(v, 6) + 0.0 END v FROM a WHERE i >= j", BAND_SQL)(lambda s, d: _cells(files.unit_lower(band(s, d))))
add("diagonal", "SELECT i, round(v, 6) + 0.0 v FROM a WHERE i = j", BAND_SQL)(lambda s, d: E.diagonal(band(s, d)).select("i", _r("v")))
add("missing_diagonal", "SELECT p_partkey j FROM part WHERE p_partkey NOT IN (SELECT i FROM m2 WHERE i = j)", M2_SQL)(lambda s, d: E.missing_diagonal(parts_suppliers(s, d), n_parts(s, d)))
add("block_diagonal", "SELECT i + b * n i, j + b * n j, round(v, 6) + 0.0 v FROM a, n, range(3) r(b)", BAND_SQL)(lambda s, d: _cells(T.block_diagonal(band(s, d), n_parts(s, d), 3)))
add(
    "perturbed",
    "SELECT i, j, round(v * CASE WHEN row_number() OVER (ORDER BY j, i) = 1 THEN 0.01 ELSE 1 END * CASE WHEN row_number() OVER (ORDER BY j DESC, i DESC) = 1 THEN 0.0001 ELSE 1 END, 6) + 0.0 v FROM a",
    BAND_SQL,
)(lambda s, d: _cells(T.perturbed(band(s, d))))
add("batch_copies", "SELECT b batch_id, i, j, round(v, 6) + 0.0 v FROM a, range(2) r(b)", BAND_SQL)(lambda s, d: T.batch_of(band(s, d), 2).select("batch_id", "i", "j", _r("v")))


def _side(spark: SparkSession, d: str) -> int:
    """Side of the square grid that the parts fill."""
    return math.isqrt(n_parts(spark, d))


def priced_grid(spark: SparkSession, d: str) -> DataFrame:
    """Five-point stencil on the grid of parts, each row times its part's price."""
    price = _read(spark, d, "part").select(F.col("p_partkey").alias("i"), "p_retailprice")
    return T.laplacian(spark, _side(spark, d)).join(price, "i").select("i", "j", (F.col("v") * F.col("p_retailprice")).alias("v"))


SIDE_SQL = "k AS (SELECT floor(sqrt(count(*)))::BIGINT k FROM part)"
add(
    "laplacian",
    "SELECT i, j, round(CASE WHEN i = j THEN 4.0 ELSE -1.0 END * p_retailprice, 6) + 0.0 v FROM (SELECT g.i, g.i + o.o j, k, o.o FROM range(1000000) g(i), k, (VALUES (0), (-1), (1), (-k.k), (k.k)) o(o) WHERE g.i < k * k) JOIN part ON p_partkey = i "
    "WHERE j >= 0 AND j < k * k AND (abs(o) <> 1 OR i // k = j // k)".replace("(VALUES (0), (-1), (1), (-k.k), (k.k)) o(o)", "LATERAL (SELECT unnest([0, -1, 1, -k, k]) o) o"),
    SIDE_SQL,
)(lambda s, d: _cells(priced_grid(s, d)))
add("true_solution", "SELECT p_partkey i, k::INTEGER k, CASE WHEN p_partkey % 2 = 1 THEN 1.0 ELSE -1.0 END::DOUBLE x FROM part, range(2) r(k)")(lambda s, d: T.true_solution(s, n_parts(s, d), 2))
add("column_pointers", "SELECT p_partkey p, coalesce(sum(c) OVER (ORDER BY p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT start, c count FROM (SELECT p_partkey, count(j) c FROM part LEFT JOIN a ON j = p_partkey GROUP BY 1)", BAND_SQL)(
    lambda s, d: T.pointers(band(s, d), "j", n_parts(s, d))
)
add("argsort", "SELECT i, round(v, 6) + 0.0 v, row_number() OVER (ORDER BY v DESC, i) - 1 rank FROM m1d", M1_SQL + ", m1d AS (SELECT i, sum(v) v FROM m1 GROUP BY 1)")(
    lambda s, d: E.argsort(orders_parts(s, d).groupBy("i").agg(F.sum("v").alias("v")), "v", True).select("i", _r("v"), "rank")
)


@add("permute", "SELECT n - 1 - i i, (j + 1) % n j, round(v, 6) + 0.0 v FROM a, n", BAND_SQL)
def permute(s: SparkSession, d: str) -> DataFrame:
    n = n_parts(s, d)
    flip = s.range(n).select(F.col("id").alias("src"), (n - 1 - F.col("id")).alias("dst"))
    turn = s.range(n).select(F.col("id").alias("src"), ((F.col("id") + 1) % n).alias("dst"))
    return _cells(E.permute(band(s, d), flip, turn))


@add("permutation_valid", "SELECT true AS forward, true AS inverse, false AS broken")
def permutation_valid(s: SparkSession, d: str) -> DataFrame:
    n = n_parts(s, d)
    turn = s.range(n).select(F.col("id").alias("src"), ((F.col("id") + 7) % n).alias("dst"))
    bad = turn.withColumn("dst", F.col("dst") * F.lit(0))
    return _one(s, "forward boolean, inverse boolean, broken boolean", (E.is_permutation(turn, n), E.is_permutation(E.invert_permutation(turn), n), E.is_permutation(bad, n)))


@add("scale_both", "SELECT i, j, round(v * (1 + i % 3) * (1 + j % 4), 6) + 0.0 v FROM a", BAND_SQL)
def scale_both(s: SparkSession, d: str) -> DataFrame:
    ids = s.range(n_parts(s, d)).withColumnRenamed("id", "i")
    return _cells(E.scale(band(s, d), ids.withColumn("s", 1.0 + F.col("i") % 3), ids.withColumn("s", 1.0 + F.col("i") % 4)))


@add("blocks", "SELECT i // 64 bi, j // 64 bj, count(*) cells, round(sum(v), 6) + 0.0 total FROM a GROUP BY 1, 2", BAND_SQL)
def blocks(s: SparkSession, d: str) -> DataFrame:
    return E.to_blocks(band(s, d), 64).groupBy("bi", "bj").agg(F.count(F.lit(1)).alias("cells"), F.sum("v").alias("total")).select("bi", "bj", "cells", _r("total"))


@add("compressed_columns", "SELECT j p, count(*) nnz, min(i) low, max(i) high, round(sum(v), 6) + 0.0 total FROM a GROUP BY 1", BAND_SQL)
def compressed_columns(s: SparkSession, d: str) -> DataFrame:
    packed = E.compressed(band(s, d))
    total = F.aggregate("values", F.lit(0.0), lambda x, y: x + y).alias("total")
    return packed.select("p", F.size("indices").cast("long").alias("nnz"), F.col("indices")[0].alias("low"), F.element_at("indices", -1).alias("high"), total).select("p", "nnz", "low", "high", _r("total"))


@add(
    "complex_arithmetic",
    "SELECT i, round((v * v + v * 2) / (v * v + 4), 6) + 0.0 re, round((v * v - 2 * v) / (v * v + 4), 6) + 0.0 im, round(sqrt(2) * v, 6) + 0.0 size FROM a WHERE i = j",
    BAND_SQL,
)
def complex_arithmetic(s: SparkSession, d: str) -> DataFrame:
    cells = E.diagonal(band(s, d)).withColumn("z", C.make(F.col("v"), F.col("v"))).withColumn("w", C.make(F.col("v"), F.lit(2.0)))
    out = cells.withColumn("q", C.divide(F.col("z"), F.col("w"))).select("i", F.col("q.re").alias("re"), F.col("q.im").alias("im"), C.modulus(F.col("z")).alias("size"))
    return out.select("i", _r("re"), _r("im"), _r("size"))


# --- aggregations and products --------------------------------------------------------------------------------------

NORMS_SQL = """SELECT 'M' kind, round(max(abs(v)), 6) + 0.0 AS value FROM a UNION ALL SELECT '1', round(max(s), 6) + 0.0 FROM (SELECT sum(abs(v)) s FROM a GROUP BY j)
UNION ALL SELECT 'I', round(max(s), 6) + 0.0 FROM (SELECT sum(abs(v)) s FROM a GROUP BY i) UNION ALL SELECT 'F', round(sqrt(sum(v * v)), 6) + 0.0 FROM a"""


@add("norms", NORMS_SQL, BAND_SQL)
def norms(s: SparkSession, d: str) -> DataFrame:
    a = Scratch(s).keep(band(s, d))
    return _one(s, "kind string, value double", *[(k, round(P.norm(a, k), 6) + 0.0) for k in "M1IF"])


EQUIL_SQL = "r AS (SELECT i, 1 / max(abs(v)) s FROM m2 GROUP BY 1), c AS (SELECT j i, 1 / max(abs(v) * s) s FROM m2 JOIN r USING (i) GROUP BY 1)"


@add("equilibrate", "SELECT 'row' side, i, round(s, 6) + 0.0 s FROM r UNION ALL SELECT 'col', i, round(s, 6) + 0.0 FROM c", f"{M2_SQL}, {EQUIL_SQL}")
def equilibrate(s: SparkSession, d: str) -> DataFrame:
    e = P.equilibrate(Scratch(s).keep(parts_suppliers(s, d)), n_parts(s, d), _read(s, d, "supplier").count())
    return e.rows.select(F.lit("row").alias("side"), "i", _r("s")).unionByName(e.cols.select(F.lit("col").alias("side"), "i", _r("s")))


RADIX_SQL = "r AS (SELECT i, 1 / pow(2, trunc(log2(max(abs(v))))) s FROM m2 GROUP BY 1)"


@add("equilibrate_radix", "SELECT i, round(s, 6) + 0.0 s FROM r", f"{M2_SQL}, {RADIX_SQL}")
def equilibrate_radix(s: SparkSession, d: str) -> DataFrame:
    e = P.equilibrate(Scratch(s).keep(parts_suppliers(s, d)), n_parts(s, d), _read(s, d, "supplier").count(), radix=True)
    return e.rows.select("i", _r("s"))


@add(
    "equilibration_decision",
    "SELECT round(rowcnd, 6) + 0.0 rowcnd, round(colcnd, 6) + 0.0 colcnd, round(amax, 6) + 0.0 amax, CASE WHEN rowcnd >= 0.1 THEN CASE WHEN colcnd >= 0.1 THEN 'N' ELSE 'C' END WHEN colcnd >= 0.1 THEN 'R' ELSE 'B' END kind "
    "FROM (SELECT min(1 / s) / max(1 / s) rowcnd, max(1 / s) amax FROM r), (SELECT min(1 / s) / max(1 / s) colcnd FROM c)",
    f"{M2_SQL}, {EQUIL_SQL}",
)
def equilibration_decision(s: SparkSession, d: str) -> DataFrame:
    e = P.equilibrate(Scratch(s).keep(parts_suppliers(s, d)), n_parts(s, d), _read(s, d, "supplier").count())
    row = (round(e.rowcnd, 6), round(e.colcnd, 6), round(e.amax, 6), P.equilibration_kind(e.rowcnd, e.colcnd, e.amax))
    return _one(s, "rowcnd double, colcnd double, amax double, kind string", row)


add("row_column_counts", "SELECT 'row' side, i, count(*) nnz FROM m1 GROUP BY 2 UNION ALL SELECT 'col', j, count(*) FROM m1 GROUP BY 2", M1_SQL)(
    lambda s, d: (
        lambda a: a.groupBy("i").agg(F.count(F.lit(1)).alias("nnz")).select(F.lit("row").alias("side"), "i", "nnz").unionByName(a.groupBy(F.col("j").alias("i")).agg(F.count(F.lit(1)).alias("nnz")).select(F.lit("col").alias("side"), "i", "nnz"))
    )(orders_parts(s, d))
)
SPMV = "SELECT {r} i, 0 k, round(sum({t}), 6) + 0.0 x FROM a JOIN xt ON xt.i = a.{c} GROUP BY 1"
add("spmv", SPMV.format(r="a.i", c="j", t="v * x"), BAND_SQL)(lambda s, d: _vector(P.spmv(band(s, d), T.true_solution(s, n_parts(s, d)))))
add("spmv_transposed", SPMV.format(r="a.j", c="i", t="v * x"), BAND_SQL)(lambda s, d: _vector(P.spmv(band(s, d), T.true_solution(s, n_parts(s, d)), trans=True)))
add("spmv_absolute", SPMV.format(r="a.i", c="j", t="abs(v) * abs(x)"), BAND_SQL)(lambda s, d: _vector(P.spmv(band(s, d), T.true_solution(s, n_parts(s, d)), absolute=True)))
add("spmv_single_in_double", "SELECT a.i, 0 k, round(sum(v::FLOAT::DOUBLE * x), 6) + 0.0 x FROM a JOIN xt ON xt.i = a.j GROUP BY 1", BAND_SQL)(
    lambda s, d: _vector(P.spmv(band(s, d).withColumn("v", F.col("v").cast("float")), T.true_solution(s, n_parts(s, d))))
)
add("spmm", "SELECT a.i, k::INTEGER k, round(sum(v * x * (k + 1)), 6) + 0.0 x FROM a JOIN xt ON xt.i = a.j, range(3) r(k) GROUP BY 1, 2", BAND_SQL)(
    lambda s, d: _vector(P.spmv(band(s, d), T.true_solution(s, n_parts(s, d), 3).withColumn("x", F.col("x") * (F.col("k") + 1))))
)
add("gemv", "SELECT a.i, 0 k, round(2 * sum(v * t.x) - 3 * any_value(o.x), 6) + 0.0 x FROM a JOIN xt t ON t.i = a.j JOIN xt o ON o.i = a.i GROUP BY 1", BAND_SQL)(
    lambda s, d: _vector(P.gemv(band(s, d), T.true_solution(s, n_parts(s, d)), T.true_solution(s, n_parts(s, d)), 2.0, -3.0))
)
add("matmul_gram", "SELECT l.j i, r.j, round(sum(l.v * r.v), 6) + 0.0 v FROM m2 l JOIN m2 r USING (i) GROUP BY 1, 2", M2_SQL)(lambda s, d: _cells(P.matmul(E.transpose(parts_suppliers(s, d)), parts_suppliers(s, d))))
add("a_plus_at_pattern", "SELECT i, j FROM a WHERE i <> j UNION SELECT j, i FROM a WHERE i <> j", BAND_SQL)(lambda s, d: P.a_plus_at_pattern(band(s, d)))
add("ata_pattern", "SELECT DISTINCT l.j i, r.j FROM a l JOIN a r USING (i) WHERE l.j <> r.j", BAND_SQL)(lambda s, d: P.ata_pattern(band(s, d)))
add(
    "schur_step",
    "SELECT i, j, round(sum(v), 6) + 0.0 v FROM (SELECT i, j, v FROM a WHERE i <> 0 AND j <> 0 UNION ALL SELECT l.i, u.j, -l.v * u.v / p.v FROM a l, a u, a p WHERE l.j = 0 AND l.i <> 0 AND u.i = 0 AND u.j <> 0 AND p.i = 0 AND p.j = 0) GROUP BY 1, 2",
    BAND_SQL,
)(lambda s, d: _cells(P.schur_step(band(s, d), 0)))
add(
    "residual_vector", "SELECT a.i, 0 k, round(1 - sum(v * x), 6) + 0.0 x FROM a JOIN xt ON xt.i = a.j GROUP BY 1", BAND_SQL
)(lambda s, d: _vector(P.residual_vector(band(s, d), T.true_solution(s, n_parts(s, d)), T.ones(s, n_parts(s, d)))))
add(
    "backward_error",
    "SELECT 0 k, round(max(abs(1 - ax) / (aax + 1)), 6) + 0.0 berr FROM (SELECT a.i, sum(v * x) ax, sum(abs(v) * abs(x)) aax FROM a JOIN xt ON xt.i = a.j GROUP BY 1)",
    BAND_SQL,
)(lambda s, d: P.backward_error(band(s, d), T.true_solution(s, n_parts(s, d)), T.ones(s, n_parts(s, d)), n_parts(s, d)).select("k", _r("berr")))
add("error_norms", "SELECT 0 k, 2.0::DOUBLE err_norm, 2.0::DOUBLE err_comp")(lambda s, d: P.error_norms(T.true_solution(s, n_parts(s, d)), T.ones(s, n_parts(s, d))).select("k", _r("err_norm"), _r("err_comp")))

# --- analysis -------------------------------------------------------------------------------------------------------


def _kept(s: SparkSession, d: str) -> DataFrame:
    return Scratch(s).keep(band(s, d), "band")




def shifted(s: SparkSession, d: str) -> DataFrame:
    """The band with its rows turned by 7, so that the heaviest entries lie off the diagonal."""
    n = n_parts(s, d)
    turn = s.range(n).select(F.col("id").alias("src"), ((F.col("id") + 7) % n).alias("dst"))
    return Scratch(s).keep(E.permute(band(s, d), turn), "shifted")


add("match_rows", "SELECT p_partkey src, (p_partkey - 7 + n) % n dst, 0 info FROM part, (SELECT count(*) n FROM part)")(lambda s, d: N.match_rows(shifted(s, d), n_parts(s, d)).select("src", "dst", "info"))
add("heavy_matching", "SELECT p_partkey src, (p_partkey - 7 + n) % n dst FROM part, (SELECT count(*) n FROM part)")(lambda s, d: N.heavy_matching(shifted(s, d)))
for _how in ("mmd_at_plus_a", "mmd_ata", "nested_dissection", "natural"):
    add(f"order_{_how}", "SELECT count(*) n, true valid FROM part")(
        lambda s, d, how=_how: N.order_columns(_kept(s, d), how, n_parts(s, d)).agg(
            F.count(F.lit(1)).alias("n"), ((F.countDistinct("dst") == F.count(F.lit(1))) & (F.min("dst") == 0) & (F.max("dst") == F.count(F.lit(1)) - 1)).alias("valid")
        )
    )


@add(
    "order_fill",
    "SELECT sum(CASE WHEN j < k - 1 THEN j + 3 ELSE least(k, k * k - 1 - j) + 1 END)::BIGINT AS natural_entries, true AS degree_fewer, true AS dissection_fewer, true AS separators_fewer FROM k, range(1000000) r(j) WHERE j < k * k",
    SIDE_SQL,
)
def order_fill(s: SparkSession, d: str) -> DataFrame:
    """Entries of L of the grid of parts: in natural order known by a formula, in fill-reducing orders fewer; all are counted, none is made."""
    n = _side(s, d) ** 2
    a = Scratch(s).keep(priced_grid(s, d), "grid")

    natural = N.factor_entries(a, n)
    degree = N.factor_entries(a, n, N.order_columns(a, "mmd_at_plus_a", n))
    separators = N.factor_entries(a, n, D.dissect(a, n).permutation())
    # beyond a piece the order by nested dissection is that of the separators
    dissection = separators if n > G.PIECE else N.factor_entries(a, n, N.order_columns(a, "nested_dissection", n))
    found = [entries < natural for entries in (degree, dissection, separators)]
    return _one(s, "natural_entries long, degree_fewer boolean, dissection_fewer boolean, separators_fewer boolean", (natural, *found))


#: Pattern and values of the band's rows side by side, for recursion from row to row.
ROWS_SQL = """w AS MATERIALIZED (SELECT p_partkey i, coalesce(max(v) FILTER (j = i - 2), 0) a2, coalesce(max(v) FILTER (j = i - 1), 0) a1, max(v) FILTER (j = i) a0,
coalesce(max(v) FILTER (j = i + 1), 0) b1, coalesce(max(v) FILTER (j = i + 2), 0) b2 FROM part LEFT JOIN a ON i = p_partkey GROUP BY 1)"""
_LU = """l2 AS (SELECT 0), lu AS (SELECT i, 0.0::DOUBLE l2, 0.0::DOUBLE l1, a0 d, b1 e, b2 f, 1.0::DOUBLE d1, 0.0::DOUBLE e1, 0.0::DOUBLE f1 FROM w WHERE i = 0 UNION ALL
SELECT i, l2, l1, a0 - l2 * f1 - l1 * e, {e}, b2, d, e, f FROM (SELECT w.*, lu.d, lu.e, lu.f, lu.f1, w.a2 / lu.d1 l2, {l1} l1 FROM lu JOIN w ON w.i = lu.i + 1))"""
LU_SQL = _LU.format(l1="(w.a1 - w.a2 / lu.d1 * lu.e1) / lu.d", e="b1 - l1 * f").removeprefix("l2 AS (SELECT 0), ")
ILU_SQL = _LU.format(l1="CASE WHEN w.a1 = 0 THEN 0 ELSE (w.a1 - w.a2 / lu.d1 * lu.e1) / lu.d END", e="CASE WHEN b1 = 0 THEN 0 ELSE b1 - l1 * f END").removeprefix("l2 AS (SELECT 0), ")
#: Exact patterns of L and U: whether the place one (two) left of and right of the diagonal is filled.
FILL_SQL = """fl AS (SELECT i, false p2, false p1, b1 <> 0 q1, b2 <> 0 q2, false o1, false o2 FROM w WHERE i = 0 UNION ALL
SELECT i, p2, p1, b1 <> 0 OR (p1 AND q2), b2 <> 0, q1, q2 FROM (SELECT w.*, fl.q1, fl.q2, w.a2 <> 0 p2, w.a1 <> 0 OR (w.a2 <> 0 AND fl.o1) p1 FROM fl JOIN w ON w.i = fl.i + 1))"""
#: Cholesky pattern of the band's symmetric pattern: whether a row reaches one (two) to the left.
TREE_SQL = """y AS MATERIALIZED (SELECT p_partkey i, coalesce(bool_or(t.d = 1), false) s1, coalesce(bool_or(t.d = 2), false) s2 FROM part LEFT JOIN (SELECT greatest(i, j) i, abs(i - j) d FROM a WHERE i <> j) t ON t.i = p_partkey GROUP BY 1),
ch AS (SELECT 0::BIGINT i, false c1, false c2 UNION ALL SELECT y.i, y.s1 OR (y.s2 AND ch.c1), y.s2 FROM ch JOIN y ON y.i = ch.i + 1)"""

#: Pattern of A'A beside the band (a row's columns are neighbours) and its Cholesky pattern: whether a row reaches one to four to the left.
COLUMN_TREE_SQL = """ap AS MATERIALIZED (SELECT DISTINCT greatest(l.j, r.j) i, abs(l.j - r.j) d FROM a l JOIN a r USING (i) WHERE l.j <> r.j),
y AS MATERIALIZED (SELECT p_partkey i, coalesce(bool_or(d = 1), false) s1, coalesce(bool_or(d = 2), false) s2, coalesce(bool_or(d = 3), false) s3, coalesce(bool_or(d = 4), false) s4 FROM part LEFT JOIN ap ON i = p_partkey GROUP BY 1),
ch AS (SELECT 0::BIGINT i, false f1, false f2, false f3, false f4, false g1, false g2, false g3, false h1, false h2, false k1 UNION ALL
SELECT i, s1 OR (s4 AND g3) OR (e3 AND g2) OR (e2 AND g1), e2, e3, s4, g1, g2, g3, h1, h2, k1 FROM (SELECT *, s2 OR (s4 AND h2) OR (e3 AND h1) e2 FROM (SELECT y.*, ch.f1 g1, ch.f2 g2, ch.f3 g3, ch.g1 h1, ch.g2 h2, ch.h1 k1, y.s3 OR (y.s4 AND ch.h1) e3 FROM ch JOIN y ON y.i = ch.i + 1)))"""
SYMMETRIC_PARENTS = "pa AS MATERIALIZED (SELECT k.p_partkey node, CASE WHEN x.c1 THEN x.i WHEN z.c2 THEN z.i ELSE n END::BIGINT parent FROM part k, n LEFT JOIN ch x ON x.i = k.p_partkey + 1 LEFT JOIN ch z ON z.i = k.p_partkey + 2)"
COLUMN_PARENTS = "pa AS MATERIALIZED (SELECT k.p_partkey node, CASE WHEN x.f1 THEN x.i WHEN z.f2 THEN z.i WHEN t.f3 THEN t.i WHEN u.f4 THEN u.i ELSE n END::BIGINT parent FROM part k, n LEFT JOIN ch x ON x.i = k.p_partkey + 1 LEFT JOIN ch z ON z.i = k.p_partkey + 2 LEFT JOIN ch t ON t.i = k.p_partkey + 3 LEFT JOIN ch u ON u.i = k.p_partkey + 4)"
#: All pairs of a node and what is above it; then counts below, and in postorder what comes before by earlier children.
MEASURES_SQL = """ab AS (SELECT node, node up, 0::BIGINT d FROM pa UNION ALL SELECT ab.node, parent, d + 1 FROM ab JOIN pa ON pa.node = ab.up, n WHERE parent < n.n),
sz AS MATERIALIZED (SELECT up node, count(*) size, max(d) lev FROM ab GROUP BY 1),
os AS MATERIALIZED (SELECT pa.node, parent, size, lev, coalesce(sum(size) OVER (PARTITION BY parent ORDER BY pa.node ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) o FROM pa JOIN sz USING (node))"""
MEASURES = "SELECT v.node, any_value(v.parent)::BIGINT parent, (sum(u.o) + any_value(v.size) - 1)::BIGINT post, any_value(v.lev)::BIGINT AS level, (any_value(v.size) - 1)::BIGINT descendants FROM ab JOIN os v ON v.node = ab.node JOIN os u ON u.node = ab.up GROUP BY 1"

add("elimination_parents", "SELECT * FROM pa", f"RECURSIVE {BAND_SQL}, {TREE_SQL}, {SYMMETRIC_PARENTS}")(
    lambda s, d: R.elimination_parents(P.a_plus_at_pattern(band(s, d)), n_parts(s, d))
)
add("elimination_tree", MEASURES, f"RECURSIVE {BAND_SQL}, {TREE_SQL}, {SYMMETRIC_PARENTS}, {MEASURES_SQL}")(lambda s, d: R.elimination_tree(_kept(s, d), n_parts(s, d)))
add("column_tree", MEASURES, f"RECURSIVE {BAND_SQL}, {COLUMN_TREE_SQL}, {COLUMN_PARENTS}, {MEASURES_SQL}")(lambda s, d: R.elimination_tree(_kept(s, d), n_parts(s, d), "column"))
add("supernodes")(lambda s, d: N.supernodes(_kept(s, d), n_parts(s, d), 8, 32, 4))
add("load_imbalance")(lambda s, d: N.load_imbalance(N.supernodes(_kept(s, d), n_parts(s, d), 8, 32, 4)))
add(
    "symbolic",
    "SELECT part, i, j FROM (SELECT 'L' part, i, i j FROM fl UNION ALL SELECT 'L', i, i - 1 FROM fl WHERE p1 UNION ALL SELECT 'L', i, i - 2 FROM fl WHERE p2 UNION ALL "
    "SELECT 'U', i, i FROM fl UNION ALL SELECT 'U', i, i + 1 FROM fl WHERE q1 UNION ALL SELECT 'U', i, i + 2 FROM fl WHERE q2)",
    f"RECURSIVE {BAND_SQL}, {ROWS_SQL}, {FILL_SQL}",
)(lambda s, d: N.symbolic(_kept(s, d), n_parts(s, d)))
add(
    "incomplete_lu",
    "SELECT a.i, a.j, round(CASE a.j - a.i WHEN -2 THEN l2 WHEN -1 THEN l1 WHEN 0 THEN d WHEN 1 THEN e ELSE f END, 6) + 0.0 v FROM a JOIN lu ON lu.i = a.i",
    f"RECURSIVE {BAND_SQL}, {ROWS_SQL}, {ILU_SQL}",
)(lambda s, d: _cells(N.incomplete_lu(_kept(s, d), n_parts(s, d))))

# --- solving --------------------------------------------------------------------------------------------------------

X_SQL = "SELECT p_partkey i, k::INTEGER k, CASE WHEN p_partkey % 2 = 1 THEN 1.0 ELSE -1.0 END::DOUBLE x FROM part, range({n}) r(k)"


def _solved(options: Options, nrhs: int = 1) -> Query:
    def run(s: SparkSession, d: str) -> DataFrame:
        a, n = _kept(s, d), n_parts(s, d)
        b = P.spmv(a, T.true_solution(s, n, nrhs), trans=options.trans)
        return _vector(S.solve(a, b, n, options).x)

    return run


add("solve", X_SQL.format(n=1))(_solved(Options()))
add("solve_many_sides", X_SQL.format(n=3))(_solved(Options(), 3))
add("solve_transposed", X_SQL.format(n=1))(_solved(Options(trans=True)))
add("solve_by_subtrees", X_SQL.format(n=1))(_solved(Options(task_rows=64)))
add("solve_nested_dissection", X_SQL.format(n=1))(_solved(Options(col_perm="nested_dissection", row_perm="none")))
add("solve_mixed_precision", X_SQL.format(n=1))(_solved(Options(precision="single")))
add("solve_plain", X_SQL.format(n=1))(_solved(Options(equilibrate=False, row_perm="none", col_perm="natural", refine="none", replace_tiny_pivot=True)))


@add("solve_single_bounds", "SELECT i, k, x, true bounded FROM (" + X_SQL.format(n=2) + ")")
def solve_single_bounds(s: SparkSession, d: str) -> DataFrame:
    """Single-precision factors, double-precision result with error bounds that hold."""
    a, n = _kept(s, d), n_parts(s, d)
    true = T.true_solution(s, n, 2)
    x, bounds = S.mixed_precision(a, P.spmv(a, true), n)
    x = Scratch(s).keep(x)
    held = P.error_norms(x, true).join(bounds, "k").select("k", ((F.col("err_norm") <= F.col("norm_bound")) & (F.col("err_comp") <= F.col("comp_bound"))).alias("bounded"))
    return x.join(held, "k").select("i", "k", _r("x"), "bounded")


@add("solve_reusing_factor", X_SQL.format(n=1))
def solve_reusing_factor(s: SparkSession, d: str) -> DataFrame:
    """Factor once, then solve a matrix of the same pattern with the order, matching and scalings kept."""
    a, n = _kept(s, d), n_parts(s, d)
    first = S.factorize(a, n)
    other = E.scale_add_identity(a, 2.0)
    return _vector(S.solve(other, P.spmv(other, T.true_solution(s, n)), n, Options(fact="same_pattern_same_row_perm"), first).x)


@add("lower_upper_solve", "SELECT p_partkey i, 0 k, CASE WHEN p_partkey % 2 = 1 THEN 1.0 ELSE -1.0 END::DOUBLE x FROM part")
def lower_upper_solve(s: SparkSession, d: str) -> DataFrame:
    a, n = _kept(s, d), n_parts(s, d)
    low, up = files.unit_lower(a), a.filter("i <= j")
    b = P.spmv(low, P.spmv(up, T.true_solution(s, n)))
    return _vector(N.solve_factored(a, b))


@add("factor_product", "SELECT 0.0::DOUBLE worst")
def factor_product(s: SparkSession, d: str) -> DataFrame:
    """Greatest entry of L U - A1, with A1 the scaled and permuted matrix."""
    a, n = _kept(s, d), n_parts(s, d)
    f = S.factorize(a, n)
    at = f.tables()[0]
    one = a.join(at.select("i", "r", "rs"), "i").join(at.select(F.col("i").alias("j"), "c", "cs"), "j")
    one = one.select(F.col("r").alias("i"), F.col("c").alias("j"), (-F.col("v") * F.col("rs") * F.col("cs")).alias("v"))
    gap = P.matmul(f.triangle(True), f.triangle(False)).unionByName(one).groupBy("i", "j").agg(F.sum("v").alias("v"))
    return gap.agg((F.round(F.max(F.abs("v")), 9) + 0.0).alias("worst"))


@add("normalised_residual", "SELECT true AS passes")
def normalised_residual(s: SparkSession, d: str) -> DataFrame:
    a, n = _kept(s, d), n_parts(s, d)
    b = Scratch(s).keep(P.spmv(a, T.true_solution(s, n, 2)))
    x = Scratch(s).keep(S.solve(a, b, n).x)
    return _one(s, "passes boolean", (P.normalised_residual(a, x, b) < 20,))


@add("log_determinant", "SELECT 1.0::DOUBLE sign, round(sum(ln(d)), 6) logdet FROM lu", f"RECURSIVE {BAND_SQL}, {ROWS_SQL}, {LU_SQL}")
def log_determinant(s: SparkSession, d: str) -> DataFrame:
    sign, logdet = S.factorize(_kept(s, d), n_parts(s, d)).logdet()
    return _one(s, "sign double, logdet double", (float(sign), round(logdet, 6)))


def _systems(s: SparkSession, d: str) -> DataFrame:
    """One small system for each nation: suppliers' customers' order counts by month, made dominant."""
    o = _read(s, d, "orders").join(_read(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    off = o.select(F.col("c_nationkey").cast("long").alias("batch_id"), (F.col("o_orderkey") % 12).cast("long").alias("i"), (F.col("o_custkey") % 12).cast("long").alias("j"))
    off = off.filter("i != j").groupBy("batch_id", "i", "j").agg(F.count(F.lit(1)).cast("double").alias("v"))
    sums = off.groupBy("batch_id", "i").agg(F.sum("v").alias("s"))
    every = off.select("batch_id").distinct().crossJoin(s.range(12).withColumnRenamed("id", "i")).join(sums, ["batch_id", "i"], "left")
    return off.unionByName(every.select("batch_id", "i", F.col("i").alias("j"), (F.lit(1.0) + F.coalesce("s", F.lit(0.0))).alias("v")))


@add("solve_batch", "SELECT DISTINCT c_nationkey::BIGINT batch_id, i, 0 k, CASE WHEN i % 2 = 1 THEN 1.0 ELSE -1.0 END::DOUBLE x FROM orders JOIN customer ON o_custkey = c_custkey, range(12) r(i) WHERE o_orderkey % 12 <> o_custkey % 12")
def solve_batch(s: SparkSession, d: str) -> DataFrame:
    a = _systems(s, d)
    x = F.when(F.col("j") % 2 == 1, 1.0).otherwise(-1.0)
    b = a.groupBy("batch_id", "i").agg(F.sum(F.col("v") * x).alias("x")).select("batch_id", "i", F.lit(0).alias("k"), "x")
    return S.solve_batch(a, b).select("batch_id", "i", "k", _r("x"))


SYSTEMS_SQL = """so AS (SELECT c_nationkey::BIGINT batch_id, (o_orderkey % 12)::BIGINT i, (o_custkey % 12)::BIGINT j, count(*)::DOUBLE v FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey % 12 <> o_custkey % 12 GROUP BY 1, 2, 3),
sd AS (SELECT b.batch_id, r.i, r.i j, 1.0 + coalesce(sum(v), 0) v FROM (SELECT DISTINCT batch_id FROM so) b CROSS JOIN range(12) r(i) LEFT JOIN so ON so.batch_id = b.batch_id AND so.i = r.i GROUP BY 1, 2),
sf AS (SELECT b.batch_id, list(coalesce(x.v, 0.0) ORDER BY p) m FROM (SELECT DISTINCT batch_id FROM so) b CROSS JOIN range(144) r(p) LEFT JOIN (SELECT * FROM so UNION ALL SELECT * FROM sd) x ON x.batch_id = b.batch_id AND x.i * 12 + x.j = p GROUP BY 1),
el AS (SELECT batch_id, 0 k, m, 0.0::DOUBLE t FROM sf UNION ALL
SELECT batch_id, k + 1, list_transform(range(144), lambda p: m[p + 1] - CASE WHEN p // 12 > k THEN m[(p // 12) * 12 + k + 1] * m[k * 12 + p % 12 + 1] / m[k * 13 + 1] ELSE 0 END), t + ln(m[k * 13 + 1]) FROM el WHERE k < 12)"""
add("logdet_batch", "SELECT batch_id, 1.0::DOUBLE sign, round(t, 6) + 0.0 logdet, 0::BIGINT info FROM el WHERE k = 12", f"RECURSIVE {SYSTEMS_SQL}")(lambda s, d: S.logdet_batch(_systems(s, d)).select("batch_id", "sign", _r("logdet"), "info"))


@add("solve_components", "SELECT p_partkey + b * n i, 0 k, CASE WHEN (p_partkey + b * n) % 2 = 1 THEN 1.0 ELSE -1.0 END::DOUBLE x FROM part, n, range(3) r(b)", "n AS (SELECT count(*) n FROM part)")
def solve_components(s: SparkSession, d: str) -> DataFrame:
    n = n_parts(s, d)
    a = Scratch(s).keep(T.block_diagonal(_kept(s, d), n, 3))
    return _vector(S.solve_components(a, P.spmv(a, T.true_solution(s, 3 * n))))


add("events_matrix", "SELECT user_id i, ascii(event_type)::BIGINT j, round(sum(value), 6) + 0.0 v FROM events GROUP BY 1, 2")(
    lambda s, d: _cells(T.from_table(_read(s, d, "events"), "user_id", "ascii(event_type)", "value"))
)


@add("solve_complex", "SELECT i, 0 k, 1.0::DOUBLE re, -1.0::DOUBLE im FROM (SELECT count(*) n FROM part), range(1000000) r(i) WHERE i < greatest(2, n // 500) * 48")
def solve_complex(s: SparkSession, d: str) -> DataFrame:
    """A lattice as long as there are parts for, each row times its part's price."""
    parts = n_parts(s, d)
    length = max(2, parts // 500)
    price = _read(s, d, "part").select(F.col("p_partkey").alias("p"), "p_retailprice")
    a = T.lattice(s, (length, 2, 2, 4), 3).withColumn("p", F.col("i") % parts).join(price, "p")
    a = Scratch(s).keep(a.select("i", "j", C.times(F.col("v"), F.col("p_retailprice"), True).alias("v")))
    x = C.make(F.lit(1.0), F.lit(-1.0))
    b = a.withColumn("t", C.multiply(F.col("v"), x)).groupBy("i").agg(F.sum("t.re").alias("re"), F.sum("t.im").alias("im"))
    b = b.select("i", F.lit(0).alias("k"), F.struct("re", "im").alias("x"))
    got = S.solve(a, b, length * 48).x.select("i", "k", F.col("x.re").alias("re"), F.col("x.im").alias("im"))
    return got.select("i", "k", _r("re"), _r("im"))


# --- complex twins, storage forms, files ----------------------------------------------------------------------------

ZBAND_SQL = BAND_SQL + ", z AS (SELECT i, j, v re, v * (i - j) / 4 im FROM a)"


def zband(spark: SparkSession, d: str) -> DataFrame:
    """The band with imaginary parts off the diagonal."""
    return band(spark, d).select("i", "j", C.make(F.col("v"), F.col("v") * (F.col("i") - F.col("j")) / 4).alias("v"))


def ztrue(spark: SparkSession, n: int) -> DataFrame:
    """1 - i at even, -1 + 2 i at odd indices."""
    even = F.col("i") % 2 == 0
    return T.ones(spark, n).select("i", "k", C.make(F.when(even, 1.0).otherwise(-1.0), F.when(even, -1.0).otherwise(2.0)).alias("x"))


ZX_SQL = "zx AS (SELECT p_partkey i, CASE WHEN p_partkey % 2 = 0 THEN 1.0 ELSE -1.0 END xr, CASE WHEN p_partkey % 2 = 0 THEN -1.0 ELSE 2.0 END xi FROM part)"


def _zcells(a: DataFrame, digits: int = 6) -> DataFrame:
    return a.select("i", "j", *[(F.round(F.col(f"v.{c}"), digits) + 0.0).alias(c) for c in ("re", "im")])


def _zvector(x: DataFrame) -> DataFrame:
    return x.select("i", "k", F.col("x.re").alias("re"), F.col("x.im").alias("im")).select("i", "k", _r("re"), _r("im"))


ZSPMV = "SELECT z.{r} i, 0 k, round(sum(re * xr - {s} im * xi), 6) + 0.0 re, round(sum(re * xi + {s} im * xr), 6) + 0.0 im FROM z JOIN zx ON zx.i = z.{c} GROUP BY 1"
add("spmv_complex", ZSPMV.format(r="i", c="j", s=""), f"{ZBAND_SQL}, {ZX_SQL}")(lambda s, d: _zvector(P.spmv(zband(s, d), ztrue(s, n_parts(s, d)))))
add("spmv_conjugate_transposed", ZSPMV.format(r="j", c="i", s="-1 *"), f"{ZBAND_SQL}, {ZX_SQL}")(lambda s, d: _zvector(P.spmv(zband(s, d), ztrue(s, n_parts(s, d)), trans=True, conj=True)))
add("matmul_complex", "SELECT l.i, r.j, round(sum(l.re * r.re - l.im * r.im), 9) + 0.0 re, round(sum(l.re * r.im + l.im * r.re), 9) + 0.0 im FROM z l JOIN z r ON l.j = r.i GROUP BY 1, 2", ZBAND_SQL)(
    lambda s, d: (lambda a: _zcells(P.matmul(a, a.select("i", "j", "v")), 9))(Scratch(s).keep(zband(s, d)))
)
add(
    "gemv_conjugate",
    "SELECT z.j i, 0 k, round(2 * sum(re * t.xr + im * t.xi) - 3 * any_value(o.xr), 6) + 0.0 re, round(2 * sum(re * t.xi - im * t.xr) - 3 * any_value(o.xi), 6) + 0.0 im FROM z JOIN zx t ON t.i = z.i JOIN zx o ON o.i = z.j GROUP BY 1",
    f"{ZBAND_SQL}, {ZX_SQL}",
)(lambda s, d: (lambda n: _zvector(P.gemv(zband(s, d), ztrue(s, n), ztrue(s, n), 2.0, -3.0, trans=True, conj=True)))(n_parts(s, d)))
add(
    "schur_step_complex",
    "SELECT i, j, round(sum(re), 6) + 0.0 re, round(sum(im), 6) + 0.0 im FROM (SELECT i, j, re, im FROM y WHERE i <> 0 AND j <> 0 UNION ALL "
    "SELECT l.i, u.j, -((l.re * u.re - l.im * u.im) * p.re + (l.re * u.im + l.im * u.re) * p.im) / (p.re * p.re + p.im * p.im), "
    "-((l.re * u.im + l.im * u.re) * p.re - (l.re * u.re - l.im * u.im) * p.im) / (p.re * p.re + p.im * p.im) "
    "FROM y l, y u, y p WHERE l.j = 0 AND l.i <> 0 AND u.i = 0 AND u.j <> 0 AND p.i = 0 AND p.j = 0) GROUP BY 1, 2",
    BAND_SQL + ", y AS (SELECT i, j, v re, v * (i - j + 1) / 4 im FROM a)",
)(lambda s, d: _zcells(P.schur_step(band(s, d).select("i", "j", C.make(F.col("v"), F.col("v") * (F.col("i") - F.col("j") + 1) / 4).alias("v")), 0)))
add("scale_add_identity_complex", "SELECT i, j, round(2.5 * re + CASE WHEN i = j THEN 1 ELSE 0 END, 6) + 0.0 re, round(2.5 * im, 6) + 0.0 im FROM z", ZBAND_SQL)(lambda s, d: _zcells(E.scale_add_identity(zband(s, d), 2.5)))
add("norms_complex", NORMS_SQL.replace("FROM a", "FROM (SELECT i, j, sqrt(re * re + im * im) v FROM z)"), ZBAND_SQL)(
    lambda s, d: (lambda a: _one(s, "kind string, value double", *[(k, round(P.norm(a, k), 6) + 0.0) for k in "M1IF"]))(Scratch(s).keep(zband(s, d)))
)
add(
    "equilibrate_complex",
    "SELECT 'row' side, i, round(s, 6) + 0.0 s FROM r UNION ALL SELECT 'col', i, round(s, 6) + 0.0 FROM c",
    ZBAND_SQL + ", m2 AS (SELECT i, j, abs(re) + abs(im) v FROM z), " + EQUIL_SQL,
)(
    lambda s, d: (
        lambda e: e.rows.select(F.lit("row").alias("side"), "i", _r("s")).unionByName(e.cols.select(F.lit("col").alias("side"), "i", _r("s")))
    )(P.equilibrate(Scratch(s).keep(zband(s, d)), n_parts(s, d), n_parts(s, d)))
)
add(
    "backward_error_complex",
    "SELECT 0 k, round(max((abs(1 - ar) + abs(ai)) / (size + 1)), 6) + 0.0 berr FROM (SELECT z.i, sum(re * xr - im * xi) ar, sum(re * xi + im * xr) ai, sum((abs(re) + abs(im)) * (abs(xr) + abs(xi))) size FROM z JOIN zx ON zx.i = z.j GROUP BY 1)",
    f"{ZBAND_SQL}, {ZX_SQL}",
)(lambda s, d: P.backward_error(zband(s, d), ztrue(s, n_parts(s, d)), T.ones(s, n_parts(s, d)), n_parts(s, d)).select("k", _r("berr")))


@add("solve_complex_band", "SELECT i, 0 k, xr::DOUBLE re, xi::DOUBLE im FROM zx", ZX_SQL)
def solve_complex_band(s: SparkSession, d: str) -> DataFrame:
    """Complex system with refinement, factored by subtrees."""
    a, n = Scratch(s).keep(zband(s, d)), n_parts(s, d)
    return _zvector(S.solve(a, P.spmv(a, ztrue(s, n)), n, Options(task_rows=64)).x)


@add("solve_real_with_complex_sides", "SELECT i, 0 k, xr::DOUBLE re, xi::DOUBLE im FROM zx", ZX_SQL)
def solve_real_with_complex_sides(s: SparkSession, d: str) -> DataFrame:
    a, n = _kept(s, d), n_parts(s, d)
    return _zvector(S.solve(a, P.spmv(a, ztrue(s, n)), n).x)


@add(
    "solve_batch_complex",
    "SELECT DISTINCT c_nationkey::BIGINT batch_id, i, 0 k, 1.0::DOUBLE re, -1.0::DOUBLE im FROM orders JOIN customer ON o_custkey = c_custkey, range(12) r(i) WHERE o_orderkey % 12 <> o_custkey % 12",
)
def solve_batch_complex(s: SparkSession, d: str) -> DataFrame:
    a = _systems(s, d).withColumn("v", C.make(F.col("v"), F.col("v") * (F.col("i") - F.col("j")) / 24))
    b = a.withColumn("p", C.multiply(F.col("v"), C.make(F.lit(1.0), F.lit(-1.0)))).groupBy("batch_id", "i").agg(C.total(F.col("p"), True).alias("x"))
    got = S.solve_batch(a, b.select("batch_id", "i", F.lit(0).alias("k"), "x"))
    return got.select("batch_id", "i", "k", F.col("x.re").alias("re"), F.col("x.im").alias("im")).select("batch_id", "i", "k", _r("re"), _r("im"))


@add("solver_session", X_SQL.format(n=2))
def solver_session(s: SparkSession, d: str) -> DataFrame:
    """Factor, refactor a matrix of the same pattern, solve, free."""
    a, n = _kept(s, d), n_parts(s, d)
    with S.Solver(a, n) as solver:
        other = Scratch(s).keep(E.scale_add_identity(a, 2.0))
        solver.refactor(other)
        return _vector(solver.solve(P.spmv(other, T.true_solution(s, n, 2))).x)


MSR_SQL = """p AS (SELECT p_partkey r, count(j) c FROM part LEFT JOIN a ON i = p_partkey AND i <> j GROUP BY 1),
st AS (SELECT r, coalesce(sum(c) OVER (ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (SELECT n + 1 FROM n) b FROM p)"""
add(
    "modified_rows",
    "SELECT r::BIGINT AS at, round(v, 6) + 0.0 val, b::BIGINT bindx FROM st JOIN a ON i = r AND j = r UNION ALL SELECT n, NULL, n + 1 + (SELECT sum(c) FROM p)::BIGINT FROM n "
    "UNION ALL SELECT (b + row_number() OVER (PARTITION BY i ORDER BY j) - 1)::BIGINT, round(v, 6) + 0.0, j FROM a JOIN st ON i = r WHERE i <> j",
    f"{BAND_SQL}, {MSR_SQL}",
)(lambda s, d: E.to_msr(_kept(s, d), n_parts(s, d)).select("at", _r("val"), "bindx"))


add(
    "modified_rows_complex",
    "SELECT r::BIGINT AS at, round(re, 6) + 0.0 re, round(im, 6) + 0.0 im, b::BIGINT bindx FROM st JOIN z ON i = r AND j = r UNION ALL SELECT n, NULL, NULL, n + 1 + (SELECT sum(c) FROM p)::BIGINT FROM n "
    "UNION ALL SELECT (b + row_number() OVER (PARTITION BY i ORDER BY j) - 1)::BIGINT, round(re, 6) + 0.0, round(im, 6) + 0.0, j FROM z JOIN st ON i = r WHERE i <> j",
    f"{ZBAND_SQL}, {MSR_SQL}",
)(lambda s, d: E.to_msr(Scratch(s).keep(zband(s, d)), n_parts(s, d)).select("at", F.col("val.re").alias("re"), F.col("val.im").alias("im"), "bindx").select("at", _r("re"), _r("im"), "bindx"))


@add("permutation_sign", "SELECT CASE WHEN (n // 2) % 2 = 0 THEN 1 ELSE -1 END flipped, CASE WHEN (n - 1) % 2 = 0 THEN 1 ELSE -1 END turned FROM (SELECT count(*) n FROM part)")
def permutation_sign(s: SparkSession, d: str) -> DataFrame:
    n = n_parts(s, d)
    ids = s.range(n).withColumnRenamed("id", "src")
    flip, turn = ids.withColumn("dst", n - 1 - F.col("src")), ids.withColumn("dst", (F.col("src") + 1) % n)
    return _one(s, "flipped int, turned int", (E.permutation_sign(flip, n), E.permutation_sign(turn, n)))


BELOW_SQL = """b AS MATERIALIZED (SELECT p_partkey node, coalesce(bool_or(j = i - 1), false) d1, coalesce(bool_or(j = i - 2), false) d2 FROM part LEFT JOIN a ON i = p_partkey AND j < i GROUP BY 1),
lv AS (SELECT 0::BIGINT node, 0::BIGINT lev, 0::BIGINT prev UNION ALL
SELECT b.node, greatest(CASE WHEN d1 THEN lev + 1 ELSE 0 END, CASE WHEN d2 THEN prev + 1 ELSE 0 END), lev FROM lv JOIN b ON b.node = lv.node + 1)"""


@add("level_sets", "SELECT node, lev FROM lv", f"RECURSIVE {BAND_SQL}, {BELOW_SQL}")
def level_sets(s: SparkSession, d: str) -> DataFrame:
    """All levels of the band's lower triangle; its SQL goes from row to row, as a row needs only the two before it."""
    return N.level_sets(_kept(s, d), n_parts(s, d)).select("node", F.col("level").alias("lev"))


@add("static_partition", "SELECT count(*) items, round(sum(l_quantity), 6) + 0.0 load, true even FROM (SELECT l_suppkey, sum(l_quantity) l_quantity FROM lineitem GROUP BY 1)")
def static_partition(s: SparkSession, d: str) -> DataFrame:
    """Suppliers dealt to 4 parts by quantity; parts differ by no more than the greatest item."""
    work = _read(s, d, "lineitem").groupBy(F.col("l_suppkey").alias("item")).agg(F.sum("l_quantity").alias("load"))
    dealt = Scratch(s).keep(N.static_partition(work, 4))
    span = dealt.groupBy("part").agg(F.sum("load").alias("l")).agg((F.max("l") - F.min("l")).alias("span"))
    out = dealt.agg(F.count(F.lit(1)).alias("items"), F.sum("load").alias("load"), F.max("load").alias("most")).join(F.broadcast(span))  # one row each
    return out.select("items", _r("load"), (F.col("span") <= F.col("most")).alias("even"))


@add("factor_extremes", "SELECT 1.0::DOUBLE most_l, round(max(abs(v)), 6) + 0.0 most_u FROM a", BAND_SQL)
def factor_extremes(s: SparkSession, d: str) -> DataFrame:
    """L of a dominant matrix has its units as greatest entries. U's are the greatest of A where the largest row comes first."""
    a, n = _kept(s, d), n_parts(s, d)
    top = a.orderBy(F.abs("v").desc(), "i").select("i").first()[0]
    ids = s.range(n).withColumnRenamed("id", "src")
    swap = ids.withColumn("dst", F.when(F.col("src") == top, 0).when(F.col("src") == 0, top).otherwise(F.col("src")).cast("long"))
    f = S.factorize(E.permute(a, swap, swap), n, Options(equilibrate=False, row_perm="none", col_perm="natural"))
    low, up = f.extremes()
    return _one(s, "most_l double, most_u double", (round(low, 6), round(up, 6)))


@add("factor_memory")
def factor_memory(s: SparkSession, d: str) -> DataFrame:
    return S.factorize(_kept(s, d), n_parts(s, d), Options(task_rows=64)).memory()


@add("solve_conjugate_triangle", "SELECT i, 0 k, xr::DOUBLE re, xi::DOUBLE im FROM zx", ZX_SQL)
def solve_conjugate_triangle(s: SparkSession, d: str) -> DataFrame:
    """The conjugate transpose of the lower triangle."""
    a, n = Scratch(s).keep(zband(s, d).filter("i >= j")), n_parts(s, d)
    return _zvector(N.triangular_solve(a, P.spmv(a, ztrue(s, n), trans=True, conj=True), trans=True, conj=True))


def _through_file(kind: str, suffix: str, wide: bool) -> Query:
    def run(s: SparkSession, d: str) -> DataFrame:
        path = f"{Scratch(s).path}/matrix.{suffix}"
        files.write_matrix(zband(s, d) if wide else band(s, d), path, kind, n_parts(s, d))
        got = files.read_matrix(s, path, wide)
        return _zcells(got) if wide else _cells(got)

    return run


ZCELLS = "SELECT i, j, round(re, 6) + 0.0 re, round(im, 6) + 0.0 im FROM z"
add("file_parquet", CELLS + "a", BAND_SQL)(_through_file("parquet", "parquet", False))
add("file_triplets", CELLS + "a", BAND_SQL)(_through_file("triplets", "datnh", False))
add("file_matrix_market", CELLS + "a", BAND_SQL)(_through_file("market", "mtx", False))
add("file_matrix_market_complex", ZCELLS, ZBAND_SQL)(_through_file("market", "mtx", True))
add("file_sized_triplets", CELLS + "a", BAND_SQL)(_through_file("sized_triplets", "dat", False))
add("file_harwell_boeing", CELLS + "a", BAND_SQL)(_through_file("boeing", "rua", False))
add("file_rutherford_boeing", CELLS + "a", BAND_SQL)(_through_file("rutherford", "rb", False))


@add("file_right_sides", "SELECT p_partkey i, 0 k, round(p_retailprice, 6) + 0.0 x FROM part")
def file_right_sides(s: SparkSession, d: str) -> DataFrame:
    path = f"{Scratch(s).path}/sides.txt"
    files.write_rhs(_read(s, d, "part").select(F.col("p_partkey").alias("i"), F.col("p_retailprice").alias("x")), path)
    return _vector(files.read_rhs(s, path))


@add("file_unit_lower", "SELECT i, j, CASE WHEN i = j THEN 1.0 ELSE round(v, 6) + 0.0 END v FROM a WHERE i >= j", BAND_SQL)
def file_unit_lower(s: SparkSession, d: str) -> DataFrame:
    path = f"{Scratch(s).path}/matrix.mtx"
    files.write_matrix(band(s, d), path, "market", n_parts(s, d))
    return _cells(files.read_unit_lower(s, path))


# --- factors kept, given permutations, systems of several sizes ---------------------------------------------------------

add("fill_constant", "SELECT i, j, 2.5::DOUBLE v FROM m2", M2_SQL)(lambda s, d: E.fill(parts_suppliers(s, d), 2.5))
add("permute_sides", "SELECT (i * 7 + 3) % n i, k::INTEGER k, round(x * (k + 1), 6) + 0.0 x FROM xt, n, range(2) r(k)", BAND_SQL)(
    lambda s, d: (
        lambda n: _vector(
            E.permute_vector(T.true_solution(s, n, 2).withColumn("x", F.col("x") * (F.col("k") + 1)), s.range(n).select(F.col("id").alias("src"), ((F.col("id") * 7 + 3) % n).alias("dst")))
        )
    )(n_parts(s, d))
)


def _natural(s: SparkSession, d: str, a: DataFrame | None = None) -> S.Factor:
    return S.factorize(_kept(s, d) if a is None else a, n_parts(s, d), Options(equilibrate=False, row_perm="none", col_perm="natural"))


def _in_rows(f: S.Factor, cells: DataFrame) -> DataFrame:
    """Cells of a factor with the matrix's own indices for its permuted ones."""
    at = f.tables()[0].select("r", F.col("i").alias("own"))
    out = cells.join(at.withColumnRenamed("own", "oi"), F.col("i") == F.col("r")).drop("r", "i").withColumnRenamed("oi", "i")
    return out.join(at, F.col("j") == F.col("r")).select("i", F.col("own").alias("j"), "v")


def _saved(s: SparkSession, d: str) -> S.Factor:
    path = f"{Scratch(s).path}/factor"
    S.factorize(_kept(s, d), n_parts(s, d), Options(task_rows=64)).save(path)
    return S.load_factor(s, path)


@add("factor_saved", X_SQL.format(n=2))
def factor_saved(s: SparkSession, d: str) -> DataFrame:
    """Factors written, read again and solved with."""
    a, n = _kept(s, d), n_parts(s, d)
    return _vector(_saved(s, d).solve(P.spmv(a, T.true_solution(s, n, 2))))


@add("factor_zeroed", "SELECT p_partkey i, p_partkey j, 1.0::DOUBLE v FROM part")
def factor_zeroed(s: SparkSession, d: str) -> DataFrame:
    """With its values zeroed L has its units alone and U nothing."""
    f = _natural(s, d).zeroed()
    return _cells(_in_rows(f, f.triangle(True).unionByName(f.triangle(False))))


@add("diagonal_inverses", "SELECT side, p_partkey i, p_partkey j, 1.0::DOUBLE v FROM part, (VALUES ('L'), ('U')) t(side)")
def diagonal_inverses(s: SparkSession, d: str) -> DataFrame:
    """Each supernode's own block of L and of U times its inverse: units."""
    f = _natural(s, d)
    sides = []
    for side, lower in (("L", True), ("U", False)):
        inverse = f.diagonal_inverses(lower)
        member = inverse.select("s", F.col("i").alias("c")).distinct()
        own = f.triangle(lower).join(member.select(F.col("s").alias("si"), F.col("c").alias("i")), "i").join(member.withColumnRenamed("c", "j"), "j").filter("s = si")
        product = P.matmul(own.select("i", "j", "v"), inverse.select("i", "j", "v"))
        sides.append(_cells(_in_rows(f, product)).filter("v != 0").withColumn("side", F.lit(side)))
    return sides[0].unionByName(sides[1])


@add("solve_factored", "SELECT i, k::INTEGER k, x * (k + 1) x FROM (" + X_SQL.format(n=2) + ")")
def solve_factored(s: SparkSession, d: str) -> DataFrame:
    """Solve once, then other right-hand sides with the same factors."""
    a, n = _kept(s, d), n_parts(s, d)
    first = S.factorize(a, n)
    S.solve(a, P.spmv(a, T.true_solution(s, n)), n, Options(fact="factored"), first)
    x = T.true_solution(s, n, 2).withColumn("x", F.col("x") * (F.col("k") + 1))
    return _vector(S.solve(a, P.spmv(a, x), n, Options(fact="factored"), first).x)


@add("solve_grid", "SELECT p_partkey i, 0 k, CASE WHEN p_partkey % 2 = 1 THEN 1.0 ELSE -1.0 END::DOUBLE x FROM part, k WHERE p_partkey < k * k", SIDE_SQL)
def solve_grid(s: SparkSession, d: str) -> DataFrame:
    """The grid of parts, which fills in, factored by subtrees."""
    a, n = Scratch(s).keep(priced_grid(s, d), "grid"), _side(s, d) ** 2
    return _vector(S.solve(a, P.spmv(a, T.true_solution(s, n)), n, Options(task_rows=200, col_perm="nested_dissection")).x)


@add("solve_shifted", X_SQL.format(n=1))
def solve_shifted(s: SparkSession, d: str) -> DataFrame:
    """A matrix whose diagonal is empty before rows are matched."""
    a, n = shifted(s, d), n_parts(s, d)
    return _vector(S.solve(a, P.spmv(a, T.true_solution(s, n)), n).x)


@add("solve_given_permutations", X_SQL.format(n=1))
def solve_given_permutations(s: SparkSession, d: str) -> DataFrame:
    """Row and column permutations of the caller."""
    a, n = shifted(s, d), n_parts(s, d)
    ids = s.range(n).withColumnRenamed("id", "src")
    rows, cols = ids.withColumn("dst", (F.col("src") - 7 + n) % n), ids.withColumn("dst", n - 1 - F.col("src"))
    f = S.factorize(a, n, row_perm=rows, col_perm=cols)
    return _vector(S.solve(a, P.spmv(a, T.true_solution(s, n)), n, Options(fact="factored"), f).x)


SIZED = "SELECT DISTINCT c_nationkey::BIGINT batch_id, i, 0 k, CASE WHEN i % 2 = 1 THEN 1.0 ELSE -1.0 END::DOUBLE x FROM orders JOIN customer ON o_custkey = c_custkey, range(12) r(i) WHERE o_orderkey % 12 <> o_custkey % 12 AND i < 4 + c_nationkey % 9"


@add("solve_batch_sizes", SIZED)
def solve_batch_sizes(s: SparkSession, d: str) -> DataFrame:
    """Systems of 4 to 12 rows in one batch."""
    a = _systems(s, d).filter("i < 4 + batch_id % 9 and j < 4 + batch_id % 9")
    x = F.when(F.col("j") % 2 == 1, 1.0).otherwise(-1.0)
    b = a.groupBy("batch_id", "i").agg(F.sum(F.col("v") * x).alias("x")).select("batch_id", "i", F.lit(0).alias("k"), "x")
    return S.solve_batch(a, b).select("batch_id", "i", "k", _r("x"))


# --- without a step in one task -----------------------------------------------------------------------------------------


def parts_grid(spark: SparkSession, d: str) -> DataFrame:
    """Parts linked with neighbours in a row or a column of a grid, by what was sold of them; dominant, and fills in."""
    n, w = n_parts(spark, d), _side(spark, d)
    to = f"l_partkey + element_at(array(-{w}, -1, 1, {w}), int(l_suppkey % 4) + 1)"
    off = T.from_table(_read(spark, d, "lineitem"), "l_partkey", to, "l_discount").filter(f"j >= 0 and j < {n}").withColumn("v", F.col("v") + 0.01)
    sums = off.groupBy("i").agg(F.sum("v").alias("s"))
    diag = spark.range(n).withColumnRenamed("id", "i").join(sums, "i", "left")
    return off.unionByName(diag.select("i", F.col("i").alias("j"), (F.lit(1.0) + F.coalesce("s", F.lit(0.0))).alias("v")))


PARTS_GRID_SQL = """n AS (SELECT count(*) n, floor(sqrt(count(*)))::BIGINT w FROM part),
off AS (SELECT i, j, v FROM (SELECT l_partkey i, l_partkey + [-w, -1, 1, w][l_suppkey % 4 + 1] j, sum(l_discount) + 0.01 v FROM lineitem, n GROUP BY 1, 2), n WHERE j >= 0 AND j < n),
a AS (SELECT i, j, v FROM off UNION ALL SELECT p_partkey, p_partkey, 1 + coalesce(s, 0) FROM part LEFT JOIN (SELECT i, sum(v) s FROM off GROUP BY 1) ON i = p_partkey)"""
add("matrix_grid", CELLS + "a", PARTS_GRID_SQL)(lambda s, d: _cells(parts_grid(s, d)))
SQL["symbolic_parallel"] = SQL["symbolic"]
add("symbolic_parallel")(lambda s, d: N.symbolic_parallel(_kept(s, d), n_parts(s, d)))


@add("separator_tree", "SELECT count(*) AS placed, count(*) AS in_nodes, true AS is_order, 0::BIGINT AS crossing FROM part")
def separator_tree(s: SparkSession, d: str) -> DataFrame:
    """Rows placed and in the tree's nodes, and entries that link two nodes of which neither is above the other."""
    a, n = Scratch(s).keep(parts_grid(s, d), "grid"), n_parts(s, d)
    found = D.dissect(a, n)
    at = found.order.select("i", "height", "node")
    far = at.select(F.col("i").alias("j"), F.col("height").alias("h"), F.col("node").alias("m"))
    ends = a.join(at.hint("merge"), "i").join(far.hint("merge"), "j")
    apart = ends.filter("case when height <= h then shiftright(node, h - height) != m else shiftright(m, height - h) != node end").count()
    return _one(s, "placed long, in_nodes long, is_order boolean, crossing long", (found.order.count(), found.tree.agg(F.sum("size")).first()[0], E.is_permutation(found.permutation(), n), apart))


@add("factor_blocks", "SELECT count(*) AS own, 0.0::DOUBLE AS worst FROM a", PARTS_GRID_SQL)
def factor_blocks(s: SparkSession, d: str) -> DataFrame:
    """Entries of the grid of parts, and the greatest of L U - A with factors made level by level of its separator tree."""
    a, n = Scratch(s).keep(parts_grid(s, d), "grid"), n_parts(s, d)
    gap = B.factorize_blocks(a, n, B.by_tree(D.dissect(a, n))).worst_gap(a)
    return gap.select(F.lit(a.count()).alias("own"), (F.round("worst", 9) + 0.0).alias("worst"))


@add("solve_blocks", X_SQL.format(n=2))
def solve_blocks(s: SparkSession, d: str) -> DataFrame:
    """The grid of parts with its rows turned: matched, cut by separators, factored and solved by blocks."""
    n = n_parts(s, d)
    turn = s.range(n).select(F.col("id").alias("src"), ((F.col("id") + 7) % n).alias("dst"))
    a = Scratch(s).keep(E.permute(parts_grid(s, d), turn), "grid")
    return _vector(S.solve(a, P.spmv(a, T.true_solution(s, n, 2)), n, Options(col_perm="parallel_dissection")).x)


@add("solve_blocks_complex", "SELECT i, 0 k, xr::DOUBLE re, xi::DOUBLE im FROM zx", ZX_SQL)
def solve_blocks_complex(s: SparkSession, d: str) -> DataFrame:
    a, n = Scratch(s).keep(zband(s, d), "band"), n_parts(s, d)
    return _zvector(S.solve(a, P.spmv(a, ztrue(s, n)), n, Options(col_perm="parallel_dissection", row_perm="none")).x)


@add("perfect_matching", "SELECT p_partkey src, p_partkey dst FROM part")
def perfect_matching(s: SparkSession, d: str) -> DataFrame:
    """Chains of eight parts whose heaviest entries leave a row without a column; only the light diagonal is perfect."""
    sold = T.from_table(_read(s, d, "lineitem"), "l_partkey", "l_partkey + 1", "l_quantity").filter("i % 8 < 7")
    n = n_parts(s, d)
    one = s.range(n).select(F.col("id").alias("i"), F.col("id").alias("j"), F.lit(1.0).alias("v"))
    a = Scratch(s).keep(one.unionByName(sold.filter(f"j < {n}").withColumn("v", F.col("v") + 1)), "chains")
    return M.heavy_perfect_matching(a, n).pairs


def order_forest(s: SparkSession, d: str) -> tuple[DataFrame, int]:
    """Orders under customers under nations under regions: ``(i, j, v)`` from each row to the one above, and the number of rows."""
    customers, nations, regions = (_read(s, d, t).count() for t in ("customer", "nation", "region"))
    orders = _read(s, d, "orders")
    found = Scratch(s).keep(orders.repartitionByRange("o_orderkey").sortWithinPartitions("o_orderkey").select("o_custkey", F.monotonically_increasing_id().alias("at")), "orders")
    pieces = found.groupBy(F.shiftright("at", 33).alias("piece")).agg(F.count(F.lit(1)).alias("rows"))
    starts = pieces.select("piece", F.coalesce(F.sum("rows").over(Window.orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    base = regions + nations
    own = found.withColumn("piece", F.shiftright("at", 33)).join(starts, "piece")
    low = own.select((F.col("at") - F.shiftleft("piece", 33) + F.col("start") + base + customers).alias("i"), (F.col("o_custkey") + base).cast("long").alias("j"))
    mid = _read(s, d, "customer").select((F.col("c_custkey") + base).cast("long").alias("i"), (F.col("c_nationkey") + regions).cast("long").alias("j"))
    top = _read(s, d, "nation").select((F.col("n_nationkey") + regions).cast("long").alias("i"), F.col("n_regionkey").cast("long").alias("j"))
    a = Scratch(s).keep(low.unionByName(mid).unionByName(top).withColumn("v", F.lit(1.0)), "forest")
    return a, base + customers + orders.count()


def _later(a: DataFrame, order: DataFrame) -> DataFrame:
    """``(later, nodes)``: how many nodes have how many neighbours after them; an order of a forest makes no fill if none has two."""
    at = Scratch(a.sparkSession).keep(order, "order")
    ends = a.join(at.select(F.col("src").alias("i"), F.col("dst").alias("x")), "i").join(at.select(F.col("src").alias("j"), F.col("dst").alias("y")), "j")
    after = ends.select(F.least("x", "y").alias("dst")).groupBy("dst").agg(F.count(F.lit(1)).alias("later"))
    return at.join(after, "dst", "left").groupBy(F.coalesce("later", F.lit(0)).alias("later")).agg(F.count(F.lit(1)).alias("nodes"))


LATER_SQL = """SELECT 1::BIGINT AS later, edges AS nodes FROM f UNION ALL SELECT 0::BIGINT, rows - edges FROM f"""
FOREST_SQL = """f AS (SELECT o + c + n AS edges, o + c + n + r AS rows FROM (SELECT count(*) o FROM orders), (SELECT count(*) c FROM customer), (SELECT count(*) n FROM nation), (SELECT count(*) r FROM region))"""


@add("order_degree_rounds", LATER_SQL, FOREST_SQL)
def order_degree_rounds(s: SparkSession, d: str) -> DataFrame:
    """Minimum degree by rounds on the forest of orders: an order without fill exists, and it must be found."""
    a, n = order_forest(s, d)
    return _later(a, G.minimum_degree(a, n, tail=0))


@add("order_column_degree_rounds", LATER_SQL, FOREST_SQL)
def order_column_degree_rounds(s: SparkSession, d: str) -> DataFrame:
    """The same of A' A, where each row of A holds a node and the one above it."""
    a, n = order_forest(s, d)
    own = a.select("i", F.col("i").alias("j"), "v")
    return _later(a, G.minimum_degree(a.unionByName(own), n, "column", tail=0))


DEALT_SQL = """b AS (SELECT r + n + c AS orders0, r + n AS customers0, r AS nations0, o + c + n + r AS rows FROM (SELECT count(*) o FROM orders), (SELECT count(*) c FROM customer), (SELECT count(*) n FROM nation), (SELECT count(*) r FROM region)),
t4 AS (SELECT i, p, 1 + i % 7 t FROM (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 + orders0 i, o_custkey + customers0 p FROM orders, b)),
t3 AS (SELECT i, p, 1 + i % 7 + coalesce(s, 0) t FROM (SELECT c_custkey + customers0 i, c_nationkey + nations0 p FROM customer, b) LEFT JOIN (SELECT p u, sum(t) s FROM t4 GROUP BY 1) ON u = i),
t2 AS (SELECT i, p, 1 + i % 7 + coalesce(s, 0) t FROM (SELECT n_nationkey + nations0 i, n_regionkey p FROM nation, b) LEFT JOIN (SELECT p u, sum(t) s FROM t3 GROUP BY 1) ON u = i),
t1 AS (SELECT i, p, 1 + i % 7 + coalesce(s, 0) t FROM (SELECT r_regionkey i, rows p FROM region, b) LEFT JOIN (SELECT p u, sum(t) s FROM t2 GROUP BY 1) ON u = i),
e AS (SELECT i::BIGINT i, p::BIGINT p, t::BIGINT t FROM (SELECT * FROM t4 UNION ALL SELECT * FROM t3 UNION ALL SELECT * FROM t2 UNION ALL SELECT * FROM t1)),
most AS (SELECT (sum(1 + i % 7) // 32)::BIGINT most FROM e),
tops AS (SELECT e.i, e.t FROM most, e LEFT JOIN e u ON e.p = u.i WHERE e.t <= most AND (u.i IS NULL OR u.t > most)),
dealt AS (SELECT i, least(coalesce(sum(t) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * 8 // sum(t) OVER (), 7)::INTEGER task FROM tops)"""


@add(
    "forest_partition",
    """SELECT e.i AS node, e.p AS parent, 1 + e.i % 7 AS load, e.t AS total, coalesce(d0.task, d1.task, d2.task, d3.task, -1)::INTEGER AS task
FROM e LEFT JOIN e u ON u.i = e.p LEFT JOIN e w ON w.i = u.p
LEFT JOIN dealt d0 ON d0.i = e.i LEFT JOIN dealt d1 ON d1.i = e.p LEFT JOIN dealt d2 ON d2.i = u.p LEFT JOIN dealt d3 ON d3.i = w.p""",
    DEALT_SQL,
)
def forest_partition(s: SparkSession, d: str) -> DataFrame:
    """The forest of orders among eight tasks, each node with its load, its subtree's and its task."""
    a, n = order_forest(s, d)
    parents = a.select(F.col("i").alias("node"), F.col("j").alias("parent"))
    roots = _read(s, d, "region").select(F.col("r_regionkey").cast("long").alias("node"), F.lit(n).cast("long").alias("parent"))
    every = Scratch(s).keep(parents.unionByName(roots), "parents")
    return R.forest_partition(every, n, every.select("node", (F.col("node") % 7 + 1).alias("load")), 8)
