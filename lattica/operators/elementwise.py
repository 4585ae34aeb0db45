"""Copies, scalings, sums, permutations and predicates of matrices."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from lattica.functions import complexnum as C
from lattica.operators.graph import connected_components
from lattica.plans.scratch import Scratch
from lattica.sources.tables import pointers


def clone_structure(a: DataFrame, value: float = 0.0) -> DataFrame:
    """The pattern with one value everywhere."""
    return a.select("i", "j", F.lit(value).cast("double").alias("v"))


zero = clone_structure
fill = clone_structure


def scale_add_identity(a: DataFrame, c: float) -> DataFrame:
    """c A + I on stored entries; diagonal entries that are not stored stay so."""
    wide = C.is_complex(a, "v")
    one = C.widen(F.when(F.col("i") == F.col("j"), 1.0).otherwise(0.0), False) if wide else F.when(F.col("i") == F.col("j"), 1.0).otherwise(0.0)
    scaled = C.times(F.col("v"), F.lit(c), wide)
    return a.select("i", "j", (C.add(scaled, one) if wide else scaled + one).alias("v"))


def scale_add(a: DataFrame, b: DataFrame, c: float) -> DataFrame:
    """c A + B for equal patterns; a difference of patterns raises when run."""
    both = a.join(b.select("i", "j", F.col("v").alias("w")), ["i", "j"], "full")
    wide = C.is_complex(a, "v")
    differs = F.raise_error(F.lit("the patterns differ")).cast(a.schema["v"].dataType)
    scaled = C.times(F.col("v"), F.lit(c), wide)
    value = F.when(F.col("v").isNull() | F.col("w").isNull(), differs).otherwise(C.add(scaled, F.col("w")) if wide else scaled + F.col("w"))
    return both.select("i", "j", value.alias("v"))


def scale(a: DataFrame, rows: DataFrame | None = None, cols: DataFrame | None = None) -> DataFrame:
    """diag(r) A diag(c) with ``rows(i, s)`` and ``cols(i, s)``; indices without a factor keep theirs."""
    out, wide = a, C.is_complex(a, "v")
    if rows is not None:
        out = out.join(rows.select("i", F.col("s").alias("r")), "i", "left").select("i", "j", C.times(F.col("v"), F.coalesce("r", F.lit(1.0)), wide).alias("v"))
    if cols is not None:
        out = out.join(cols.select(F.col("i").alias("j"), F.col("s").alias("c")), "j", "left").select("i", "j", C.times(F.col("v"), F.coalesce("c", F.lit(1.0)), wide).alias("v"))
    return out


def scale_vector(x: DataFrame, s: DataFrame) -> DataFrame:
    return x.join(s.select("i", "s"), "i", "left").select("i", "k", C.times(F.col("x"), F.coalesce("s", F.lit(1.0)), C.is_complex(x, "x")).alias("x"))


def transpose(a: DataFrame) -> DataFrame:
    return a.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")


def permute(a: DataFrame, rows: DataFrame | None = None, cols: DataFrame | None = None) -> DataFrame:
    """Move row ``src`` to ``dst`` by ``rows(src, dst)``, columns likewise."""
    out = a
    if rows is not None:
        out = out.join(rows.select(F.col("src").alias("i"), F.col("dst").alias("to")), "i").select(F.col("to").alias("i"), "j", "v")
    if cols is not None:
        out = out.join(cols.select(F.col("src").alias("j"), F.col("dst").alias("to")), "j").select("i", F.col("to").alias("j"), "v")
    return out


def permute_vector(x: DataFrame, perm: DataFrame) -> DataFrame:
    return x.join(perm.select(F.col("src").alias("i"), F.col("dst").alias("to")), "i").select(F.col("to").alias("i"), "k", "x")


def invert_permutation(perm: DataFrame) -> DataFrame:
    return perm.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def compose_permutations(first: DataFrame, then: DataFrame) -> DataFrame:
    return first.join(then.select(F.col("src").alias("dst"), F.col("dst").alias("to")), "dst").select("src", F.col("to").alias("dst"))


def is_permutation(perm: DataFrame, n: int) -> bool:
    got = perm.agg(F.count("dst").alias("n"), F.countDistinct("dst").alias("d"), F.countDistinct("src").alias("s"), F.min("dst").alias("a"), F.max("dst").alias("b")).first()
    return n == 0 if not got["n"] else (got["n"], got["d"], got["s"], got["a"], got["b"]) == (n, n, n, 0, n - 1)


def permutation_sign(perm: DataFrame, n: int) -> int:
    """1 for an even number of swaps, -1 for an odd one: n less the number of cycles, which are components."""
    cycles = connected_components(perm.select("src", "dst")).select("component").distinct().count()
    return -1 if (n - cycles) % 2 else 1


def to_msr(a: DataFrame, n: int) -> DataFrame:
    """Modified sparse rows ``(at, val, bindx)``.

    Places 0 to n - 1 hold the diagonal (0 if not stored) and where each row's
    other entries begin, place n the end, later places those entries with their
    columns, row by row.
    """
    off = a.filter("i != j")
    starts = pointers(off, "i", n)
    head = starts.join(a.filter("i = j").select(F.col("i").alias("p"), "v"), "p", "left")
    head = head.select(F.col("p").alias("at"), F.coalesce("v", C.widen(F.lit(0.0), not C.is_complex(a, "v"))).alias("val"), (F.col("start") + n + 1).alias("bindx"))
    end = off.agg(F.count(F.lit(1)).alias("c")).select(F.lit(n).cast("long").alias("at"), F.lit(None).cast(a.schema["v"].dataType).alias("val"), (F.col("c") + n + 1).alias("bindx"))
    within = F.row_number().over(Window.partitionBy("i").orderBy("j")) - 1
    tail = off.withColumn("w", within).join(starts.select(F.col("p").alias("i"), "start"), "i")
    return head.unionByName(end).unionByName(tail.select((F.col("start") + F.col("w") + n + 1).alias("at"), F.col("v").alias("val"), F.col("j").alias("bindx")))


def missing_diagonal(a: DataFrame, n: int) -> DataFrame:
    """Columns without a stored diagonal entry, as ``(j)``."""
    every = a.sparkSession.range(n).withColumnRenamed("id", "j")
    return every.join(a.filter("i = j").select("j").distinct(), "j", "left_anti")


def diagonal(a: DataFrame) -> DataFrame:
    return a.filter("i = j").select("i", "v")


def to_blocks(a: DataFrame, size: int) -> DataFrame:
    """Entries with their block ``(bi, bj)``, dealt by it."""
    blocked = a.withColumn("bi", F.floor(F.col("i") / size)).withColumn("bj", F.floor(F.col("j") / size))
    return blocked.repartition("bi", "bj")


def compressed(a: DataFrame, by: str = "j") -> DataFrame:
    """Rows or columns as sorted arrays ``(p, indices, values)``; a row of the result is one column (or row) of the matrix."""
    other = "i" if by == "j" else "j"
    packed = a.groupBy(F.col(by).alias("p")).agg(F.sort_array(F.collect_list(F.struct(other, "v"))).alias("cells"))
    return packed.select("p", F.col(f"cells.{other}").alias("indices"), F.col("cells.v").alias("values"))


def argsort(values: DataFrame, by: str, descending: bool = False) -> DataFrame:
    """``values(i, ...)`` with ``rank`` from 0 by ``by``, ties by i; ranges are counted, so no task sorts all."""
    key = F.col(by).desc() if descending else F.col(by).asc()
    ranged = values.repartitionByRange(key, "i").sortWithinPartitions(key, "i").withColumn("_at", F.monotonically_increasing_id())
    ranged = Scratch(values.sparkSession).keep(ranged, "ranged").withColumn("_p", F.shiftright("_at", 33))
    sizes = ranged.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_p", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_b"))
    out = ranged.join(before, "_p").withColumn("rank", F.col("_b") + F.col("_at") - F.shiftleft("_p", 33))
    return out.drop("_at", "_p", "_b")
