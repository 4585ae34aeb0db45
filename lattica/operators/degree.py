"""Minimum degree orders by rounds of joins.

The graph is held as elements: sets of variables that are all linked with each other. For A + A' every edge is an
element of two, for A' A every row of A is one, so A' A is never formed. Eliminating a variable makes one element of
all those it is in. Each round takes, of the variables whose degree is near the least, those that come first in all
their elements; no two of them are linked, so their eliminations touch different elements and are one join.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from lattica.plans import kernels as K
from lattica.plans.scratch import Scratch

#: Variables that are left when one task orders the rest.
TAIL = 500
#: A variable is taken at a degree up to this many times the least one.
SLACK = 1.5
#: Where at least this share of the variables goes without fill, a round takes no others.
PEEL = 1 / 4
#: Neighbouring variables that one task orders.
PIECE = 1 << 16
#: So many pieces are one in the next pass.
JOINED = 16
#: Squares of sizes of the elements between pieces, summed, up to which the kernel orders their variables too.
DENSE = 10_000_000


def _elements(a: DataFrame, n: int, column: bool) -> DataFrame:
    """``(e, v)``: elements with their variables."""
    if not column:
        pairs = a.filter("i != j").select(F.least("i", "j").alias("p"), F.greatest("i", "j").alias("q")).distinct()
        return pairs.select(F.struct("p", "q").alias("e"), F.explode(F.array("p", "q")).alias("v"))
    # dealt by element once, which serves the three steps after it
    cells = a.select(F.struct(F.col("i").alias("p"), F.lit(-1).cast("long").alias("q")).alias("e"), F.col("j").alias("v")).repartition("e").distinct()
    wide = cells.groupBy("e").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") > max(16, int(10 * math.sqrt(n))))
    return cells.join(wide, "e", "left_anti")


def _taken(now: DataFrame, weighed: DataFrame, most: float) -> DataFrame:
    """``(v, bound)`` of the unlinked variables of this round, of those with a bound up to ``most``."""
    near = weighed.filter(F.col("own") > 1).filter(F.col("bound") <= most)
    first = now.join(near, "v").groupBy("e").agg(F.min(F.struct("bound", F.xxhash64("v").alias("h"), "v", "own")).alias("b"))
    won = first.groupBy(F.col("b.v").alias("v"), F.col("b.bound").alias("bound"), F.col("b.own").alias("own")).agg(F.count(F.lit(1)).alias("won"))
    return won.filter("won = own").select("v", "bound")


def _absorbed(now: DataFrame, mark: int) -> DataFrame:
    """``e`` of the elements that an element of this round (``q = mark``) covers; of equal ones the first stays.

    A covering element also holds the covered one's least shared variable, so only elements that meet there are compared.
    Elements of one variable are counted by variable instead: any other element there covers them, and many may meet there.
    """
    shared = now.groupBy("v").agg(F.count(F.lit(1)).alias("own"))
    sizes = now.join(shared, "v").groupBy("e").agg(F.count(F.lit(1)).alias("size"), F.min(F.struct("own", "v")).alias("at"))
    lone = sizes.filter("size = 1").select("e", F.col("at.v").alias("v"), F.col("at.own").alias("own"))
    there = lone.groupBy("v").agg(F.count(F.lit(1)).alias("lone"), F.min("e").alias("first"))
    spare = lone.join(there, "v").filter("own > lone or e != first").select("e")
    small = sizes.filter("size > 1").select("e", "size", F.col("at.v").alias("v"))
    large = now.filter(F.col("e.q") == mark).join(sizes.filter("size > 1").select("e", F.col("size").alias("room")), "e").select(F.col("e").alias("f"), "room", "v")
    meet = small.join(large, "v").filter("e != f and (size < room or (size = room and (e.q != f.q or e.p > f.p)))").select("e", "f", "size")
    both = meet.join(now, "e").join(now.filter(F.col("e.q") == mark).select(F.col("e").alias("f"), "v"), ["f", "v"])
    return both.groupBy("e", "f", "size").agg(F.count(F.lit(1)).alias("found")).filter("found = size").select("e").distinct().unionByName(spare)


def _peeled(scratch: Scratch, now: DataFrame, alone: DataFrame) -> DataFrame:
    """``now`` without the variables ``alone``, each of one element, and without elements that others cover then.

    No element is made, so only those of one variable can have become covered: of these one stays, where the variable has no wider one.
    """
    size = F.count(F.lit(1)).over(Window.partitionBy("e"))
    left = scratch.keep(now.join(alone, "v", "left_anti").select("e", "v", size.alias("size")), "left")
    lone = F.col("size") == 1
    there = left.groupBy("v").agg(F.max("size").alias("most"), F.min("e").alias("first")).filter("most = 1").select("first")
    return left.filter(~lone).select("e", "v").unionByName(left.filter(lone).join(there.withColumnRenamed("first", "e"), "e", "left_semi").select("e", "v"))


def _rest(frame: pd.DataFrame) -> pd.DataFrame:
    """Ranks of the last variables by the one-task kernel; at most ``TAIL`` of them, so their links are bounded."""
    ids, at = np.unique(frame["v"].to_numpy(), return_inverse=True)
    near: list[set[int]] = [set() for _ in ids]
    for own in pd.Series(at).groupby([frame["p"].to_numpy(), frame["q"].to_numpy()]):
        members = set(own[1].tolist())
        for k in members:
            near[k] |= members
    perm = K.minimum_degree([np.array(sorted(s - {k}), np.int64) for k, s in enumerate(near)])
    return pd.DataFrame({"v": ids, "bound": perm})


def _numbered(scratch: Scratch, rows: DataFrame) -> DataFrame:
    """``(src, dst)``: places of ``v`` by round, step and degree; ranges are numbered first."""
    keys = ["round", "step", "bound", "v"]
    ranged = scratch.keep(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).select("v", F.monotonically_increasing_id().alias("place")), "ranged")
    ranged = ranged.withColumn("piece", F.shiftright("place", 33))
    pieces = ranged.groupBy("piece").agg(F.count(F.lit(1)).alias("rows"))
    before = Window.orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)  # one row a task
    starts = pieces.select("piece", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("start"))
    return ranged.join(starts, "piece").select(F.col("v").alias("src"), (F.col("start") + F.col("place") - F.shiftleft("piece", 33)).alias("dst"))


def minimum_degree(a: DataFrame, n: int, kind: str = "symmetric", slack: float = SLACK, tail: int = TAIL) -> DataFrame:
    """``(src, dst)`` of a minimum degree order of A + A' ("symmetric") or A' A ("column"), A of any number of rows then.

    A variable of one element only is linked with nothing else, so it goes without fill as soon as it is one; where these are many
    (``PEEL``) the others wait, as fewer of them may need fill then. Rows of A
    with more than 10 sqrt(n) entries (at least 16) make no element for A' A, as they link nearly everything. When ``tail`` variables are left one task orders them; with 0 the rounds go on to the end. Repeated
    entries and the diagonal count nothing, rows without others come first, and the order is the same in every run.
    The number of rounds grows with the last, dense elements, each of which gives up one variable a round at least.
    """
    if kind not in ("symmetric", "column"):
        raise ValueError(f"no kind of graph {kind!r}")
    spark = a.sparkSession
    scratch = Scratch(spark)
    now = scratch.keep(_elements(a, n, kind == "column"), "elements")
    path = f"{scratch.path}/placed"

    def place(rows: DataFrame, k: int) -> DataFrame:
        rows.select("v", F.col("step").cast("int").alias("step"), F.col("bound").cast("long").alias("bound")).write.parquet(f"{path}/round={k}")
        return spark.read.schema("v long, step int, bound long").parquet(f"{path}/round={k}")

    k = 0
    while True:
        shared = scratch.keep(now.groupBy("v").agg(F.count(F.lit(1)).alias("own")), "shared")
        alone = shared.filter("own = 1").select("v", F.lit(0).alias("step"), F.lit(0).alias("bound"))
        ones, many = shared.agg(F.count(F.when(F.col("own") == 1, 1)), F.count(F.when(F.col("own") > 1, 1))).first()
        if many <= tail:
            left = now.join(alone, "v", "left_anti").select("e.p", "e.q", "v", F.lit(0).alias("one"))
            rest = left.groupBy("one").applyInPandas(lambda frame: _rest(frame), "v long, bound long")
            place(alone.unionByName(rest.select("v", F.lit(1).alias("step"), "bound")), k)
            break
        if ones >= PEEL * (ones + many):
            later = scratch.keep(_peeled(scratch, now, place(alone, k)), "elements")
            used = (now, shared)
        else:
            # a bound is at least the degree, and equal to it where elements overlap in the variable alone
            sizes = now.groupBy("e").agg((F.count(F.lit(1)) - 1).alias("others"))
            weighed = now.join(sizes, "e").groupBy("v").agg(F.count(F.lit(1)).alias("own"), F.sum("others").alias("bound"))
            weighed = scratch.keep(weighed.filter("own > 1"), "weighed")
            mark, least = -2 - k, weighed.agg(F.min("bound")).first()[0]
            taken = place(alone.unionByName(_taken(now, weighed, slack * least + 1).withColumn("step", F.lit(1))), k)
            into = now.join(taken.filter("step = 1"), "v").select("e", F.struct(F.col("v").alias("p"), F.lit(mark).cast("long").alias("q")).alias("to"))
            moved = now.join(taken, "v", "left_anti").join(into, "e", "left")
            merged = moved.filter("to is null").select("e", "v").unionByName(moved.filter("to is not null").select(F.col("to").alias("e"), "v").distinct())
            merged = scratch.keep(merged, "merged")
            later = scratch.keep(merged.join(_absorbed(merged, mark), "e", "left_anti"), "elements")
            used = (now, shared, weighed, merged)
        for done in used:
            scratch.drop(done)
        now = later
        k += 1
    placed = spark.read.schema("v long, step int, bound long, round int").parquet(path)
    lone = spark.range(n).withColumnRenamed("id", "v").join(placed, "v", "left_anti")
    lone = lone.select("v", F.lit(0).alias("step"), F.lit(0).cast("long").alias("bound"), F.lit(-1).alias("round"))
    return _numbered(scratch, placed.unionByName(lone))


def _piece_ordered(mark: int) -> Callable:
    """Variables of a piece that no element outside links (``held`` false) get ranks; the others are left with elements ``(p, q)``."""

    def work(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["p", "q"], kind="stable")
        ids, at = np.unique(frame["v"].to_numpy(), return_inverse=True)
        held = np.zeros(len(ids), bool)
        held[at] = frame["held"].to_numpy(bool)
        p, q = frame["p"].to_numpy(), frame["q"].to_numpy()
        near: list[set[int]] = [set() for _ in ids]
        for own in np.split(at, np.flatnonzero((np.diff(p) != 0) | (np.diff(q) != 0)) + 1):
            members = set(own.tolist())
            for k in members:
                near[k] |= members
        order, cliques, edges = K.partial_minimum_degree([np.array(sorted(s - {k}), np.int64) for k, s in enumerate(near)], held)
        left = [(ids[c], mark, ids[x]) for c, members in cliques.items() for x in members]
        left += [(ids[x], ids[y], ids[z]) for x in np.flatnonzero(held).tolist() for y in edges[x] if x < y for z in (x, y)]
        rest = np.array(left, np.int64).reshape(-1, 3)
        ranks = pd.DataFrame({"v": ids[order], "p": -1, "q": -1, "rank": np.arange(len(order))})
        return pd.concat([ranks, pd.DataFrame({"v": rest[:, 2], "p": rest[:, 0], "q": rest[:, 1], "rank": -1})]).assign(piece=key[0])

    return work


def minimum_degree_by_pieces(a: DataFrame, n: int, kind: str = "symmetric", piece: int = PIECE, dense: int = DENSE) -> DataFrame:
    """``(src, dst)`` as ``minimum_degree``: ranges of ``piece`` neighbouring variables are ordered side by side by the one-task kernel.

    Variables that an element links with another range wait, with the elements the others leave, for the next pass of
    wider ranges; the last has one. Where numbers are near their neighbours a task holds little more than ``piece`` variables; in a
    graph without such nearness most variables wait for the last task. Where what the first pass leaves is ``dense``, degrees of
    full elements tell little and cost most: these variables go boundary after boundary, two neighbouring ranges first, then fours.
    """
    if kind not in ("symmetric", "column"):
        raise ValueError(f"no kind of graph {kind!r}")
    spark = a.sparkSession
    scratch = Scratch(spark)
    now = scratch.keep(_elements(a, n, kind == "column"), "elements")
    placed = spark.createDataFrame([], "v long, round int, step long, bound long")
    level, size = 0, piece
    while True:
        of = F.expr(f"v div {size}")
        spans = now.groupBy("e").agg(F.min(of).alias("lo"), F.max(of).alias("hi"))
        spanned = scratch.keep(now.join(spans.hint("merge"), "e"), "spanned")
        linked = spanned.filter("lo < hi").select("v").distinct().withColumn("held", F.lit(True))
        inner = spanned.filter("lo = hi").join(linked.hint("merge"), "v", "left").select("lo", "e.p", "e.q", "v", F.coalesce("held", F.lit(False)).alias("held"))
        done = scratch.keep(inner.groupBy("lo").applyInPandas(_piece_ordered(-2 - level), "v long, p long, q long, rank long, piece long"), "ordered")
        placed = placed.unionByName(done.filter("rank >= 0").select("v", F.lit(level).alias("round"), F.col("piece").alias("step"), F.col("rank").alias("bound")))
        if size >= n:
            break
        rest = done.filter("rank < 0").select(F.struct("p", "q").alias("e"), "v")
        later = scratch.keep(spanned.filter("lo < hi").select("e", "v").unionByName(rest), "elements")
        if level == 0 and (later.groupBy("e").agg(F.count(F.lit(1)).alias("c")).agg(F.sum(F.col("c") * F.col("c"))).first()[0] or 0) > dense:
            between = spanned.filter("lo < hi").groupBy("v").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
            between = between.withColumn("up", F.length(F.bin(F.col("lo").bitwiseXOR(F.col("hi")))))
            # a boundary comes after all within the ranges it parts
            step = F.expr("shiftleft(shiftright(lo, up) + 1L, up) * 64 + up")
            rest = scratch.keep(between.select("v", F.lit(1).alias("round"), step.alias("step"), F.col("v").alias("bound")), "between")
            placed = placed.unionByName(rest)
            break
        scratch.drop(now)
        scratch.drop(spanned)
        now, level, size = later, level + 1, size * JOINED
    lone = spark.range(n).withColumnRenamed("id", "v").join(placed.hint("merge"), "v", "left_anti")
    lone = lone.select("v", F.lit(-1).alias("round"), F.lit(0).cast("long").alias("step"), F.lit(0).cast("long").alias("bound"))
    return _numbered(scratch, placed.unionByName(lone))
