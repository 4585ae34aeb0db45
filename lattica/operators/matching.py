"""Perfect row matchings of heavy weight by rounds of joins: an auction, augmenting paths, exchanges of pairs."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from lattica.functions import complexnum as C
from lattica.operators.graph import contracted_components
from lattica.plans import kernels as K
from lattica.plans.scratch import Scratch


#: Least raises of the sales, as shares of the spread of weights.
STEPS = (1 / 8, 1 / 32, 1 / 128, 1 / 512)


@dataclass
class Matching:
    """``pairs(src, dst)``: row src goes to the place of column dst; ``missing`` rows have no partner (structurally singular)."""

    pairs: DataFrame
    missing: int


def _auctioned(scratch: Scratch, edges: DataFrame, n: int, rounds: int) -> DataFrame:
    """Columns sold to rows: every free row bids for the column that is worth most to it less its price.

    A bid raises the price by what the row gains over its second choice, and a step more; the highest bid takes the column
    from its owner. The sale is held once for each of ``STEPS`` (shares of the spread of weights): each keeps the prices of the one
    before and sells all columns anew, so what was sold by coarse steps binds nobody. A sale ends when no row is free, after
    ``rounds`` bids, or, but for the last sale, when five of them sold no more columns. Where all rows get their first choice at
    once nothing can be better. What the last sale leaves free is left to augmenting paths.
    """
    ends = edges.agg(F.max("w").alias("a"), F.min("w").alias("b")).first()
    spread = max(ends["a"] - ends["b"], 1.0) if ends["a"] is not None else 1.0
    prices = scratch.keep(edges.select("j", F.col("w").alias("price")).limit(0), "prices")
    sold = prices.select("j", F.lit(0).cast("long").alias("i"), "price")
    for at, share in enumerate(STEPS):
        step, most, still = spread * share, 0, 0
        sold = scratch.keep(prices.select("j", F.lit(None).cast("long").alias("i"), "price"), "sold", n)
        for k in range(rounds):
            taken = sold.filter("i is not null").select("i")
            free = edges.join(taken, "i", "left_anti").join(sold.select("j", "price"), "j", "left").withColumn("price", F.coalesce("price", F.lit(0.0)))
            worth = free.select("i", "j", (F.col("w") - F.col("price")).alias("worth"), "price")
            rank = F.row_number().over(Window.partitionBy("i").orderBy(F.desc("worth"), "j"))
            two = worth.withColumn("rank", rank).filter("rank <= 2").groupBy("i")
            bids = two.agg(F.max(F.when(F.col("rank") == 1, F.struct("j", "price", "worth"))).alias("b"), F.max(F.when(F.col("rank") == 2, F.col("worth"))).alias("second"))
            gain = F.coalesce(F.col("b.worth") - F.col("second"), F.lit(spread)) + step
            best = bids.select("i", F.col("b.j").alias("j"), (F.col("b.price") + gain).alias("bid")).groupBy("j").agg(F.max(F.struct("bid", (-F.col("i")).alias("o"))).alias("b"))
            best = best.select("j", (-F.col("b.o")).alias("i"), F.col("b.bid").alias("price"))
            after = scratch.keep(sold.join(best.select("j"), "j", "left_anti").unionByName(best), "sold", n)
            scratch.drop(sold)
            sold, have = after, after.filter("i is not null").count()
            still = 0 if have > most else still + 1
            most = max(most, have)
            if have == n or (still >= 5 and at + 1 < len(STEPS)):
                break
        if at == 0 and most == n and k == 0:
            break
        prices = scratch.keep(sold.select("j", "price"), "prices", n)
    return scratch.keep(sold.filter("i is not null").select("i", "j"), "found", n)


def _augmented(scratch: Scratch, edges: DataFrame, found: DataFrame, rows: DataFrame) -> tuple[DataFrame, int]:
    """The matching after one phase of shortest augmenting paths, and how many there were.

    Trees grow from all free rows at once; a column joins the tree that reaches it by its heaviest entry, so
    trees share no column, and each tree takes one free column of the level that has the first.
    """
    free_rows = rows.join(found.select("i"), "i", "left_anti")
    frontier = scratch.keep(free_rows.select("i", F.col("i").alias("root")), "frontier")
    seen = None
    while True:
        reach = edges.join(frontier, "i")
        if seen is not None:
            reach = reach.join(seen.select("j"), "j", "left_anti")
        new = reach.groupBy("j").agg(F.max(F.struct("w", (-F.col("i")).alias("o"), "root")).alias("b")).select("j", (-F.col("b.o")).alias("parent"), "b.root", "b.w")
        new = scratch.keep(new, "reached")
        if new.isEmpty():
            return found, 0
        seen = scratch.keep(new if seen is None else seen.unionByName(new), "seen")
        mates = new.join(found, "j", "left").select("j", "root", "w", F.col("i").alias("mate"))
        mates = scratch.keep(mates, "mates")
        ends = mates.filter("mate is null")
        if not ends.isEmpty():
            break
        frontier = mates.select(F.col("mate").alias("i"), "root")
    at = scratch.keep(ends.groupBy("root").agg(F.max(F.struct("w", (-F.col("j")).alias("o"))).alias("b")).select("root", (-F.col("b.o")).alias("j")), "ends")
    count = at.count()
    flips = None
    while not at.isEmpty():
        step = seen.select("j", "parent").join(at, "j")
        flips = step.select(F.col("parent").alias("i"), "j") if flips is None else flips.unionByName(step.select(F.col("parent").alias("i"), "j"))
        flips = scratch.keep(flips, "flips")
        before = step.filter("parent != root").select(F.col("parent").alias("i"), "root")
        at = scratch.keep(before.join(found, "i").select("root", "j"), "back")
    kept = found.join(flips.select("i"), "i", "left_anti")
    return scratch.keep(kept.unionByName(flips), "found"), count


def _exchanged(scratch: Scratch, edges: DataFrame, found: DataFrame) -> tuple[DataFrame, bool]:
    """The matching after exchanges of columns between pairs of rows that gain by it, each row in the best one for both; and whether any did."""
    own = edges.join(found, ["i", "j"]).select("i", "j", F.col("w").alias("has"))
    own = scratch.keep(own, "own")
    to = own.select(F.col("i").alias("k"), "j")
    wish = edges.join(to, "j").filter("i != k").join(own.select("i", "has"), "i").select("i", "k", (F.col("w") - F.col("has")).alias("g"))
    wish = scratch.keep(wish, "wishes")
    back = wish.select(F.col("i").alias("k"), F.col("k").alias("i"), F.col("g").alias("h"))
    gain = wish.join(back, ["i", "k"]).select("i", "k", (F.col("g") + F.col("h")).alias("gain")).filter("gain > 1e-9")
    tie = F.xxhash64(F.least("i", "k"), F.greatest("i", "k"))
    best = scratch.keep(gain.groupBy("i").agg(F.max(F.struct("gain", tie.alias("t"), "k")).alias("b")).select("i", F.col("b.k").alias("k")), "best")
    pairs = best.join(best.select(F.col("i").alias("k"), F.col("k").alias("i")), ["i", "k"])
    pairs = scratch.keep(pairs, "pairs")
    if pairs.isEmpty():
        return found, False
    moved = pairs.join(found.withColumnRenamed("i", "k"), "k").select("i", "j")
    return scratch.keep(found.join(moved.select("i"), "i", "left_anti").unionByName(moved), "found"), True


def heavy_perfect_matching(a: DataFrame, n: int, auction_rounds: int = 30, exchange_rounds: int = 5) -> Matching:
    """A perfect matching of the nonzero entries of n rows and columns whose product of sizes is large.

    First an auction of at most ``auction_rounds`` rounds for each of its steps; then augmenting paths until every row has a column, or none is left to gain (``missing`` rows
    of a structurally singular matrix); then rows exchange columns in pairs as long as the product grows, at most
    ``exchange_rounds`` times. The greatest product is not promised. Zeros count as no entries.
    """
    scratch = Scratch(a.sparkSession)
    size = C.size(F.col("v"), C.is_complex(a, "v"))
    edges = a.select("i", "j", size.alias("s")).filter("s > 0").groupBy("i", "j").agg(F.log(F.max("s")).alias("w"))
    edges = scratch.keep(edges, "edges")
    rows = a.sparkSession.range(n).withColumnRenamed("id", "i")
    found = _auctioned(scratch, edges, n, auction_rounds)
    have = found.count()
    while have < n:
        found, more = _augmented(scratch, edges, found, rows)
        if not more:
            break
        have += more
    for _ in range(exchange_rounds):
        found, more = _exchanged(scratch, edges, found)
        if not more:
            break
    return Matching(found.select(F.col("i").alias("src"), F.col("j").alias("dst")), n - have)


def _matched_component(m: pd.DataFrame) -> pd.DataFrame:
    """Matching of greatest product of one component of rows and columns; row -1 tells that it has none."""
    rows, i = np.unique(m["i"].to_numpy(np.int64), return_inverse=True)
    cols, j = np.unique(m["j"].to_numpy(np.int64), return_inverse=True)
    got = K.match_rows(len(rows), i, j, m["s"].to_numpy()) if len(rows) == len(cols) else None
    if got is None or got.info:
        return pd.DataFrame({"i": [-1], "j": [-1], "u": [0.0], "v": [0.0]})
    return pd.DataFrame({"i": rows, "j": cols[got.perm], "u": got.u, "v": got.v[got.perm]})


def product_matching(a: DataFrame, n: int) -> DataFrame:
    """``(src, dst, u, v, info)`` of the greatest product with its scalings, as ``analysis.match_rows`` of job 5.

    Scales that bring the greatest entry of each column and row to 1 come from two aggregations; where every row then has
    a column of its own with an entry of 1, that is the matching. Only components of rows and columns where some have none
    are matched by shortest augmenting paths, one task each.
    """
    spark = a.sparkSession
    scratch = Scratch(spark)
    edges = a.select("i", "j", C.size(F.col("v"), C.is_complex(a, "v")).alias("s")).filter("s > 0 and not isnan(s)")
    top = edges.groupBy("j").agg(F.max("s").alias("top"))
    edges = scratch.keep(edges.join(top.hint("merge"), "j").select("i", "j", "s", (F.log("top") - F.log("s")).alias("cost"), F.log("top").alias("top")), "edges")
    u = edges.groupBy("i").agg(F.min("cost").alias("u"))
    edges = scratch.keep(edges.join(u.hint("merge"), "i"), "edges")
    # what columns can still gain once rows have their scales
    v = edges.groupBy("j").agg(F.min(F.col("cost") - F.col("u")).alias("v"))
    tight = edges.join(v.hint("merge"), "j").filter("cost - u - v <= 1e-15")
    pick = tight.groupBy("i").agg(F.min(F.struct("j", "u", (F.col("v") - F.col("top")).alias("v"))).alias("b")).select("i", "b.*")
    pick = scratch.keep(pick.withColumn("first", F.row_number().over(Window.partitionBy("j").orderBy("i")) == 1), "pick")
    won = pick.filter("first").drop("first")
    if won.count() < n:
        every = edges.select((F.col("i") * 2).alias("src"), (F.col("j") * 2 + 1).alias("dst"))
        of = scratch.keep(contracted_components(every, scratch).filter("node % 2 = 0").select(F.expr("node div 2").alias("i"), "component"), "components")
        open_ = scratch.keep(of.join(won.select("i").hint("merge"), "i", "left_anti").select("component").distinct(), "open")
        apart = of.join(open_, "component")
        rest = edges.join(apart, "i").select("component", "i", "j", "s").groupBy("component").applyInPandas(_matched_component, "i long, j long, u double, v double")
        won = scratch.keep(won.join(apart.select("i"), "i", "left_anti").select("i", "j", "u", "v").unionByName(rest), "won")
        if won.filter("i >= 0").count() < n:
            return spark.range(n).select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(0.0).alias("u"), F.lit(0.0).alias("v"), F.lit(1).alias("info"))
    cols = won.select(F.col("j").alias("i"), "v")
    return scratch.keep(won.select("i", "j", "u").join(cols.hint("merge"), "i").select(F.col("i").alias("src"), F.col("j").alias("dst"), "u", "v", F.lit(0).alias("info")), "matched")
