"""Elimination trees of large matrices and what is counted along them, by rounds of joins.

A tree depends on the graph only through which nodes hang together below each bound. So a block of
rows that comes first needs its own edges alone: it links its nodes, shrinks every edge to a later
node to (root, node), and hands the later neighbours of each root on as a path, which holds
together below every bound as the root did. Blocks of one level do this side by side.

Tables here have a row a node; written small, many would be broadcast through the driver, so joins are told to merge.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from lattica.operators.blocks import Layout, _due, in_order
from lattica.operators.products import a_plus_at_pattern
from lattica.plans.scratch import Scratch

#: Rows that one task links.
RANGE = 1 << 16

LINK = "node long, parent long, pb long, pl int, kind string"


def _linked(frame: pd.DataFrame) -> pd.DataFrame:
    """Parents within a block, and the edges it hands on; rows are edges (lo, hi) with the block and level of hi."""
    frame = frame.drop_duplicates(["lo", "hi"])
    block = int(frame["block"].iloc[0])
    own = frame["hb"].to_numpy() == block
    ids = np.unique(np.concatenate((frame["lo"].to_numpy(), frame["hi"].to_numpy()[own])))
    up = list(range(len(ids)))

    def root(x: int) -> int:
        top = x
        while up[top] != top:
            top = up[top]
        while up[x] != top:
            up[x], x = top, up[x]
        return top

    node, parent = [], []
    inner = frame[own].sort_values("hi")
    for lo, hi in zip(np.searchsorted(ids, inner["lo"]).tolist(), np.searchsorted(ids, inner["hi"]).tolist(), strict=True):
        top = root(lo)
        if top != hi:
            up[top] = hi
            node.append(ids[top])
            parent.append(ids[hi])
    out = [pd.DataFrame({"node": node, "parent": parent, "pb": block, "pl": 0, "kind": "parent"})]
    outer = frame[~own]
    if len(outer):
        tops = ids[[root(x) for x in np.searchsorted(ids, outer["lo"]).tolist()]]
        outer = outer.assign(lo=tops).drop_duplicates(["lo", "hi"]).sort_values(["lo", "hi"])
        first = (outer["lo"] != outer["lo"].shift()).to_numpy()
        out.append(pd.DataFrame({"node": outer["lo"][first], "parent": outer["hi"][first], "pb": block, "pl": 0, "kind": "parent"}))
        on = outer[~first]
        before = outer.shift()[~first]
        out.append(pd.DataFrame({"node": before["hi"].astype(np.int64), "parent": on["hi"], "pb": on["hb"], "pl": on["hl"], "kind": "edge"}).assign(fb=before["hb"].astype(np.int64), fl=before["hl"].astype(np.int64)))
    done = pd.concat(out)
    for c in ("fb", "fl"):
        done[c] = done[c].fillna(0).astype(np.int64) if c in done else 0
    return done[["node", "parent", "pb", "pl", "kind", "fb", "fl"]]


def elimination_parents(edges: DataFrame, n: int, layout: Layout | None = None) -> DataFrame:
    """``(node, parent)`` by position for the graph ``edges(i, j)`` of n rows, a root's parent is n; repeated edges and loops count nothing.

    Positions are those of ``layout``, by default the rows' own with ranges of ``RANGE`` rows.
    """
    spark = edges.sparkSession
    scratch = Scratch(spark)
    layout = layout or in_order(edges, n, RANGE)
    at = layout.places.select("i", (F.col("block") + F.col("at")).alias("pos"), "block", "level")
    x, y = (at.select(F.col("i").alias(c), F.struct("pos", "block", "level").alias(f"s{c}")) for c in ("i", "j"))
    both = edges.select("i", "j").filter("i != j").join(x.hint("merge"), "i").join(y.hint("merge"), "j").select(F.least("si", "sj").alias("lo"), F.greatest("si", "sj").alias("hi")).distinct()
    columns = [F.col("lo.pos").alias("lo"), F.col("lo.block").alias("block"), F.col("lo.level").alias("level"), F.col("hi.pos").alias("hi"), F.col("hi.block").alias("hb"), F.col("hi.level").alias("hl")]
    both.select(*columns).write.partitionBy("level").parquet(f"{scratch.path}/edges/round=0")
    for level in range(layout.levels):
        due = _due(scratch, f"{scratch.path}/edges/round=*/level={level}")
        if due is None:
            continue
        done = due.select("lo", "block", "hi", "hb", "hl").groupBy("block").applyInPandas(_linked, LINK + ", fb long, fl long")
        done = scratch.keep(done, f"linked{level}")
        done.filter("kind = 'parent'").select("node", "parent").write.parquet(f"{scratch.path}/parents/level={level}")
        on = done.filter("kind = 'edge'").select(F.col("node").alias("lo"), F.col("fb").alias("block"), F.col("fl").cast("int").alias("level"), F.col("parent").alias("hi"), F.col("pb").alias("hb"), F.col("pl").alias("hl"))
        on.write.partitionBy("level").parquet(f"{scratch.path}/edges/round={level + 1}")
    found = _due(scratch, f"{scratch.path}/parents/level=*")
    every = spark.range(n).withColumnRenamed("id", "node")
    if found is None:
        return every.withColumn("parent", F.lit(n).cast("long"))
    return every.join(found.select("node", "parent").hint("merge"), "node", "left").select("node", F.coalesce("parent", F.lit(n)).cast("long").alias("parent"))


def row_paths(a: DataFrame) -> DataFrame:
    """``(i, j)``: for each row of ``a`` a path through its columns; the graph hangs together as that of A' A, which is not formed."""
    before = F.lag("j").over(Window.partitionBy("i").orderBy("j"))
    return a.select("i", "j").distinct().select("j", before.alias("p")).filter("p is not null").select(F.col("p").alias("i"), "j").distinct()


def _before(scratch: Scratch, rows: DataFrame, group: str, order: str, value: str, name: str) -> DataFrame:
    """``rows`` with the sum of ``value`` over the earlier rows of the group; ranges are summed first, so no task sees a whole group."""
    ranged = rows.repartitionByRange(group, order).sortWithinPartitions(group, order).withColumn("place_", F.monotonically_increasing_id())
    ranged = scratch.keep(ranged, "ranged").withColumn("piece_", F.shiftright("place_", 33))
    inner = Window.partitionBy(group, "piece_").orderBy("place_").rowsBetween(Window.unboundedPreceding, -1)
    pieces = ranged.groupBy(group, "piece_").agg(F.sum(value).alias("sum_"))
    outer = Window.partitionBy(group).orderBy("piece_").rowsBetween(Window.unboundedPreceding, -1)
    starts = pieces.select(group, "piece_", F.coalesce(F.sum("sum_").over(outer), F.lit(0)).alias("start_"))
    out = ranged.join(starts.hint("merge"), [group, "piece_"])
    return out.select(*rows.columns, (F.col("start_") + F.coalesce(F.sum(value).over(inner), F.lit(0))).alias(name))


def tree_measures(parents: DataFrame, n: int) -> DataFrame:
    """``(node, parent, post, level, descendants)`` of a forest ``(node, parent)``; a root's parent is n.

    ``level`` is the greatest distance to a node below, ``descendants`` counts the nodes below, ``post`` is the place in
    postorder (children by index). Sums run up the tree by jumps of 1, 2, 4, ... parents, so a chain of n takes log2(n) rounds.
    """
    scratch = Scratch(parents.sparkSession)
    up = F.when(F.col("parent") < n, F.col("parent"))
    now = scratch.keep(parents.select("node", "parent", up.alias("jump"), F.lit(1).cast("long").alias("size"), F.lit(0).cast("long").alias("level")), "sizes", n)
    span = 1
    while not now.filter("jump is not null").isEmpty():
        below = now.filter("jump is not null").groupBy(F.col("jump").alias("b")).agg(F.sum("size").alias("more"), F.max("level").alias("deep"))
        farther = now.select(F.col("node").alias("jump"), F.col("jump").alias("far"))
        nxt = now.join(below.hint("merge"), F.col("node") == F.col("b"), "left").join(farther.hint("merge"), "jump", "left")
        nxt = nxt.select("node", "parent", F.col("far").alias("jump"), (F.col("size") + F.coalesce("more", F.lit(0))).alias("size"), F.greatest("level", F.col("deep") + span).alias("level"))
        nxt = scratch.keep(nxt, "sizes", n)
        scratch.drop(now)
        now, span = nxt, span * 2
    sums = _before(scratch, now.select("node", "parent", "size", "level"), "parent", "node", "size", "start")
    sums = scratch.keep(sums.withColumn("jump", up), "starts", n)
    while not sums.filter("jump is not null").isEmpty():
        farther = sums.select(F.col("node").alias("jump"), F.col("jump").alias("far"), F.col("start").alias("more"))
        nxt = sums.join(farther.hint("merge"), "jump", "left").select("node", "parent", "size", "level", (F.col("start") + F.coalesce("more", F.lit(0))).alias("start"), F.col("far").alias("jump"))
        nxt = scratch.keep(nxt, "starts", n)
        scratch.drop(sums)
        sums = nxt
    return sums.select("node", "parent", (F.col("start") + F.col("size") - 1).alias("post"), "level", (F.col("size") - 1).alias("descendants"))


def elimination_tree(a: DataFrame, n: int, kind: str = "symmetric", layout: Layout | None = None) -> DataFrame:
    """``(node, parent, post, level, descendants)`` of the elimination tree of A + A' ("symmetric") or A' A ("column")."""
    edges = row_paths(a) if kind == "column" else a_plus_at_pattern(a)
    return tree_measures(elimination_parents(edges, n, layout), n)


def subtree_sums(parents: DataFrame, n: int, loads: DataFrame) -> DataFrame:
    """``(node, parent, load, total)``: the sum of ``loads(node, load)``, whole numbers, over each node and those below it.

    A node without a load counts 0; a root's parent is n. Sums run up by jumps of 1, 2, 4, ... parents.
    """
    scratch = Scratch(parents.sparkSession)
    own = parents.select("node", "parent").join(loads.select("node", F.col("load").cast("long").alias("load")).hint("merge"), "node", "left")
    own = own.select("node", "parent", F.coalesce("load", F.lit(0)).alias("load"))
    now = scratch.keep(own.select("*", F.col("load").alias("total"), F.when(F.col("parent") < n, F.col("parent")).alias("jump")), "sums", n)
    while not now.filter("jump is not null").isEmpty():
        below = now.filter("jump is not null").groupBy(F.col("jump").alias("node")).agg(F.sum("total").alias("more"))
        farther = now.select(F.col("node").alias("jump"), F.col("jump").alias("far"))
        nxt = now.join(below.hint("merge"), "node", "left").join(farther.hint("merge"), "jump", "left")
        nxt = nxt.select("node", "parent", "load", (F.col("total") + F.coalesce("more", F.lit(0))).alias("total"), F.col("far").alias("jump"))
        nxt = scratch.keep(nxt, "sums", n)
        scratch.drop(now)
        now = nxt
    return now.select("node", "parent", "load", "total")


def forest_partition(parents: DataFrame, n: int, loads: DataFrame, parts: int, pieces: int = 4) -> DataFrame:
    """``(node, parent, load, total, task)``: whole subtrees dealt to tasks 0 to ``parts`` - 1; what lies above them has task -1.

    Heavy subtrees are split from the top until none holds more than 1 / (``pieces`` x ``parts``) of all load. Neighbouring
    ones, by index, share a task, so a task holds at most its mean and one such piece more; a task may stay empty. A
    node that is heavier than a piece by itself belongs to the top. Loads are whole numbers, none below 0; a forest
    without load goes to task 0, and an empty one gives no rows.
    """
    scratch = Scratch(parents.sparkSession)
    sums = scratch.keep(subtree_sums(parents, n, loads), "sums", n)
    most = (sums.agg(F.sum("load")).first()[0] or 0) // (pieces * parts)
    above = sums.select(F.col("node").alias("parent"), F.col("total").alias("upper"))
    light = sums.filter(F.col("total") <= most).join(above.hint("merge"), "parent", "left").withColumn("top", F.col("upper").isNull() | (F.col("upper") > most))
    light = scratch.keep(light.select("node", "parent", "total", "top"), "light", n)
    tops = scratch.keep(_before(scratch, light.filter("top").select(F.lit(0).alias("one"), "node", "total"), "one", "node", "total", "before"), "tops", n)
    dealt = max(1, tops.agg(F.sum("total")).first()[0] or 0)
    place = F.expr(f"least(cast(before as decimal(38, 0)) * {parts} div {dealt}, {parts - 1})").cast("int")
    task = tops.select("node", place.alias("task"))
    # the others look for the top of their subtree by jumps
    now = scratch.keep(light.join(task.hint("merge"), "node", "left").select("node", "task", F.when(~F.col("top"), F.col("parent")).alias("jump")), "tasks", n)
    while not now.filter("task is null").isEmpty():
        there = now.select(F.col("node").alias("jump"), F.col("task").alias("found"), F.col("jump").alias("far"))
        nxt = now.join(there.hint("merge"), "jump", "left").select("node", F.coalesce("task", "found").alias("task"), F.when(F.coalesce("task", "found").isNull(), F.col("far")).alias("jump"))
        nxt = scratch.keep(nxt, "tasks", n)
        scratch.drop(now)
        now = nxt
    return sums.join(now.select("node", "task").hint("merge"), "node", "left").select("node", "parent", "load", "total", F.coalesce("task", F.lit(-1)).alias("task"))
