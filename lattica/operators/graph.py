"""Connected components of an undirected edge table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lattica.plans.scratch import Scratch

#: Edges of a partition that are joined into a forest at once.
FOREST_EDGES = 1 << 18


def forest_roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Least index reachable from each of ``n`` nodes by the edges a-b: labels travel, then jump to their own label."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def local_forests(edges: DataFrame) -> DataFrame:
    """``(src, dst)``: edges with the same components, at most one an end in each partition's block; loops stay."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        have = 0
        for batch in batches:
            held.append(batch)
            have += len(batch)
            if have >= FOREST_EDGES:
                yield thinned(held)
                held, have = [], 0
        if have:
            yield thinned(held)

    def thinned(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        ends, at = np.unique(np.concatenate([table.column(0).to_numpy(), table.column(1).to_numpy()]), return_inverse=True)
        root = forest_roots(at[: len(table)], at[len(table) :], len(ends))
        own = root != np.arange(len(ends))
        lone = ~own & ~np.isin(np.arange(len(ends)), root[own])
        keep = own | lone
        return pa.RecordBatch.from_arrays([pa.array(ends[keep]), pa.array(ends[root[keep]])], ["src", "dst"])

    ends = edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst")).dropna()
    return ends.mapInArrow(work, "src long, dst long")


def contracted_components(edges: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """``connected_components`` where most edges link nodes of near numbers: ranges of nodes are joined first, side by side.

    A node of several ranges links the least nodes it hangs on there; only these links, few where numbers are near, go through rounds.
    The result is the same for any numbers.
    """
    scratch = scratch or Scratch(edges.sparkSession)
    ends = edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).filter("src is not null and dst is not null")
    # the piece of an edge follows its lesser end only, so a piece holds whole stars
    hung = scratch.keep(local_forests(ends.repartitionByRange("src")).distinct(), "hung")
    # a root hangs on itself in its own piece, so that it meets the roots it hangs on elsewhere
    hung = hung.unionByName(hung.select(F.col("dst").alias("src"), "dst")).groupBy("src")
    least = scratch.keep(hung.agg(F.min("dst").alias("root"), F.collect_set("dst").alias("roots")), "least")
    links = least.filter(F.size("roots") > 1).select(F.col("root").alias("src"), F.explode("roots").alias("dst")).filter("src != dst")
    links = scratch.keep(links, "links")
    if links.isEmpty():
        return least.select(F.col("src").alias("node"), F.col("root").alias("component"))
    over = connected_components(links, scratch).select(F.col("node").alias("root"), "component")
    return least.select("src", "root").join(over, "root", "left").select(F.col("src").alias("node"), F.coalesce("component", "root").alias("component"))


def connected_components(edges: DataFrame, scratch: Scratch | None = None, max_rounds: int = 200) -> DataFrame:
    """``(node, component)`` for every end of ``edges(src, dst)``; component = least reachable node.

    Edges are first thinned to a forest in each partition. Then least labels
    travel along the edges, and each label is replaced by its label's own label,
    so a path of n nodes takes about log2(n) rounds. Every round is a written
    table, and both sides of a join on labels are written, so that a label of
    many nodes can be split. Null ends and loops link nothing; a loop's node is
    listed. Repeated edges count once; no edges give no rows.
    """
    scratch = scratch or Scratch(edges.sparkSession)
    ends = local_forests(edges)
    both = ends.select("src", "dst", F.explode(F.array(F.lit(False), F.lit(True))).alias("_turn"))
    turned = F.when(F.col("_turn"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"))).otherwise(F.struct("src", "dst"))
    both = scratch.keep(both.select(turned.alias("_e")).select("_e.*").distinct(), "both")
    n = both.count()
    labels = scratch.keep(both.groupBy(F.col("src").alias("node")).agg(F.least(F.min("dst"), F.col("src")).alias("component")), "labels", n)
    for _ in range(max_rounds):
        heard = (
            both.join(labels.withColumnRenamed("node", "src"), "src")
            .groupBy(F.col("dst").alias("node"))
            .agg(F.min("component").alias("heard"))
        )
        lower = labels.join(heard, "node").select("node", F.least("component", "heard").alias("component"), F.col("component").alias("old"))
        lower = scratch.keep(lower, "lower", n)
        root = lower.select(F.col("node").alias("component"), F.col("component").alias("root"))
        jumped = scratch.keep(
            lower.join(root, "component").select("node", F.col("root").alias("component"), (F.col("root") < F.col("old")).alias("moved")), "labels", n
        )
        moved = not jumped.filter("moved").isEmpty()
        scratch.drop(labels)
        scratch.drop(lower)
        labels = jumped
        if not moved:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    scratch.drop(both)
    return labels.select("node", "component")
