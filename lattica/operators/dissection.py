"""Nested dissection of a matrix's graph in tables: parts, separators, their tree and the order of elimination.

Rows whose neighbours have like numbers are first halved by number. Another graph is coarsened by heavy-edge matching, all its
parts side by side, until each is small enough for one task, which cuts it by its spectrum. The cut travels
back level by level and is refined by moves that lower it. Parts that are
still large are cut again in the same way, so no task ever holds the graph. Edges
between parts name the separators: of each cut the side with fewer ends. What a part holds between them is cut by one task.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from lattica.operators.products import a_plus_at_pattern
from lattica.plans import kernels as K
from lattica.plans.scratch import Scratch

#: Nodes of a part's coarse graph that one task cuts.
COARSE = 400
#: Cuts of a part in one go: two to this power parts.
BITS = 3
#: Rows of a part that one task cuts to the end.
PIECE = 1 << 15
#: Rows with links to another range, as a share of all, up to which numbers are halved.
ENDS = 1 / 8


@dataclass
class Dissection:
    """Elimination order with its tree.

    ``order`` is ``(i, pos, height, node, rank)``: where each row goes, its tree node, its place there. ``tree`` is
    ``(height, node, size, first)`` of the nodes that hold rows: parts have height 0, the separator of
    ``node`` at height h stands above the parts ``node * 2**h`` to ``(node + 1) * 2**h - 1``; ``first`` is the first
    position of the node. A node comes after all below it. ``depth`` is the greatest height.
    """

    order: DataFrame
    tree: DataFrame
    depth: int

    def permutation(self) -> DataFrame:
        """``(src, dst)``."""
        return self.order.select(F.col("i").alias("src"), F.col("pos").alias("dst"))


def spectral_order(n: int, u: np.ndarray, v: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Nodes of a small graph along the second eigenvector of its Laplacian, component after component."""
    lap = np.zeros((n, n))
    np.add.at(lap, (u, v), -w)
    lap = (lap + lap.T) / 2
    np.fill_diagonal(lap, 0.0)
    lap[np.arange(n), np.arange(n)] = -lap.sum(1)
    label = np.arange(n)
    while len(u):
        low = label.copy()
        np.minimum.at(low, u, label[v])
        low = low[low]
        if (low == label).all():
            break
        label = low
    out = []
    for c in np.unique(label):
        own = np.flatnonzero(label == c)
        if len(own) > 2:
            along = np.linalg.eigh(lap[np.ix_(own, own)])[1][:, 1]
            own = own[np.lexsort((own, along.round(9)))]
        out.append(own)
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def split_small(weight: np.ndarray, u: np.ndarray, v: np.ndarray, w: np.ndarray, bits: int) -> np.ndarray:
    """Part 0 .. 2**bits - 1 of each node: halves of like weight, cut again and again."""
    part = np.zeros(len(weight), np.int64)
    for _ in range(bits):
        nxt = part * 2
        for p in np.unique(part):
            own = np.flatnonzero(part == p)
            at = np.full(len(weight), -1)
            at[own] = np.arange(len(own))
            keep = (at[u] >= 0) & (at[v] >= 0)
            along = spectral_order(len(own), at[u[keep]], at[v[keep]], w[keep])
            half = np.cumsum(weight[own[along]]) - weight[own[along]] / 2 > weight[own].sum() / 2
            nxt[own[along[half]]] += 1
        part = nxt
    return part


def _tie(a: Column, b: Column) -> Column:
    return F.xxhash64(F.least(a, b), F.greatest(a, b))


def _coarser(scratch: Scratch, edges: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(map, edges, nodes)`` of the graph with matched nodes as one.

    Every node names its heaviest edge (ties by a hash that both ends know). Two that name each other
    are a pair. Others join the pair of the one they named, if that one is in a pair, up to a few for each; those
    who named one node that is in no pair are paired among themselves, by a hash.
    """
    named = edges.groupBy("u").agg(F.max(F.struct("w", _tie(F.col("u"), F.col("v")).alias("t"), "v")).alias("b")).select("u", F.col("b.v").alias("v"))
    named = scratch.keep(named, "named")
    back = named.select(F.col("u").alias("v"), F.col("v").alias("back"))
    said = named.join(back.hint("merge"), "v", "left").withColumn("pair", F.coalesce(F.col("back") == F.col("u"), F.lit(False)))
    said = scratch.keep(said.select("u", "v", "pair"), "said")
    heads = said.filter("pair").select(F.col("u").alias("v"), F.least("u", "v").alias("head"))
    singles = said.filter("not pair")
    fans = singles.groupBy("v").agg(F.count(F.lit(1)).alias("fans"))
    singles = singles.join(fans.hint("merge"), "v").join(heads.hint("merge"), "v", "left")
    bucket = F.pmod(F.xxhash64("u", "v"), F.greatest(F.col("fans") / 2, F.lit(1)).cast("long"))
    bucket = F.when(F.col("head").isNotNull() & (F.col("fans") <= 3), F.lit(-1)).otherwise(bucket)
    least = singles.withColumn("bucket", bucket)
    inside = least.filter("bucket >= 0").groupBy("v", "bucket").agg(F.min("u").alias("least"))
    led = least.join(inside.hint("merge"), ["v", "bucket"], "left").select("u", F.coalesce("least", "head").alias("c"))
    to = said.filter("pair").select("u", F.least("u", "v").alias("c")).unionByName(led)
    to = scratch.keep(nodes.select("u", "part", "weight").join(to.hint("merge"), "u", "left").select("u", F.coalesce("c", "u").alias("c"), "part", "weight"), "map")
    left = edges.join(to.select("u", F.col("c").alias("cu")).hint("merge"), "u").join(to.select(F.col("u").alias("v"), F.col("c").alias("cv")).hint("merge"), "v")
    less = scratch.keep(left.filter("cu != cv").groupBy(F.col("cu").alias("u"), F.col("cv").alias("v")).agg(F.sum("w").alias("w")), "edges")
    fewer = scratch.keep(to.groupBy(F.col("c").alias("u")).agg(F.first("part").alias("part"), F.sum("weight").alias("weight")), "nodes")
    return to.select("u", "c"), less, fewer


def _refined(scratch: Scratch, edges: DataFrame, nodes: DataFrame, bits: int) -> DataFrame:
    """``nodes(u, part, weight, own)`` after moves to a neighbouring part of the same parent that cut less, first upward, then downward.

    In one pass all moves go one way, so no two neighbours change places; a part takes no more than an eighth over its share.
    """
    for upward in (True, False):
        loads = nodes.groupBy("part", "own").agg(F.sum("weight").alias("load"))
        share = loads.groupBy("part").agg((F.sum("load") / F.lit(2**bits) * F.lit(1.125)).alias("most"))
        room = loads.join(share, "part").select("part", F.col("own").alias("to"), (F.col("most") - F.col("load")).alias("room"))
        far = nodes.select(F.col("u").alias("v"), F.col("own").alias("there"))
        near = edges.join(nodes.select("u", "part", "own", "weight").hint("merge"), "u").join(far.hint("merge"), "v")
        pull = near.groupBy("u", "part", "own", "weight", "there").agg(F.sum("w").alias("pull"))
        stay = F.max(F.when(F.col("there") == F.col("own"), F.col("pull"))).over(Window.partitionBy("u"))
        pull = pull.withColumn("stay", F.coalesce(stay, F.lit(0.0)))
        way = F.col("there") > F.col("own") if upward else F.col("there") < F.col("own")
        best = pull.filter(way & (F.col("pull") > F.col("stay"))).groupBy("u", "part", "weight").agg(F.max(F.struct((F.col("pull") - F.col("stay")).alias("gain"), (-F.col("there")).alias("t"))).alias("b"))
        best = best.select("u", "part", "weight", (-F.col("b.t")).alias("to"), F.col("b.gain").alias("gain"))
        wanted = best.groupBy("part", "to").agg(F.sum("weight").alias("wanted"))
        allowed = room.join(wanted, ["part", "to"]).select("part", "to", F.try_divide("room", "wanted").alias("share"))
        # where more want in than there is room, a hash lets in about the share there is room for
        let = F.pmod(F.xxhash64("u", F.lit(5)), F.lit(1024)) < F.col("share") * 1024
        moves = best.join(allowed, ["part", "to"]).filter(let).select("u", "to")
        nodes = scratch.keep(nodes.join(moves.hint("merge"), "u", "left").select("u", "part", "weight", F.coalesce("to", "own").alias("own")), "moved")
    return nodes


def _cut_coarse(bits: int):
    def work(key: tuple, nodes: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
        ids = nodes["u"].to_numpy()
        ids = np.sort(ids)
        weight = nodes.set_index("u")["weight"].reindex(ids).to_numpy(float)
        u, v = np.searchsorted(ids, edges["u"].to_numpy()), np.searchsorted(ids, edges["v"].to_numpy())
        return pd.DataFrame({"u": ids, "part": key[0], "weight": weight.astype(np.int64), "own": split_small(weight, u, v, edges["w"].to_numpy(float), bits)})

    return work


def _split(scratch: Scratch, edges: DataFrame, nodes: DataFrame, bits: int, coarse: int) -> DataFrame:
    """``(u, own)``: a new part 0 .. 2**bits - 1 for each node of ``nodes(u, part, weight)``, by multilevel cuts of every part."""
    levels = []
    size = nodes.groupBy("part").agg(F.count(F.lit(1)).alias("c")).agg(F.max("c"), F.sum("c")).first()
    most, total = size[0] or 0, size[1] or 0
    while most > coarse:
        to, less, fewer = _coarser(scratch, edges, nodes)
        got = fewer.groupBy("part").agg(F.count(F.lit(1)).alias("c")).agg(F.max("c"), F.sum("c")).first()
        if got[1] > 0.95 * total:  # hardly an edge left: what is apart stays apart
            break
        levels.append((edges, nodes, to))
        edges, nodes, most, total = less, fewer, got[0], got[1]
    linked = edges.join(nodes.select(F.col("u").alias("from"), F.col("part").alias("in_part")).hint("merge"), F.col("u") == F.col("from")).select("in_part", "u", "v", "w")
    if most <= coarse:
        cut = nodes.groupBy("part").cogroup(linked.groupBy("in_part")).applyInPandas(_cut_coarse(bits), "u long, part long, weight long, own long")
    else:
        cut = nodes.withColumn("own", F.pmod(F.xxhash64("u"), F.lit(2**bits)))
    cut = scratch.keep(cut, "cut")
    for fine_edges, fine_nodes, to in reversed(levels):
        cut = fine_nodes.join(to.hint("merge"), "u").join(cut.select(F.col("u").alias("c"), "own").hint("merge"), "c").select("u", "part", "weight", "own")
        cut = _refined(scratch, fine_edges, scratch.keep(cut, "projected"), bits)
    return cut.select("u", "own")


def _height(p: Column, q: Column) -> Column:
    """How far up the tree two parts meet: the length of their difference in bits."""
    x = p.bitwiseXOR(q)
    return F.when(x == 0, 0).otherwise(F.length(F.bin(x)))


def level_halves(start: list[int], near: list[int], inside: list[int], part: list[int], mark: int) -> list[int]:
    """Nodes of ``inside`` (those with ``part`` = mark) level after level from a far end, component after component; nodes with like places are near."""

    def walk(root: int, seen: set[int]) -> list[int]:
        out = [root]
        seen.add(root)
        for x in out:
            for y in near[start[x] : start[x + 1]]:
                if part[y] == mark and y not in seen:
                    seen.add(y)
                    out.append(y)
        return out

    order: list[int] = []
    seen: set[int] = set()
    for root in inside:
        if root not in seen:
            found = walk(root, seen)
            order += walk(found[-1], set()) if len(found) > 2 else found
    return order


def _dissected(bits: int) -> Callable:
    """Tree nodes and ranks of one part's rows: halved by levels ``bits`` times, separators are the sides of cuts with fewer ends, leaves go by minimum degree."""

    def work(key: tuple, rows: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
        base = int(key[0])
        out = [rows.loc[rows["height"] > 0, ["i", "height", "node"]].assign(rank=0)]  # separators of parts keep the order of their rows
        ids = np.sort(rows.loc[rows["height"] == 0, "i"].to_numpy())
        u, v = np.searchsorted(ids, edges["u"].to_numpy()), np.searchsorted(ids, edges["v"].to_numpy())
        here = (u < len(ids)) & (v < len(ids))
        here[here] = (ids[u[here]] == edges["u"].to_numpy()[here]) & (ids[v[here]] == edges["v"].to_numpy()[here])
        order = np.lexsort((v[here], u[here]))
        u, v = u[here][order], v[here][order]
        start, near = np.searchsorted(u, np.arange(len(ids) + 1)).tolist(), v.tolist()
        part = [0] * len(ids)
        inside = [list(range(len(ids)))]
        for _ in range(bits):
            halves = []
            for mark, own in enumerate(inside):
                along = level_halves(start, near, own, part, mark)
                middle = (len(along) + 1) // 2
                halves += [sorted(along[:middle]), sorted(along[middle:])]
            for mark, own in enumerate(halves):
                for x in own:
                    part[x] = mark
            inside = halves
        place = np.array(part, np.int64)
        height = np.zeros(len(ids), np.int64)
        for h in range(1, bits + 1):
            cut = (place[u] >> h == place[v] >> h) & (place[u] >> h - 1 != place[v] >> h - 1)
            ends = np.unique(u[cut])
            node, side = place[ends] >> h, place[ends] >> h - 1 & 1
            count = np.bincount(place[ends] >> h - 1, minlength=2 << bits - h)
            fewer = np.where(count[0::2] <= count[1::2], 0, 1)
            height[ends[side == fewer[node]]] = h
        rank = np.arange(len(ids))
        leaf = np.flatnonzero(height == 0)
        leaf = leaf[np.argsort(place[leaf], kind="stable")]
        both = (height[u] == 0) & (height[v] == 0)
        lu, lv = u[both], v[both]  # rows of two leaves have no link
        by = np.argsort(place[lu], kind="stable")
        lu, lv = lu[by], lv[by]
        cuts, links = np.searchsorted(place[leaf], np.arange(2**bits + 1)), np.searchsorted(place[lu], np.arange(2**bits + 1))
        for m in range(2**bits):
            own = leaf[cuts[m] : cuts[m + 1]]
            x, y = lu[links[m] : links[m + 1]], lv[links[m] : links[m + 1]]
            rank[own] = K.minimum_degree(K.symmetric_columns(len(own), np.searchsorted(own, x), np.searchsorted(own, y)))
        out.append(pd.DataFrame({"i": ids, "height": height, "node": ((base << bits) + place) >> height, "rank": rank}))
        return pd.concat(out)

    return work


def _ranges(edges: DataFrame, n: int, piece: int) -> int:
    """How often numbers may be halved so that few rows have links to other ranges; 0 where numbers do not tell who is near whom."""
    most = max(0, int(np.ceil(np.log2(n / piece)))) if n else 0
    far = edges.select("u", _height(_range("u", n, most), _range("v", n, most)).alias("height")).filter("height > 0").distinct()
    ends = {r.height: r.ends for r in far.groupBy("height").agg(F.count(F.lit(1)).alias("ends")).collect()} if most else {}  # one row a height
    for depth in range(most, 0, -1):
        if sum(c for h, c in ends.items() if h > most - depth) <= n * ENDS:
            return depth
    return 0


def _range(c: str, n: int, depth: int) -> Column:
    return F.expr(f"{c} * {2**depth} div {max(n, 1)}")


def _separated(edges: DataFrame) -> DataFrame:
    """``(u, height)`` of rows in separators of parts: of each cut the side with fewer ends. ``edges`` hold the parts of both ends."""
    cross = edges.filter("part != other").withColumn("height", _height(F.col("part"), F.col("other")))
    cross = cross.select("u", "part", "height", F.expr("shiftright(part, height)").alias("node"), F.expr("shiftright(part, height - 1) & 1").alias("side")).distinct()
    count = cross.groupBy("height", "node").agg(F.count(F.when(F.col("side") == 0, 1)).alias("left"), F.count(F.when(F.col("side") == 1, 1)).alias("right"))
    side = count.select("height", "node", F.when(F.col("left") <= F.col("right"), 0).otherwise(1).alias("side"))
    return cross.join(side, ["height", "node", "side"]).groupBy("u").agg(F.max("height").alias("height"))


def dissect(a: DataFrame, n: int, leaf: int = 256, coarse: int = COARSE, bits: int = BITS, piece: int = PIECE) -> Dissection:
    """Separator tree and elimination order of the pattern of A + A' of n rows; parts have about ``leaf`` rows at most.

    Where neighbours have like numbers, the rows are first halved by number; else parts are cut by coarsening until they have
    about ``piece`` rows. The rest of a part is one task's: it halves what the separators left by levels of neighbours.
    A part whose graph cannot be coarsened further (no edges left to match) is dealt by a hash. Entries may repeat; n = 0
    gives empty tables. A separator may have any size.
    """
    spark = a.sparkSession
    scratch = Scratch(spark)
    edges = scratch.keep(a_plus_at_pattern(a).select(F.col("i").alias("u"), F.col("j").alias("v"), F.lit(1.0).alias("w")), "edges")
    depth = _ranges(edges, n, piece)
    most = -(-n // 2**depth)
    if most <= 4 * piece:
        parts = spark.range(n).select(F.col("id").alias("u"), _range("id", n, depth).alias("part"))
        linked = edges.select("u", "v", _range("u", n, depth).alias("part"), _range("v", n, depth).alias("other"))
    else:
        parts, depth, most = _coarsely(scratch, edges, n, piece, coarse, bits)
        held = parts.hint("merge")
        linked = scratch.keep(edges.join(held, "u").join(held.select(F.col("u").alias("v"), F.col("part").alias("other")), "v").select("u", "v", "part", "other"), "linked")
    inner = max(0, int(np.ceil(np.log2(most / leaf)))) if most else 0
    # heights count from the leaves of the whole tree
    top = _separated(linked).withColumn("height", F.col("height") + inner)
    rows = parts.join(top.hint("merge"), "u", "left").select(F.col("u").alias("i"), "part", F.coalesce("height", F.lit(0)).cast("long").alias("height"))
    rows = rows.withColumn("node", F.expr(f"shiftright(part, int(height - {inner}))"))
    inside = linked.filter("part = other").select("other", "u", "v")
    order = rows.groupBy("part").cogroup(inside.groupBy("other")).applyInPandas(_dissected(inner), "i long, height long, node long, rank long")
    order = order.withColumn("height", F.col("height").cast("int")).withColumn("last", F.expr("shiftleft(node + 1L, height) - 1"))
    order = _numbered(scratch, order)
    tree = scratch.keep(order.groupBy("height", "node").agg(F.count(F.lit(1)).alias("size"), F.min("pos").alias("first")), "tree")
    order = order.join(tree.select("height", "node", "first").hint("merge"), ["height", "node"]).select("i", "pos", "height", "node", (F.col("pos") - F.col("first")).alias("rank"))
    return Dissection(scratch.keep(order, "order"), tree, depth + inner)


def _coarsely(scratch: Scratch, edges: DataFrame, n: int, piece: int, coarse: int, bits: int) -> tuple[DataFrame, int, int]:
    """``(u, part)`` with about ``piece`` rows a part at most, by coarsening; how often parts were halved, and the rows of the largest."""
    parts = scratch.spark.range(n).select(F.col("id").alias("u"), F.lit(0).cast("long").alias("part"))
    depth, most = 0, n
    while most > piece:
        step = min(bits, int(np.ceil(np.log2(most / piece))))
        nodes = scratch.keep(parts.withColumn("weight", F.lit(1).cast("long")), "parts")
        sizes = nodes.groupBy("part").agg(F.count(F.lit(1)).alias("c"))
        large = nodes.join(sizes.filter(F.col("c") > piece), "part", "left_semi")
        near, far = large.select("u", "part").hint("merge"), large.select(F.col("u").alias("v"), F.col("part").alias("other")).hint("merge")
        inside = edges.join(near, "u").join(far, "v").filter("part = other").select("u", "v", "w")
        own = _split(scratch, scratch.keep(inside, "inside"), scratch.keep(large, "large"), step, coarse)
        parts = scratch.keep(nodes.join(own.hint("merge"), "u", "left").select("u", (F.col("part") * 2**step + F.coalesce("own", F.lit(0))).alias("part")), "parts")
        depth += step
        now = parts.groupBy("part").agg(F.count(F.lit(1)).alias("c")).agg(F.max("c")).first()[0]
        if now > 0.9 * most and depth > 20:
            most = now
            break
        most = now
    return parts, depth, most


def _numbered(scratch: Scratch, rows: DataFrame) -> DataFrame:
    """``pos`` of rows in the order of the tree; ranges are counted, so no task sorts them all."""
    keys = ["last", "height", "rank", "i"]
    ranged = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id())
    ranged = scratch.keep(ranged, "ranged").withColumn("piece", F.shiftright("at", 33))
    sizes = ranged.groupBy("piece").agg(F.count(F.lit(1)).alias("c"))
    before = sizes.select("piece", F.coalesce(F.sum("c").over(Window.orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    out = ranged.join(before, "piece").withColumn("pos", F.col("before") + F.col("at") - F.shiftleft("piece", 33))
    return scratch.keep(out.select("i", "height", "node", "pos"), "numbered")
