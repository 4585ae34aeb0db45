"""Merkle manifest of a dataset: a tree of digests for each group, a tree of the groups' subroots, proofs and folds.

Digests are lowercase hex. A parent's preimage is the text of its children's
digests end to end, so the preimages of neighbouring parents of one level are one
string too, cut every ``ARITY`` digests. ``BITS`` levels of ``BLOCK`` neighbouring
nodes are kept as one row of such strings. A node joins the row of its block and,
through it, its ancestors' preimages in the blocks above; cutting its own slot of
64 characters out of each leaves its siblings, and putting another digest into
the slot gives the preimage of the changed parent.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from lattica.llm.numbering import numbered
from lattica.plans.scratch import Scratch

HEX = 64
ARITY = 2
BITS = 6
BLOCK = ARITY**BITS


def field(value: Column) -> Column:
    """``-`` for null, else the value's UTF-8 length, a colon and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def digest(*values: Column) -> Column:
    """Digest of a record: of its fields end to end."""
    return F.sha2(F.concat(*[field(v) for v in values]).cast("binary"), 256)


def _shift(value: Column, by: Column | int) -> Column:
    return F.call_function("shiftright", value, by if isinstance(by, Column) else F.lit(by))


def _parents(children: Column) -> Column:
    """Digests of neighbouring parents from the digests of their children, both end to end."""
    places = F.sequence(F.lit(0), ((F.length(children) - 1) / (ARITY * HEX)).cast("int"))
    return F.array_join(F.transform(places, lambda i: F.sha2(F.substr(children, i * (ARITY * HEX) + 1, F.lit(ARITY * HEX)).cast("binary"), 256)), "")


def _climb(scratch: Scratch, nodes: DataFrame) -> list[DataFrame]:
    """Tables ``(tree, pos, n, levels, hash)`` of blocks of ``nodes(tree, pos, n, hash)``, of blocks of those, and so on.

    ``levels`` has the digests of a block's nodes end to end, then those of their parents, up to the block's own.
    """
    tiers = []
    most = nodes.agg(F.max("n")).first()[0] or 0
    while True:
        depth = F.when(F.col("n") <= 1, 0).otherwise(F.least(F.lit(BITS), F.length(F.bin(F.col("n") - 1))))
        blocks = nodes.groupBy("tree", F.shiftright("pos", BITS).alias("pos")).agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("pos", "hash"))).alias("held"))
        first = F.array_join(F.col("held.hash"), "")
        levels = F.aggregate(
            F.slice(F.array(*[F.lit(k) for k in range(BITS)]), F.lit(1), depth), F.array(first), lambda have, _: F.concat(have, F.array(_parents(F.element_at(have, -1))))
        )
        blocks = blocks.select("tree", "pos", "n", levels.alias("levels")).withColumn("hash", F.element_at("levels", -1))
        tiers.append(scratch.keep(blocks, "blocks"))
        if most <= BLOCK:
            return tiers
        most = -(-most // BLOCK)
        nodes = tiers[-1].filter(F.col("n") > BLOCK).withColumn("n", F.ceil(F.col("n") / BLOCK).cast("long"))


def _own_path(levels: Column, pos: Column) -> Column:
    """Preimages of a node's ancestors in its block, each with the slot that leads to the node."""
    at = pos.bitwiseAND(F.lit(BLOCK - 1))

    def step(digests: Column, level: Column) -> Column:
        parent, slot = _shift(at, level + 1), _shift(at, level).bitwiseAND(F.lit(ARITY - 1))
        return F.struct(F.substr(digests, (parent * (ARITY * HEX) + 1).cast("int"), F.lit(ARITY * HEX)).alias("preimage"), slot.cast("int").alias("slot"))

    return F.transform(F.slice(levels, F.lit(1), F.size(levels) - 1), step)


def _paths(scratch: Scratch, nodes: DataFrame, above: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``nodes`` with ``path`` (ancestors' preimages and slots, from the parent up) and what ``above`` says of their tree.

    ``above`` turns ``(tree, hash)`` of whole trees into ``(tree, over, path)``: any struct, and the way on from the tree's own digest.
    """
    tiers = _climb(scratch, nodes)
    tops = [t.filter(F.col("n") <= BLOCK).select("tree", "pos", "levels", "hash") for t in tiers]
    whole = tops[0].select("tree", "hash")
    for t in tops[1:]:
        whole = whole.unionByName(t.select("tree", "hash"))
    given = above(whole)
    upper = None
    for tier, top in zip(reversed(tiers), reversed(tops), strict=True):
        own = top.join(given, "tree").select("tree", "pos", "levels", "over", "path")
        if upper is not None:
            below = _joined(tier.filter(F.col("n") > BLOCK).select("tree", "pos", F.col("levels").alias("own")), upper)
            own = own.unionByName(below.select("tree", "pos", F.col("own").alias("levels"), "over", "path"))
        upper = own
    return _joined(nodes, upper)


def _joined(nodes: DataFrame, blocks: DataFrame) -> DataFrame:
    """Nodes of a tier with their ancestors' preimages, from the blocks they are in."""
    blocks = blocks.select(F.col("tree").alias("in_tree"), F.col("pos").alias("block"), "levels", "over", F.col("path").alias("way"))
    got = nodes.join(blocks, (F.col("tree") == F.col("in_tree")) & (F.shiftright("pos", BITS) == F.col("block")))
    return got.select(*nodes.columns, "over", F.concat(_own_path(F.col("levels"), F.col("pos")), F.col("way")).alias("path"))


def manifest(rows: DataFrame, group: str, order: str, leaf: str, keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns of ``rows`` with ``leaf``, ``subroot``, ``root`` and ``path``, the way from leaf to root.

    The leaves of each group ascend by ``order`` (nulls first; equal ones by leaf, so that a repeated
    row gives the same tree in any order); neighbours become the digest of their digests until one is
    left, the last one alone if its level is odd. The groups' subroots, null first, then bytewise, give the root
    in the same way. Rows are shared out by position, so a group of any size is many tasks' work. An
    empty table gives no rows; columns not named are not read. ``keep`` must not hold columns tree, pos, n, hash, over or path.
    """
    scratch = Scratch(rows.sparkSession)
    keep = [c for c in keep or [] if c != leaf]
    tree = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))
    given = scratch.keep(rows.select(*keep, tree.alias("tree"), F.col(order).alias("order_"), F.col(leaf).alias("hash")), "leaves")
    nodes = scratch.keep(numbered(scratch, given, "tree", ["order_", "hash"]).drop("order_"), "nodes")

    def root(whole: DataFrame) -> DataFrame:
        nowhere = F.array().cast("array<struct<preimage string, slot int>>")
        return whole.select("tree", F.struct(F.col("hash").alias("root")).alias("over"), nowhere.alias("path"))

    def roots(whole: DataFrame) -> DataFrame:
        named = whole.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "hash")
        named = scratch.keep(numbered(scratch, named, "tree", ["name"]), "subroots")
        over = F.struct(F.col("hash").alias("subroot"), "over.root")
        return scratch.keep(_paths(scratch, named, root).select(F.col("name").alias("tree"), over.alias("over"), "path"), "roots")

    out = _paths(scratch, nodes, roots)
    return out.select(*keep, F.col("hash").alias(leaf), "over.subroot", "over.root", "path")


def _left(step: Column) -> Column:
    return F.substr(step["preimage"], F.lit(1), step["slot"] * HEX)


def _right(step: Column) -> Column:
    return F.substr(step["preimage"], step["slot"] * HEX + HEX + 1, F.lit(ARITY * HEX))


def siblings(path: Column) -> Column:
    """The other digests of each level, from the leaf up, end to end."""
    return F.array_join(F.transform(path, lambda step: F.concat(_left(step), _right(step))), "")


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf leads to: each level's slot gets the digest made below it."""
    return F.aggregate(path, leaf, lambda below, step: F.sha2(F.concat(_left(step), below, _right(step)).cast("binary"), 256))
