"""Weighted rendezvous hashing of record keys over shards, in DataFrame functions.

A key scores every shard by ``-weight / ln(u)`` with u in (0, 1) hashed from key
and shard; the highest score wins. A further shard only wins keys, so records
move into it alone, and with weight w it wins w / total of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lattica.llm.columns import fresh
from lattica.plans.scratch import Scratch


def shard_of(key: Column, weights: list[float]) -> Column:
    """Shard of each key; equal scores go to the lower shard, a null key to where its hash leads."""

    def score(shard: Column, weight: Column) -> Column:
        bits = F.shiftrightunsigned(F.xxhash64(key, shard, F.lit(977)), 11)
        unit = (bits.cast("double") + 0.5) / F.lit(float(1 << 53))
        return F.struct((-weight / F.log(unit)).alias("score"), (-shard).alias("shard"))

    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive")
    if len(set(weights)) == 1:
        table = F.transform(F.sequence(F.lit(0), F.lit(len(weights) - 1)), lambda s: score(s, F.lit(float(weights[0]))))
    else:
        pairs = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(w)).alias("w")) for i, w in enumerate(weights)])
        table = F.transform(pairs, lambda p: score(p["i"], p["w"]))
    return (-F.array_max(table)["shard"]).cast("int")


def assign_shards(df: DataFrame, key: str, weights: list[float], shard: str = "shard") -> DataFrame:
    """``df`` with a shard column (a column of that name is replaced); no shuffle. Equal keys share a shard."""
    return df.withColumn(shard, shard_of(F.col(key), weights))


def number_slots(df: DataFrame, shard: str = "shard", slot: str = "slot") -> DataFrame:
    """Number the rows of each shard from 0 without gaps, in the order of the written partitions.

    The rows are written once, so that a retried task can't change the order. Each
    piece (partition and shard) is numbered alone and moved by the rows of the
    shard's earlier pieces; no task sees a whole shard. Repeated rows get slots of
    their own; an empty table stays empty; a column named as ``slot`` is replaced.
    """
    row, piece, size, before = fresh(df, "row", "piece", "size_", "before")
    rows = Scratch(df.sparkSession).keep(df.withColumn(row, F.monotonically_increasing_id()), "rows")
    rows = rows.withColumn(piece, F.shiftright(row, 33))
    sizes = rows.groupBy(shard, piece).agg(F.count(F.lit(1)).alias(size))
    earlier = F.sum(size).over(Window.partitionBy(shard).orderBy(piece).rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select(shard, piece, F.coalesce(earlier, F.lit(0)).alias(before))
    rank = F.row_number().over(Window.partitionBy(shard, piece).orderBy(row))
    out = rows.join(starts, [shard, piece]).withColumn(row, F.col(before) + rank - 1)
    return out.select(*[c for c in df.columns if c != slot], F.col(row).alias(slot))
