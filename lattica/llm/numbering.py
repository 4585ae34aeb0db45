"""Positions of rows within groups of any size, without a task that sees a whole group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from lattica.plans.scratch import Scratch


def numbered(scratch: Scratch, rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``rows`` with ``pos`` (from 0 in its group, by ``order``) and ``n`` (rows of the group).

    Rows are dealt by ranges of group and order and written once; those of a
    group in one range stand side by side, so its first row and the sizes of its
    earlier ranges give every position. Rows equal in all of ``order`` are told apart
    by where they stood, so copies of one row spread over ranges. Nulls come first; an
    empty table stays empty. ``rows`` must not have columns pos, n, row_, piece_ or place_.
    """
    keys = [group, *order, "place_"]
    dealt = rows.withColumn("place_", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    kept = scratch.keep(dealt.drop("place_").withColumn("row_", F.monotonically_increasing_id()), "numbered")
    kept = kept.withColumn("piece_", F.shiftright("row_", 33))
    pieces = kept.groupBy(group, "piece_").agg(F.count(F.lit(1)).alias("size"), F.min("row_").alias("first"))
    whole = Window.partitionBy(group)
    earlier = F.sum("size").over(whole.orderBy("piece_").rowsBetween(Window.unboundedPreceding, -1))
    starts = pieces.select(group, "piece_", (F.coalesce(earlier, F.lit(0)) - F.col("first")).alias("shift"), F.sum("size").over(whole).alias("n"))
    out = kept.join(starts, [group, "piece_"])
    return out.select(*rows.columns, (F.col("row_") + F.col("shift")).alias("pos"), "n")
