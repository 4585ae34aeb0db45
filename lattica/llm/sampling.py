"""Bounded samples for the models trained on the driver, and the shares that are held out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def crc_share(column: str, n: int) -> Column:
    """crc32 of the id as text, modulo n."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


def under(key: Column, share: float) -> Column:
    """Whether a 64-bit hash is among the least ``share`` of all."""
    return key <= F.lit(min((1 << 63) - 1, int((share - 0.5) * 2.0**64)))


def some_rows(rows: DataFrame, n: int, seed: int = 11) -> DataFrame:
    """The rows of ``rows(doc_id, text, ...)`` with the ``n`` least hashes of doc_id and text; no shuffle of texts.

    More than ``n`` only where the last of them repeats, so a ``limit(n)`` after it drops but equal rows.
    Hashes beyond four times the share of ``n`` are left out before they are sorted, so few move at any size.
    """
    key = F.xxhash64("doc_id", "text", F.lit(seed))
    low = under(key, 4 * n / max(1, rows.count()))
    last = rows.filter(low).select(key.alias("k")).orderBy("k").limit(n).agg(F.max("k").alias("k")).first()["k"]
    return rows.filter(low & (key <= F.lit(last))) if last is not None else rows.limit(0)
