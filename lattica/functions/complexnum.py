"""Complex values as ``struct<re, im>``: scalar operations as Column functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructType


def is_complex(df: DataFrame, name: str) -> bool:
    """Whether a column holds complex values; every operator that takes values tells them apart by this."""
    return isinstance(df.schema[name].dataType, StructType)


def widen(c: Column, wide: bool) -> Column:
    """A value as a complex one; ``wide`` says that it is one already."""
    return c if wide else make(c, F.lit(0.0))


def size(c: Column, wide: bool) -> Column:
    """Absolute value."""
    return modulus(c) if wide else F.abs(c)


def size1(c: Column, wide: bool) -> Column:
    """Absolute value, of complex values the cheap one."""
    return modulus1(c) if wide else F.abs(c)


def times(c: Column, factor: Column, wide: bool) -> Column:
    """A value times a real factor."""
    return make(c["re"] * factor, c["im"] * factor) if wide else c * factor


def total(c: Column, wide: bool) -> Column:
    """Sum of a group."""
    return F.struct(F.sum(c["re"]).alias("re"), F.sum(c["im"]).alias("im")) if wide else F.sum(c)


def make(re: Column, im: Column) -> Column:
    return F.struct(re.cast("double").alias("re"), im.cast("double").alias("im"))


def add(a: Column, b: Column) -> Column:
    return make(a["re"] + b["re"], a["im"] + b["im"])


def subtract(a: Column, b: Column) -> Column:
    return make(a["re"] - b["re"], a["im"] - b["im"])


def multiply(a: Column, b: Column) -> Column:
    return make(a["re"] * b["re"] - a["im"] * b["im"], a["re"] * b["im"] + a["im"] * b["re"])


def conjugate(a: Column) -> Column:
    return make(a["re"], -a["im"])


def modulus(a: Column) -> Column:
    return F.hypot(a["re"], a["im"])


def modulus1(a: Column) -> Column:
    """|re| + |im|, a cheap stand-in for the modulus."""
    return F.abs(a["re"]) + F.abs(a["im"])


def divide(a: Column, b: Column) -> Column:
    """a / b scaled by the larger part of b, so that it overflows late; null for a zero divisor."""
    wide = F.abs(b["re"]) >= F.abs(b["im"])
    ratio = F.when(wide, F.try_divide(b["im"], b["re"])).otherwise(F.try_divide(b["re"], b["im"]))
    size = F.when(wide, b["re"] + b["im"] * ratio).otherwise(b["im"] + b["re"] * ratio)
    re = F.when(wide, a["re"] + a["im"] * ratio).otherwise(a["re"] * ratio + a["im"])
    im = F.when(wide, a["im"] - a["re"] * ratio).otherwise(a["im"] * ratio - a["re"])
    return F.when((b["re"] == 0) & (b["im"] == 0), F.lit(None)).otherwise(make(F.try_divide(re, size), F.try_divide(im, size)))
