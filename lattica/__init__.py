"""Lattica: sparse linear algebra as Spark DataFrames."""

__version__ = "0.1.0"
