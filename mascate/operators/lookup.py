"""Joins to a side with one row per key where a key may hold a large part of the other side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lookup(left: DataFrame, right: DataFrame, key: str, how: str = "left") -> DataFrame:
    """Join ``right`` by ``key`` so that Spark can divide the rows of a hot key (or NULL) on the left.

    At run time Spark splits a skewed join only if both sides were shuffled for that join. A right
    side that comes out of an aggregate by the key is already partitioned and would not be; with
    the key's hash as second join column it is, at the price of one shuffle of its few rows. If
    the right side is small enough to be broadcast, nothing changes.
    """
    mark, hashed = "_mark", F.xxhash64(key)
    while mark in (*left.columns, *right.columns):
        mark += "_"
    return left.withColumn(mark, hashed).join(right.withColumn(mark, hashed), [key, mark], how).drop(mark)
