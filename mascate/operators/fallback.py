"""Seller filters that give way when nothing passes them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_fallback(df: DataFrame, flag: str, whole: bool = False) -> DataFrame:
    """Rows whose ``flag`` is true; if the whole frame has none, every row.

    The test for "none" is a scalar subquery over the same frame. Spark reuses those of its
    shuffles that carry the same columns in both uses; a shuffle from which the test needs fewer
    columns is run a second time. With ``whole`` the test takes a hash of all columns along, so that all
    shuffles below are the same: right where facts are summed below, and columns are few.
    """
    found = F.max(flag)
    if whole:
        found = F.max(F.when(F.col(flag), F.xxhash64(*df.columns))).isNotNull()
    any_flagged = df.agg(F.coalesce(found, F.lit(False)).alias(flag)).scalar()
    return df.where(F.col(flag) | ~any_flagged).drop(flag)


def either(filtered: DataFrame, unfiltered: DataFrame) -> DataFrame:
    """``filtered`` if it has a row, else ``unfiltered``; both must have the same columns."""
    found = filtered.limit(1).agg(F.count("*").alias("found")).scalar()
    return filtered.unionByName(unfiltered.where(found == 0))
