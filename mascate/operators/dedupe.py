"""Best row per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def low_first(number: str) -> Column:
    """Ranks a whole number from low to high; NULL comes last."""
    return F.bitwise_not(F.col(number))


def best_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """One row per key: the highest in ``order``, NULL last; remaining ties go by the other columns.

    This is one aggregate with a partial step before the shuffle, so a key that holds a large part
    of the rows leaves each map task as a single row. Equal input gives equal output in any order.
    """
    rank = [c if isinstance(c, str) else c.alias(f"_{i}") for i, c in enumerate(order)]
    rest = [c for c in df.columns if c not in (*keys, *(r for r in rank if isinstance(r, str)))]
    best = df.groupBy(*keys).agg(F.max(F.struct(*rank, *rest)).alias("_best"))
    return best.select(*[F.col(c if c in keys else f"_best.{c}").alias(c) for c in df.columns])
