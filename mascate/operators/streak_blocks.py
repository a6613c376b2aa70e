"""Runs on goal kept block by block: a new block extends them without a look at older purchases.

A block is a stretch of the goal calendar. The runs of two neighbouring blocks join into the runs of both
by one rule: a run that reaches the end of the older block and one that begins with the newer block are one
run. The rule is associative, so blocks may be joined in any grouping, and only a member's last run can
ever change: what has ended before the newest block is final.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mascate.operators.goals import goal_islands

_RUN = ("member_no", "first_period", "last_period", "length")


def block_runs(purchases: DataFrame, goals: DataFrame, first: date, last: date) -> DataFrame:
    """The runs within the goal periods from ``first`` to ``last``: ``member_no, first_period, last_period, length``.

    Only that block's purchases are read. ``purchases`` and ``goals`` are those of ``goals.goal_islands``.
    """
    inside = F.col("period").between(F.lit(first), F.lit(last))
    return goal_islands(purchases.where(inside), goals.where(inside), last).select(*_RUN)


def joined(older: DataFrame, newer: DataFrame, goals: DataFrame, first: date) -> DataFrame:
    """The runs of two neighbouring blocks, of which the newer one begins with ``first``.

    ``goals`` is the goal calendar; its last period before ``first`` and its first one from there on reach
    the driver. A member's rows meet only where a run touches the border: at most one on either side.
    """
    ends = goals.where(F.col("period").isNotNull()).agg(
        F.max(F.when(F.col("period") < F.lit(first), F.col("period"))).alias("end"),
        F.min(F.when(F.col("period") >= F.lit(first), F.col("period"))).alias("begin"),
    )
    end, begin = ends.first()
    if end is None or begin is None:
        return older.select(*_RUN).unionByName(newer.select(*_RUN))
    open_, leading = F.col("last_period") == F.lit(end), F.col("first_period") == F.lit(begin)
    left = older.where(open_).select("member_no", *[F.col(c).alias(f"_{c}") for c in _RUN[1:]])
    met = left.join(newer.where(leading).select(*_RUN), "member_no", "full").select(
        "member_no",
        F.coalesce("_first_period", "first_period").alias("first_period"),
        F.coalesce("last_period", "_last_period").alias("last_period"),
        (F.coalesce("_length", F.lit(0)) + F.coalesce("length", F.lit(0))).cast("int").alias("length"),
    )
    return met.unionByName(older.where(~open_).select(*_RUN)).unionByName(newer.where(~leading).select(*_RUN))


def with_current(runs: DataFrame, goals: DataFrame, last_period: date) -> DataFrame:
    """The runs as ``goals.goal_islands`` gives them: ``is_current`` tells those that reach the last goal period."""
    last = goals.where(F.col("period") <= F.lit(last_period)).agg(F.max("period")).first()[0]
    return runs.withColumn("is_current", F.coalesce(F.col("last_period") == F.lit(last), F.lit(False)))
