"""Net sales to league members."""

from __future__ import annotations

from datetime import date
from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mascate.functions.calendar import DateWindow, first_of_month
from mascate.functions.keys import digits
from mascate.operators.ledger import net_ledger
from mascate.operators.members import member_since

# First entry date of a new member, and the global goal.
NEW_SINCE = date(2026, 6, 1)
GLOBAL_GOAL = Decimal("1600000")


def league_sales_by_seller(
    roster: DataFrame,
    orders: DataFrame,
    returns: DataFrame,
    sellers: DataFrame,
    as_of: date,
    start: date | None = None,
    end: date | None = None,
    new_since: date = NEW_SINCE,
    ordered: bool = True,
) -> DataFrame:
    """Net sales per seller to all roster members, and to those who entered since ``new_since``.

    The period is the month of ``as_of`` up to that day unless given. Facts are summed per customer
    and seller before the roster join. A seller number held by two sellers counts for both.
    """
    window = DateWindow.days(start or first_of_month(as_of), end or as_of)
    per_customer = (
        net_ledger(orders, returns, window)
        .groupBy("tax_id", "seller_no")
        .agg(F.sum("value").alias("value"))
        .withColumn("tax_digits", digits(F.col("tax_id")))
    )
    is_new = F.col("member_since") >= F.lit(new_since)
    per_number = (
        per_customer.join(member_since(roster), "tax_digits")
        .groupBy("seller_no")
        .agg(
            F.sum("value").alias("league"),
            F.sum(F.when(is_new, F.col("value")).otherwise(F.lit(0))).alias("new"),
        )
    )
    result = per_number.join(sellers, "seller_no").select(
        "seller_id",
        "seller_no",
        F.col("name").alias("seller_name"),
        F.round("league", 2).alias("league_sales"),
        F.round("new", 2).alias("new_member_sales"),
    )
    if ordered:
        result = result.orderBy(F.col("league_sales").desc(), F.col("seller_id").asc())
    return result


def league_goal_status(league_sales: DataFrame, goal: Decimal | int = GLOBAL_GOAL) -> DataFrame:
    """One row: the goal, what all sellers sold, whether it is reached and what is left."""
    zero = F.lit(Decimal("0.00"))
    target = F.lit(Decimal(str(goal)))
    return league_sales.agg(
        F.round(F.coalesce(F.sum("league_sales"), zero), 2).alias("value")
    ).select(
        target.alias("goal"),
        "value",
        (F.col("value") >= target).alias("reached"),
        F.greatest(zero, F.round(target - F.col("value"), 2)).alias("remaining"),
    )
