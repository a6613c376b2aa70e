"""Month snapshots of the record-risk report: opened once, closed once, never rewritten.

The functions say which rows a month has; ``sources.tables.freeze_month`` stores them once.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mascate.functions.calendar import first_of_month
from mascate.operators.risk import record_risk_summary


def open_month(risk: DataFrame, month: date, opened: DataFrame | None = None) -> DataFrame:
    """The rows to append at the start of a month: nothing if ``opened`` already has the month."""
    rows = risk.select(
        F.lit(first_of_month(month)).alias("month"),
        "customer_id",
        "name",
        "seller_name",
        "store",
        "needed",
    )
    return rows if opened is None else _unless_present(rows, opened, month)


def close_month(
    opened: DataFrame, risk: DataFrame, month: date, closed: DataFrame | None = None
) -> DataFrame:
    """The final rows of a month: who was at risk at its start, what they bought until its end.

    Seller and store are those at the end of the month. Customers of the opening that the report
    lists no more keep their opening seller and store, with nothing realised.
    """
    ending = risk.select(
        "customer_id",
        F.lit(True).alias("listed"),
        F.col("seller_name").alias("end_seller"),
        F.col("store").alias("end_store"),
        F.col("realised").alias("end_realised"),
    )
    listed = F.col("listed").isNotNull()
    realised = F.coalesce("end_realised", F.lit(0).cast(risk.schema["realised"].dataType))
    rows = (
        opened.where(F.col("month") == F.lit(first_of_month(month)))
        .join(ending, "customer_id", "left")
        .select(
            "month",
            "customer_id",
            "name",
            F.when(listed, F.col("end_seller")).otherwise(F.col("seller_name")).alias("seller_name"),
            F.when(listed, F.col("end_store")).otherwise(F.col("store")).alias("store"),
            "needed",
            realised.alias("realised"),
            (realised >= F.col("needed")).alias("reached"),
        )
    )
    return rows if closed is None else _unless_present(rows, closed, month)


def current_month(opened: DataFrame, risk: DataFrame, month: date) -> DataFrame:
    """The opened month as it stands today: the customers of its start with what they bought since."""
    return close_month(opened, risk, month)


def month_groups(rows: DataFrame) -> DataFrame:
    """The customers of one month, of :func:`current_month` or closed, per seller, per store and in all."""
    return record_risk_summary(rows)


def oldest_open_month(opened_months: DataFrame, closed_months: DataFrame) -> date | None:
    """The first month (column ``month``) that is opened and not closed; one date reaches the driver."""
    left = opened_months.select("month").join(closed_months.select("month"), "month", "left_anti")
    return left.agg(F.min("month")).first()[0]


def _unless_present(rows: DataFrame, history: DataFrame, month: date) -> DataFrame:
    present = (
        history.where(F.col("month") == F.lit(first_of_month(month)))
        .limit(1)
        .agg(F.count("*").alias("present"))
        .scalar()
    )
    return rows.where(present == 0)


def history_of(
    closed: DataFrame,
    month: date | None = None,
    seller_name: str | None = None,
    store: int | None = None,
) -> DataFrame:
    """Closed months, filtered by month, seller or store where given."""
    rows = closed
    if month is not None:
        rows = rows.where(F.col("month") == F.lit(first_of_month(month)))
    if seller_name:
        rows = rows.where(F.col("seller_name") == seller_name.strip())
    if store is not None:
        rows = rows.where(F.col("store") == int(store))
    return rows
