"""Records of an account's or customer's month that can be merged, and the reports from them.

A record holds sums, counts and the newest line of a month. Two records of one month, such as what is
stored and what came in late, merge into the record of all their rows, so that a report over months reads
records instead of facts. ``sources.month_store`` keeps them.
"""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mascate.functions.calendar import DateWindow, add_months, first_of_month
from mascate.operators.ledger import ZERO, net_purchases_of, never_cancelled, not_cancelled, resolve_window
from mascate.operators.newest import SHOWN, line_number, with_newest
from mascate.operators.risk import active_of, active_window, deactivation_of, record_risk_of, record_window

_MONEY = "decimal(38,6)"
_SUMS = ("sold", "sold_lines", "returned", "returned_lines", "returned_any", "returned_any_lines")


# ---------------------------------------------------------------- sales lines


def line_records(sales_lines: DataFrame) -> DataFrame:
    """Per customer and month: value, lines, and the newest line's number and texts."""
    lines = sales_lines.where(F.col("customer_id").isNotNull() & F.col("date").isNotNull()).select(
        "customer_id",
        F.trunc("date", "MM").alias("month"),
        F.col("signed_value").cast(_MONEY).alias("value"),
        F.lit(1).cast("long").alias("lines"),
        line_number(sales_lines).alias("newest"),
        *SHOWN,
    )
    return merged_lines(lines)


def merged_lines(records: DataFrame) -> DataFrame:
    """One record for each customer and month; also of single lines in that shape."""
    sums = records.groupBy("customer_id", "month").agg(
        F.sum("value").cast(_MONEY).alias("value"), F.sum("lines").alias("lines"), F.max("newest").alias("newest")
    )
    shown = with_newest(sums, records, "customer_id")
    return shown.select("customer_id", "month", "value", "lines", "newest", *[F.col(f"last.{c}").alias(c) for c in SHOWN])


def _in_months(records: DataFrame, window: DateWindow) -> DataFrame:
    return records.where(window.holds(F.col("month"))).withColumnRenamed("month", "day")


def active_customers(
    records: DataFrame, customers: DataFrame, history: DataFrame, sellers: DataFrame, as_of: date, ordered: bool = True
) -> DataFrame:
    """``risk.active_customers`` from :func:`line_records`; its window is six whole months."""
    return active_of(_in_months(records, active_window(as_of)), customers, history, sellers, ordered)


def record_risk(records: DataFrame, history: DataFrame, sellers: DataFrame, month: date, **options) -> DataFrame:
    """``risk.record_risk`` from :func:`line_records`; its window is seven whole months."""
    return record_risk_of(_in_months(records, record_window(month)), history, sellers, month, **options)


# ---------------------------------------------------------------- orders and returns


def _movements(orders: DataFrame, returns: DataFrame, day: Column) -> DataFrame:
    """Each valid order and return as a record of its day.

    A return counts in ``returned`` by the strict rule (cancelled NULL or ``N``), in ``returned_any`` by
    the order rule; the counts tell a sum of zero from no row.
    """
    amount = F.coalesce(F.col("total"), F.lit(ZERO).cast("decimal(10,2)")).cast(_MONEY)
    cancelled, none = F.col("cancelled"), F.lit(0).cast(_MONEY)
    one = lambda flag: F.when(flag, F.lit(1)).otherwise(F.lit(0)).cast("long")

    def rows(df: DataFrame, sold: Column, strict: Column, loose: Column) -> DataFrame:
        parts = [(sold, "sold"), (strict, "returned"), (loose, "returned_any")]
        fields = []
        for flag, name in parts:
            fields += [F.when(flag, amount).otherwise(none).alias(name), one(flag).alias(f"{name}_lines")]
        return df.where(F.col("date").isNotNull() & (sold | strict | loose)).select("tax_id", day.alias("day"), *fields)

    no = F.lit(False)
    return rows(orders, not_cancelled(cancelled), no, no).unionByName(
        rows(returns, no, never_cancelled(cancelled), not_cancelled(cancelled))
    )


def movement_records(orders: DataFrame, returns: DataFrame) -> DataFrame:
    """Per tax id and month the sums and counts of orders and returns that are not cancelled."""
    return merged_movements(_movements(orders, returns, F.trunc("date", "MM")).withColumnRenamed("day", "month"))


def merged_movements(records: DataFrame) -> DataFrame:
    """One record for each tax id and month."""
    sums = [F.sum(c).cast("long" if c.endswith("_lines") else _MONEY).alias(c) for c in _SUMS]
    return records.groupBy("tax_id", "month").agg(*sums)


def whole_months(window: DateWindow) -> tuple[DateWindow, list[DateWindow]]:
    """The whole months of a window, and the days before and after them."""
    start, stop, edges = window.start, window.stop, []
    if start is not None and start != first_of_month(start):
        start = add_months(start, 1)
    if stop is not None:
        stop = first_of_month(stop)
    if start is not None and stop is not None and start >= stop:
        return DateWindow(start, start), [window]
    if window.start != start:
        edges.append(DateWindow(window.start, start))
    if window.stop != stop:
        edges.append(DateWindow(stop, window.stop))
    return DateWindow(start, stop), edges


def movements_of(records: DataFrame, orders: DataFrame, returns: DataFrame, window: DateWindow) -> DataFrame:
    """The movements of a window: whole months from the records, what is left of other months from the facts."""
    months, edges = whole_months(window)
    rows = _in_months(records, months).select("tax_id", "day", *_SUMS)
    for edge in edges:
        inside = edge.holds(F.col("date"))
        rows = rows.unionByName(_movements(orders.where(inside), returns.where(inside), F.col("date")))
    return rows


def net_purchases(
    records: DataFrame,
    targets: DataFrame,
    customers: DataFrame,
    orders: DataFrame,
    returns: DataFrame,
    history: DataFrame,
    sellers: DataFrame,
    as_of: date,
    start: date | None = None,
    end: date | None = None,
    month: str | None = None,
    months: int | None = None,
    seller_no: int | None = None,
    ordered: bool = True,
) -> DataFrame:
    """``ledger.net_purchases`` by month from :func:`movement_records`; facts are read for broken months only."""
    rows = movements_of(records, orders, returns, resolve_window(as_of, start, end, month, months))
    net = (
        rows.where(F.col("sold_lines") + F.col("returned_lines") > 0)
        .groupBy(F.col("tax_id").alias("account"), F.trunc("day", "MM").alias("period"))
        .agg(F.sum(F.col("sold") - F.col("returned")).cast(_MONEY).alias("value"))
    )
    return net_purchases_of(net, targets, customers, history, sellers, "month", seller_no, ordered)


def deactivation_risk(
    records: DataFrame,
    orders: DataFrame,
    returns: DataFrame,
    customers: DataFrame,
    history: DataFrame,
    sellers: DataFrame,
    as_of: date,
    net_current_month: bool = False,
    **options,
) -> DataFrame:
    """``risk.deactivation_risk`` from :func:`movement_records`; facts are read for the days of this month only."""
    window = DateWindow(add_months(as_of, -2), as_of + timedelta(days=1))
    sold, returned = F.col("sold"), F.col("returned_any")
    current = sold - returned if net_current_month else sold + returned
    now = F.col("day") >= F.lit(first_of_month(as_of))
    per_account = (
        movements_of(records, orders, returns, window)
        .where(F.col("sold_lines") + F.col("returned_any_lines") > 0)
        .groupBy("tax_id")
        .agg(
            F.sum(sold - returned).cast(_MONEY).alias("total"),
            F.sum(F.when(now, current).otherwise(F.lit(0))).cast(_MONEY).alias("month"),
        )
    )
    return deactivation_of(per_account, customers, history, sellers, **options)
