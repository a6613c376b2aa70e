"""Customers about to lose their account: too little bought, and how they recover."""

from __future__ import annotations

from datetime import date
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mascate.functions.calendar import DateWindow, add_months, first_of_month
from mascate.functions.keys import digits, visible
from mascate.operators.customers import customer_directory, customer_phone
from mascate.operators.dedupe import best_per_key
from mascate.operators.fallback import with_fallback
from mascate.operators.ledger import net_ledger
from mascate.operators.lookup import lookup
from mascate.operators.newest import SHOWN, line_number, with_newest
from mascate.operators.owners import flag_owned, latest_owner

# The least purchase volume and the group name of rows without one.
MINIMUM = Decimal("3200")
NO_GROUP = "(sem info)"


def _money(value: Decimal | int | str) -> Column:
    return F.lit(Decimal(str(value)))


def deactivation_risk(
    orders: DataFrame,
    returns: DataFrame,
    customers: DataFrame,
    history: DataFrame,
    sellers: DataFrame,
    as_of: date,
    seller_no: int | None = None,
    minimum: Decimal | int = MINIMUM,
    net_current_month: bool = False,
    ordered: bool = True,
) -> DataFrame:
    """Parents whose net purchases of this and the two months before stay under the minimum.

    The current-month figure adds returns, as the report always did; ``net_current_month``
    subtracts them. A seller filter works on the accounts before they are summed, and gives way if
    no parent is left.
    """
    this_month = first_of_month(as_of)
    window = DateWindow.days(add_months(as_of, -2), as_of)
    current = F.col("value")
    if not net_current_month:
        current = F.when(F.col("kind") == "return", -current).otherwise(current)

    # One row per account before any join: an account with a large share of the facts is already
    # summed on the map side. Digits are taken of the few summed rows, not of every fact.
    per_account = (
        net_ledger(orders, returns, window, strict_returns=False)
        .groupBy("tax_id")
        .agg(
            F.sum("value").alias("total"),
            F.sum(
                F.when(F.col("date") >= F.lit(this_month), current).otherwise(F.lit(0))
            ).alias("month"),
        )
    )
    return deactivation_of(per_account, customers, history, sellers, seller_no, minimum, ordered)


def deactivation_of(
    per_account: DataFrame,
    customers: DataFrame,
    history: DataFrame,
    sellers: DataFrame,
    seller_no: int | None = None,
    minimum: Decimal | int = MINIMUM,
    ordered: bool = True,
) -> DataFrame:
    """:func:`deactivation_risk` of sums that are there already: ``tax_id, total, month``, one row per id."""
    per_account = per_account.withColumn("tax_digits", digits(F.col("tax_id")))
    directory = customer_directory(customers)
    parents = directory.select("tax_digits", "parent_tax_id14")
    per_account = flag_owned(per_account, "tax_digits", history, seller_no).join(
        parents, "tax_digits", "left"
    )

    def sums(flag: Column) -> list[Column]:
        return [
            F.sum(F.when(flag, F.col("total"))).alias("total"),
            F.sum(F.when(flag, F.col("month"))).alias("month"),
        ]

    key = F.coalesce("parent_tax_id14", "tax_digits").alias("parent_tax_id")
    if seller_no is None:
        agg = per_account.groupBy(key).agg(*sums(F.lit(True))).withColumn("owned", F.lit(True))
    else:
        # Both answers in one pass: the sums over the seller's accounts and over all accounts.
        both = per_account.groupBy(key).agg(
            F.struct(*sums(F.col("owned"))).alias("mine"),
            F.struct(*sums(F.lit(True))).alias("all"),
            F.max("owned").alias("any_owned"),
        )
        mine = F.struct("mine.total", "mine.month", F.lit(True).alias("owned"))
        every = F.struct("all.total", "all.month", F.lit(False).alias("owned"))
        answers = F.when(F.col("any_owned"), F.array(mine, every)).otherwise(F.array(every))
        agg = both.select("parent_tax_id", F.inline(answers))

    listed = directory.select(F.col("tax_digits").alias("parent_tax_id"), "name", "phone", "status")
    owner = latest_owner(history, sellers).withColumnRenamed("tax_digits", "parent_tax_id")
    total = F.round("total", 2)
    at_risk = (
        agg.where(F.col("total") < _money(minimum))
        .join(listed, "parent_tax_id", "left")
        .where(visible(F.col("status")))
    )
    if seller_no is None:
        at_risk = at_risk.drop("owned")
    else:
        at_risk = with_fallback(at_risk, "owned")
    result = at_risk.join(owner, "parent_tax_id", "left").select(
        "parent_tax_id",
        "name",
        "phone",
        F.lit(True).alias("is_parent"),
        "seller_no",
        "seller_name",
        total.alias("total_3m"),
        F.round("month", 2).alias("current_month"),
        (F.col("month") == 0).alias("zero_month"),
        (_money(minimum) - total).alias("missing"),
    )
    if ordered:
        result = result.orderBy(
            F.col("zero_month").desc_nulls_first(),
            F.col("missing").desc_nulls_first(),
            F.col("parent_tax_id").asc_nulls_last(),
        )
    return result


def line_facts(sales_lines: DataFrame, window: DateWindow) -> DataFrame:
    """The lines of a window in the shape of month records: ``day``, ``value``, ``lines`` and ``newest``."""
    return sales_lines.where(window.holds(F.col("date")) & F.col("customer_id").isNotNull()).select(
        "customer_id",
        F.col("date").alias("day"),
        F.col("signed_value").alias("value"),
        F.lit(1).cast("long").alias("lines"),
        line_number(sales_lines).alias("newest"),
        *SHOWN,
    )


def _shown_seller(history: DataFrame, sellers: DataFrame) -> DataFrame:
    return latest_owner(history, sellers).select(
        "tax_digits", F.trim("seller_name").alias("owner_name")
    )


def active_customers(
    sales_lines: DataFrame,
    customers: DataFrame,
    history: DataFrame,
    sellers: DataFrame,
    as_of: date,
    ordered: bool = True,
) -> DataFrame:
    """Customers with a net of at least 1 over the six closed months before ``as_of``."""
    lines = line_facts(sales_lines, active_window(as_of))
    return active_of(lines, customers, history, sellers, ordered)


def active_window(as_of: date) -> DateWindow:
    """The six closed months before ``as_of``."""
    return DateWindow(add_months(as_of, -6), first_of_month(as_of))


def active_of(
    lines: DataFrame, customers: DataFrame, history: DataFrame, sellers: DataFrame, ordered: bool = True
) -> DataFrame:
    """:func:`active_customers` of :func:`line_facts`, or of month records, of the window."""
    active = (
        with_newest(
            lines.groupBy("customer_id")
            .agg(F.sum("value").alias("net"), F.max("newest").alias("newest"))
            .where(F.col("net") >= 1),
            lines,
            "customer_id",
        )
        .where(visible(F.col("last.status")))
        .select("customer_id", "last.*")
        .withColumn("tax_digits", digits(F.col("tax_id")))
    )
    phones = best_per_key(
        customers.select("customer_id", "tax_id", customer_phone().alias("phone")),
        ["customer_id"],
        ["tax_id"],
    ).drop("tax_id")
    result = (
        lookup(
            active.join(phones, "customer_id", "left"),
            _shown_seller(history, sellers),
            "tax_digits",
        )
        .select(
            "customer_id",
            F.trim("customer_name").alias("name"),
            "tax_id",
            F.coalesce("phone", F.lit(" ")).alias("phone"),
            "status",
            F.coalesce("owner_name", F.trim("seller_name")).alias("seller_name"),
        )
    )
    return result.orderBy("customer_id") if ordered else result


def record_risk(
    sales_lines: DataFrame,
    history: DataFrame,
    sellers: DataFrame,
    month: date,
    minimum: Decimal | int = MINIMUM,
    seller_name: str | None = None,
    store: int | None = None,
    ordered: bool = True,
) -> DataFrame:
    """Customers under the minimum over the two closed months before ``month``, and their recovery.

    One pass over the lines gives the closed, current and six-month sums and the newest line's
    number; the texts of that line are fetched for the customers at risk only.
    """
    lines = line_facts(sales_lines, record_window(month))
    return record_risk_of(lines, history, sellers, month, minimum, seller_name, store, ordered)


def record_window(month: date) -> DateWindow:
    """The month and the six before it."""
    m = first_of_month(month)
    return DateWindow(add_months(m, -6), add_months(m, 1))


def record_risk_of(
    lines: DataFrame,
    history: DataFrame,
    sellers: DataFrame,
    month: date,
    minimum: Decimal | int = MINIMUM,
    seller_name: str | None = None,
    store: int | None = None,
    ordered: bool = True,
) -> DataFrame:
    """:func:`record_risk` of :func:`line_facts`, or of month records, of the window."""
    m = first_of_month(month)
    day, value = F.col("day"), F.col("value")
    closed = (day >= F.lit(add_months(m, -2))) & (day < F.lit(m))
    zero = F.lit(0)
    under = (
        lines.groupBy("customer_id")
        .agg(
            F.sum(F.when(closed, F.col("lines"))).alias("closed_lines"),
            F.sum(F.when(closed, value)).alias("closed"),
            F.coalesce(F.sum(F.when(day >= F.lit(m), value)), zero).alias("realised"),
            F.coalesce(F.sum(F.when(day < F.lit(m), value)), zero).alias("bought_6m"),
            F.max("newest").alias("newest"),
        )
        .where((F.col("closed_lines") > 0) & (F.col("closed") < _money(minimum)))
    )
    per_customer = (
        with_newest(under, lines, "customer_id")
        .where(visible(F.col("last.status")))
        .withColumn("tax_digits", digits(F.col("last.tax_id")))
    )
    result = lookup(per_customer, _shown_seller(history, sellers), "tax_digits").select(
        "customer_id",
        F.trim("last.customer_name").alias("name"),
        F.coalesce("owner_name", F.trim("last.seller_name")).alias("seller_name"),
        F.col("last.store").alias("store"),
        (_money(minimum) - F.col("closed")).alias("needed"),
        "realised",
        ((F.col("closed") + F.col("realised")) >= _money(minimum)).alias("reached"),
        "bought_6m",
    )
    if seller_name:
        result = result.where(F.col("seller_name") == seller_name.strip())
    if store is not None:
        result = result.where(F.col("store") == int(store))
    return result.orderBy("customer_id") if ordered else result


def record_risk_summary(risk: DataFrame) -> DataFrame:
    """Totals of :func:`record_risk` per seller, per store and overall; an empty report has zeros."""
    named = risk.select(
        F.coalesce("seller_name", F.lit(NO_GROUP)).alias("seller"),
        F.coalesce(F.col("store").cast("string"), F.lit(NO_GROUP)).alias("shop"),
        "reached",
        "needed",
        "realised",
    )
    by = F.grouping_id()
    groups = (
        named.groupingSets([["seller"], ["shop"]], "seller", "shop")
        .agg(
            by.alias("by"),
            F.count("*").alias("customers"),
            F.count_if("reached").alias("reached"),
            F.coalesce(F.sum("needed"), F.lit(0)).alias("needed"),
            F.coalesce(F.sum("realised"), F.lit(0)).alias("realised"),
        )
        .select(
            F.when(F.col("by") == 1, "seller").otherwise("store").alias("grouped_by"),
            F.coalesce("seller", "shop").alias("group_name"),
            "customers",
            "reached",
            "needed",
            "realised",
        )
    )


    total = groups.where(F.col("grouped_by") == "seller").agg(
        F.lit("total").alias("grouped_by"),
        F.lit("").alias("group_name"),
        *[F.coalesce(F.sum(c), F.lit(0)).cast(groups.schema[c].dataType).alias(c) for c in groups.columns[2:]],
    )
    return groups.unionByName(total)


def record_risk_report(risk: DataFrame) -> dict[str, DataFrame]:
    """The report as named frames: totals, by seller, by store and the customers.

    Each frame is lazy; a caller that shows all of them may persist ``risk`` first.
    """
    summary = record_risk_summary(risk)

    def part(kind: str) -> DataFrame:
        return summary.where(F.col("grouped_by") == kind).drop("grouped_by")

    return {
        "summary": part("total").drop("group_name"),
        "by_seller": part("seller"),
        "by_store": part("store"),
        "customers": risk,
    }
