"""Net purchases: orders minus returns."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mascate.functions.calendar import DateWindow, resolve_window
from mascate.functions.keys import digits
from mascate.operators.customers import account_groups, target_groups
from mascate.operators.lookup import lookup
from mascate.operators.owners import flag_owned, latest_owner

ZERO = "0.00"


def not_cancelled(cancelled: Column) -> Column:
    """Anything but ``S``; NULL and other letters count as valid."""
    return ~cancelled.eqNullSafe(F.lit("S"))


def never_cancelled(cancelled: Column) -> Column:
    """NULL or ``N`` only."""
    return F.coalesce(cancelled, F.lit("N")) == "N"


def net_ledger(
    orders: DataFrame,
    returns: DataFrame,
    window: DateWindow = DateWindow(),
    strict_returns: bool = True,
) -> DataFrame:
    """Orders (+) and returns (-) that are not cancelled: ``tax_id, date, seller_no, kind, value``.

    Returns must be cancelled NULL or ``N``; with ``strict_returns=False`` they follow the order rule.
    """
    amount = F.coalesce(F.col("total"), F.lit(ZERO).cast("decimal(10,2)"))

    def side(df: DataFrame, kind: str, valid: Column, value: Column) -> DataFrame:
        return df.where(window.holds(F.col("date")) & valid).select(
            "tax_id", "date", "seller_no", F.lit(kind).alias("kind"), value.alias("value")
        )

    returned = never_cancelled if strict_returns else not_cancelled
    return side(orders, "order", not_cancelled(F.col("cancelled")), amount).unionByName(
        side(returns, "return", returned(F.col("cancelled")), -amount)
    )


def net_purchases(
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
    grain: str = "month",
    seller_no: int | None = None,
    ordered: bool = True,
) -> DataFrame:
    """Net purchases per target tax id and month or day, over all accounts of the target's group.

    The target's own id counts even if its account is hidden or unknown. With ``seller_no`` only
    accounts ever owned by the seller count; a target for which that leaves nothing gets its
    unfiltered rows.

    Facts are summed once per account and period, then once per group. A target reads the sum of
    its group and, if the group lacks the target's own id, of a group that holds just that id. The
    work stays linear in the accounts: no pair of target and account is ever formed.
    """
    if grain not in ("month", "day"):
        raise ValueError(f"grain must be 'month' or 'day', got {grain!r}")
    window = resolve_window(as_of, start, end, month, months)
    period = F.trunc("date", "MM") if grain == "month" else F.col("date")
    net = (
        net_ledger(orders, returns, window)
        .groupBy(F.col("tax_id").alias("account"), period.alias("period"))
        .agg(F.sum("value").alias("value"))
    )
    return net_purchases_of(net, targets, customers, history, sellers, grain, seller_no, ordered)


def net_purchases_of(
    net: DataFrame,
    targets: DataFrame,
    customers: DataFrame,
    history: DataFrame,
    sellers: DataFrame,
    grain: str = "month",
    seller_no: int | None = None,
    ordered: bool = True,
) -> DataFrame:
    """:func:`net_purchases` of sums that are there already: ``account, period, value``, one row per pair."""
    layout = "yyyy-MM" if grain == "month" else "yyyy-MM-dd"
    asked = target_groups(targets, customers)
    owner = latest_owner(history, sellers).withColumnRenamed("tax_digits", "parent_tax_id14")
    group_source = F.concat(F.lit("group "), F.col("group_id"))
    own_source = F.concat(F.lit("own "), F.col("target"))
    # The owner joins one row per target here, not one per target and period later.
    sources = (
        lookup(asked, owner, "parent_tax_id14")
        .select(
            "target",
            "seller_no",
            "seller_name",
            F.explode(F.array(group_source, F.when(~F.col("listed"), own_source))).alias("source"),
        )
        .where(F.col("source").isNotNull())
    )
    links = (
        account_groups(customers)
        .join(asked.select("group_id").distinct(), "group_id", "left_semi")
        .select(group_source.alias("source"), "account")
        .unionByName(
            asked.where(~F.col("listed")).select(
                own_source.alias("source"), F.col("target").alias("account")
            )
        )
    )
    sums = [F.sum("value").alias("value")]
    if seller_no is None:
        per_account = links.join(net, "account")
    else:
        # Only accounts of the group can be the seller's; the target's own id is never forced in.
        flagged = flag_owned(
            links.withColumn("account_digits", digits(F.col("account"))),
            "account_digits",
            history,
            seller_no,
        )
        counts = F.col("owned") & F.col("source").startswith("group ")
        per_account = flagged.join(net, "account").withColumn(
            "owned_value", F.when(counts, F.col("value"))
        )
        sums.append(F.sum("owned_value").alias("owned_value"))
    per_source = per_account.groupBy("source", "period").agg(*sums)
    rows = (
        sources.join(per_source, "source")
        .groupBy("target", "period", "seller_no", "seller_name")
        .agg(*sums)
    )
    if seller_no is not None:
        # Owned sums are NULL where the seller owns none of the period's accounts. A target has
        # at most one row per period here, so the window stays small.
        owned = F.col("owned_value")
        rows = (
            rows.withColumn("found", F.count(owned).over(Window.partitionBy("target")) > 0)
            .where(owned.isNotNull() | ~F.col("found"))
            .withColumn("value", F.when(F.col("found"), owned).otherwise(F.col("value")))
        )

    result = rows.select(
        F.col("target").alias("tax_id"),
        F.date_format("period", layout).alias("label"),
        "period",
        F.round("value", 2).alias("total"),
        "seller_no",
        "seller_name",
    )
    return result.orderBy("tax_id", "period") if ordered else result
