"""Reports on few targets: tables and facts are cut to the asked groups before anything is summed.

The reports as such sum every account once, which is right for many targets and wasteful for ten. Here the
ids that matter are sought first, in the customers only, and kept as a small table; then customers, owners
and facts are cut to them by semi-joins below the first aggregate. As the table's true size is known, Spark
broadcasts it if it is small enough, and the facts are filtered as they are scanned, without a shuffle.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mascate.functions.keys import digits, parent_tax_id14, tax_id14, tax_id14_uncut
from mascate.operators import ledger, members
from mascate.operators.customers import visible_customers
from mascate.operators.owners import latest_owner
from mascate.sources.shared import kept

#: The most ids to which tables are cut; with more, the reports sum every account.
FEW = 100_000


def _only(df: DataFrame, key: Column, ids: DataFrame) -> DataFrame:
    """The rows whose ``key`` is among ``ids`` (column ``id``); all columns, in their order."""
    return df.withColumn("_id", key).join(ids.withColumnRenamed("id", "_id"), "_id", "left_semi").select(*df.columns)


def _ids(*columns: DataFrame) -> DataFrame:
    """One table of the distinct, known ids of several one-column frames."""
    every = columns[0].toDF("id")
    for more in columns[1:]:
        every = every.unionByName(more.toDF("id"))
    return kept(every.where(F.col("id").isNotNull()).distinct(), "ids")


def _few(ids: DataFrame, most: int) -> bool:
    return ids.limit(most + 1).count() <= most


def net_purchases(
    targets: DataFrame,
    customers: DataFrame,
    orders: DataFrame,
    returns: DataFrame,
    history: DataFrame,
    sellers: DataFrame,
    as_of: date,
    most: int = FEW,
    **options,
) -> DataFrame:
    """``ledger.net_purchases`` for few targets; with more than ``most``, or of more accounts, just that.

    Small jobs over targets and customers run at once, to know the ids.
    """
    asked = _ids(targets.select(tax_id14(F.col("tax_id"))))
    if _few(asked, most):
        homes = _only(visible_customers(customers), digits(F.col("tax_id")), asked)
        groups = _ids(homes.select("parent_tax_id"))
        accounts = _only(visible_customers(customers), F.col("parent_tax_id"), groups).select("tax_id")
        ids = _ids(accounts, asked)
        if _few(ids, most):
            customers = _only(customers, F.col("tax_id"), _ids(homes.select("tax_id"), accounts))
            owners = _ids(ids.select(digits(F.col("id"))), groups.select(tax_id14(F.col("id"))), asked)
            history = _only(history, digits(F.col("tax_id")), owners)
            orders, returns = (_only(facts, F.col("tax_id"), ids) for facts in (orders, returns))
    return ledger.net_purchases(targets, customers, orders, returns, history, sellers, as_of, **options)


def member_profile(
    targets: DataFrame, customers: DataFrame, roster: DataFrame, details: DataFrame, most: int = FEW
) -> DataFrame:
    """``members.member_profile`` for few targets; with more than ``most``, or of more accounts, just that."""
    asked = _ids(targets.select(tax_id14_uncut(F.col("tax_id"))))
    if _few(asked, most):
        group = parent_tax_id14(F.col("parent_tax_id"), F.col("tax_id"))
        groups = _ids(_only(customers, tax_id14(F.col("tax_id")), asked).select(group))
        inside = _only(customers, group, groups)
        ids = _ids(inside.select(tax_id14(F.col("tax_id"))), asked)
        if _few(ids, most):
            customers = inside
            roster, details = (_only(df, tax_id14(F.col("tax_id")), ids) for df in (roster, details))
    return members.member_profile(targets, customers, roster, details)


def owners_of(targets: DataFrame, history: DataFrame, sellers: DataFrame, most: int = FEW) -> DataFrame:
    """``owners.latest_owner`` of few targets (column ``tax_id``); with more than ``most`` a semi-join afterwards."""
    asked = _ids(targets.select(digits(F.col("tax_id"))))
    if _few(asked, most):
        return latest_owner(_only(history, digits(F.col("tax_id")), asked), sellers)
    return _only(latest_owner(history, sellers), F.col("tax_digits"), asked)
