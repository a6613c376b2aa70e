"""Customer accounts, their parents and their groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mascate.functions.keys import digits, parent_tax_id14, phone_of, tax_id14, visible
from mascate.operators.dedupe import best_per_key, low_first


def customer_phone(blank_as_null: bool = False):
    """The phone column of a customer row."""
    return phone_of(F.col("area2"), F.col("phone2"), F.col("area1"), F.col("phone1"), blank_as_null)


def customer_directory(customers: DataFrame, blank_phone_as_null: bool = False) -> DataFrame:
    """One row per tax id (digits, not padded): parent flag, padded parent id, name, phone, status.

    Of several accounts with one tax id the lowest ``customer_id`` is taken.
    """
    accounts = customers.select(
        digits(F.col("tax_id")).alias("tax_digits"),
        (F.col("parent_id").isNull() | (F.col("customer_id") == F.col("parent_id"))).alias("is_parent"),
        parent_tax_id14(F.col("parent_tax_id"), F.col("tax_id")).alias("parent_tax_id14"),
        F.trim("name").alias("name"),
        customer_phone(blank_phone_as_null).alias("phone"),
        "status",
        "customer_id",
    )
    return best_per_key(accounts, ["tax_digits"], [low_first("customer_id")]).drop("customer_id")


def visible_customers(customers: DataFrame) -> DataFrame:
    """Customers whose status may be listed."""
    return customers.where(visible(F.col("status")))


def account_groups(customers: DataFrame) -> DataFrame:
    """Which raw tax ids belong to which raw parent tax id, over visible accounts.

    Together with :func:`target_groups` this is the link from a customer to all accounts of its
    parent. The two sides are kept apart on purpose: pairing each account with each other one of
    its group grows with the square of the group.
    """
    return (
        visible_customers(customers)
        .where(F.col("parent_tax_id").isNotNull())
        .select(F.col("parent_tax_id").alias("group_id"), F.col("tax_id").alias("account"))
        .distinct()
    )


def target_groups(targets: DataFrame, customers: DataFrame) -> DataFrame:
    """The group of each target tax id (column ``tax_id``), one row per padded target.

    The parent comes from the lowest visible account with that id. ``group_id`` is the raw parent
    id and NULL if there is none; ``parent_tax_id14`` then is the target itself. ``listed`` tells
    whether the group holds an account stored under exactly the target's id.
    """
    asked = targets.select(tax_id14(F.col("tax_id")).alias("target")).distinct()
    target = digits(F.col("tax_id"))
    per_group = (
        visible_customers(customers)
        .groupBy(target.alias("target"), F.col("parent_tax_id").alias("group_id"))
        .agg(
            F.min("customer_id").alias("customer_id"),
            F.max(F.col("tax_id") == target).alias("listed"),
        )
    )
    home = best_per_key(per_group, ["target"], [low_first("customer_id")]).drop("customer_id")
    return asked.join(home, "target", "left").select(
        "target",
        "group_id",
        tax_id14(F.coalesce("group_id", "target")).alias("parent_tax_id14"),
        (F.col("group_id").isNotNull() & F.coalesce("listed", F.lit(False))).alias("listed"),
    )
