"""Which seller owns a customer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from mascate.functions.keys import digits
from mascate.operators.dedupe import best_per_key, low_first
from mascate.operators.lookup import lookup


def sellers_by_number(sellers: DataFrame) -> DataFrame:
    """One seller per seller number: the lowest ``seller_id``."""
    return best_per_key(sellers, ["seller_no"], [low_first("seller_id")])


# Room for a seller number, and what lifts the smallest one above 0, which stands for none.
_ROOM, _LIFT = 10**11, 2**31 + 1


def _in_one_number(since: Column, seller_no: Column) -> Column:
    """Time and seller in one number that sorts like both, NULLs lowest.

    The largest of a number is kept by a hash aggregate; that of a struct makes Spark sort the
    history on the map side.
    """
    time = F.coalesce(F.unix_micros(since.cast("timestamp")), F.lit(-(2**63))).cast("decimal(20,0)")
    seller = F.coalesce(seller_no.cast("long") + _LIFT, F.lit(0)).cast("decimal(11,0)")
    return (time * F.lit(_ROOM).cast("decimal(12,0)") + seller).cast("decimal(38,0)")


def _seller_of(number: Column, kind: DataType) -> Column:
    seller = F.pmod(number, F.lit(_ROOM).cast("decimal(12,0)")).cast("long")
    return F.when(seller > 0, seller - _LIFT).cast(kind)


def latest_owner(history: DataFrame, sellers: DataFrame) -> DataFrame:
    """The newest owning seller per tax id (digits): ``tax_digits, seller_no, seller_name``.

    An unknown time counts as oldest; equal times go to the highest seller number. The history is
    reduced to one row per tax id before it meets the sellers.
    """
    newest = (
        history.groupBy(digits(F.col("tax_id")).alias("tax_digits"))
        .agg(F.max(_in_one_number(F.col("since"), F.col("seller_no"))).alias("newest"))
        .select("tax_digits", _seller_of(F.col("newest"), history.schema["seller_no"].dataType).alias("seller_no"))
    )
    names = sellers_by_number(sellers).select("seller_no", F.trim("name").alias("seller_name"))
    return lookup(newest, names, "seller_no").select("tax_digits", "seller_no", "seller_name")


def owned_ids(history: DataFrame, seller_no: int) -> DataFrame:
    """The distinct tax ids (digits) the seller owns now or owned at any time."""
    return (
        history.where(F.col("seller_no") == seller_no)
        .select(digits(F.col("tax_id")).alias("tax_digits"))
        .where(F.col("tax_digits").isNotNull())
        .distinct()
    )


def owned_by_seller(df: DataFrame, key: str, history: DataFrame, seller_no: int) -> DataFrame:
    """Rows whose ``key`` (digits of a tax id) was ever owned by the seller."""
    owned = owned_ids(history, seller_no).withColumnRenamed("tax_digits", key)
    return lookup(df, owned, key, "left_semi")


def flag_owned(
    df: DataFrame, key: str, history: DataFrame, seller_no: int | None, flag: str = "owned"
) -> DataFrame:
    """All rows, with a flag that tells the rows :func:`owned_by_seller` would keep."""
    if seller_no is None:
        return df.withColumn(flag, F.lit(True))
    owned = owned_ids(history, seller_no).select(
        F.col("tax_digits").alias(key), F.lit(True).alias(flag)
    )
    return lookup(df, owned, key).withColumn(flag, F.coalesce(flag, F.lit(False)))


def link_users_to_sellers(users: DataFrame, sellers: DataFrame) -> DataFrame:
    """Users with the seller of their number, one seller at most; users without one stay."""
    linked = sellers_by_number(sellers).select(
        "seller_no",
        "seller_id",
        F.col("name").alias("seller_name"),
        F.col("store").alias("seller_store"),
    )
    return lookup(users.drop("password_md5"), linked, "seller_no")
