"""What one snapshot of a table has that another has not."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INSERTED, DELETED, CHANGED = "inserted", "deleted", "changed"


def _digest(columns: list[str]) -> Column:
    """One short text for the values of a row; NULL is told from empty text, and columns from each other."""
    row = F.struct(*[F.col(f"`{c}`") for c in columns])
    return F.unhex(F.sha2(F.to_json(row, {"ignoreNullFields": "false"}), 256))


def difference(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``key``, ``change``, the names of changed ``columns``, and the row ``before`` and ``after``.

    A key of ``new`` alone is ``inserted``, one of ``old`` alone ``deleted``, one whose rows differ
    ``changed``; keys whose rows are equal are left out. Both snapshots have the same columns and types,
    and a key once; rows with a NULL key meet no other row, so each is inserted or deleted.

    Only keys and digests of all rows are shuffled and compared. Whole rows are fetched afterwards, of
    the keys that differ: the work on wide columns grows with the change, not with the table.
    """
    if [(f.name, f.dataType) for f in old.schema] != [(f.name, f.dataType) for f in new.schema]:
        raise ValueError("the snapshots differ in their columns")
    columns = [c for c in old.columns if c != key]

    def digests(df: DataFrame, name: str) -> DataFrame:
        return df.select(F.col(key).alias("key"), _digest(columns).alias(name))

    both = digests(old, "was").join(digests(new, "now"), "key", "full")
    change = F.when(F.col("was").isNull(), INSERTED).when(F.col("now").isNull(), DELETED).otherwise(CHANGED)
    differing = both.where(~F.col("was").eqNullSafe(F.col("now"))).select("key", change.alias("change"))

    def rows(df: DataFrame, name: str, kinds: list[str]) -> DataFrame:
        whole = df.select(F.col(key).alias("key"), F.struct("*").alias(name))
        wanted = differing.where(F.col("change").isin(kinds)).select(F.col("key").alias("wanted"), "change")
        # a NULL key is one side's alone
        found = whole.join(wanted.where("wanted IS NOT NULL"), F.col("key") == F.col("wanted"), "inner").drop("wanted")
        alone = whole.where(F.col("key").isNull()).withColumn("change", F.lit(kinds[0]))
        return found.unionByName(alone)

    before = rows(old, "before", [DELETED, CHANGED]).withColumnRenamed("change", "was")
    after = rows(new, "after", [INSERTED, CHANGED]).withColumnRenamed("change", "now")
    met = before.join(after, "key", "full")
    named = [F.when(~F.col(f"before.`{c}`").eqNullSafe(F.col(f"after.`{c}`")), F.lit(c)) for c in columns]
    kind = F.coalesce("was", "now")
    return met.select(
        F.col("key").alias(key),
        kind.alias("change"),
        F.when(kind == CHANGED, F.array_compact(F.array(*named))).alias("columns"),
        "before",
        "after",
    )


def applied(old: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """The new snapshot: ``old`` with the changes of :func:`difference`, in the columns of ``old``."""
    touched = changes.where((F.col("change") != INSERTED) & F.col(key).isNotNull()).select(key)
    lost = changes.where((F.col("change") == DELETED) & F.col(key).isNull()).limit(1).agg(F.count("*").alias("n")).scalar()
    kept = old.join(touched, key, "left_anti").where(F.col(key).isNotNull() | (lost == 0)).select(*old.columns)
    return kept.unionByName(changes.where(F.col("change") != DELETED).select("after.*"))


def touched_columns(changes: DataFrame) -> DataFrame:
    """How many rows each kind of change has, and of changed rows how many each column: ``change, column, rows``."""
    each = changes.select("change", F.explode_outer("columns").alias("column"))
    return each.groupBy("change", "column").agg(F.count("*").alias("rows"))
