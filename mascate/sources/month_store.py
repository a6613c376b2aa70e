"""A store of month records to which late rows are added: only the months that they touch are written anew.

A batch is merged with what is stored of its months, written into a folder of its own, and committed by
entries that name that folder for each of the months. Readers take a month from the folder that the latest
entry names; other months keep their files. Nothing is ever written in place, so a run that breaks leaves
no trace, a batch that is added again changes nothing, and a reader sees a batch as a whole or not at all.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mascate.functions.calendar import DateWindow, first_of_month
from mascate.sources.shared import append_entry, entries, first_entries

_ENTRY = "sequence BIGINT, run STRING, batch STRING, month DATE"


@dataclass(frozen=True)
class Pending:
    """A batch that is written and not yet committed: the number of its commit, its folder and its months."""

    sequence: int
    run: str
    batch: str
    months: tuple[date, ...]


def _entries(spark: SparkSession, root: str) -> DataFrame:
    return first_entries(entries(spark, root, _ENTRY), "sequence")


def _current(spark: SparkSession, root: str) -> dict[date, str]:
    """The run that holds each month; a row for each month of the calendar reaches the driver."""
    newest = F.max_by("run", "sequence").alias("run")
    rows = _entries(spark, root).where(F.col("month").isNotNull()).groupBy("month").agg(newest).collect()
    return {row["month"]: row["run"] for row in rows}


def stored_months(spark: SparkSession, root: str) -> DataFrame:
    """The months of the store, with the run that wrote them last."""
    return spark.createDataFrame(sorted(_current(spark, root).items()), "month DATE, run STRING")


def _rows(spark: SparkSession, root: str, runs: dict[date, str]) -> DataFrame:
    base = f"{root.rstrip('/')}/rows"
    paths = [f"{base}/run={run}/month={month.isoformat()}" for month, run in sorted(runs.items())]
    rows = spark.read.option("basePath", base).parquet(*paths).drop("run")
    return rows.withColumn("month", F.col("month").cast("date"))


def prepare(records: DataFrame, root: str, merge: Callable[[DataFrame], DataFrame], batch: str) -> Pending | None:
    """Write a batch merged with the stored records of its months; None if the batch is in the store.

    ``records`` have a column ``month`` (its first day) and are merged among themselves; ``merge``
    makes one record of several.
    """
    spark = records.sparkSession
    known = _entries(spark, root)
    if known.where(F.col("batch") == batch).limit(1).count():
        return None
    sequence = 1 + (known.agg(F.max("sequence")).first()[0] or 0)
    run = str(uuid.uuid4())
    # a row for each month of the calendar
    months = tuple(sorted(row[0] for row in records.select("month").distinct().collect()))
    current = _current(spark, root)
    touched = {month: current[month] for month in months if month in current}
    if touched:
        records = merge(records.unionByName(_rows(spark, root, touched).select(*records.columns)))
    records.hint("rebalance", F.col("month")).write.partitionBy("month").parquet(f"{root.rstrip('/')}/rows/run={run}")
    return Pending(sequence, run, batch, months)


def commit(spark: SparkSession, root: str, pending: Pending) -> bool:
    """Enter a prepared batch; False if another run has entered its number first, and nothing has changed."""
    rows = [(pending.sequence, pending.run, pending.batch, month) for month in pending.months or (None,)]
    append_entry(spark.createDataFrame(rows, _ENTRY), root)
    mine = (F.col("sequence") == pending.sequence) & (F.col("run") == pending.run)
    return bool(_entries(spark, root).where(mine).limit(1).count())


def add(records: DataFrame, root: str, merge: Callable[[DataFrame], DataFrame], batch: str) -> bool:
    """Add a batch under its name; False, and nothing changed, if a batch of that name is in the store.

    If another run commits meanwhile, the batch is merged anew with what that run has stored.
    """
    while (pending := prepare(records, root, merge, batch)) is not None:
        if commit(records.sparkSession, root, pending):
            return True
    return False


def read(spark: SparkSession, root: str, window: DateWindow = DateWindow()) -> DataFrame:
    """The records of the months of ``window``; the files of other months are not opened."""
    current = _current(spark, root)
    if not current:
        raise ValueError(f"no month has been stored under {root}")
    start = first_of_month(window.start) if window.start is not None else date.min
    stop = window.stop or date.max
    inside = {month: run for month, run in current.items() if start <= month < stop}
    if not inside:
        month = min(current)
        return _rows(spark, root, {month: current[month]}).where(F.lit(False))
    return _rows(spark, root, inside)
