"""Table shapes, readers that bring a source into them, and snapshot writers.

A source may name its tables and columns as it likes; ``columns`` maps our name to the source's.
Types are fixed here and never inferred.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from datetime import date

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from mascate.functions.calendar import DateWindow, first_of_month
from mascate.sources.shared import append_entry, entries, first_entries

_MOVEMENT = (
    "store INT, document DECIMAL(9,0), date DATE, seller_no INT, tax_id STRING, "
    "total DECIMAL(10,2), cancelled STRING"
)

TABLES: dict[str, str] = {
    "customers": (
        "customer_id INT, tax_id STRING, name STRING, area1 STRING, phone1 STRING, area2 STRING, "
        "phone2 STRING, status INT, parent_id INT, parent_tax_id STRING, parent_name STRING, "
        "parent_area1 STRING, parent_phone1 STRING, parent_area2 STRING, parent_phone2 STRING, "
        "parent_birth DATE, parent_status INT"
    ),
    "owner_history": "seller_no INT, tax_id STRING, since TIMESTAMP_NTZ",
    "sellers": "seller_id INT, seller_no INT, name STRING, store INT",
    "orders": _MOVEMENT,
    "returns": _MOVEMENT,
    "sales_lines": (
        "store INT, document DECIMAL(9,0), date DATE, customer_id INT, tax_id STRING, "
        "customer_name STRING, status INT, product DECIMAL(6,0), signed_value DECIMAL(38,6), "
        "seller_name STRING"
    ),
    "league_roster": "member_no INT, tax_id STRING, entered DATE, active STRING",
    "league_members": (
        "plan_code INT, member_no INT, name STRING, tax_id STRING, plan STRING, stars INT, "
        "exchange_days INT, discount_pct DOUBLE, points DOUBLE, purchases_7m DOUBLE, "
        "current_month DOUBLE, birth TIMESTAMP_NTZ, plan_start TIMESTAMP_NTZ, "
        "plan_end TIMESTAMP_NTZ, changed TIMESTAMP_NTZ"
    ),
    "ranking": "member_no INT, value DECIMAL(10,2), position INT",
    "race_purchases": "member_no INT, start DATE, end DATE, total DECIMAL(12,2)",
    "race_goals": "start DATE, end DATE, goal DECIMAL(12,2), star_value DECIMAL(12,2)",
    "race_prizes": "member_no INT, start DATE, end DATE",
    "month_purchases": "member_no INT, period DATE, total DECIMAL(12,2)",
    "month_goals": "period DATE, goal DECIMAL(12,2)",
    "users": (
        "user_id INT, login STRING, password_md5 STRING, email STRING, active INT, "
        "created TIMESTAMP, changed TIMESTAMP, created_by INT, changed_by INT, person_id INT, "
        "seller_no INT, type INT, store STRING"
    ),
}

# Fixed-width text columns: a source may hand them over with trailing blanks.
FIXED_WIDTH = {"orders": ("tax_id", "cancelled"), "returns": ("tax_id", "cancelled")}


def schema_of(table: str) -> StructType:
    return StructType.fromDDL(TABLES[table])


def _shaped(field: StructField, table: str, names: Mapping[str, str]) -> Column:
    value = F.col(names.get(field.name, field.name))
    return F.rtrim(value) if field.name in FIXED_WIDTH.get(table, ()) else value


def conform(df: DataFrame, table: str, columns: Mapping[str, str] | None = None) -> DataFrame:
    """Rename and cast a source to the shape of ``table``; only the mapped columns are read.

    A value that does not fit ends the job; :func:`sift` sets such rows aside instead.
    """
    names = columns or {}
    fields = schema_of(table).fields
    return df.select(*[_shaped(f, table, names).cast(f.dataType).alias(f.name) for f in fields])


def sift(
    df: DataFrame, table: str, columns: Mapping[str, str] | None = None, required: Sequence[str] = ()
) -> tuple[DataFrame, DataFrame]:
    """A source in the shape of ``table``, and the rows that have no such shape.

    The first frame has the rows all of whose values fit, cast. The second has the others, as they
    came, in ``row``, with ``reasons``: for each column that is to blame its name, what is wrong
    (``value`` is no value of the type, or ``missing`` in a column of ``required``) and the value as
    text. Each row is in exactly one of them, also if it is repeated; NULL fits where it is not
    required. A text that needs rounding to fit a decimal fits, as in :func:`conform`. Both frames
    are lazy and read the source by themselves: whoever writes both reads it twice, with the columns
    that each needs. Columns that are not mapped are only in ``row``.
    """
    names = columns or {}
    unknown = set(required) - {f.name for f in schema_of(table).fields}
    if unknown:
        raise ValueError(f"{table} has no column {sorted(unknown)}")
    cast, wrong = [], []
    for field in schema_of(table).fields:
        value = _shaped(field, table, names)
        fitted = value.try_cast(field.dataType)
        cast.append(fitted.alias(field.name))
        shown = F.struct(
            F.lit(field.name).alias("column"),
            F.when(value.isNull(), "missing").otherwise("value").alias("reason"),
            value.cast("string").alias("value"),
        )
        bad = value.isNotNull() & fitted.isNull()
        if field.name in required:
            bad = bad | value.isNull()
        wrong.append(F.when(bad, shown))
    reasons = F.array_compact(F.array(*wrong)).alias("reasons")
    judged = df.select(F.struct("*").alias("row"), F.struct(*cast).alias("fit"), reasons)
    refused = judged.where(F.size("reasons") > 0).select("row", "reasons")
    return judged.where(F.size("reasons") == 0).select("fit.*"), refused


def refusals(refused: DataFrame) -> DataFrame:
    """How often each column of :func:`sift` was to blame, and why: ``column, reason, rows``."""
    blamed = refused.select(F.explode("reasons").alias("r"))
    return blamed.groupBy("r.column", "r.reason").agg(F.count("*").alias("rows"))


def read_parquet(
    spark: SparkSession, table: str, path: str, columns: Mapping[str, str] | None = None
) -> DataFrame:
    """Read a Parquet table. Column types come from the files and are cast to those of ``table``."""
    return conform(spark.read.parquet(path), table, columns)


def read_jdbc(
    spark: SparkSession,
    table: str,
    url: str,
    source: str,
    columns: Mapping[str, str] | None = None,
    split_on: str | None = None,
    bounds: tuple[str, str] | None = None,
    pieces: int | None = None,
    properties: Mapping[str, str] | None = None,
) -> DataFrame:
    """Read a database table in ``pieces`` parallel ranges of ``split_on``.

    To read a table as a whole, through one connection and one task, ask for ``pieces=1``.
    """
    if split_on is None and pieces != 1:
        raise ValueError("give split_on, bounds and pieces, or ask for pieces=1")
    if split_on is not None and pieces is None:
        raise ValueError("split_on needs pieces")
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", source)
    if split_on is not None:
        if bounds is None:
            raise ValueError("split_on needs bounds")
        reader = (
            reader.option("partitionColumn", split_on)
            .option("lowerBound", bounds[0])
            .option("upperBound", bounds[1])
            .option("numPartitions", pieces)
        )
    return conform(reader.options(**(properties or {})).load(), table, columns)


def write_facts(df: DataFrame, path: str, key: str = "tax_id", row_group: int | None = None) -> None:
    """Store orders, returns or sales lines by month, so that date windows skip other months.

    Rebalancing gathers small months and splits large ones by size at run time. Inside a file rows are
    sorted by ``key`` and carry a Bloom filter of it, so that a lookup of some ids skips the row groups
    without them, by their bounds or by the filter. ``row_group`` is their size in bytes (128 MB).
    """
    months = df.withColumn("month", F.trunc("date", "MM")).hint("rebalance", F.col("month"))
    writer = months.sortWithinPartitions("month", key).write.partitionBy("month").mode("errorifexists")
    if row_group is not None:
        writer = writer.option("parquet.block.size", row_group)
    writer.option(f"parquet.bloom.filter.enabled#{key}", "true").parquet(path)


def read_facts(
    spark: SparkSession, table: str, path: str, window: DateWindow, ids: Sequence[str] | None = None, key: str = "tax_id"
) -> DataFrame:
    """The days of ``window`` of a table stored by :func:`write_facts`; other months are not read.

    ``ids``, some literal values of ``key``, reach the scan as a filter: row groups whose bounds or
    Bloom filter exclude all of them are not read.
    """
    start = first_of_month(window.start) if window.start is not None else None
    months = DateWindow(start, window.stop)
    stored = spark.read.parquet(path)
    rows = stored.where(months.holds(F.col("month")) & window.holds(F.col("date")))
    if ids is not None:
        rows = rows.where(F.col(key).isin(list(ids)))
    return conform(rows, table)


def write_snapshot(df: DataFrame, root: str, name: str) -> str:
    """Store a full new snapshot under its own name; an existing one is never overwritten."""
    path = f"{root.rstrip('/')}/{name}"
    df.write.mode("errorifexists").parquet(path)
    return path


_FROZEN = "month DATE, run STRING"


def _frozen(spark: SparkSession, root: str) -> DataFrame:
    return first_entries(entries(spark, root, _FROZEN), "month")


def frozen_months(spark: SparkSession, root: str) -> DataFrame:
    """The months (column ``month``) that :func:`freeze_month` has stored under ``root``, also empty ones."""
    return _frozen(spark, root).select("month").distinct()


def freeze_month(df: DataFrame, root: str, month: date) -> bool:
    """Store the rows of a month once and for all; False if it is, or meanwhile was, stored by another run.

    The rows go into a folder of this run alone, then an entry that names the run commits them. No run
    writes where another one has written, so a frozen month never changes: of two runs at once the
    first entry counts, and what the other one has left is read by nobody. A month without rows has
    its entry too.
    """
    month, spark, root = first_of_month(month), df.sparkSession, root.rstrip("/")
    if frozen_months(spark, root).where(F.col("month") == F.lit(month)).limit(1).count():
        return False
    run = str(uuid.uuid4())
    df.drop("month").write.parquet(f"{root}/rows/month={month.isoformat()}/run={run}")
    append_entry(spark.range(1).select(F.lit(month).alias("month"), F.lit(run).alias("run")), root)
    return bool(_frozen(spark, root).where((F.col("month") == F.lit(month)) & (F.col("run") == run)).count())


def read_months(spark: SparkSession, root: str, schema: str | None = None) -> DataFrame:
    """The rows of all frozen months, with their month.

    A store without any month has no rows to tell the columns from; ``schema`` (without ``month``) does.
    """
    root = root.rstrip("/")
    frozen = _frozen(spark, root).select("month", "run")
    try:
        rows = spark.read.option("basePath", f"{root}/rows").parquet(f"{root}/rows/month=*/run=*")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND" or schema is None:
            raise
        return spark.createDataFrame([], f"{schema}, month DATE")
    return rows.withColumn("month", F.col("month").cast("date")).join(frozen, ["month", "run"], "left_semi").drop("run")
