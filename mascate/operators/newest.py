"""The newest sales line of a customer: found as one number, its texts fetched afterwards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, DataType, DecimalType, IntegerType, LongType, ShortType

#: What lifts 0001-01-01 to 1, and the digits that the lifted days of all dates have at most.
_FIRST_DAY, _DAY_DIGITS = 719_163, 7
_DIGITS = {ByteType: 3, ShortType: 5, IntegerType: 10, LongType: 19}

#: What the reports show of the newest line, in the order in which lines of the same number are told apart.
SHOWN = ("customer_name", "tax_id", "status", "seller_name", "store")


def _room(kind: DataType) -> int:
    """The digits of a whole number of this type."""
    if isinstance(kind, DecimalType) and kind.scale == 0:
        return kind.precision
    if type(kind) not in _DIGITS:
        raise ValueError(f"a whole number is needed, got {kind.simpleString()}")
    return _DIGITS[type(kind)]


def line_number(lines: DataFrame, day: str = "date", document: str = "document", product: str = "product") -> Column:
    """Date, document and product in one number that sorts like all three, NULLs lowest.

    The largest of a number is kept by a hash aggregate; that of a struct with texts makes Spark sort
    the lines on the map side. A column whose types leave no room in 38 digits is refused.
    """
    rooms = {name: _room(lines.schema[name].dataType) for name in (document, product)}
    if _DAY_DIGITS + sum(room + 1 for room in rooms.values()) > 38:
        raise ValueError(f"{document} and {product} have too many digits for one number: {rooms}")
    number = (F.unix_date(F.col(day)) + _FIRST_DAY).cast("decimal(38,0)")
    for name, room in rooms.items():
        lifted = F.coalesce(F.col(name).cast("decimal(38,0)") + F.lit(10**room).cast("decimal(38,0)"), F.lit(0))
        number = (number * F.lit(10 ** (room + 1)).cast(f"decimal({room + 2},0)")).cast("decimal(38,0)")
        number = (number + lifted.cast("decimal(38,0)")).cast("decimal(38,0)")
    return number


def with_newest(
    found: DataFrame, lines: DataFrame, key: str, number: str = "newest", shown: Sequence[str] = SHOWN
) -> DataFrame:
    """``found`` with ``last``, the texts of each row's line ``number``; of equal lines the largest texts.

    Only lines that are some row's newest are kept and shuffled for it, by key and number together, so that
    a customer with a large share of the lines is no large share of any task.
    """
    line = [key, number]
    wanted = found.select(*line).where(F.col(number).isNotNull())
    texts = (
        lines.select(*line, F.struct(*shown).alias("last"))
        .join(wanted, line, "left_semi")
        .groupBy(*line)
        .agg(F.max("last").alias("last"))
    )
    return found.join(texts, line, "left")
