"""Date windows worked out on the driver from report parameters."""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_of_month(day: date) -> date:
    return day.replace(day=1)


def add_months(day: date, months: int) -> date:
    """The first day of the month that lies ``months`` after the month of ``day``."""
    index = day.year * 12 + day.month - 1 + months
    return date(index // 12, index % 12 + 1, 1)


def month_start(text: str | None, as_of: date) -> date:
    """First day of the month named ``YYYY-MM`` or ``YYYY-MM-DD``; without one, of ``as_of``."""
    if not text:
        return first_of_month(as_of)
    match = re.match(r"([0-9]{4})-([0-9]{2})", text)
    if match is None:
        raise ValueError(f"month must start with YYYY-MM, got {text!r}")
    return date(int(match[1]), int(match[2]), 1)


@dataclass(frozen=True)
class DateWindow:
    """Days from ``start`` up to but not including ``stop``; an open end is None."""

    start: date | None = None
    stop: date | None = None

    def holds(self, day: Column) -> Column:
        """Literal bounds on a plain column, so that the scan can use them."""
        tests = []
        if self.start is not None:
            tests.append(day >= F.lit(self.start))
        if self.stop is not None:
            tests.append(day < F.lit(self.stop))
        if not tests:
            return F.lit(True)
        return tests[0] if len(tests) == 1 else tests[0] & tests[1]

    @staticmethod
    def days(first: date | None, last: date | None) -> "DateWindow":
        """Both ends included."""
        return DateWindow(first, None if last is None else last + timedelta(days=1))

    @staticmethod
    def months(first: date, count: int = 1) -> "DateWindow":
        start = first_of_month(first)
        return DateWindow(start, add_months(start, count))


def resolve_window(
    as_of: date,
    start: date | None = None,
    end: date | None = None,
    month: str | None = None,
    months: int | None = None,
) -> DateWindow:
    """Explicit range, else the given month, else the last ``months`` (12) with no upper end."""
    if start is not None or end is not None:
        return DateWindow.days(start, end)
    if month is not None:
        if re.fullmatch(r"[0-9]{4}-[0-9]{2}", month) is None:
            raise ValueError(f"month must be YYYY-MM, got {month!r}")
        return DateWindow.months(month_start(month, as_of))
    back = months if months is not None and months > 0 else 12
    return DateWindow(add_months(as_of, 1 - back), None)
