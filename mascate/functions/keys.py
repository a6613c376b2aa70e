"""Tax-id keys, customer visibility and phone numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Customer statuses left out of every list (open, in service, scheduled, 95).
HIDDEN_STATUSES = (6, 8, 9, 95)

TAX_ID_WIDTH = 14


def digits(text: Column) -> Column:
    """The digits of a text; NULL stays NULL."""
    return F.regexp_replace(text, "[^0-9]", "")


def tax_id14(text: Column) -> Column:
    """Digits padded left to 14 with zeros; a longer id is cut to its first 14 digits."""
    return F.lpad(digits(text), TAX_ID_WIDTH, "0")


def tax_id14_uncut(text: Column) -> Column:
    """Like :func:`tax_id14`, but a longer id is kept whole and NULL counts as empty text."""
    d = digits(F.coalesce(text, F.lit("")))
    return F.when(F.length(d) >= TAX_ID_WIDTH, d).otherwise(F.lpad(d, TAX_ID_WIDTH, "0"))


def parent_tax_id14(parent_tax_id: Column, own_tax_id: Column) -> Column:
    """The padded tax id of the parent account; without a parent id, the account's own."""
    return tax_id14(F.coalesce(F.nullif(parent_tax_id, F.lit("")), own_tax_id))


def visible(status: Column) -> Column:
    """Whether a customer of this status may be listed; an unknown status may."""
    return status.isNull() | ~status.isin(*HIDDEN_STATUSES)


def has_number(phone: Column) -> Column:
    """Whether a phone holds any digit other than zero."""
    return F.coalesce(phone, F.lit("")).rlike("[1-9]")


def phone_of(
    mobile_area: Column,
    mobile: Column,
    landline_area: Column,
    landline: Column,
    blank_as_null: bool = False,
) -> Column:
    """Area code and number of the mobile if it has a number, else of the landline.

    With neither number the value is one blank, or NULL with ``blank_as_null``.
    """

    def joined(area: Column, number: Column) -> Column:
        return F.concat(
            F.trim(F.coalesce(area, F.lit(""))), F.lit(" "), F.trim(F.coalesce(number, F.lit("")))
        )

    phone = F.when(has_number(mobile), joined(mobile_area, mobile)).otherwise(
        joined(landline_area, landline)
    )
    if blank_as_null:
        phone = F.when(F.trim(phone) != "", phone)
    return phone
