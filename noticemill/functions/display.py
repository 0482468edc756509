"""Text forms used in listings and charts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DASH = "—"


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def day(ts: Column | str) -> Column:
    """UTC day as ``YYYY-MM-DD``."""
    return F.date_format(ts, "yyyy-MM-dd")


def short_date(ts: Column | str) -> Column:
    """``Mar 5, 2024``, a dash when missing."""
    return F.coalesce(F.date_format(ts, "MMM d, yyyy"), F.lit(DASH))


def money(amount: Column | str) -> Column:
    """``$1,234.5``: grouped, at most three decimals; a dash when missing or zero."""
    amount = _col(amount)
    text = F.regexp_replace(F.format_number(amount, 3), r"\.?0+$", "")
    return F.when(amount.isNull() | (amount == 0), DASH).otherwise(F.concat(F.lit("$"), text))


def grouped(number: Column | str) -> Column:
    """Integer with thousands separators."""
    return F.format_number(_col(number), 0)


def axis_day(date_text: Column | str) -> Column:
    """``MM-DD`` from ``YYYY-MM-DD``."""
    return F.substring(_col(date_text), 6, 5)
