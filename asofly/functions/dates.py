"""Date functions: partial dates, month arithmetic, elapsed time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Average days of a month and of a year, as the cost and cadence figures use them.
DAYS_PER_MONTH, DAYS_PER_YEAR = 30.44, 365.25


def parse_partial_date(text: Column | str) -> Column:
    """``YYYY``, ``YYYY-MM`` or ``YYYY-MM-DD`` as a date, the missing parts first of their range; anything else is null."""
    c = F.trim(F.col(text) if isinstance(text, str) else text)
    full = F.when(c.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), F.try_to_date(c, "yyyy-M-d"))
    month = F.when(c.rlike(r"^\d{4}-\d{1,2}$"), F.try_to_date(F.concat(c, F.lit("-1")), "yyyy-M-d"))
    year = F.when(c.rlike(r"^\d{4}$"), F.try_to_date(F.concat(c, F.lit("-1-1")), "yyyy-M-d"))
    return F.coalesce(full, month, year)


def parse_full_date(text: Column | str) -> Column:
    """Only complete ISO dates; the history index takes no partial ones."""
    c = F.col(text) if isinstance(text, str) else text
    return F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(c, "yyyy-MM-dd"))


def month_start(d: Column | str) -> Column:
    return F.trunc(F.col(d) if isinstance(d, str) else d, "MM")


def elapsed_months(start: Column, as_of: Column) -> Column:
    """Days over 30.44, zero before the start and without one."""
    days = F.datediff(as_of, start)
    return F.when(start.isNull() | (days <= 0), F.lit(0.0)).otherwise(days / F.lit(DAYS_PER_MONTH))


def elapsed_years(start: Column, as_of: Column) -> Column:
    return F.datediff(as_of, start) / F.lit(DAYS_PER_YEAR)
