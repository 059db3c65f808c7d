"""Date and time arithmetic on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAYS_PER_YEAR = 365.25


def as_date(column: str | Column) -> Column:
    return (F.col(column) if isinstance(column, str) else column).cast("date")


def age_years(birth: str | Column, at: str | Column) -> Column:
    """Unrounded age in years: whole days divided by 365.25."""
    return F.datediff(as_date(at), as_date(birth)) / F.lit(DAYS_PER_YEAR)


def within_days(event: str | Column, index: str | Column, days_pre: int, days_post: int) -> Column:
    """Event no more than ``days_pre`` before and ``days_post`` after the index.

    Both bounds are inclusive; a NULL date on either side never matches.
    """
    return F.datediff(as_date(event), as_date(index)).between(-days_pre, days_post)


def elapsed_seconds(start: str | Column, end: str | Column) -> Column:
    return F.timestamp_diff("SECOND", start, end)
