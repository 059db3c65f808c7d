"""Events near a person's index dates."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlane.functions.dates import as_date, within_days
from cohortlane.operators.sieve import PersonSieve

DateRange = tuple[date, date]


def reachable(index_between: DateRange, days_pre: int, days_post: int) -> DateRange:
    """Dates an event must have to be near any index date of the range."""
    start, end = index_between
    return start - timedelta(days=days_pre), end + timedelta(days=days_post)


def date_filter(df: DataFrame, date_col: str, between: DateRange | None) -> DataFrame:
    """Static bounds on the event date: Spark cannot derive them from the window
    condition, but given as literals they reach the file scan."""
    if between is None:
        return df
    return df.where(as_date(date_col).between(F.lit(between[0]), F.lit(between[1])))


def index_dates(cohort: DataFrame, date_col: str, by: Sequence[str] = ()) -> DataFrame:
    """Distinct (person_id, index_date), with the columns ``by``."""
    return cohort.select("person_id", *by, as_date(date_col).alias("index_date")).distinct()


def join_near(
    index: DataFrame,
    events: DataFrame,
    days_pre: int,
    days_post: int,
    how: str = "inner",
    day_buckets: bool = False,
) -> DataFrame:
    """Join (person_id, index_date) with (person_id, event_date, ...) in the window.

    Both sides hold distinct days, so even a person owning a large part of all
    raw events brings at most one row per day and side. ``person_id`` is the
    only equi key, which lets every later step per person reuse the
    partitioning. ``day_buckets=True`` adds the day bucket as a second key for
    cohorts where comparing all days of a person with each other is too much.
    """
    near = within_days("event_date", "index_date", days_pre, days_post)
    right = events.withColumnRenamed("person_id", "_person")
    same_person = F.col("person_id") == F.col("_person")
    if not day_buckets:
        return index.join(right, same_person & near, how).drop("_person")
    left = with_buckets(index, "index_date", days_pre, days_post)
    right = right.withColumn("_event_bucket", day_bucket("event_date", days_pre, days_post))
    same_bucket = F.col("_bucket") == F.col("_event_bucket")
    return left.join(right, same_person & same_bucket & near, how).drop(
        "_person", "_bucket", "_event_bucket"
    )


def day_bucket(date_col: str | Column, days_pre: int, days_post: int) -> Column:
    """Number of the window-sized stretch of days a date falls in."""
    width = max(1, days_pre + days_post + 1)
    return F.floor(F.unix_date(as_date(date_col)) / F.lit(width))


def with_buckets(index: DataFrame, date_col: str, days_pre: int, days_post: int) -> DataFrame:
    """Index rows repeated for the one or two buckets their window touches."""
    first = day_bucket(F.date_sub(date_col, days_pre), days_pre, days_post)
    last = day_bucket(F.date_add(date_col, days_post), days_pre, days_post)
    return index.withColumn("_bucket", F.explode_outer(F.sequence(first, last)))


def near_index(
    events: DataFrame,
    event_date: str,
    cohort: DataFrame,
    index_date: str,
    days_pre: int,
    days_post: int,
    index_between: DateRange | None = None,
) -> DataFrame:
    """All event rows in the window of an index date, with that index date.

    Unlike the phenotype operators this keeps every event row, so the output is
    as large as the number of (event, index date) matches. The join is by person
    and day bucket, which spreads a person with very many events.
    """
    between = reachable(index_between, days_pre, days_post) if index_between else None
    bounded = date_filter(events, event_date, between).withColumn(
        "_event_bucket", day_bucket(event_date, days_pre, days_post)
    )
    index = index_dates(cohort, index_date).select(
        F.col("person_id").alias("_person"), F.col("index_date").alias(index_date)
    )
    return bounded.join(
        with_buckets(index, index_date, days_pre, days_post),
        (F.col("person_id") == F.col("_person"))
        & (F.col("_event_bucket") == F.col("_bucket"))
        & within_days(event_date, index_date, days_pre, days_post),
    ).drop("_person", "_event_bucket", "_bucket")


def restrict_to_persons(
    df: DataFrame, persons: DataFrame, sieve: PersonSieve | None = None
) -> DataFrame:
    """Rows of persons that occur in another frame.

    With a ``sieve`` of these persons most other rows go before the join.
    """
    if sieve is not None:
        df = sieve.keep(df)
    return df.join(persons.select("person_id"), "person_id", "left_semi")
