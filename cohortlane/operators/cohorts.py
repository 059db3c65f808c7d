"""Index events and eligibility."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlane.functions.dates import age_years, as_date
from cohortlane.functions.labels import FEMALE, MALE
from cohortlane.operators.proximity import DateRange, date_filter

# Service and event-type concepts of admission/transfer records.
ICU_SERVICE = 2000000078
ADMISSION = 2000000083
DISCHARGE = 2000000084
TRANSFER_IN = 2000000085
TRANSFER_OUT = 2000000086
CENSUS = 2000000087

ENTRY_TYPES = (ADMISSION, TRANSFER_IN)


def latest_visit_by_site(visits: DataFrame) -> DataFrame:
    return visits.groupBy("site").agg(
        F.max(as_date("visit_start_date")).alias("max_visit_date")
    )


def count_patients(df: DataFrame) -> DataFrame:
    """Exact number of distinct persons, as a one-row frame."""
    return df.agg(F.count_distinct("person_id").alias("n_patients"))


def icu_admits(
    adt: DataFrame,
    between: DateRange,
    services: Sequence[int] = (ICU_SERVICE,),
    types: Sequence[int] = ENTRY_TYPES,
) -> DataFrame:
    """Admission/transfer records of given services and types in a date range."""
    return date_filter(adt, "adt_date", between).where(
        F.col("adt_type_concept_id").isin(*types) & F.col("service_concept_id").isin(*services)
    )


def index_events(
    adt: DataFrame, visits: DataFrame, person: DataFrame, service: int = ICU_SERVICE
) -> DataFrame:
    """Records of one service with their visit's dates and the person's birth date.

    Records without a visit would all meet in one NULL key, so each gets a key
    of its own that no visit has.
    """
    records = adt.where(F.col("service_concept_id") == service)
    times = visits.select(
        F.col("visit_occurrence_id").alias("_visit"), "visit_start_date", "visit_end_date"
    )
    dealt = F.coalesce(F.col("visit_occurrence_id"), -F.abs(F.xxhash64(*records.columns)) - 1)
    # ids are not negative; a NULL one must not find a visit whatever its key
    found = (dealt == F.col("_visit")) & F.col("visit_occurrence_id").isNotNull()
    return (
        records.join(times, found, "left")
        .drop("_visit")
        .select(
            "visit_occurrence_id",
            *[c for c in records.columns if c != "visit_occurrence_id"],
            "visit_start_date",
            "visit_end_date",
        )
        .join(person.select("person_id", "birth_date"), "person_id", "left")
    )


def _eligible(
    index: DataFrame,
    person: DataFrame,
    date_col: str,
    between: DateRange,
    max_age: int,
    sexes: Sequence[int] | None,
) -> DataFrame:
    # Age limits imply limits on the birth date; as literals they reach the
    # scan of the person table.
    oldest = between[0] - timedelta(days=max_age * 366)
    candidates = person.where(
        F.col("birth_date").between(F.lit(oldest), F.lit(between[1]))
    ).select("person_id", "birth_date", "gender_concept_id")
    if sexes is not None:
        candidates = candidates.where(F.col("gender_concept_id").isin(*sexes))
    return (
        index.join(candidates, "person_id")
        .withColumn("age", age_years("birth_date", date_col))
        .where((F.col("age") >= 0) & (F.col("age") < max_age))
        .select("person_id", "birth_date", date_col, "age", "gender_concept_id")
    )


def icu_cohort_adt(
    adt: DataFrame,
    person: DataFrame,
    between: DateRange,
    service: int = ICU_SERVICE,
    types: Sequence[int] = ENTRY_TYPES,
    max_age: int = 18,
    sexes: Sequence[int] | None = (MALE, FEMALE),
) -> DataFrame:
    """Persons under ``max_age`` at each distinct date they entered the service.

    ``sexes=None`` accepts any sex.
    The records are reduced to distinct (person, date) before persons are
    looked up, so repeated records of one person do not travel.
    """
    index = (
        icu_admits(adt, between, (service,), types)
        .select("person_id", as_date("adt_date").alias("adt_date"))
        .distinct()
    )
    return _eligible(index, person, "adt_date", between, max_age, sexes)


def icu_cohort_visit(
    adt: DataFrame,
    visits: DataFrame,
    person: DataFrame,
    between: DateRange,
    service: int = ICU_SERVICE,
    max_age: int = 18,
    sexes: Sequence[int] | None = (MALE, FEMALE),
) -> DataFrame:
    """The same by the start date of the visit; any record type counts."""
    index = (
        visit_index(adt, visits, between, service)
        .select("person_id", "visit_start_date")
        .distinct()
    )
    return _eligible(index, person, "visit_start_date", between, max_age, sexes)


def visit_index(
    adt: DataFrame, visits: DataFrame, between: DateRange, service: int = ICU_SERVICE
) -> DataFrame:
    """Distinct (person, visit) seen by a service, for visits starting in a range."""
    seen = (
        adt.where(F.col("service_concept_id") == service)
        .select("person_id", "visit_occurrence_id")
        .distinct()
    )
    started = date_filter(visits, "visit_start_date", between).select(
        "visit_occurrence_id", as_date("visit_start_date").alias("visit_start_date")
    )
    return seen.join(started, "visit_occurrence_id")


def site_subset(df: DataFrame, sites: Sequence[str]) -> DataFrame:
    """Rows of some sites."""
    return df.where(F.col("site").isin(*sites))


def add_site(df: DataFrame, person: DataFrame) -> DataFrame:
    """Site of each row's person."""
    return df.join(person.select("person_id", "site"), "person_id", "left")
