"""Emergency visits linked to inpatient visits, and what happens in them."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlane.functions.dates import age_years, as_date, elapsed_seconds
from cohortlane.operators.codes import (
    match_codes,
    match_codes_with_attributes,
    tag_events,
)

# Visit concepts.
INPATIENT = 9201
EMERGENCY = 9203
EMERGENCY_TO_INPATIENT = 2000000048
OBSERVATION = 2000000088

EMERGENCY_CONCEPTS = (EMERGENCY, EMERGENCY_TO_INPATIENT)
INPATIENT_CONCEPTS = (INPATIENT, EMERGENCY_TO_INPATIENT, OBSERVATION)

VISIT_COLUMNS = (
    "person_id",
    "visit_occurrence_id",
    "visit_start_date",
    "visit_start_datetime",
    "visit_concept_id",
    "visit_concept_name",
    "visit_start_age_in_months",
    "site",
)


def _visit_columns(visits: DataFrame) -> list[str]:
    return [c for c in VISIT_COLUMNS if c in visits.columns]


def ed_visits(visits: DataFrame) -> DataFrame:
    wanted = visits.where(F.col("visit_concept_id").isin(*EMERGENCY_CONCEPTS))
    return wanted.select(*_visit_columns(visits)).distinct()


def inpatient_visits(visits: DataFrame) -> DataFrame:
    wanted = visits.where(F.col("visit_concept_id").isin(*INPATIENT_CONCEPTS))
    return wanted.select(*_visit_columns(visits), "preceding_visit_occurrence_id").distinct()


def ed_linked_to_inpatient(
    visits: DataFrame, fact_relationship: DataFrame, combined_since: date
) -> DataFrame:
    """Distinct union of three kinds of linked visits.

    1. combined emergency-to-inpatient visits since a date;
    2. emergency visits linked to an inpatient visit of the same person through
       the relationship table, as the emergency visit;
    3. inpatient visits preceded by an emergency visit of the same person, with
       the inpatient visit id and the other columns of the emergency visit.
    """
    columns = _visit_columns(visits)
    emergency = visits.where(F.col("visit_concept_id").isin(*EMERGENCY_CONCEPTS)).select(*columns)
    inpatient = visits.where(F.col("visit_concept_id").isin(*INPATIENT_CONCEPTS)).select(
        "person_id",
        F.col("visit_occurrence_id").alias("_inpatient"),
        F.col("preceding_visit_occurrence_id").alias("_preceding"),
    )
    related = fact_relationship.select(
        F.col("fact_id_1").alias("_emergency"), F.col("fact_id_2").alias("_inpatient")
    ).distinct()

    # Both kinds of link start from the inpatient visit: as (emergency visit,
    # person, id to show). The visits are read twice, once for each side.
    def link(emergency_id: str, shown: str) -> Column:
        return F.when(
            F.col(emergency_id).isNotNull(),
            F.struct(F.col(emergency_id).alias("_linked"), F.col(shown).alias("_shown")),
        )

    links = inpatient.join(related, "_inpatient", "left").select(
        F.col("person_id").alias("_person"),
        F.inline(F.array_compact(F.array(link("_preceding", "_inpatient"), link("_emergency", "_emergency")))),
    ).distinct()
    same = (F.col("visit_occurrence_id") == F.col("_linked")) & (F.col("person_id") == F.col("_person"))
    combined = (F.col("visit_concept_id") == EMERGENCY_TO_INPATIENT) & (
        F.col("visit_start_date") >= F.lit(combined_since)
    )
    shown = F.array_compact(F.array(F.when(combined, F.col("visit_occurrence_id")), F.col("_shown")))
    return (
        emergency.join(links, same, "left")
        .withColumn("visit_occurrence_id", F.explode(shown))
        .select(*columns)
        .distinct()
    )


def _linked_keys(linked: DataFrame) -> DataFrame:
    return linked.select(
        "person_id",
        "visit_occurrence_id",
        F.col("visit_start_datetime").alias("_start"),
        "visit_concept_id",
    ).distinct()


def _culture_sources(
    procedures: DataFrame, procedure_codes: DataFrame, labs: DataFrame, lab_codes: DataFrame
) -> list[DataFrame]:
    keys = ("person_id", "visit_occurrence_id")
    by_procedure = match_codes(procedures, "procedure_concept_id", procedure_codes).select(
        *keys, F.col("procedure_datetime").alias("culture_datetime")
    )
    by_lab = match_codes(labs, "measurement_concept_id", lab_codes).select(
        *keys, F.col("measurement_datetime").alias("culture_datetime")
    )
    return [by_procedure, by_lab]


def _after_first_start(cultures: DataFrame, linked: DataFrame) -> DataFrame:
    """Cultures at or after a linked visit of the person began.

    Being at or after *any* start is being at or after a first one, so events
    meet a person's first visit of each kind instead of all of them. (One row
    per person would do, but then Spark would join within the shuffle of that
    aggregate, which it cannot split for a person with very many events.)
    """
    first_starts = linked.groupBy(F.col("person_id").alias("_person"), "visit_concept_id").agg(
        F.min("visit_start_datetime").alias("_first_start")
    ).drop("visit_concept_id")
    late = (F.col("person_id") == F.col("_person")) & (F.col("culture_datetime") >= F.col("_first_start"))
    return cultures.join(first_starts, late, "left_semi")


def blood_culture_after_ed(
    linked: DataFrame,
    procedures: DataFrame,
    procedure_codes: DataFrame,
    labs: DataFrame,
    lab_codes: DataFrame,
    max_seconds: int | None = None,
) -> DataFrame:
    """Cultures in linked visits, with seconds since the visit's start.

    By default every culture of a linked visit counts, whatever the time.
    ``max_seconds`` keeps those between the start and that many seconds later.
    """
    # Visit and time travel as one column: sources shuffled alike by visit would
    # otherwise be united, sorted and reduced partition by partition in one task.
    culture = F.struct("visit_occurrence_id", "culture_datetime").alias("_culture")
    taken = [
        _after_first_start(source, linked).select(culture)
        for source in _culture_sources(procedures, procedure_codes, labs, lab_codes)
    ]
    timed = (
        reduce(DataFrame.union, taken)
        .distinct()
        .select("_culture.*")
        .join(_linked_keys(linked), "visit_occurrence_id")
        .withColumn("tst_time", elapsed_seconds("_start", "culture_datetime"))
    )
    if max_seconds is not None:
        timed = timed.where(F.col("tst_time").between(0, max_seconds))
    return timed.select(
        "person_id", "visit_occurrence_id", "culture_datetime", "tst_time", "visit_concept_id"
    ).distinct()


def drug_in_visit(
    linked: DataFrame, drugs: DataFrame, codes: DataFrame, attributes: Sequence[str] = ()
) -> DataFrame:
    """Exposures to coded drugs in linked visits, with seconds since the start.

    ``attributes`` are columns of the code set to carry along. Repeated
    exposures are removed before the join with the visits.
    """
    columns = ("person_id", "visit_occurrence_id", "drug_exposure_start_datetime")
    given = (
        match_codes_with_attributes(drugs, "drug_concept_id", codes, attributes)
        if attributes
        else match_codes(drugs, "drug_concept_id", codes)
    )
    return (
        given.select(*columns, *attributes)
        .distinct()
        .join(_linked_keys(linked), ["person_id", "visit_occurrence_id"])
        .withColumn("tst_time", elapsed_seconds("_start", "drug_exposure_start_datetime"))
        .select(*columns, "tst_time", "visit_concept_id", *attributes)
        .distinct()
    )


def same_visit_criteria(
    linked: DataFrame,
    procedures: DataFrame,
    procedure_codes: DataFrame,
    labs: DataFrame,
    lab_codes: DataFrame,
    drugs: DataFrame,
    fluid_codes: DataFrame,
    antibiotic_codes: DataFrame,
) -> DataFrame:
    """Distinct (person, visit) of linked visits with culture, fluids and antibiotics.

    Only existence matters, so no pairs of events are formed. Drugs, cultures and
    the linked visits themselves become one table that is reduced once, to a row
    per (person, visit): a bit set, the last culture, which is late enough if any
    is, and whether the visit is linked.
    """
    keys = ("person_id", "visit_occurrence_id")
    no_time = F.lit(None).cast("timestamp_ntz")
    marked = [
        tag_events(drugs, ("drug_concept_id",), {0: fluid_codes, 1: antibiotic_codes}).select(
            *keys, "_tags", no_time.alias("_culture")
        ),
        *(
            source.select(*keys, F.lit(0).cast("bigint"), F.col("culture_datetime"))
            for source in _culture_sources(procedures, procedure_codes, labs, lab_codes)
        ),
        linked.select(*keys, F.lit(4).cast("bigint"), no_time),
    ]
    by_visit = (
        reduce(DataFrame.union, marked)
        .groupBy(*keys)
        .agg(F.bit_or("_tags").alias("_tags"), F.max("_culture").alias("_culture"))
    )
    # being at or after any start of the person is being at or after the first
    first = linked.groupBy("person_id").agg(F.min("visit_start_datetime").alias("_first"))
    # a culture counts for its visit, whoever's it is
    late = F.bool_or(F.coalesce(F.col("_culture") >= F.col("_first"), F.lit(False)))
    return (
        by_visit.join(first, "person_id")
        .where(F.col("visit_occurrence_id").isNotNull())
        .withColumn("_late", late.over(Window.partitionBy("visit_occurrence_id")))
        .where(F.col("_late") & (F.col("_tags") == 7))
        .select(*keys)
    )


def same_visit_phenotype(
    person_visits: DataFrame, visits: DataFrame, person: DataFrame, max_age: int = 18
) -> DataFrame:
    """Persons aged under ``max_age`` at such a visit, with the latest visit date."""
    return (
        person_visits.join(
            visits.select(
                "visit_occurrence_id", as_date("visit_start_date").alias("visit_start_date")
            ),
            "visit_occurrence_id",
        )
        .select("person_id", "visit_start_date")
        .distinct()
        .join(person.select("person_id", "birth_date"), "person_id")
        .withColumn("age", age_years("birth_date", "visit_start_date"))
        .where((F.col("age") >= 0) & (F.col("age") < max_age))
        .groupBy("person_id")
        .agg(F.max("visit_start_date").alias("max_sepsis_date"))
    )
