"""The sepsis feasibility study: cohorts, summaries, funnel and report tables.

Every table below comes from at most one evaluation of the criteria per index
definition: ``study_persons`` evaluates all phenotypes together, and the rest
reads them off its rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlane.config import StudyCatalog
from cohortlane.functions.labels import FEMALE, MALE
from cohortlane.operators.attrition import AttritionStep, attrition
from cohortlane.operators.cohorts import (
    ENTRY_TYPES,
    ICU_SERVICE,
    add_site,
    icu_cohort_adt,
    icu_cohort_visit,
    site_subset,
    visit_index,
)
from cohortlane.operators.demographics import demographics, known_sex
from cohortlane.operators.person_sets import Cut, PersonNumbers, person_sets
from cohortlane.operators.phenotype import (
    Criterion,
    EventSource,
    condition_source,
    criteria_by_index,
    phenotypes_by_person,
)
from cohortlane.operators.proximity import DateRange
from cohortlane.operators.report import report_attrition, report_demographics
from cohortlane.operators.sieve import PersonSieve
from cohortlane.operators.summary import (
    SUMMARY_VARIABLES,
    demographic_summary,
    labelled_summary,
    raceth_by_sex,
)
from cohortlane.sources import materialize, write_result

SUSPECTED = "(culture_px or culture_lab) and fluids and antibiotics"
CODED = "coded"
KNOWN_SEXES = (MALE, FEMALE)

# Column titles of the report.
SUSPECTED_TITLE = "Suspected Sepsis N (Col %)"
CONFIRMED_TITLE = "Confirmed Sepsis N (Col %)"


@dataclass(frozen=True, eq=False)
class StudyInputs:
    """Tables and code sets of the study, and its time frame."""

    person: DataFrame
    visits: DataFrame
    adt: DataFrame
    conditions: DataFrame
    procedures: DataFrame
    labs: DataFrame
    drugs: DataFrame
    sepsis_codes: DataFrame
    culture_px_codes: DataFrame
    culture_lab_codes: DataFrame
    fluid_codes: DataFrame
    antibiotic_codes: DataFrame
    index_between: DateRange
    sites: Sequence[str]
    days_pre: int = 7
    days_post: int = 7


def suspected_criteria(inputs: StudyInputs) -> list[Criterion]:
    drugs = EventSource(inputs.drugs, "drug_exposure_start_date", ("drug_concept_id",))
    procedures = EventSource(inputs.procedures, "procedure_date", ("procedure_concept_id",))
    labs = EventSource(inputs.labs, "measurement_date", ("measurement_concept_id",))
    return [
        Criterion("culture_px", procedures, inputs.culture_px_codes),
        Criterion("culture_lab", labs, inputs.culture_lab_codes),
        Criterion("fluids", drugs, inputs.fluid_codes),
        Criterion("antibiotics", drugs, inputs.antibiotic_codes),
    ]


# phenotype name -> rule over the criteria
PHENOTYPES = {"suspected": SUSPECTED, "coded": CODED}


def study_criteria(
    inputs: StudyInputs, phenotypes: Sequence[str] = tuple(PHENOTYPES)
) -> list[Criterion]:
    """The criteria that the phenotypes need; no other event table is read."""
    coded = Criterion(CODED, condition_source(inputs.conditions), inputs.sepsis_codes)
    return [
        *(suspected_criteria(inputs) if "suspected" in phenotypes else []),
        *([coded] if "coded" in phenotypes else []),
    ]


def index_cohort(
    inputs: StudyInputs, by: str = "adt_date", sexes: Sequence[int] | None = KNOWN_SEXES
) -> DataFrame:
    """Eligible persons and dates, by ``adt_date`` or ``visit_start_date``."""
    if by == "adt_date":
        return icu_cohort_adt(inputs.adt, inputs.person, inputs.index_between, sexes=sexes)
    return icu_cohort_visit(
        inputs.adt, inputs.visits, inputs.person, inputs.index_between, sexes=sexes
    )


def study_criteria_by_index(
    inputs: StudyInputs,
    by: str = "adt_date",
    sexes: Sequence[int] | None = KNOWN_SEXES,
    keep_unmatched: bool = False,
    cohort: DataFrame | None = None,
    phenotypes: Sequence[str] = tuple(PHENOTYPES),
    sieve: PersonSieve | None = None,
) -> DataFrame:
    """The criteria of the phenotypes at each index date.

    ``cohort`` is a stored :func:`index_cohort`, if there is one, and ``sieve``
    one of its persons.
    """
    return criteria_by_index(
        index_cohort(inputs, by, sexes) if cohort is None else cohort,
        study_criteria(inputs, phenotypes),
        by,
        inputs.days_pre,
        inputs.days_post,
        inputs.index_between,
        keep_unmatched=keep_unmatched,
        stored_cohort=cohort is not None,
        sieve=sieve,
    )


def study_persons(
    inputs: StudyInputs,
    by: str = "adt_date",
    sexes: Sequence[int] | None = KNOWN_SEXES,
    keep_unmatched: bool = False,
    cohort: DataFrame | None = None,
    phenotypes: Sequence[str] = tuple(PHENOTYPES),
    sieve: PersonSieve | None = None,
) -> DataFrame:
    """One row per person: dates and counts of the phenotypes.

    With ``keep_unmatched`` every person of the index cohort has a row.
    """
    return phenotypes_by_person(
        study_criteria_by_index(inputs, by, sexes, keep_unmatched, cohort, phenotypes, sieve),
        by,
        {name: PHENOTYPES[name] for name in phenotypes},
    )


INDEX_KINDS = ("adt_date", "visit_start_date")


def persons_by_kind(inputs: StudyInputs, keep_unmatched: bool = False) -> DataFrame:
    """``study_persons`` of both index definitions, told apart by ``index_kind``.

    The events are read and reduced once for both. Any sex counts.
    """
    cohorts = [
        index_cohort(inputs, kind, None).select(
            "person_id", F.lit(kind).alias("index_kind"), F.col(kind).alias("index_day")
        )
        for kind in INDEX_KINDS
    ]
    by_index = criteria_by_index(
        reduce(DataFrame.unionByName, cohorts),
        study_criteria(inputs),
        "index_day",
        inputs.days_pre,
        inputs.days_post,
        inputs.index_between,
        keep_unmatched=keep_unmatched,
        by=("index_kind",),
    )
    return phenotypes_by_person(by_index, "index_day", PHENOTYPES, ("index_kind",))


# cohort name -> (rows that belong to it, phenotype its dates refer to)
MEMBERSHIP = {
    "suspected": ("suspected_n_dates > 0", "suspected"),
    "coded": ("coded_n_dates > 0", "coded"),
    "confirmed": ("suspected_n_dates > 0 and coded_n_dates > 0", "coded"),
}


def phenotypes_of(cohorts: Sequence[str]) -> tuple[str, ...]:
    """The phenotypes that decide on membership in the cohorts."""
    return tuple(p for p in PHENOTYPES if any(f"{p}_n_dates" in MEMBERSHIP[c][0] for c in cohorts))


def cohort_members(
    persons: DataFrame, cohorts: Sequence[str], by: Sequence[str] = ()
) -> DataFrame:
    """One row per person and cohort, with first, last and number of index dates."""

    def entry(cohort: str) -> Column:
        condition, phenotype = MEMBERSHIP[cohort]
        return F.when(
            F.expr(condition),
            F.struct(
                F.lit(cohort).alias("cohort"),
                F.col(f"{phenotype}_min_date").alias("min_picu_date"),
                F.col(f"{phenotype}_max_date").alias("max_picu_date"),
                F.col(f"{phenotype}_n_dates").alias("n_picu_dates"),
            ),
        )

    entries = F.array_compact(F.array(*[entry(name) for name in cohorts]))
    return persons.select("person_id", *by, F.inline(entries))


def cohort_demographics(
    inputs: StudyInputs,
    cohorts: Sequence[str],
    by: str = "adt_date",
    sexes: Sequence[int] | None = KNOWN_SEXES,
    persons: DataFrame | None = None,
) -> DataFrame:
    """Members of the cohorts with demographics at their last matching date.

    ``persons`` are stored :func:`study_persons`, if there are any.
    """
    if persons is None:
        persons = study_persons(inputs, by, sexes, phenotypes=phenotypes_of(cohorts))
    return demographics(cohort_members(persons, cohorts), "max_picu_date", inputs.person)


def summary_by_cohort(
    members: DataFrame,
    sites: Sequence[str] | None = None,
    variables: Sequence[str] = SUMMARY_VARIABLES,
    cohorts: Sequence[str] = (),
) -> DataFrame:
    """Labelled demographic summary of each cohort of the members, in one pass.

    ``cohorts`` are reported with a total of 0 if they have no members.
    """
    if sites is not None:
        members = site_subset(members, sites)
    return labelled_summary(
        demographic_summary(
            members,
            variables,
            by=("cohort",),
            one_row_per_person=True,
            groups=[(c,) for c in cohorts],
        )
    )


def raceth_by_sex_all(
    members: DataFrame, sites: Sequence[str], subset_label: str = "Subset"
) -> DataFrame:
    """Cross-tabs of suspected and confirmed sepsis, for all sites and a subset."""
    members = members.where(F.col("cohort").isin("suspected", "confirmed"))
    groups = F.array_compact(
        F.array(
            F.lit("All"), F.when(F.col("site").isin(*sites), F.lit(subset_label))
        )
    )
    placed = members.withColumnRenamed("cohort", "sepsis_type").withColumn(
        "site", F.explode(groups)
    )
    return raceth_by_sex(placed, by=("sepsis_type", "site")).orderBy(
        F.asc_nulls_last("sepsis_type"), F.asc_nulls_last("site"), F.asc_nulls_last("race_cat")
    )


def entry_condition(inputs: StudyInputs) -> Column:
    first, last = inputs.index_between
    return F.col("adt_date").between(F.lit(first), F.lit(last)) & F.col("adt_type_concept_id").isin(
        *ENTRY_TYPES
    )


def attrition_steps(inputs: StudyInputs, persons: DataFrame | None = None) -> list[AttritionStep]:
    """The eight steps of the funnel.

    ``persons`` are stored :func:`study_persons` of the whole index cohort, if
    there are any.
    """
    service = inputs.adt.where(F.col("service_concept_id") == ICU_SERVICE)
    evaluated = study_persons(inputs, keep_unmatched=True) if persons is None else persons
    persons = add_site(evaluated, inputs.person)
    suspected, confirmed = (F.expr(MEMBERSHIP[c][0]) for c in ("suspected", "confirmed"))
    here = F.col("site").isin(*inputs.sites)
    return [
        AttritionStep("1. All patients", inputs.person),
        AttritionStep("2. From 1: Patients with an ICU record", service),
        AttritionStep(
            "3. From 2: ICU admission or transfer in within the study period",
            service,
            entry_condition(inputs),
        ),
        AttritionStep("4. From 3: Aged >=0 and <18 with male or female sex", persons),
        AttritionStep("5. From 4: Suspected sepsis", persons, suspected),
        AttritionStep("6. From 5: Confirmed sepsis", persons, confirmed),
        AttritionStep("5B. From 5: Site subset", persons, suspected & here),
        AttritionStep("6B. From 6: Site subset", persons, confirmed & here),
    ]


def attrition_steps_wide(
    inputs: StudyInputs, linked: DataFrame, same_visit: DataFrame, linked_person: DataFrame
) -> list[AttritionStep]:
    """What has to be evaluated for the wide funnel: see :func:`wide_cuts`.

    ``linked`` are the emergency visits linked to inpatient ones, ``same_visit``
    the persons with suspected sepsis within one of them.
    """
    service = inputs.adt.where(F.col("service_concept_id") == ICU_SERVICE)
    started = visit_index(inputs.adt, inputs.visits, inputs.index_between)
    persons = add_site(persons_by_kind(inputs, keep_unmatched=True), inputs.person)
    by_entry, by_visit = (F.col("index_kind") == kind for kind in INDEX_KINDS)
    in_visit = add_site(same_visit, linked_person)
    suspected, coded = (F.expr(MEMBERSHIP[c][0]) for c in ("suspected", "coded"))
    return [
        AttritionStep("person", inputs.person),
        AttritionStep("service", service),
        AttritionStep("entry", service, entry_condition(inputs)),
        AttritionStep("visit", started),
        AttritionStep("minor at entry", persons, by_entry),
        AttritionStep("minor at visit", persons, by_visit),
        AttritionStep("coded at entry", persons, by_entry & coded),
        AttritionStep("coded at visit", persons, by_visit & coded),
        AttritionStep("suspected at entry", persons, by_entry & suspected),
        AttritionStep("suspected at visit", persons, by_visit & suspected),
        AttritionStep("linked", linked),
        AttritionStep("same visit", in_visit),
    ]


def wide_sets(
    inputs: StudyInputs, linked: DataFrame, same_visit: DataFrame, linked_person: DataFrame
) -> DataFrame:
    """The persons of each step of the wide funnel, by site; persons are numbered first."""
    numbers = PersonNumbers.checked(inputs.person, inputs.adt, linked_person, linked)
    return person_sets(attrition_steps_wide(inputs, linked, same_visit, linked_person), numbers)


def wide_cuts(sites: Sequence[str]) -> list[Cut]:
    """Seventeen lines: by entry date (A, C), visit date (B, D) and linked visits (X)."""
    here = tuple(sites)
    return [
        Cut("1. All patients", (1,)),
        Cut("2A. From 1: Patients with an ICU record", (2,)),
        Cut("3A. From 2A: ICU entry within the study period", (3,)),
        Cut("3B. From 2A: Visit started within the study period", (4,)),
        Cut("4A. From 3A: Aged >=0 and <18 at entry", (5,)),
        Cut("4B. From 3B: Aged >=0 and <18 at visit start", (6,)),
        Cut("5A. From 4A: Sepsis code near entry", (7,)),
        Cut("5B. From 4B: Sepsis code near visit start", (8,)),
        Cut("5C. From 4A: Suspected sepsis near entry", (9,)),
        Cut("5D. From 4B: Suspected sepsis near visit start", (10,)),
        Cut("6A. From 5A: Site subset", (7,), here),
        Cut("6B. From 5B: Site subset", (8,), here),
        Cut("6C. From 5C: Site subset", (9,), here),
        Cut("6D. From 5D: Site subset", (10,), here),
        Cut("2X. From 1: Emergency visit linked to an inpatient visit", (11,)),
        Cut("3X. From 2X: Suspected sepsis in the same visit", (12,)),
        Cut("4X. From 3X: Site subset", (12,), here),
    ]


REPORT_TITLES = {"suspected": SUSPECTED_TITLE, "confirmed": CONFIRMED_TITLE}


def write_study(inputs: StudyInputs, catalog: StudyCatalog) -> list[str]:
    """Run the study and store its tables; returns their names.

    Three intermediates are stored first, because everything else reads them:
    the index cohort, the phenotypes of everybody in it, and the cohorts with
    demographics.
    """
    cohort = materialize(index_cohort(inputs), catalog, "sepsis_index")
    everybody = study_persons(
        inputs, keep_unmatched=True, cohort=cohort, sieve=PersonSieve.checked(cohort)
    )
    persons = materialize(everybody, catalog, "sepsis_persons")
    members = materialize(
        cohort_demographics(inputs, tuple(MEMBERSHIP), persons=persons), catalog, "sepsis_cohorts"
    )
    members = known_sex(members)
    names = tuple(MEMBERSHIP)
    summary = materialize(
        summary_by_cohort(members, cohorts=names), catalog, "sepsis_summary"
    )
    here = materialize(
        summary_by_cohort(members, inputs.sites, cohorts=names), catalog, "sepsis_summary_subset"
    )
    funnel = materialize(
        attrition(attrition_steps(inputs, persons)), catalog, "sepsis_attrition"
    )
    tables = {
        "sepsis_raceth_by_sex": raceth_by_sex_all(members, inputs.sites),
        "sepsis_report_attrition": report_attrition(funnel.orderBy("step")),
        "sepsis_report_demographics": report_demographics(summary, "cohort", REPORT_TITLES),
        "sepsis_report_demographics_subset": report_demographics(here, "cohort", REPORT_TITLES),
    }
    for name, table in tables.items():
        write_result(table, catalog, name)
    stored = ("index", "persons", "cohorts", "summary", "summary_subset", "attrition")
    return [*(f"sepsis_{name}" for name in stored), *tables]


WIDE_VARIABLES = ("site", "raceth_cat", "sex_cat", "age_group")
# Column titles of the wide report.
WIDE_TITLES = {
    "adt_coded": "adt_date confirmed N (%)",
    "visit_coded": "visit_start_date confirmed N (%)",
    "adt_suspected": "adt_date suspected N (%)",
    "visit_suspected": "visit_start_date suspected N (%)",
    "same_visit": "suspected ED/IP N (%)",
}


def wide_summary(
    inputs: StudyInputs,
    same_visit: DataFrame,
    linked_person: DataFrame,
    sites: Sequence[str] | None = None,
) -> DataFrame:
    """Labelled summaries of the five cohorts of the wide report, for all sites or some."""
    columns = ("cohort", "person_id", *WIDE_VARIABLES)
    near = cohort_members(persons_by_kind(inputs), ("coded", "suspected"), ("index_kind",))
    prefix = F.when(F.col("index_kind") == "adt_date", "adt_").otherwise("visit_")
    parts = [
        demographics(near, "max_picu_date", inputs.person).withColumn(
            "cohort", F.concat(prefix, F.col("cohort"))
        ),
        demographics(same_visit, "max_sepsis_date", linked_person).withColumn(
            "cohort", F.lit("same_visit")
        ),
    ]
    everyone = reduce(DataFrame.unionByName, [part.select(*columns) for part in parts])
    return summary_by_cohort(everyone, sites, WIDE_VARIABLES, tuple(WIDE_TITLES))
