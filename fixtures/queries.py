"""One query per operator, over the clinical views of a test-data folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlane.config import StudyCatalog
from cohortlane.operators import availability, codes, linkage
from cohortlane.operators.attrition import attrition
from cohortlane.operators.cohorts import (
    ICU_SERVICE,
    add_site,
    count_patients,
    icu_admits,
    icu_cohort_adt,
    icu_cohort_visit,
    index_events,
    latest_visit_by_site,
    site_subset,
)
from cohortlane.operators.demographics import demographics, known_sex
from cohortlane.operators.episodes import adt_episodes, max_records_per_instant
from cohortlane.operators.person_sets import Cut, funnel_of
from cohortlane.operators.phenotype import (
    EventSource,
    Criterion,
    condition_near_index,
    criteria_by_index,
    phenotype_near_index,
    two_level_cohort,
)
from cohortlane.operators.proximity import near_index, restrict_to_persons
from cohortlane.operators.report import report_attrition, report_demographics, side_by_side
from cohortlane.operators.sets import union_distinct
from cohortlane.operators.sieve import PersonSieve
from cohortlane.operators.summary import (
    age_quantiles,
    demographic_summary,
    demographics_continuous,
    labelled_summary,
    raceth_by_sex,
)
from cohortlane.plans import sepsis
from cohortlane.plans.sepsis import StudyInputs
from cohortlane.sources import (
    cdm_table,
    get_result,
    materialize,
    read_codeset,
    read_notes,
    stage,
    stage_path,
    vocabulary_table,
    write_csv,
)
from cohortlane.sources.codesets import BYTE_ORDER_MARK
from fixtures.views import DAYS, INDEX_RANGE, LINKED_SINCE, SITES, ClinicalViews

Query = Callable[[SparkSession, str], DataFrame]
_registry: dict[str, Callable[[ClinicalViews], DataFrame]] = {}

SUBSET_LABEL = "Asia and Europe"


def _query(build: Callable[[ClinicalViews], DataFrame]):
    _registry[build.__name__] = build
    return build


def study_inputs(v: ClinicalViews) -> StudyInputs:
    return StudyInputs(
        person=v.person,
        visits=v.visits,
        adt=v.adt,
        conditions=v.conditions,
        procedures=v.procedures,
        labs=v.labs,
        drugs=v.drugs,
        sepsis_codes=v.dx_sepsis,
        culture_px_codes=v.px_blood_culture,
        culture_lab_codes=v.lab_blood_culture,
        fluid_codes=v.iv_fluids,
        antibiotic_codes=v.med_broad_spec_abx,
        index_between=INDEX_RANGE,
        sites=SITES,
        days_pre=DAYS,
        days_post=DAYS,
    )


def _members(v: ClinicalViews, *cohorts: str) -> DataFrame:
    return sepsis.cohort_demographics(study_inputs(v), cohorts)


# cohorts


@_query
def latest_visit_by_site_(v):
    return latest_visit_by_site(v.visit_occurrence)


@_query
def index_events_(v):
    return index_events(v.adt_occurrence, v.visits, v.person)


@_query
def icu_cohort_adt_(v):
    return icu_cohort_adt(v.adt, v.person, INDEX_RANGE)


@_query
def icu_cohort_visit_(v):
    return icu_cohort_visit(v.adt, v.visits, v.person, INDEX_RANGE)


@_query
def icu_admits_(v):
    return icu_admits(v.adt_occurrence, INDEX_RANGE)


@_query
def patient_count(v):
    return count_patients(v.adt.where(F.col("service_concept_id") == ICU_SERVICE))


@_query
def person_site_lookup(v):
    cohort = icu_cohort_adt(v.adt, v.person, INDEX_RANGE)
    return add_site(cohort.select("person_id").distinct(), v.person)


# phenotypes


def _condition(v, by: str, days: int = DAYS) -> DataFrame:
    cohort = sepsis.index_cohort(study_inputs(v), by)
    return condition_near_index(
        v.dx_sepsis, cohort, by, days, days, v.conditions, INDEX_RANGE
    )


def _suspected(v, by: str, days: int = DAYS) -> DataFrame:
    inputs = study_inputs(v)
    return phenotype_near_index(
        sepsis.index_cohort(inputs, by),
        sepsis.suspected_criteria(inputs),
        sepsis.SUSPECTED,
        by,
        days,
        days,
        INDEX_RANGE,
    )


@_query
def condition_near_index_(v):
    return _condition(v, "adt_date")


@_query
def condition_near_index_1day(v):
    return _condition(v, "adt_date", days=1)


@_query
def condition_near_index_visit(v):
    return _condition(v, "visit_start_date")


@_query
def phenotype_near_index_(v):
    return _suspected(v, "adt_date")


@_query
def phenotype_near_index_1day(v):
    return _suspected(v, "adt_date", days=1)


@_query
def phenotype_near_index_visit(v):
    return _suspected(v, "visit_start_date")


@_query
def phenotype_near_stored_index(v):
    """With the cohort stored first: other persons' events go before the shuffle."""
    inputs = study_inputs(v)
    cohort = stage(sepsis.index_cohort(inputs), "index")
    by_index = sepsis.study_criteria_by_index(inputs, cohort=cohort)
    return by_index.where(sepsis.SUSPECTED).select("person_id", "adt_date")


@_query
def phenotype_near_sieved_index(v):
    """With a sieve of the stored cohort's persons in place of a join with them."""
    inputs = study_inputs(v)
    cohort = stage(sepsis.index_cohort(inputs), "index")
    by_index = sepsis.study_criteria_by_index(inputs, cohort=cohort, sieve=PersonSieve.checked(cohort))
    return by_index.where(sepsis.SUSPECTED).select("person_id", "adt_date")


def _two_level(v, level: str) -> DataFrame:
    by_index = sepsis.study_criteria_by_index(study_inputs(v))
    both = two_level_cohort(by_index, "adt_date", sepsis.SUSPECTED, sepsis.CODED, level)
    return known_sex(demographics(both, "max_date", v.person)).select(
        "person_id", "min_date", "max_date", "n_dates", "sex_cat"
    )


@_query
def two_level_cohort_(v):
    return _two_level(v, "person")


@_query
def two_level_cohort_same_index(v):
    return _two_level(v, "index")


# demographics and summaries


@_query
def demographics_(v):
    cohort = _condition(v, "adt_date").withColumnRenamed("max_date", "max_picu_date")
    return demographics(cohort, "max_picu_date", v.person)


@_query
def demographic_summary_(v):
    return demographic_summary(known_sex(_members(v, "coded")), one_row_per_person=True)


@_query
def demographic_summary_by_index(v):
    """Several rows per person: the total counts persons, the categories rows."""
    cohort = icu_cohort_adt(v.adt, v.person, INDEX_RANGE)
    return demographic_summary(demographics(cohort, "adt_date", v.person))


@_query
def demographic_summary_site_subset(v):
    here = site_subset(known_sex(_members(v, "coded")), SITES)
    return demographic_summary(here, one_row_per_person=True)


@_query
def demographic_summary_two_level(v):
    return demographic_summary(known_sex(_members(v, "confirmed")), one_row_per_person=True)


@_query
def demographic_summary_same_visit(v):
    cohort = demographics(_same_visit_persons(v), "max_sepsis_date", v.person_star)
    return demographic_summary(cohort, sepsis.WIDE_VARIABLES, one_row_per_person=True)


@_query
def study_cohorts(v):
    return _members(v, "suspected", "coded", "confirmed").select(
        "cohort", "person_id", "min_picu_date", "max_picu_date", "n_picu_dates", "site", "age_group"
    )


@_query
def labelled_summary_(v):
    return labelled_summary(
        demographic_summary(known_sex(_members(v, "suspected")), one_row_per_person=True)
    )


@_query
def raceth_by_sex_(v):
    return raceth_by_sex(_members(v, "coded"))


@_query
def raceth_by_sex_all(v):
    return sepsis.raceth_by_sex_all(_members(v, "suspected", "confirmed"), SITES, SUBSET_LABEL)


@_query
def age_quantiles_(v):
    return age_quantiles(_members(v, "coded"))


@_query
def demographics_continuous_(v):
    table = demographics_continuous(_members(v, "coded"))
    return table.withColumns({"mean": F.round("mean", 6), "sd": F.round("sd", 6)})


# funnel and reports


@_query
def attrition_(v):
    return attrition(sepsis.attrition_steps(study_inputs(v)))


def _linked(v) -> DataFrame:
    return linkage.ed_linked_to_inpatient(v.visit_star, v.fact_relationship, LINKED_SINCE)


def _stored_linked(v) -> DataFrame:
    """Linked visits that a query reads several times are worked out once."""
    if v.linked is None:
        v.linked = stage(_linked(v), "linked")
    return v.linked


def _wide_fluids(v):
    return v.codes(0, 49)


def _wide_antibiotics(v):
    return v.codes(20, 79)


def _wide_cultures(v):
    return v.codes(0, 49)


def _same_visit(v) -> DataFrame:
    return linkage.same_visit_criteria(
        _stored_linked(v),
        v.procedure_star,
        _wide_cultures(v),
        v.measurement_star,
        _wide_cultures(v),
        v.drug_star,
        _wide_fluids(v),
        _wide_antibiotics(v),
    )


def _same_visit_persons(v) -> DataFrame:
    return linkage.same_visit_phenotype(_same_visit(v), v.visit_star, v.person_star)


@_query
def attrition_wide(v):
    return funnel_of(_wide_sets(v), sepsis.wide_cuts(SITES))


def _wide_sets(v) -> DataFrame:
    return stage(sepsis.wide_sets(study_inputs(v), _stored_linked(v), _same_visit_persons(v), v.person_star), "sets")


@_query
def funnel_cuts(v):
    """Other cuts through the same stored sets: persons in two steps, single sites."""
    return funnel_of(_wide_sets(v), [
        Cut("Coded and suspected near entry", (7, 9)),
        Cut("Coded and suspected near entry, asia", (7, 9), ("asia",)),
        Cut("Coded near entry and near visit start, europe or africa", (7, 8), ("europe", "africa")),
        Cut("ICU record and linked emergency visit", (2, 11)),
        Cut("Nowhere", (1, 7), ("atlantis",)),
    ])


@_query
def report_attrition_(v):
    return report_attrition(attrition_(v))


@_query
def report_demographics_(v):
    return _report(v)


def _report(v, sites=None) -> DataFrame:
    cohorts = ("suspected", "confirmed")
    summary = sepsis.summary_by_cohort(_members(v, *cohorts), sites, cohorts=cohorts)
    return report_demographics(summary, "cohort", sepsis.REPORT_TITLES)


@_query
def report_demographics_site_subset(v):
    return _report(v, SITES)


@_query
def report_demographics_empty_cohort(v):
    """A subset in which nobody belongs to either cohort still has its totals."""
    return _report(v, ("St. John's",))


def _report_wide(v, sites=None) -> DataFrame:
    summary = sepsis.wide_summary(study_inputs(v), _same_visit_persons(v), v.person_star, sites)
    return report_demographics(summary, "cohort", sepsis.WIDE_TITLES, without=())


@_query
def report_demographics_wide(v):
    return _report_wide(v)


@_query
def report_demographics_wide_site_subset(v):
    return _report_wide(v, SITES)


# concept search and availability


@_query
def concept_search_all(v):
    return availability.concept_search(v.concept, ["red", "widget"])


@_query
def concept_search_any(v):
    return availability.concept_search(v.concept, ["red|blue", "widget|ring"])


@_query
def concept_search_excluding(v):
    return availability.concept_search(v.concept, ["small"], ["gear"])


@_query
def codeset_availability_by_site(v):
    topics = availability.topic_codes({"blood culture": v.px_blood_culture})
    return availability.availability_by_site(
        v.procedure_occurrence, "procedure_concept_id", topics
    )


SEARCHES = {
    "red or blue": (["red|blue"], []),
    "widget or ring": (["widget|ring"], []),
    "small, no gear": (["small"], ["gear"]),
}


@_query
def search_availability_by_site(v):
    return availability.availability_by_site(
        v.measurement_labs,
        "measurement_concept_id",
        availability.search_topics(v.concept, SEARCHES),
    )


@_query
def observed_concepts(v):
    found = availability.concept_search(v.concept, ["red|blue", "widget|ring"])
    return availability.observed_concepts(v.labs, "measurement_concept_id", found)


@_query
def observed_concepts_by_topic(v):
    return availability.observed_concepts_by_topic(
        v.labs, "measurement_concept_id", v.concept, SEARCHES
    )


# linked visits


@_query
def ed_visits(v):
    return linkage.ed_visits(v.visit_star)


@_query
def inpatient_visits(v):
    return linkage.inpatient_visits(v.visit_star)


@_query
def ed_linked_to_inpatient(v):
    return _linked(v)


def _cultures_after_ed(v, max_seconds: int | None = None) -> DataFrame:
    return linkage.blood_culture_after_ed(
        _stored_linked(v),
        v.procedure_star,
        _wide_cultures(v),
        v.measurement_star,
        _wide_cultures(v),
        max_seconds,
    )


@_query
def blood_culture_after_ed(v):
    return _cultures_after_ed(v)


@_query
def blood_culture_within_30_days(v):
    return _cultures_after_ed(v, 30 * 86_400)


@_query
def drug_in_visit(v):
    return linkage.drug_in_visit(_linked(v), v.drug_star, _wide_antibiotics(v))


@_query
def drug_in_visit_with_attributes(v):
    return linkage.drug_in_visit(
        _linked(v), v.drug_star, _wide_fluids(v), ("concept_code", "vocabulary_id")
    )


@_query
def same_visit_criteria(v):
    return _same_visit(v)


@_query
def same_visit_phenotype(v):
    return _same_visit_persons(v)


# stays


@_query
def adt_tie_guard(v):
    return max_records_per_instant(v.adt)


@_query
def adt_episodes_(v):
    service = v.adt_occurrence.where(F.col("service_concept_id") == ICU_SERVICE)
    return adt_episodes(service, v.visits)


@_query
def adt_episodes_without_visits(v):
    return adt_episodes(v.adt_occurrence)


# single operators


@_query
def codeset_semi_join(v):
    return codes.match_codes(v.drug_exposure, "drug_concept_id", v.iv_fluids)


@_query
def codeset_join_fanout(v):
    twice = v.iv_fluids.unionByName(v.med_broad_spec_abx)
    return codes.match_codes(v.drug_exposure, "drug_concept_id", twice, dedupe=False)


@_query
def codeset_attribute_join(v):
    return codes.match_codes_with_attributes(
        v.drug_exposure, "drug_concept_id", v.iv_fluids, ("concept_name", "vocabulary_id")
    )


@_query
def source_code_anti_join(v):
    return codes.match_source_only(
        v.condition_occurrence,
        "condition_concept_id",
        "condition_source_concept_id",
        v.dx_sepsis,
    )


@_query
def interval_join(v):
    cohort = icu_cohort_adt(v.adt, v.person, INDEX_RANGE)
    coded = codes.match_codes(v.conditions, "condition_concept_id", v.dx_sepsis)
    return near_index(coded, "condition_start_date", cohort, "adt_date", 2, 5, INDEX_RANGE).select(
        "condition_occurrence_id", "person_id", "condition_start_date", "adt_date"
    )


def _flags(v, names: tuple[str, ...]) -> DataFrame:
    inputs = study_inputs(v)
    wanted = [c for c in sepsis.study_criteria(inputs) if c.name in names]
    return criteria_by_index(
        sepsis.index_cohort(inputs), wanted, "adt_date", DAYS, DAYS, INDEX_RANGE
    )


@_query
def key_union_full_join(v):
    flags = _flags(v, ("culture_px", "culture_lab"))
    return flags.where("culture_px or culture_lab").select("person_id", "adt_date")


@_query
def criteria_intersection(v):
    flags = _flags(v, ("fluids", "antibiotics"))
    return flags.where("fluids and antibiotics").select("person_id", "adt_date")


@_query
def day_bucket_join(v):
    inputs = study_inputs(v)
    coded = Criterion(
        "coded",
        EventSource(v.conditions, "condition_start_date", ("condition_concept_id",)),
        v.dx_sepsis,
    )
    return criteria_by_index(
        sepsis.index_cohort(inputs), [coded], "adt_date", 2, 5, INDEX_RANGE, day_buckets=True
    ).select("person_id", "adt_date")


@_query
def person_sieve_join(v):
    """Conditions of sepsis among the persons of a stored cohort."""
    cohort = stage(sepsis.index_cohort(study_inputs(v)).select("person_id"), "persons")
    coded = codes.match_codes(v.conditions, "condition_concept_id", v.dx_sepsis)
    return restrict_to_persons(coded, cohort, PersonSieve.checked(cohort)).select(
        "condition_occurrence_id", "person_id", "condition_start_date"
    )


@_query
def person_semi_join(v):
    coded = _condition(v, "adt_date")
    return restrict_to_persons(coded, _suspected(v, "adt_date"))


@_query
def union_distinct_by_name(v):
    return union_distinct([
        v.px_blood_culture.select("concept_id", "concept_name"),
        v.iv_fluids.select("concept_name", "concept_id", "concept_code"),
        v.lab_blood_culture.select("concept_id", "concept_name"),
    ])


def _by_race(v, sex: str) -> DataFrame:
    cohort = demographics(
        icu_cohort_adt(v.adt, v.person, INDEX_RANGE), "adt_date", v.person
    )
    return cohort.where(F.col("sex_cat") == sex).groupBy("race_cat2", "eth_cat2").agg(
        F.count("*").alias(f"n_{sex.lower()}")
    )


@_query
def null_key_left_join(v):
    return side_by_side(_by_race(v, "Female"), _by_race(v, "Male"), ["race_cat2", "eth_cat2"])


@_query
def null_key_left_join_null_safe(v):
    return side_by_side(
        _by_race(v, "Female"), _by_race(v, "Male"), ["race_cat2", "eth_cat2"], null_safe=True
    )


# sources and sinks


def _stored_as_text(v, name: str, df: DataFrame) -> StudyCatalog:
    """A stored table whose ids are text, and which has a column too many."""
    folder = stage_path(v.spark, "tables")
    ids = {c: F.col(c).cast("string") for c in df.columns if c.endswith("_id") and c != "vocabulary_id"}
    df.withColumns(ids).withColumn("loaded", F.lit(True)).write.parquet(f"{folder}/{name}")
    return StudyCatalog(cdm=folder, vocabulary=folder, results=folder, layout="parquet")


@_query
def cdm_table_scan(v):
    catalog = _stored_as_text(v, "visit_occurrence", v.visit_occurrence)
    visits = cdm_table(v.spark, catalog, "visit_occurrence")
    return visits.where(F.col("visit_start_date").between(F.lit(INDEX_RANGE[0]), F.lit(INDEX_RANGE[1])))


@_query
def vocabulary_scan(v):
    catalog = _stored_as_text(v, "concept", v.concept)
    return vocabulary_table(v.spark, catalog).where(F.col("concept_id") < 50)


@_query
def result_table_roundtrip(v):
    folder = stage_path(v.spark, "results")
    catalog = StudyCatalog(cdm=v.sf_dir, vocabulary=v.sf_dir, results=folder, layout="parquet")
    return materialize(_condition(v, "adt_date"), catalog, "coded_adt")


@_query
def result_csv_roundtrip(v):
    """A summary exported as CSV and read from there."""
    folder = stage_path(v.spark, "exports")
    catalog = StudyCatalog(cdm=v.sf_dir, vocabulary=v.sf_dir, results=folder, layout="parquet")
    summary = labelled_summary_(v)
    write_csv(summary, f"{folder}/summary.csv", single_file=True)
    schema = ", ".join(f"{name} {kind}" for name, kind in summary.dtypes)
    return get_result(v.spark, catalog, "summary", csv_folder=folder, schema=schema)


@_query
def notes_table(v):
    """Free text with awkward headers: out as CSV, back under clean names."""
    path = stage_path(v.spark, "notes")
    notes = v.concept.select(
        F.col("concept_name").alias("Component Name (all)"),
        F.concat_ws(", ", "concept_code", "vocabulary_id").alias("Notes on data-availability"),
    )
    write_csv(notes, path)
    return read_notes(v.spark, path)


@_query
def notes_result(v):
    """Notes from a file with a byte order mark, stored as a result table."""
    path = stage_path(v.spark, "notes")
    notes = v.concept.select(
        F.col("concept_name").alias(f"{BYTE_ORDER_MARK}Component Name"),
        F.concat(F.lit('said "'), "concept_code", F.lit('",\nthen '), "vocabulary_id").alias("Notes"),
    )
    # every part has the mark in its header, and is written and read by a task of its own
    write_csv(notes, path)
    catalog = StudyCatalog(v.sf_dir, v.sf_dir, stage_path(v.spark, "results"), layout="parquet")
    return materialize(read_notes(v.spark, path), catalog, "notes")


@_query
def codeset_csv_roundtrip(v):
    path = stage_path(v.spark, "codes")
    write_csv(v.med_broad_spec_abx, path, single_file=True)
    return read_codeset(v.spark, path)


def all_queries() -> dict[str, Query]:
    def bind(build):
        return lambda spark, sf_dir: build(ClinicalViews(spark, sf_dir))

    # a trailing underscore only avoids the name of the operator called
    return {name.rstrip("_"): bind(build) for name, build in _registry.items()}
