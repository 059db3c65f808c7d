"""Linked visits on hand-made rows."""

from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from cohortlane.operators import linkage
from cohortlane.operators.linkage import (
    EMERGENCY,
    EMERGENCY_TO_INPATIENT,
    INPATIENT,
    OBSERVATION,
)

T0 = datetime(2020, 5, 1, 8)
SINCE = date(2009, 1, 1)
VISITS = (
    "visit_occurrence_id long, person_id long, visit_start_datetime timestamp_ntz, visit_start_date date,"
    " visit_concept_id long, preceding_visit_occurrence_id long, visit_end_date date, site string"
)


def visits(spark, *rows):
    full = [
        (v, p, T0 + timedelta(hours=h), (T0 + timedelta(hours=h)).date(), c, before, None, "a")
        for v, p, h, c, before in rows
    ]
    return spark.createDataFrame(full, VISITS)


def facts(spark, *pairs):
    return spark.createDataFrame(list(pairs), "fact_id_1 long, fact_id_2 long")


def linked(spark, rows, pairs=()):
    found = linkage.ed_linked_to_inpatient(visits(spark, *rows), facts(spark, *pairs), SINCE)
    return sorted(
        (r.visit_occurrence_id, r.person_id, (r.visit_start_datetime - T0).total_seconds() / 3600, r.visit_concept_id)
        for r in found.collect()
    )


def test_combined_visits_since_a_date(spark):
    old = -24 * 365 * 12
    rows = [(1, 1, 0, EMERGENCY_TO_INPATIENT, None), (2, 1, old, EMERGENCY_TO_INPATIENT, None)]
    assert linked(spark, rows) == [(1, 1, 0, EMERGENCY_TO_INPATIENT)]


def test_link_through_fact_keeps_the_emergency_visit(spark):
    rows = [(1, 1, 0, EMERGENCY, None), (2, 1, 5, INPATIENT, None), (3, 9, 5, INPATIENT, None)]
    assert linked(spark, rows, [(1, 2), (1, 2)]) == [(1, 1, 0, EMERGENCY)]
    # the inpatient visit has to be of the same person, and inpatient
    assert linked(spark, rows, [(1, 3), (2, 1)]) == []


def test_link_through_preceding_keeps_inpatient_id_and_emergency_date(spark):
    rows = [(1, 1, 0, EMERGENCY, None), (2, 1, 5, OBSERVATION, 1), (3, 9, 5, INPATIENT, 1)]
    assert linked(spark, rows) == [(2, 1, 0, EMERGENCY)]


def test_one_visit_may_be_linked_twice(spark):
    rows = [(1, 1, 0, EMERGENCY, None), (2, 1, 5, EMERGENCY_TO_INPATIENT, 1)]
    assert linked(spark, rows) == [(2, 1, 0, EMERGENCY), (2, 1, 5, EMERGENCY_TO_INPATIENT)]


def event_frame(spark, prefix, rows):
    full = [(p, v, c, T0 + timedelta(hours=h)) for p, v, c, h in rows]
    return spark.createDataFrame(
        full,
        f"person_id long, visit_occurrence_id long, {prefix}_concept_id long,"
        f" {'drug_exposure_start' if prefix == 'drug' else prefix}_datetime timestamp_ntz",
    )


@pytest.fixture(scope="module")
def study(spark):
    v = visits(
        spark,
        (1, 1, 0, EMERGENCY_TO_INPATIENT, None),
        (2, 1, 48, EMERGENCY_TO_INPATIENT, None),
        (3, 2, 0, EMERGENCY_TO_INPATIENT, None),
    )
    codes = spark.createDataFrame(
        [(1, "x"), (2, "y")], "concept_id long, category string"
    )
    return v, linkage.ed_linked_to_inpatient(v, facts(spark, (0, 0)), SINCE), codes


def test_cultures(spark, study):
    _, link, codes = study
    px = event_frame(spark, "procedure", [(1, 1, 1, 2), (1, 2, 1, 3), (2, 3, 1, -1), (2, 3, 9, 5)])
    labs = event_frame(spark, "measurement", [(1, 1, 2, 2), (2, 3, 2, 1)])
    found = linkage.blood_culture_after_ed(link, px, codes, labs, codes).collect()
    # visit 2: taken before that visit started, but after the person's first one
    assert sorted((r.visit_occurrence_id, r.tst_time) for r in found) == [
        (1, 7200), (2, -45 * 3600), (3, 3600),
    ]
    bounded = linkage.blood_culture_after_ed(link, px, codes, labs, codes, 4 * 3600).collect()
    assert sorted((r.visit_occurrence_id, r.tst_time) for r in bounded) == [(1, 7200), (3, 3600)]


def test_cultures_repeated_or_without_keys(spark, study):
    """A culture counts once, whichever source has it and however often; NULL keys match nothing."""
    _, link, codes = study
    twice = [(1, 1, 1, 2), (1, 1, 1, 2)]
    px = event_frame(spark, "procedure", [*twice, (None, 1, 1, 3), (1, None, 1, 3), (1, 1, None, 3), (2, 1, 1, 5)])
    labs = event_frame(spark, "measurement", [*twice, (9, 3, 1, 1), (2, 3, 2, -1)])
    found = linkage.blood_culture_after_ed(link.union(link), px, codes, labs, codes).collect()
    # the culture of person 2 counts for the visit it was recorded in, under that visit's person
    assert sorted((r.person_id, r.visit_occurrence_id, r.tst_time) for r in found) == [(1, 1, 7200), (1, 1, 18000)]


def test_drugs(spark, study):
    _, link, codes = study
    drugs = event_frame(spark, "drug", [(1, 1, 1, 2), (1, 1, 1, 2), (1, 3, 1, 2), (2, 3, 2, -1)])
    found = linkage.drug_in_visit(link, drugs, codes, ("category",)).collect()
    assert sorted((r.visit_occurrence_id, r.tst_time, r.category) for r in found) == [
        (1, 7200, "x"), (3, -3600, "y"),
    ]
    assert linkage.drug_in_visit(link, drugs, codes).count() == 2


def test_same_visit(spark, study):
    v, link, codes = study
    one = codes.where("concept_id = 1")
    two = codes.where("concept_id = 2")
    px = event_frame(spark, "procedure", [(1, 1, 1, 2), (1, 2, 1, 49), (2, 3, 1, 1)])
    labs = event_frame(spark, "measurement", [(9, 9, 9, 0)])
    drugs = event_frame(
        spark, "drug", [(1, 1, 1, 2), (1, 1, 2, 3), (1, 2, 1, 49), (1, 2, 2, 50), (2, 3, 1, 1)]
    )
    both = linkage.same_visit_criteria(link, px, codes, labs, codes, drugs, one, two)
    assert sorted(r.visit_occurrence_id for r in both.collect()) == [1, 2]
    person = spark.createDataFrame([(1, date(2010, 1, 1))], "person_id long, birth_date date")
    latest = linkage.same_visit_phenotype(both, v, person).collect()
    assert [(r.person_id, r.max_sepsis_date) for r in latest] == [(1, date(2020, 5, 3))]
    grown = spark.createDataFrame([(1, date(1990, 1, 1))], "person_id long, birth_date date")
    assert linkage.same_visit_phenotype(both, v, grown).count() == 0


def test_same_visit_with_unknown_keys(spark, study):
    """NULL persons and visits match nothing; a culture counts for its visit whoever's it is."""
    _, link, codes = study
    one, two = codes.where("concept_id = 1"), codes.where("concept_id = 2")
    drugs = event_frame(
        spark, "drug", [(p, v, c, 2) for p, v in ((1, 1), (None, 1), (1, None), (2, 3)) for c in (1, 2)]
    )
    labs = event_frame(spark, "measurement", [(9, 9, 9, 0)])
    none = event_frame(spark, "procedure", [(None, 1, 1, 2), (1, None, 1, 2), (2, 3, 1, -1), (7, 3, 1, 5)])
    gaps = link.unionByName(link.where("person_id = 1").withColumn("visit_occurrence_id", F.lit(None).cast("long")))
    both = linkage.same_visit_criteria(gaps, none, codes, labs, codes, drugs, one, two)
    assert both.collect() == []
    others = event_frame(spark, "procedure", [(2, 1, 1, 2)])
    both = linkage.same_visit_criteria(gaps, others, codes, labs, codes, drugs, one, two)
    assert [tuple(r) for r in both.collect()] == [(1, 1)]
