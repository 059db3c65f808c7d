"""Eligibility, demographics and categories."""

from datetime import date, timedelta

import pytest

from cohortlane.functions import labels
from cohortlane.operators.cohorts import (
    ADMISSION,
    ICU_SERVICE,
    add_site,
    icu_cohort_adt,
    icu_cohort_visit,
)
from cohortlane.operators.demographics import demographics

INDEX = date(2020, 6, 1)
RANGE = (date(2020, 1, 1), date(2020, 12, 31))
PERSON = (
    "person_id long, site string, birth_date date, gender_concept_id long,"
    " race_concept_id long, ethnicity_concept_id long"
)
ADT = (
    "adt_occurrence_id long, person_id long, visit_occurrence_id long, service_concept_id long,"
    " adt_type_concept_id long, adt_date date"
)


def person_frame(spark, rows):
    return spark.createDataFrame([(*row, 8527, 38003564) for row in rows], PERSON)


def adt_frame(spark, rows):
    full = [(i, p, p * 10, s, t, d) for i, (p, s, t, d) in enumerate(rows)]
    return spark.createDataFrame(full, ADT)


@pytest.mark.parametrize(
    ("days_old", "eligible"),
    [(0, True), (-1, False), (6573, True), (6574, True), (6575, False)],
)
def test_age_bounds(spark, days_old, eligible):
    person = person_frame(spark, [(1, "a", INDEX - timedelta(days=days_old), 8507)])
    adt = adt_frame(spark, [(1, ICU_SERVICE, ADMISSION, INDEX)])
    assert icu_cohort_adt(adt, person, RANGE).count() == int(eligible)


def test_cohort_rules(spark):
    born = date(2015, 1, 1)
    person = person_frame(
        spark, [(1, "a", born, 8507), (2, "a", born, 8532), (3, "a", born, 0), (4, "a", None, 8507)]
    )
    adt = adt_frame(spark, [
        (1, ICU_SERVICE, ADMISSION, INDEX),
        (1, ICU_SERVICE, ADMISSION, INDEX),
        (1, ICU_SERVICE, ADMISSION, date(2021, 1, 1)),
        (1, ICU_SERVICE, 2000000087, date(2020, 7, 1)),
        (2, 2000000079, ADMISSION, INDEX),
        (3, ICU_SERVICE, ADMISSION, INDEX),
        (4, ICU_SERVICE, ADMISSION, INDEX),
        (5, ICU_SERVICE, ADMISSION, INDEX),
    ])
    assert [r.person_id for r in icu_cohort_adt(adt, person, RANGE).collect()] == [1]
    anyone = icu_cohort_adt(adt, person, RANGE, sexes=None).collect()
    assert sorted(r.person_id for r in anyone) == [1, 3]


def test_visit_cohort_ignores_record_types(spark):
    person = person_frame(spark, [(1, "a", date(2015, 1, 1), 8507)])
    adt = adt_frame(spark, [(1, ICU_SERVICE, 2000000087, date(2019, 1, 1))])
    visits = spark.createDataFrame([(10, INDEX)], "visit_occurrence_id long, visit_start_date date")
    assert [r.visit_start_date for r in icu_cohort_visit(adt, visits, person, RANGE).collect()] == [INDEX]


def test_missing_person_is_kept(spark):
    cohort = spark.createDataFrame([(9, INDEX)], "person_id long, max_date date")
    row = demographics(cohort, "max_date", person_frame(spark, [])).first()
    assert (row.site, row.age, row.sex_cat, row.age_group) == (
        None, None, "Other/unknown/ambiguous", "Old or Unknown",
    )
    assert add_site(cohort, person_frame(spark, [])).first().site is None


@pytest.mark.parametrize(
    ("age", "group"),
    [
        (-0.1, "<1"), (0.99, "<1"), (1.0, "01 to 04"), (4.99, "01 to 04"), (5.0, "05 to 09"),
        (10.0, "10 to 13"), (13.99, "10 to 13"), (14.0, "14 to 17"), (18.0, "Old or Unknown"),
        (None, "Old or Unknown"),
    ],
)
def test_age_groups(spark, age, group):
    df = spark.createDataFrame([(age,)], "age double")
    assert df.select(labels.age_group().alias("g")).first().g == group


RACE = {
    8527: ("White_or_Middle_Eastern_North_African", "White_or_Middle_Eastern_North_African"),
    38003615: ("White_or_Middle_Eastern_North_African", "White_or_Middle_Eastern_North_African"),
    8516: ("Black", "Black_or_African_American"),
    8515: ("Asian", "Asian"),
    8657: ("American_Indian_Alaska_Native", "Multiple_or_AI_AN_or_NH_OPI"),
    8557: ("Native_Hawaiian_Other_PI", "Multiple_or_AI_AN_or_NH_OPI"),
    44814659: ("Multiple_Race", "Multiple_or_AI_AN_or_NH_OPI"),
    44814650: ("Unknown_Other_Refuse", "Unknown_Other_Refuse"),
    44814653: ("Unknown_Other_Refuse", "Unknown_Other_Refuse"),
    44814649: ("Unknown_Other_Refuse", "Unknown_Other_Refuse"),
    44814660: ("Unknown_Other_Refuse", "Unknown_Other_Refuse"),
    0: (None, None),
    None: (None, None),
}


def test_race_labels(spark):
    df = spark.createDataFrame([(k,) for k in RACE], "race_concept_id long")
    rows = df.select("race_concept_id", labels.race().alias("a"), labels.race_grouped().alias("b"))
    assert {r[0]: (r.a, r.b) for r in rows.collect()} == RACE


ETHNICITY = {
    38003563: ("Hispanic", "Hispanic"),
    38003564: ("Not_Hispanic", "Not_Hispanic/Other/Unknown"),
    44814660: ("Refuse_Other_Unknown", "Not_Hispanic/Other/Unknown"),
    44814649: ("Refuse_Other_Unknown", "Not_Hispanic/Other/Unknown"),
    0: ("Other/Unknown", "Not_Hispanic/Other/Unknown"),
    None: ("Other/Unknown", "Not_Hispanic/Other/Unknown"),
}


def test_ethnicity_labels(spark):
    df = spark.createDataFrame([(k,) for k in ETHNICITY], "ethnicity_concept_id long")
    rows = df.select(
        "ethnicity_concept_id", labels.ethnicity().alias("a"), labels.ethnicity_short().alias("b")
    )
    assert {r[0]: (r.a, r.b) for r in rows.collect()} == ETHNICITY


@pytest.mark.parametrize(
    ("race", "ethnicity", "expected"),
    [
        (8516, 38003563, "Hispanic"),
        (38003615, 38003564, "NH_White_or_Middle_Eastern_North_African"),
        (8516, 38003564, "NH_Black/AA"),
        (8515, 38003564, "NH_Asian"),
        (8557, 38003564, "NH_Multiple_or_AI_AN_NH_OPI"),
        (8516, 0, "Other/Unknown"),
        (8516, None, "Other/Unknown"),
        (None, 38003564, "Other/Unknown"),
    ],
)
def test_race_ethnicity(spark, race, ethnicity, expected):
    df = spark.createDataFrame([(race, ethnicity)], "race_concept_id long, ethnicity_concept_id long")
    assert df.select(labels.race_ethnicity().alias("x")).first().x == expected


@pytest.mark.parametrize(
    ("sex", "expected"),
    [(8532, "Female"), (8507, "Male"), (0, "Other/unknown/ambiguous"), (None, "Other/unknown/ambiguous")],
)
def test_sex(spark, sex, expected):
    df = spark.createDataFrame([(sex,)], "gender_concept_id long")
    assert df.select(labels.sex().alias("x")).first().x == expected


def test_records_without_a_visit_keep_their_rows(spark):
    from cohortlane.operators.cohorts import ICU_SERVICE, index_events

    adt = spark.createDataFrame(
        [(1, None, ICU_SERVICE), (1, None, ICU_SERVICE), (1, 7, ICU_SERVICE), (2, 8, ICU_SERVICE)],
        "person_id long, visit_occurrence_id long, service_concept_id long",
    )
    visits = spark.createDataFrame(
        [(7, "a", "b"), (None, "c", "d")],
        "visit_occurrence_id long, visit_start_date string, visit_end_date string",
    )
    person = spark.createDataFrame([(1, "z")], "person_id long, birth_date string")
    rows = sorted(
        ((r.person_id, r.visit_occurrence_id or 0, r.visit_start_date or "", r.birth_date or "")
         for r in index_events(adt, visits, person).collect())
    )
    assert rows == [(1, 0, "", "z"), (1, 0, "", "z"), (1, 7, "a", "z"), (2, 8, "", "")]
