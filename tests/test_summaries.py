"""Summaries, cross-tabs, funnels and report tables on hand-made rows."""

import random

import pytest
from pyspark.sql import functions as F

from cohortlane.operators.attrition import AttritionStep, attrition
from cohortlane.operators.report import report_attrition, report_demographics, side_by_side
from cohortlane.operators.sets import union_distinct
from cohortlane.operators.summary import (
    age_quantiles,
    demographic_summary,
    demographics_continuous,
    labelled_summary,
    raceth_by_sex,
)

SCHEMA = "person_id long, race_cat2 string, sex_cat string"


def as_dict(summary):
    return {(r.variable, r.category): (r.n_patients, r.percent_of_total) for r in summary.collect()}


def test_null_category_is_not_the_total(spark):
    df = spark.createDataFrame([(1, "a", "x"), (2, None, "x"), (3, None, "y"), (4, "a", "x")], SCHEMA)
    expected = {
        ("Total", "Total"): (4, 100.0),
        ("race_cat2", "a"): (2, 50.0),
        ("race_cat2", None): (2, 50.0),
        ("sex_cat", "x"): (3, 75.0),
        ("sex_cat", "y"): (1, 25.0),
    }
    for unique in (False, True):
        found = demographic_summary(df, ("race_cat2", "sex_cat"), one_row_per_person=unique)
        assert as_dict(found) == expected


def test_total_counts_persons_and_categories_count_rows(spark):
    df = spark.createDataFrame([(1, "a", "x"), (1, "a", "x"), (1, "b", "x"), (2, "a", "x")], SCHEMA)
    found = as_dict(demographic_summary(df, ("race_cat2",)))
    assert found == {
        ("Total", "Total"): (2, 100.0),
        ("race_cat2", "a"): (3, 150.0),
        ("race_cat2", "b"): (1, 50.0),
    }


def test_empty_cohort(spark):
    empty = spark.createDataFrame([], SCHEMA)
    for unique in (False, True):
        rows = labelled_summary(
            demographic_summary(empty, ("race_cat2",), one_row_per_person=unique)
        ).collect()
        assert [(r.variable, r.n_patients, r.percent_of_total) for r in rows] == [("1_Total", 0, None)]


def test_summary_by_group(spark):
    df = spark.createDataFrame(
        [(1, "a", "g"), (2, "b", "g"), (1, "a", "h")], "person_id long, race_cat2 string, grp string"
    )
    rows = demographic_summary(df, ("race_cat2",), by=("grp",)).collect()
    assert {(r.grp, r.variable, r.category, r.n_patients, r.percent_of_total) for r in rows} == {
        ("g", "Total", "Total", 2, 100.0), ("g", "race_cat2", "a", 1, 50.0),
        ("g", "race_cat2", "b", 1, 50.0), ("h", "Total", "Total", 1, 100.0),
        ("h", "race_cat2", "a", 1, 100.0),
    }


@pytest.mark.parametrize(("n", "total", "text"), [(1, 8, "1 (12.5)"), (1, 1, "1 (100)"), (1, 3, "1 (33.33)")])
def test_count_and_percent(spark, n, total, text):
    rows = [(i, "a" if i < n else "b", "x") for i in range(total)]
    labelled = labelled_summary(demographic_summary(spark.createDataFrame(rows, SCHEMA), ("race_cat2",)))
    assert labelled.where("category = 'a'").first().n_pct == text


def test_labels(spark):
    df = spark.createDataFrame([(1, "a", "x")], SCHEMA)
    labelled = labelled_summary(demographic_summary(df, ("race_cat2", "sex_cat")))
    assert {r.variable for r in labelled.collect()} == {"1_Total", "Race", "Sex"}


def test_hot_person_in_summary(spark):
    rows = [(0, "a", "x")] * 1000 + [(p, random.Random(p).choice("ab"), "x") for p in range(1, 2000)]
    found = as_dict(demographic_summary(spark.createDataFrame(rows, SCHEMA), ("race_cat2",)))
    assert found[("Total", "Total")][0] == 2000
    assert found[("race_cat2", "a")][0] + found[("race_cat2", "b")][0] == len(rows)


CROSS = "person_id long, gender_concept_id long, ethnicity_concept_id long, race_cat string"


def test_crosstab_has_all_columns(spark):
    df = spark.createDataFrame([(1, 8532, 38003563, "a"), (2, 0, 38003563, "a"), (3, 8532, 38003563, None)], CROSS)
    rows = {r.race_cat: r.asDict() for r in raceth_by_sex(df).collect()}
    assert rows["a"] == {
        "race_cat": "a", "Hispanic_Female": 1, "Hispanic_Male": 0,
        "Not_Hispanic_or_Refuse_Other_Unknown_Female": 0,
        "Not_Hispanic_or_Refuse_Other_Unknown_Male": 0,
    }
    assert rows[None]["Hispanic_Female"] == 1


def test_crosstab_counts_unknown_ethnicity_as_not_hispanic(spark):
    df = spark.createDataFrame([(1, 8507, None, "a")], CROSS)
    assert raceth_by_sex(df).first()["Not_Hispanic_or_Refuse_Other_Unknown_Male"] == 1


def test_attrition_keeps_order_and_empty_steps(spark):
    df = spark.createDataFrame([(1, "a", "x"), (1, "b", "x"), (2, None, "y")], SCHEMA)
    empty = spark.createDataFrame([], SCHEMA)
    table = attrition([
        AttritionStep("all", df),
        AttritionStep("nobody", empty),
        AttritionStep("with race", df, "race_cat2 is not null"),
        AttritionStep("race b", df, F.col("race_cat2") == "b"),
        AttritionStep("none", df, "sex_cat = 'z'"),
    ])
    assert [tuple(r) for r in table.collect()] == [
        (1, "all", 2), (2, "nobody", 0), (3, "with race", 1), (4, "race b", 1), (5, "none", 0),
    ]
    assert report_attrition(table).columns == ["Description", "Patient Count"]


def test_quantiles_interpolate(spark):
    df = spark.createDataFrame([(float(x),) for x in (1, 2, 3, 4, 10)] + [(None,)], "age double")
    found = [(r.probability, round(r.age, 9)) for r in age_quantiles(df).collect()]
    assert found == [(0.2, 1.8), (0.4, 2.6), (0.6, 3.4), (0.8, 5.2)]


def test_continuous_table(spark):
    df = spark.createDataFrame([(1.0, "a"), (3.0, "a"), (None, None)], "age double, site string")
    rows = {(r.variable, r.category): r for r in demographics_continuous(df, ("site",)).collect()}
    age = rows[("age", None)]
    assert (age.n_patients, age.mean, age.sd) == (2, 2.0, pytest.approx(2**0.5))
    assert (rows[("site", "a")].n_patients, rows[("site", "a")].percent_of_total) == (2, 100.0)
    assert (rows[("site", None)].n_patients, rows[("site", None)].percent_of_total) == (1, None)


def tagged_summary(spark):
    rows = [(1, "a", "s"), (2, None, "s"), (3, "b", "s"), (1, "a", "c"), (2, None, "c")]
    df = spark.createDataFrame(rows, "person_id long, race_cat2 string, cohort string")
    return labelled_summary(demographic_summary(df, ("race_cat2",), by=("cohort",)))


def test_report_side_by_side(spark):
    columns = {"s": "S", "c": "C"}
    plain = report_demographics(tagged_summary(spark), "cohort", columns)
    assert [tuple(r) for r in plain.collect()] == [
        ("Total", "Total", "3 (100)", "2 (100)"),
        ("Race", "a", "1 (33.33)", "1 (50)"),
        ("Race", "b", "1 (33.33)", None),
        ("Race", None, "1 (33.33)", None),
    ]
    safe = report_demographics(tagged_summary(spark), "cohort", columns, null_safe=True)
    assert safe.collect()[-1]["C"] == "1 (50)"


def test_report_leaves_rows_only_other_cohorts_have(spark):
    rows = report_demographics(tagged_summary(spark), "cohort", {"c": "C", "s": "S"}).collect()
    assert ("Race", "b") not in {(r.variable, r.category) for r in rows}


def test_side_by_side_null_keys(spark):
    left = spark.createDataFrame([("a", 1), (None, 2)], "k string, x long")
    right = spark.createDataFrame([("a", 3), (None, 4)], "k string, y long")
    assert {r.k: r.y for r in side_by_side(left, right, ["k"]).collect()} == {"a": 3, None: None}
    assert {r.k: r.y for r in side_by_side(left, right, ["k"], null_safe=True).collect()} == {"a": 3, None: 4}


def test_union_distinct(spark):
    a = spark.createDataFrame([(1, None), (1, None)], "x long, y string")
    b = spark.createDataFrame([(None, 1)], "y string, x long")
    c = spark.createDataFrame([(1,)], "x long")
    assert union_distinct([a, b, c]).count() == 1


def test_groups_without_rows_have_a_total(spark):
    df = spark.createDataFrame([("b", 1, "x")], "cohort string, person_id long, site string")
    rows = demographic_summary(df, ("site",), by=("cohort",), groups=[("a",), ("b",)]).collect()
    totals = {r.cohort: (r.n_patients, r.percent_of_total) for r in rows if r.variable == "Total"}
    assert totals == {"a": (0, None), "b": (1, 100.0)}
    assert {(r.cohort, r.category) for r in rows if r.variable == "site"} == {("b", "x")}


def test_report_with_an_empty_first_cohort(spark):
    df = spark.createDataFrame([("b", 1, "x")], "cohort string, person_id long, sex_cat string")
    summary = labelled_summary(
        demographic_summary(df, ("sex_cat",), by=("cohort",), groups=[("a",), ("b",)])
    )
    rows = report_demographics(summary, "cohort", {"a": "A", "b": "B"}).collect()
    assert [tuple(r) for r in rows] == [("Total", "Total", "0 (NaN)", "1 (100)")]


def test_attrition_leaves_out_rows_without_a_person(spark):
    df = spark.createDataFrame([(1,), (None,), (1,)], "person_id long")
    assert [r.counts for r in attrition([AttritionStep("all", df)]).collect()] == [1]


def test_moments_merge(spark):
    """Parts merge to the moments of all rows, also far from zero."""
    from cohortlane.operators.moments import mean_of, merged, moments, sd_of

    rows = [(i % 7, None if i % 5 == 0 else 1e9 + (i * 37 % 101) / 10) for i in range(500)] + [(9, None)]
    df = spark.createDataFrame(rows, "part int, x double")
    parts = df.groupBy("part").agg(moments("x").alias("m"))
    whole = parts.agg(merged(F.col("m")).alias("m")).select(
        F.col("m.n").alias("n"), mean_of(F.col("m")).alias("mean"), sd_of(F.col("m")).alias("sd")
    )
    got = whole.first()
    want = df.agg(F.count("x"), F.avg("x"), F.stddev_samp("x")).first()
    assert got.n == want[0] == 400
    assert got.mean == pytest.approx(want[1], rel=1e-15) and got.sd == pytest.approx(want[2], rel=1e-9)
    one = df.where("x is null").groupBy("part").agg(moments("x").alias("m")).agg(merged(F.col("m")).alias("m"))
    assert one.select(mean_of(F.col("m")).alias("a"), sd_of(F.col("m")).alias("b")).first() == (None, None)


def test_continuous_table_of_nobody(spark):
    df = spark.createDataFrame([], "age double, site string")
    assert [tuple(r) for r in demographics_continuous(df, ("site",)).collect()] == [("age", None, 0, None, None, None)]


def test_summary_of_repeated_persons_by_cells(spark):
    """A person in several categories is one person and several rows."""
    df = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (2, "b"), (3, None)], "person_id long, site string")
    rows = {(r.variable, r.category): r.n_patients for r in demographic_summary(df, ("site",)).collect()}
    assert rows == {("Total", "Total"): 3, ("site", "a"): 2, ("site", "b"): 2, ("site", None): 1}
