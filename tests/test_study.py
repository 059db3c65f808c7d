"""Relations that have to hold between the tables of the study."""

import pytest

from cohortlane.operators.attrition import attrition
from cohortlane.operators.demographics import known_sex
from cohortlane.operators.summary import demographic_summary, raceth_by_sex
from cohortlane.plans import sepsis
from compare import spark_rows
from fixtures.literal import literal_query
from fixtures.queries import all_queries, study_inputs
from fixtures.scale import scaled_copy
from fixtures.views import ClinicalViews


@pytest.fixture(scope="module")
def inputs(spark, sf_dir):
    return study_inputs(ClinicalViews(spark, sf_dir))


def test_funnel_never_grows(inputs):
    counts = {r.descriptions.split()[0]: r.counts for r in attrition(sepsis.attrition_steps(inputs)).collect()}
    chain = [counts[k] for k in ("1.", "2.", "3.", "4.", "5.", "6.")]
    assert chain == sorted(chain, reverse=True)
    assert counts["5B."] <= counts["5."] and counts["6B."] <= counts["6."]
    assert counts["6."] > 0


def test_categories_add_up_to_the_cohort(inputs):
    members = known_sex(sepsis.cohort_demographics(inputs, ("suspected",)))
    rows = demographic_summary(members).collect()
    total = next(r.n_patients for r in rows if r.variable == "Total")
    assert total == members.count()
    for variable in {r.variable for r in rows}:
        assert sum(r.n_patients for r in rows if r.variable == variable) == total


def test_crosstab_adds_up_to_the_cohort(inputs):
    members = sepsis.cohort_demographics(inputs, ("coded",))
    cells = raceth_by_sex(members).collect()
    assert sum(sum(r[1:]) for r in cells) == known_sex(members).count()


def test_repeated_records_change_nothing(inputs):
    from dataclasses import replace

    doubled = replace(
        inputs,
        adt=inputs.adt.union(inputs.adt),
        conditions=inputs.conditions.union(inputs.conditions),
        drugs=inputs.drugs.union(inputs.drugs),
    )
    def rows(x):
        return sorted(map(tuple, sepsis.study_persons(x).collect()))

    assert rows(inputs) == rows(doubled)


def test_confirmed_is_suspected_and_coded(inputs):
    persons = {}
    for name in ("suspected", "coded", "confirmed"):
        members = sepsis.cohort_members(sepsis.study_persons(inputs), (name,))
        persons[name] = {r.person_id for r in members.collect()}
    assert persons["confirmed"] == persons["suspected"] & persons["coded"]


def test_stored_study(spark, inputs, tmp_path):
    from cohortlane.config import StudyCatalog
    from cohortlane.sources import read_result

    catalog = StudyCatalog("", "", str(tmp_path / "results"), "parquet")
    names = sepsis.write_study(inputs, catalog)
    assert all(read_result(spark, catalog, name).count() > 0 for name in names)

    def rows(df):
        return sorted(map(str, df.collect()))

    direct = attrition(sepsis.attrition_steps(inputs))
    assert rows(read_result(spark, catalog, "sepsis_attrition")) == rows(direct)
    members = sepsis.cohort_demographics(inputs, ("suspected", "confirmed"))
    assert rows(read_result(spark, catalog, "sepsis_raceth_by_sex")) == rows(
        sepsis.raceth_by_sex_all(members, inputs.sites)
    )


@pytest.mark.parametrize("name", ["report_demographics", "adt_episodes", "same_visit_phenotype"])
def test_literal_plans_give_the_same_rows(name, spark, sf_dir):
    ours = spark_rows(all_queries()[name](spark, sf_dir))
    assert spark_rows(literal_query(spark, sf_dir, name)) == ours


def test_scaled_copy(spark, tmp_path, sf_dir):
    scaled_copy(spark, sf_dir, str(tmp_path), 3)
    events = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    copy = spark.read.parquet(str(tmp_path / "events.parquet"))
    assert copy.count() == 3 * events == copy.select("event_id").distinct().count()
    assert copy.where("user_id = 1").count() > events * 0.9
