"""What the physical plans must and must not contain."""

import re
from datetime import date

import pytest
from pyspark.sql import functions as F

from cohortlane.operators.phenotype import Criterion, EventSource, phenotype_near_index
from cohortlane.plans import sepsis
from cohortlane.operators.codes import CodeSet
from fixtures.queries import all_queries, study_inputs
from fixtures.views import ClinicalViews

QUERIES = all_queries()


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_cross_join_and_no_python(name, spark, sf_dir):
    plan = plan_of(QUERIES[name](spark, sf_dir))
    for forbidden in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "Pandas"):
        assert forbidden not in plan


@pytest.fixture
def without_automatic_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.fixture
def stored(spark, tmp_path):
    """Plain stored tables, as on a cluster."""
    def table(name, schema):
        path = str(tmp_path / name)
        spark.createDataFrame([], schema).write.parquet(path)
        return spark.read.schema(schema).parquet(path)

    return table


def phenotype(stored, spark):
    cohort = stored("cohort", "person_id long, adt_date date")
    px = EventSource(
        stored("px", "person_id long, concept long, day date, note string"), "day", ("concept",)
    )
    drugs = EventSource(
        stored("drug", "person_id long, concept long, day date, note string"), "day", ("concept",)
    )
    codes = CodeSet.checked(spark.createDataFrame([(1,)], "concept_id long"))
    criteria = [Criterion("px", px, codes), Criterion("iv", drugs, codes), Criterion("abx", drugs, codes)]
    between = (date(2020, 1, 1), date(2020, 12, 31))
    return phenotype_near_index(cohort, criteria, "px and iv and abx", "adt_date", 7, 7, between)


def test_phenotype_plan(spark, stored, without_automatic_broadcast):
    plan = plan_of(phenotype(stored, spark))
    # each event table is read once, with the columns and days needed
    assert len(re.findall(r"FileScan parquet .*concept", plan)) == 2
    assert "note" not in plan
    assert plan.count("GreaterThanOrEqual(day,2019-12-25), LessThanOrEqual(day,2021-01-07)") == 2
    # code sets are broadcast, the person join is not
    assert plan.count("BroadcastHashJoin") == 2
    assert plan.count("SortMergeJoin") == 1
    # index dates by day and then person, events by day and then person; the
    # aggregates after the join reuse its partitioning
    by_person = re.findall(r"Exchange hashpartitioning\((?:person_id|_person)#\d+L?, \d+\)", plan)
    by_day = re.findall(r"Exchange hashpartitioning\(person_id#\d+L?, \w+#\d+, \d+\)", plan)
    assert (len(by_person), len(by_day)) == (2, 2)


def test_study_scans_each_event_table_once(spark, sf_dir):
    plan = plan_of(sepsis.study_persons(study_inputs(ClinicalViews(spark, sf_dir))))
    # records, conditions, procedures, labs, drugs
    assert plan.count("/events.parquet") == 5


@pytest.mark.parametrize(
    ("name", "scans"),
    [("demographic_summary", 2), ("raceth_by_sex", 2), ("age_quantiles", 2), ("labelled_summary", 4)],
)
def test_only_the_criteria_asked_for_are_evaluated(name, scans, spark, sf_dir):
    # records and conditions; or records, procedures, labs and drugs
    assert plan_of(QUERIES[name](spark, sf_dir)).count("/events.parquet") == scans


def test_both_index_definitions_look_at_events_once(spark, sf_dir):
    plan = plan_of(sepsis.persons_by_kind(study_inputs(ClinicalViews(spark, sf_dir))))
    # four events tables as criteria; records by entry, records by visit and the visits' own
    assert plan.count("/events.parquet") == 4 + 3


#: Queries that store something: results, exports, or visits that they read several times.
STORING = {
    "phenotype_near_stored_index", "phenotype_near_sieved_index", "person_sieve_join", "demographic_summary_same_visit",
    "attrition_wide", "funnel_cuts",
    "report_demographics_wide", "report_demographics_wide_site_subset", "blood_culture_after_ed",
    "blood_culture_within_30_days", "same_visit_criteria", "same_visit_phenotype", "result_table_roundtrip",
    "result_csv_roundtrip", "notes_table", "notes_result", "codeset_csv_roundtrip", "cdm_table_scan", "vocabulary_scan",
}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - STORING))
def test_building_a_query_starts_no_job(name, spark, sf_dir):
    tracker, context = spark.sparkContext.statusTracker(), spark.sparkContext
    context.setJobGroup(f"build-{name}", name)
    try:
        QUERIES[name](spark, sf_dir)
        assert not tracker.getJobIdsForGroup(f"build-{name}")
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)


def test_funnels_from_stored_sets_read_nothing_else(spark, sf_dir):
    for name in ("attrition_wide", "funnel_cuts"):
        plan = plan_of(QUERIES[name](spark, sf_dir))
        assert plan.count("FileScan parquet") == 1 and "/sets-" in plan


def test_linked_visits_read_visits_twice(spark, stored):
    from cohortlane.operators.linkage import ed_linked_to_inpatient

    visits = stored(
        "visits",
        "person_id long, visit_occurrence_id long, visit_start_date date, visit_start_datetime timestamp_ntz,"
        " visit_concept_id long, preceding_visit_occurrence_id long",
    )
    related = stored("related", "fact_id_1 long, fact_id_2 long")
    plan = plan_of(ed_linked_to_inpatient(visits, related, date(2000, 1, 1)))
    assert len(re.findall(r"FileScan parquet .*visit_concept_id", plan)) == 2


def test_date_filters_of_a_contract_table_reach_the_scan(spark, tmp_path):
    from cohortlane.config import StudyCatalog
    from cohortlane.sources import cdm_table

    schema = "visit_occurrence_id string, person_id long, visit_start_date date, visit_end_date date, site string"
    spark.createDataFrame([], schema).write.parquet(str(tmp_path / "visit_occurrence"))
    catalog = StudyCatalog(str(tmp_path), str(tmp_path), str(tmp_path), layout="parquet")
    visits = cdm_table(spark, catalog, "visit_occurrence").where("visit_start_date >= date'2020-01-01'")
    assert "GreaterThanOrEqual(visit_start_date,2020-01-01)" in plan_of(visits)
    assert dict(visits.dtypes)["visit_occurrence_id"] == "bigint"


def test_summary_is_one_pass(spark, stored):
    from cohortlane.operators.summary import demographic_summary

    schema = "person_id long, site string, race_cat2 string, eth_cat2 string, sex_cat string, age_group string"
    cohort = stored("members", schema)
    for unique in (False, True):
        plan = plan_of(demographic_summary(cohort, one_row_per_person=unique))
        assert plan.count("FileScan parquet") == 1
        assert plan.count("Expand") == 1
        # rows are reduced to cells before grouping sets multiply them
        assert "HashAggregate" in plan[plan.index("Expand") :]


def test_continuous_table_expands_cells_only(stored):
    from cohortlane.operators.summary import demographics_continuous

    cohort = stored("ages", "age double, site string, age_group string, sex_cat string, raceth_cat string")
    plan = plan_of(demographics_continuous(cohort))
    assert plan.count("FileScan parquet") == 1
    assert plan.count("Expand") == 1
    assert "HashAggregate" in plan[plan.index("Expand") :]


def test_availability_scans_once(spark, sf_dir):
    plan = plan_of(QUERIES["search_availability_by_site"](spark, sf_dir))
    assert plan.count("/events.parquet") == 1


def test_availability_counts_before_it_joins(spark, stored, without_automatic_broadcast):
    from cohortlane.operators.availability import availability_by_site

    events = stored("events", "site string, concept long, day date")
    plan = plan_of(availability_by_site(events, "concept", stored("topics", "topic string, concept_id long")))
    below = plan[re.search("Join", plan).end() :]
    counted = below[: below.index("FileScan")]
    # partial counts, their exchange, whole counts; then the join's own exchange
    assert counted.count("HashAggregate") == 2 and "partial_count" in counted


def test_sieve_needs_no_shuffle_of_events(spark, stored, without_automatic_broadcast):
    from cohortlane.operators.sieve import PersonSieve

    events = stored("events", "person_id long, day date, note string")
    sieve = PersonSieve.checked(spark.range(100).select(F.col("id").alias("person_id")))
    plan = plan_of(sieve.keep(events))
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan


def test_sieve_drops_other_persons_before_the_shuffle(spark):
    """Members all pass; of others about one in nine does."""
    from cohortlane.operators.sieve import PersonSieve

    people = spark.range(5000).select((F.col("id") * 3).alias("person_id"))
    sieve = PersonSieve.checked(people.unionByName(people).union(spark.sql("select cast(null as bigint)")))
    assert sieve.persons == 5000 and sieve.bits == 65536
    events = spark.range(15000).select(F.when(F.col("id") != 7, F.col("id")).alias("person_id"), F.lit("x").alias("note"))
    kept = sieve.keep(events)
    assert kept.columns == events.columns
    ids = {r.person_id for r in kept.collect()}
    assert ids >= set(range(0, 15000, 3)) and None not in ids
    assert len(ids) - 5000 < 10000 / 8
    # a crowded sieve lets more pass, and nobody is lost
    crowded = PersonSieve.checked(people, bits=64)
    assert {r.person_id for r in crowded.keep(events).collect()} >= set(range(0, 15000, 3))
    nobody = PersonSieve.checked(people.limit(0))
    assert nobody.keep(events).count() == 0


def test_stored_buckets_join_without_sort(spark, without_automatic_broadcast):
    from cohortlane.config import StudyCatalog
    from cohortlane.operators.demographics import PERSON_ATTRIBUTES, demographics
    from cohortlane.sources import read_result, write_result

    spark.sql("create schema if not exists sorted_buckets")
    catalog = StudyCatalog("cdm", "vocabulary", "sorted_buckets")
    kinds = {"site": "string", "birth_date": "date"}
    person = spark.range(50).select(
        F.col("id").alias("person_id"),
        *[F.lit(None).cast(kinds.get(c, "bigint")).alias(c) for c in PERSON_ATTRIBUTES],
    )
    cohort = spark.range(0, 50, 3).select(F.col("id").alias("person_id"), F.lit(date(2020, 1, 1)).alias("adt_date"))
    for name, table in (("person", person), ("cohort", cohort)):
        # many small input tasks
        write_result(table.repartition(6), catalog, name, bucket_by=(4, "person_id"))
    joined = demographics(read_result(spark, catalog, "cohort"), "adt_date", read_result(spark, catalog, "person"))
    plan = plan_of(joined)
    assert "SortMergeJoin" in plan and "Exchange" not in plan and "Sort [" not in plan
    assert joined.count() == 17
    spark.sql("drop schema sorted_buckets cascade")


def test_episodes_read_records_once(spark, stored, without_automatic_broadcast):
    from cohortlane.operators.episodes import adt_episodes

    adt = stored(
        "adt",
        "adt_occurrence_id long, person_id long, visit_occurrence_id long, site string,"
        " adt_datetime timestamp_ntz, adt_date date, adt_type_concept_id long",
    )
    visits = stored(
        "visits",
        "visit_occurrence_id long, visit_start_date date, visit_start_datetime timestamp_ntz,"
        " visit_end_date date, visit_end_datetime timestamp_ntz",
    )
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = plan_of(adt_episodes(adt, visits))
        alone = plan_of(adt_episodes(adt))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    assert len(re.findall(r"FileScan parquet .*adt_type_concept_id", plan)) == 1
    assert plan.count("ReusedExchange") == 1
    # guard, pairs of an instant and slices of stays share one partitioning of the
    # records; only condensed records are dealt out anew, by stay
    shuffles = re.findall(r" Exchange hashpartitioning\((.*?), \d+\)", alone)
    assert [re.sub(r"#\d+L?", "", keys) for keys in shuffles] == [
        "person_id, visit_occurrence_id, site", "person_id, _slice",
    ]
    assert not re.search(r"Exchange hashpartitioning\(person_id#\d+L, visit_occurrence_id#\d+L, site#\d+, _slice", plan)


def test_same_visit_criteria_are_one_aggregate(spark, stored, without_automatic_broadcast):
    """By visit and person, first starts, their join, cultures of a visit: four shuffles."""
    from cohortlane.operators import linkage

    linked = stored(
        "linked",
        "person_id long, visit_occurrence_id long, visit_start_datetime timestamp_ntz, visit_concept_id long",
    )

    def events(name, time):
        return stored(name, f"person_id long, visit_occurrence_id long, {name}_concept_id long, {time} timestamp_ntz")

    codes = CodeSet.checked(spark.createDataFrame([(1,)], "concept_id long"))
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = plan_of(linkage.same_visit_criteria(
            linked, events("procedure", "procedure_datetime"), codes,
            events("measurement", "measurement_datetime"), codes,
            events("drug", "drug_exposure_start_datetime"), codes, codes,
        ))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    shuffled = re.findall(r" Exchange hashpartitioning\((?:person_id|visit_occurrence_id)[^)]*\)", plan)
    assert len(shuffled) == 4
    assert plan.count("FileScan parquet") == 3 + 2


@pytest.mark.parametrize("max_seconds", [None, 3600])
@pytest.mark.parametrize("broadcast", ["-1", "10m"])
def test_culture_sources_are_not_united_partition_by_partition(spark, broadcast, max_seconds):
    """Both sources come out of a shuffle by visit; their sorts must not meet in one task."""
    from cohortlane.operators.linkage import blood_culture_after_ed

    def events(prefix, hours):
        rows = spark.range(0, 40, 1, 4).selectExpr(
            "id AS _visit", f"id % 3 AS {prefix}_concept_id",
            f"timestamp_ntz'2020-05-01 08:00:00' + make_dt_interval(0, {hours} * (id % 2)) AS {prefix}_datetime",
        )
        owners = spark.range(0, 40, 1, 4).selectExpr("id AS visit_occurrence_id", "id % 7 AS person_id")
        return rows.hint("merge").join(owners, F.col("_visit") == F.col("visit_occurrence_id")).drop("_visit")

    linked = spark.range(0, 40, 1, 4).selectExpr(
        "id AS visit_occurrence_id", "id % 7 AS person_id", "9203L AS visit_concept_id",
        "timestamp_ntz'2020-05-01 08:00:00' AS visit_start_datetime",
    )
    codes = CodeSet(spark.createDataFrame([(1,)], "concept_id long"), rows=1, bytes=100)
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": broadcast}
    before = {key: spark.conf.get(key) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        found = blood_culture_after_ed(linked, events("procedure", 1), codes, events("measurement", 2), codes, max_seconds)
        todo, unions = [found._jdf.queryExecution().executedPlan()], []
        while todo:
            node = todo.pop()
            if node.nodeName() == "Union":
                unions.append(node.outputPartitioning().toString())
            children = node.children()
            todo += [children.apply(i) for i in range(children.size())]
        assert len(unions) == 1 and unions[0].startswith("UnknownPartitioning")
        expected = {(v, 3600 * h * (v % 2)) for v in range(1, 40, 3) for h in (1, 2)}
        expected = {(v, t) for v, t in expected if max_seconds is None or t <= max_seconds}
        assert sorted((r.visit_occurrence_id, r.tst_time) for r in found.collect()) == sorted(expected)
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def test_bucketed_events_are_not_shuffled(spark, without_automatic_broadcast):
    from cohortlane.config import StudyCatalog
    from cohortlane.operators.phenotype import condition_near_index
    from cohortlane.sources import read_result, write_result

    spark.sql("create schema if not exists bucketed")
    catalog = StudyCatalog("cdm", "vocabulary", "bucketed")
    conditions = spark.createDataFrame(
        [(1, 5, 6, date(2020, 1, 2))],
        "person_id long, condition_concept_id long, condition_source_concept_id long,"
        " condition_start_date date",
    )
    write_result(conditions, catalog, "conditions", bucket_by=(4, "person_id"))
    write_result(
        spark.createDataFrame([(1, date(2020, 1, 1))], "person_id long, adt_date date"),
        catalog,
        "cohort",
        bucket_by=(4, "person_id"),
    )
    codes = CodeSet.checked(spark.createDataFrame([(5,)], "concept_id long"))
    near = condition_near_index(
        codes, read_result(spark, catalog, "cohort"), "adt_date", 7, 7,
        read_result(spark, catalog, "conditions"),
    )
    # only the code set is aggregated across partitions
    by_person = [line for line in plan_of(near).splitlines() if "hashpartitioning(person_id" in line]
    assert not by_person
    assert near.count() == 1
    spark.sql("drop schema bucketed cascade")


def test_shuffled_code_joins_are_salted(spark, stored, without_automatic_broadcast):
    from cohortlane.operators import codes as code_ops

    events = stored("events", "person_id long, concept long, day date")
    frame = spark.createDataFrame([(1,)], "concept_id long")
    codes = CodeSet(frame, rows=10**9, bytes=10**11, spread=16)
    plan = plan_of(code_ops.match_codes(events, "concept", codes))
    assert re.search(r"hashpartitioning\(concept#\d+L, _salt#\d+L", plan)


def test_raw_rows_near_an_index_date_are_joined_by_bucket(spark, stored, without_automatic_broadcast):
    from cohortlane.operators.proximity import near_index

    events = stored("events", "person_id long, day date, note string")
    cohort = stored("cohort", "person_id long, adt_date date")
    plan = plan_of(near_index(events, "day", cohort, "adt_date", 7, 7))
    assert re.search(r"hashpartitioning\(person_id#\d+L, _event_bucket#\d+L", plan)
