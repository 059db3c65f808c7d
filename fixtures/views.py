"""Clinical tables derived from the synthetic parquet tables.

The synthetic data has customers, orders and an event stream, not patients.
``ClinicalViews`` reads it as a clinical data model: customers are persons,
their events are admission/transfer records, conditions, procedures, labs and
drug exposures, orders are visits and lines are what happens in a visit.
"""

from __future__ import annotations

from datetime import date
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

INDEX_RANGE = (date(2024, 1, 1), date(2024, 1, 28))
LINKED_SINCE = date(1996, 1, 1)
SITES = ("asia", "europe")
DAYS = 7

ADT_TYPES = {
    "signup": 2000000083,
    "click": 2000000085,
    "error": 2000000084,
    "purchase": 2000000086,
    "view": 2000000087,
}
RACES = (8527, 38003615, 8516, 8515, 8657, 8557, 44814659, 44814650, 44814653, 0)
ETHNICITIES = (38003563, 38003564, 38003564, 44814660, 0)
VISIT_KINDS = {
    "1-URGENT": 9203,
    "2-HIGH": 9201,
    "3-MEDIUM": 2000000048,
    "4-NOT SPECIFIED": 2000000088,
    "5-LOW": 9202,
}
# Declared, so that opening a table reads no file footers.
TABLE_SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double,"
    " o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int,"
    " l_quantity double, l_extendedprice double, l_discount double, l_tax double,"
    " l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
}
DOMAINS = {"A": "procedure", "R": "measurement", "N": "drug"}


def _by_position(index: Column, values) -> Column:
    return F.element_at(F.array(*[F.lit(v).cast("bigint") for v in values]), index + 1)


def _by_key(key: Column, mapping: dict) -> Column:
    chain = F
    for k, v in mapping.items():
        chain = chain.when(key == k, F.lit(v))
    return chain


class ClinicalViews:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir
        self.linked: DataFrame | None = None

    def _table(self, name: str) -> DataFrame:
        path = f"{self.sf_dir}/{name}.parquet"
        return self.spark.read.schema(TABLE_SCHEMAS[name]).parquet(path)

    def _person(self, youngest: str) -> DataFrame:
        key, race = F.col("c_custkey"), F.col("c_custkey") % 11
        sites = (
            self._table("nation")
            .join(self._table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
            .select("n_nationkey", F.lower("r_name").alias("site"))
        )
        gender = F.when(key % 10 <= 4, 8532).when(key % 10 <= 8, 8507).otherwise(0)
        return (
            self._table("customer")
            .join(sites, F.col("c_nationkey") == F.col("n_nationkey"))
            .select(
                key.cast("bigint").alias("person_id"),
                "site",
                F.date_sub(F.lit(youngest).cast("date"), ((key * 617) % 8000).cast("int")).alias(
                    "birth_date"
                ),
                gender.cast("bigint").alias("gender_concept_id"),
                F.when(race < 10, _by_position(F.least(race, F.lit(9)).cast("int"), RACES)).alias(
                    "race_concept_id"
                ),
                _by_position(F.col("c_nationkey") % 5, ETHNICITIES).alias(
                    "ethnicity_concept_id"
                ),
            )
        )

    @cached_property
    def person(self) -> DataFrame:
        return self._person("2024-01-15")

    @cached_property
    def person_star(self) -> DataFrame:
        return self._person("2001-08-01")

    @cached_property
    def _events(self) -> DataFrame:
        user, ts = F.col("user_id"), F.col("ts")
        return self._table("events").select(
            F.col("event_id"),
            user.cast("bigint").alias("person_id"),
            ts.cast("timestamp_ntz").alias("ts"),
            ts.cast("date").alias("d"),
            "event_type",
            "value",
            F.get_json_object("props", "$.k").cast("bigint").alias("k"),
            (F.floor("value").cast("bigint") % 50).alias("v50"),
            (user * 100 + F.dayofmonth(ts)).cast("bigint").alias("visit_occurrence_id"),
        )

    def with_site(self, df: DataFrame) -> DataFrame:
        return df.join(self.person.select("person_id", "site"), "person_id")

    def _of_type(self, event_type: str, *columns) -> DataFrame:
        return self._events.where(F.col("event_type") == event_type).select(*columns)

    # Every event is a customer's, so the site can be looked up late, or not at
    # all where nothing asks for it: the short names are without it.

    @cached_property
    def visits(self) -> DataFrame:
        return self._events.groupBy("visit_occurrence_id", "person_id").agg(
            F.min("d").alias("visit_start_date"),
            F.max("d").alias("visit_end_date"),
            F.min("ts").alias("visit_start_datetime"),
            F.max("ts").alias("visit_end_datetime"),
        )

    @cached_property
    def visit_occurrence(self) -> DataFrame:
        return self.with_site(self.visits)

    @cached_property
    def adt(self) -> DataFrame:
        service = F.when(F.col("value") >= 20, 2000000078).otherwise(2000000079)
        return self._events.select(
            F.col("event_id").alias("adt_occurrence_id"),
            "person_id",
            "visit_occurrence_id",
            F.col("ts").alias("adt_datetime"),
            F.col("d").alias("adt_date"),
            service.cast("bigint").alias("service_concept_id"),
            _by_key(F.col("event_type"), ADT_TYPES).cast("bigint").alias("adt_type_concept_id"),
        )

    @cached_property
    def adt_occurrence(self) -> DataFrame:
        return self.with_site(self.adt)

    @cached_property
    def conditions(self) -> DataFrame:
        return self._of_type(
            "error",
            F.col("event_id").alias("condition_occurrence_id"),
            "person_id",
            F.col("v50").alias("condition_concept_id"),
            F.col("k").alias("condition_source_concept_id"),
            F.col("d").alias("condition_start_date"),
        )

    @cached_property
    def condition_occurrence(self) -> DataFrame:
        return self.with_site(self.conditions)

    @cached_property
    def procedures(self) -> DataFrame:
        return self._of_type(
            "purchase",
            F.col("event_id").alias("procedure_occurrence_id"),
            "person_id",
            F.col("k").alias("procedure_concept_id"),
            F.col("d").alias("procedure_date"),
        )

    @cached_property
    def procedure_occurrence(self) -> DataFrame:
        return self.with_site(self.procedures)

    @cached_property
    def labs(self) -> DataFrame:
        return self._of_type(
            "click",
            F.col("event_id").alias("measurement_id"),
            "person_id",
            F.col("k").alias("measurement_concept_id"),
            F.col("d").alias("measurement_date"),
        )

    @cached_property
    def measurement_labs(self) -> DataFrame:
        return self.with_site(self.labs)

    @cached_property
    def drugs(self) -> DataFrame:
        return self._of_type(
            "view",
            F.col("event_id").alias("drug_exposure_id"),
            "person_id",
            F.col("k").alias("drug_concept_id"),
            F.col("d").alias("drug_exposure_start_date"),
        )

    @cached_property
    def drug_exposure(self) -> DataFrame:
        return self.with_site(self.drugs)

    @cached_property
    def concept(self) -> DataFrame:
        return self._table("part").select(
            F.col("p_partkey").alias("concept_id"),
            F.col("p_name").alias("concept_name"),
            F.col("p_brand").alias("concept_code"),
            F.col("p_type").alias("vocabulary_id"),
        )

    def codes(self, first: int, last: int) -> DataFrame:
        return self.concept.where(F.col("concept_id").between(first, last))

    @cached_property
    def dx_sepsis(self) -> DataFrame:
        return self.codes(0, 4)

    @cached_property
    def px_blood_culture(self) -> DataFrame:
        return self.codes(0, 9)

    @cached_property
    def lab_blood_culture(self) -> DataFrame:
        return self.codes(0, 9)

    @cached_property
    def iv_fluids(self) -> DataFrame:
        return self.codes(0, 29)

    @cached_property
    def med_broad_spec_abx(self) -> DataFrame:
        return self.codes(20, 59)

    # Orders as visits, lines as events in them.

    @cached_property
    def visit_star(self) -> DataFrame:
        order = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
        return self._table("orders").select(
            F.col("o_orderkey").alias("visit_occurrence_id"),
            F.col("o_custkey").alias("person_id"),
            F.col("o_orderdate").cast("timestamp_ntz").alias("visit_start_datetime"),
            F.col("o_orderdate").cast("date").alias("visit_start_date"),
            _by_key(F.col("o_orderpriority"), VISIT_KINDS).cast("bigint").alias("visit_concept_id"),
            F.lag("o_orderkey").over(order).alias("preceding_visit_occurrence_id"),
            F.lead("o_orderkey").over(order).alias("following_visit_occurrence_id"),
        )

    @cached_property
    def fact_relationship(self) -> DataFrame:
        return self.visit_star.where(F.col("following_visit_occurrence_id").isNotNull()).select(
            F.col("visit_occurrence_id").alias("fact_id_1"),
            F.col("following_visit_occurrence_id").alias("fact_id_2"),
        )

    @cached_property
    def clinical_star(self) -> DataFrame:
        return (
            self._table("lineitem")
            .join(
                self._table("orders").select("o_orderkey", "o_custkey"),
                F.col("l_orderkey") == F.col("o_orderkey"),
            )
            .select(
                F.col("l_orderkey").alias("visit_occurrence_id"),
                F.col("o_custkey").alias("person_id"),
                F.col("l_shipdate").cast("timestamp_ntz").alias("event_datetime"),
                (F.col("l_partkey") % 100).cast("bigint").alias("concept_id"),
                _by_key(F.col("l_returnflag"), DOMAINS).alias("domain"),
            )
        )

    def _star_events(self, domain: str, concept: str, datetime: str) -> DataFrame:
        return self.clinical_star.where(F.col("domain") == domain).select(
            "person_id",
            "visit_occurrence_id",
            F.col("concept_id").alias(concept),
            F.col("event_datetime").alias(datetime),
        )

    @cached_property
    def procedure_star(self) -> DataFrame:
        return self._star_events("procedure", "procedure_concept_id", "procedure_datetime")

    @cached_property
    def measurement_star(self) -> DataFrame:
        return self._star_events("measurement", "measurement_concept_id", "measurement_datetime")

    @cached_property
    def drug_star(self) -> DataFrame:
        return self._star_events("drug", "drug_concept_id", "drug_exposure_start_datetime")
