"""Every query against its SQL twin, values and types."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from compare import duckdb_connection, duckdb_rows, spark_rows
from fixtures.oracle import all_oracles
from fixtures.queries import all_queries

QUERIES, ORACLES = all_queries(), all_oracles()
SPARK_TO_SQL = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "string": "VARCHAR",
    "double": "DOUBLE",
    "date": "DATE",
    "timestamp_ntz": "TIMESTAMP",
}


@pytest.fixture(scope="module")
def con(sf_dir):
    return duckdb_connection(sf_dir)


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(queries()) and set(ORACLES) <= set(oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_sql(name, spark, sf_dir, con):
    df = QUERIES[name](spark, sf_dir)
    columns, rows = spark_rows(df)
    sql_columns, sql_rows, sql_types = duckdb_rows(con, ORACLES[name])
    assert columns == sql_columns
    assert {c: SPARK_TO_SQL[t] for c, t in df.dtypes} == sql_types
    assert rows == sql_rows


def test_entry(spark):
    assert entry(spark).count() == 11


@pytest.mark.parametrize(
    ("name", "expected"),
    [
        ("icu_cohort_adt", 151),
        ("condition_near_index", 11),
        ("phenotype_near_index", 9),
        ("phenotype_near_index_1day", 4),
        ("ed_linked_to_inpatient", 783),
        ("same_visit_criteria", 181),
        ("same_visit_phenotype", 76),
    ],
)
def test_known_sizes(name, expected, spark, sf_dir):
    assert QUERIES[name](spark, sf_dir).count() == expected
