"""Queries of the text operators against their SQL twins."""

import pytest

from cohortlane.llm.queries import llm_oracles, llm_queries
from compare import duckdb_connection, duckdb_rows, spark_rows


@pytest.mark.parametrize("name", sorted(llm_oracles()))
def test_matches_sql(name, spark, sf_dir):
    columns, rows = spark_rows(llm_queries()[name](spark, sf_dir))
    sql_columns, sql_rows, _ = duckdb_rows(duckdb_connection(sf_dir), llm_oracles()[name])
    assert columns == sql_columns
    assert rows == sql_rows
