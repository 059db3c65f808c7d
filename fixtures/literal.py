"""The SQL twins as Spark SQL: the literal plans that timings are compared with."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from fixtures.oracle import all_oracles

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

#: Spellings that differ between the two dialects.
SPELLINGS = (
    ("regexp_matches(", "regexp_like("),
    ("arg_min(", "min_by("),
    ("arg_max(", "max_by("),
    ("VARCHAR", "STRING"),
    ("json_extract_string(", "get_json_object("),
    ("date_diff('day',", "datediff(DAY,"),
    ("date_sub('second',", "timestampdiff(SECOND,"),
    ("date_sub('microsecond',", "timestampdiff(MICROSECOND,"),
    (" END IGNORE NULLS)", " END) IGNORE NULLS"),
)


def literal_query(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A twin over temporary views of the test tables."""
    for table in TABLES:
        spark.read.parquet(f"{sf_dir}/{table}.parquet").createOrReplaceTempView(table)
    text = re.sub(r'"([A-Za-z][^"]*)"', r"`\1`", all_oracles()[name])
    for theirs, ours in SPELLINGS:
        text = text.replace(theirs, ours)
    return spark.sql(text)
