"""Readers for clinical, vocabulary and result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlane.config import StudyCatalog
from cohortlane.schemas import CDM_TABLES, VOCABULARY_TABLES, TableContract


def _open(spark: SparkSession, catalog: StudyCatalog, location: str) -> DataFrame:
    if catalog.layout == "table":
        return spark.table(location)
    return spark.read.parquet(location)


def conform(df: DataFrame, contract: TableContract) -> DataFrame:
    """Keep the contract's columns, casting only those stored as another type.

    Columns already of the right type pass through untouched, so filters on
    them still reach the file scan.
    """
    stored = dict(df.dtypes)
    missing = [name for name in contract.core if name not in stored]
    if missing:
        raise ValueError(f"table lacks required columns: {', '.join(missing)}")
    wanted = {
        **contract.core,
        **{n: t for n, t in contract.optional.items() if n in stored},
    }
    return df.select(*[
        F.col(n) if stored[n] == t else F.col(n).cast(t).alias(n)
        for n, t in wanted.items()
    ])


def cdm_table(spark: SparkSession, catalog: StudyCatalog, name: str) -> DataFrame:
    df = _open(spark, catalog, catalog.locate(catalog.cdm, name))
    return conform(df, CDM_TABLES[name])


def vocabulary_table(spark: SparkSession, catalog: StudyCatalog, name: str = "concept") -> DataFrame:
    df = _open(spark, catalog, catalog.locate(catalog.vocabulary, name))
    return conform(df, VOCABULARY_TABLES[name])


def read_result(spark: SparkSession, catalog: StudyCatalog, name: str) -> DataFrame:
    return _open(spark, catalog, catalog.result_name(name))


def read_result_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Read a result that was exported with :func:`write_csv`; text without a schema."""
    reader = spark.read.option("header", True).option("escape", '"')
    if schema is not None:
        reader = reader.schema(schema).option("enforceSchema", False)
    return reader.csv(path)


def get_result(
    spark: SparkSession,
    catalog: StudyCatalog,
    name: str,
    csv_folder: str | None = None,
    schema: str | None = None,
) -> DataFrame:
    """A result from its CSV export in a folder, or else from the result table."""
    if csv_folder is None:
        return read_result(spark, catalog, name)
    return read_result_csv(spark, f"{csv_folder}/{name}.csv", schema)
