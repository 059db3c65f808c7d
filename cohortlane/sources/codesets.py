"""Readers for code-set and notes CSV files."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlane.schemas import CODESET_COLUMNS

BYTE_ORDER_MARK = "\ufeff"


def _read_text_columns(spark: SparkSession, path: str, multi_line: bool) -> DataFrame:
    # Every column is read as text: header names decide what a column is, so the
    # column order of a file does not matter and codes keep leading zeros. Files
    # with line breaks inside fields can't be split among tasks.
    df = (
        spark.read.option("header", True)
        .option("inferSchema", False)
        .option("escape", '"')
        .option("nullValue", "NA")
        .option("multiLine", multi_line)
        .csv(path)
    )
    return df.toDF(*[name.replace(BYTE_ORDER_MARK, "").strip() for name in df.columns])


def read_codeset(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Code set: the four standard columns by name, then any extra columns."""
    raw = _read_text_columns(spark, path, multi_line)
    if "concept_id" not in raw.columns:
        raise ValueError(f"{path} has no concept_id column")
    standard = [
        (F.col(n) if n in raw.columns else F.lit(None)).cast(t).alias(n)
        for n, t in CODESET_COLUMNS.items()
    ]
    extra = [F.col(f"`{n}`") for n in raw.columns if n not in CODESET_COLUMNS]
    return raw.select(*standard, *extra)


def clean_name(name: str) -> str:
    return re.sub(r"[^0-9a-z]+", "_", name.lower()).strip("_")


def read_notes(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Free-text table: headers become identifiers a table can be saved with.

    ``multi_line=False`` is for large files without line breaks inside fields.
    """
    raw = _read_text_columns(spark, path, multi_line)
    return raw.toDF(*[clean_name(name) for name in raw.columns])
