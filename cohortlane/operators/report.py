"""Report tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def report_attrition(attrition: DataFrame) -> DataFrame:
    return attrition.select(
        F.col("descriptions").alias("Description"), F.col("counts").alias("Patient Count")
    )


def report_demographics(
    summary: DataFrame,
    tag: str,
    columns: Mapping[str, str],
    without: Sequence[str] = ("Site",),
    null_safe: bool = False,
) -> DataFrame:
    """Cohorts side by side, one ``n (percent)`` column each.

    ``summary`` is a labelled summary of several cohorts told apart by ``tag``;
    ``columns`` maps tags to column titles. The first cohort decides which rows
    there are, as the left side of a left join would. A NULL category is not
    equal to another one, so the other cohorts show NULL there unless
    ``null_safe``.
    """
    base = next(iter(columns))
    per_tag = {
        value: F.max(F.when(F.col(tag) == value, F.col("n_pct"))) for value in columns
    }
    wide = (
        summary.where(~F.col("variable").isin(*without) if without else F.lit(True))
        .groupBy("variable", "category")
        .agg(*[per_tag[value].alias(title) for value, title in columns.items()])
        .where(F.col(f"`{columns[base]}`").isNotNull())
    )
    shown = [
        F.col(f"`{title}`")
        if value == base or null_safe
        else F.when(F.col("category").isNotNull(), F.col(f"`{title}`")).alias(title)
        for value, title in columns.items()
    ]
    is_total = F.col("variable") == "1_Total"
    return (
        wide.orderBy(
            F.when(is_total, 0).otherwise(1),
            F.asc_nulls_last("variable"),
            F.asc_nulls_last("category"),
        )
        .select(
            F.when(is_total, "Total").otherwise(F.col("variable")).alias("variable"),
            "category",
            *shown,
        )
    )


def side_by_side(
    left: DataFrame, right: DataFrame, keys: Sequence[str], null_safe: bool = False
) -> DataFrame:
    """Left join of two summaries; NULL keys match only with ``null_safe``."""
    renamed = right.select(*[
        F.col(c).alias(f"_{c}") if c in keys else F.col(c) for c in right.columns
    ])
    condition = F.lit(True)
    for key in keys:
        same = (
            F.col(key).eqNullSafe(F.col(f"_{key}"))
            if null_safe
            else F.col(key) == F.col(f"_{key}")
        )
        condition = condition & same
    return left.join(renamed, condition, "left").drop(*[f"_{k}" for k in keys])
