"""Mean and spread of a column, taken in parts and merged.

A part is (n, mean, m2), m2 the sum of squared distances from the part's own
mean. Two parts merge without their rows and without the loss of digits that
sums of squares bring, so one aggregate over fine cells serves every coarser one.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def moments(column: str | Column) -> Column:
    """Aggregate: (n, mean, m2) of the known values; (0, 0, 0) without any."""
    value = (F.col(column) if isinstance(column, str) else column).cast("double")
    n = F.count(value)
    return F.struct(
        n.alias("n"),
        F.coalesce(F.avg(value), F.lit(0.0)).alias("mean"),
        F.coalesce(F.var_pop(value) * n, F.lit(0.0)).alias("m2"),
    )


def _merge(a: Column, b: Column) -> Column:
    n = a["n"] + b["n"]
    apart = b["mean"] - a["mean"]
    share = b["n"] / n
    both = F.struct(
        n.alias("n"),
        (a["mean"] + apart * share).alias("mean"),
        (a["m2"] + b["m2"] + apart * apart * share * a["n"]).alias("m2"),
    )
    return F.when(b["n"] == 0, a).when(a["n"] == 0, b).otherwise(both)


def merged(parts: Column) -> Column:
    """Aggregate: the moments of all rows from the moments of their parts.

    Every part of a group comes to one task: parts are cells of a cube, not rows.
    """
    nothing = F.struct(
        F.lit(0).cast("bigint").alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2")
    )
    return F.aggregate(F.collect_list(parts), nothing, _merge)


def mean_of(part: Column) -> Column:
    return F.when(part["n"] > 0, part["mean"])


def sd_of(part: Column) -> Column:
    """Sample standard deviation: NULL below two values."""
    return F.when(part["n"] > 1, F.sqrt(part["m2"] / (part["n"] - 1)))
