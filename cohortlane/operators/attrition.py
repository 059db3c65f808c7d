"""Inclusion funnels."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True, eq=False)
class AttritionStep:
    """Distinct persons of ``frame``, or of its rows meeting ``where``.

    Rows without a person don't count. Steps that share a frame are counted in one pass over it.
    """

    description: str
    frame: DataFrame
    where: str | Column = "true"


def attrition(steps: Sequence[AttritionStep]) -> DataFrame:
    """One row per step, in order, with its exact number of distinct persons.

    Each frame is reduced to one row of step flags per person (combined before
    the shuffle), and those to one row of counts; a step nobody reaches is 0.
    """
    frames: dict[int, list[tuple[int, AttritionStep]]] = {}
    for number, step in enumerate(steps, start=1):
        frames.setdefault(id(step.frame), []).append((number, step))

    counted = []
    for numbered in frames.values():
        flags = [
            F.bool_or(
                F.expr(step.where) if isinstance(step.where, str) else step.where
            ).alias(f"_step_{number}")
            for number, step in numbered
        ]
        known = numbered[0][1].frame.where(F.col("person_id").isNotNull())
        per_person = known.groupBy("person_id").agg(*flags)
        counts = per_person.agg(*[
            F.count_if(F.col(f"_step_{number}")).alias(f"_step_{number}")
            for number, _ in numbered
        ])
        rows = F.array(*[
            F.struct(
                F.lit(number).alias("step"),
                F.lit(step.description).alias("descriptions"),
                F.col(f"_step_{number}").alias("counts"),
            )
            for number, step in numbered
        ])
        counted.append(counts.select(F.inline(rows)))
    return reduce(DataFrame.unionByName, counted).orderBy("step")
