"""Exact sets of persons as bitmaps, kept per funnel step and site.

A funnel is often wanted again: for some sites, for one site at a time, for
persons who met two steps. Once every person has a dense number, the persons of a
step are bitmaps of 32,768 numbers each, and all of that is a union, an
intersection or a count of stored bitmaps; no event table is read again.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlane.operators.attrition import AttritionStep
from cohortlane.sources.sinks import stage

# Steps of one evaluation are bits of a number.
MOST_STEPS = 62


@dataclass(frozen=True, eq=False)
class PersonNumbers:
    """``table``: rows (person_id, number), numbers from 0 without large gaps; ``persons`` in all."""

    table: DataFrame
    persons: int

    @classmethod
    def checked(cls, *frames: DataFrame) -> PersonNumbers:
        """Number all persons of some frames: each is stored with its place in a part, then parts are counted.

        Rows without a person have no number.
        """
        everybody = reduce(DataFrame.union, [f.select("person_id") for f in frames])
        placed = stage(
            everybody.where(F.col("person_id").isNotNull()).distinct().withColumn("_place", F.monotonically_increasing_id()),
            "persons",
        )
        part, place = F.shiftright("_place", 33), F.col("_place").bitwiseAND((1 << 33) - 1)
        # one number per part of the table, whatever the number of persons
        sizes = sorted(tuple(r) for r in placed.groupBy(part.alias("_part")).agg(F.count("*")).collect())
        starts, total = [], 0
        for at, n in sizes:
            starts.append((at, total))
            total += n
        offsets = placed.sparkSession.createDataFrame(starts, "_part long, _start long")
        table = placed.join(F.broadcast(offsets), part == F.col("_part")).select(
            "person_id", (F.col("_start") + place).alias("number")
        )
        return cls(table, total)


def person_sets(steps: Sequence[AttritionStep], numbers: PersonNumbers) -> DataFrame:
    """Rows (step, site, bucket, members): the persons of each step and site, steps counted from 1.

    Steps that share a frame are evaluated in one pass over it. The site is the
    frame's own, NULL in frames without one. Rows without a person, and persons
    without a number, don't count.
    """
    if len(steps) > MOST_STEPS:
        raise ValueError(f"at most {MOST_STEPS} steps fit one evaluation")
    frames: dict[int, list[tuple[int, AttritionStep]]] = {}
    for number, step in enumerate(steps, start=1):
        frames.setdefault(id(step.frame), []).append((number, step))

    def condition(step: AttritionStep) -> Column:
        return F.expr(step.where) if isinstance(step.where, str) else step.where

    marked = []
    for numbered in frames.values():
        frame = numbered[0][1].frame
        bits = sum((F.when(condition(s), F.lit(1 << n).cast("bigint")).otherwise(F.lit(0)) for n, s in numbered), F.lit(0))
        site = F.col("site") if "site" in frame.columns else F.lit(None)
        marked.append(frame.select("person_id", site.cast("string").alias("site"), bits.cast("bigint").alias("_steps")))
    # a row per person and site, however many events it stands for
    met = (
        reduce(DataFrame.union, marked)
        .where("_steps <> 0 AND person_id IS NOT NULL")
        .groupBy("person_id", "site")
        .agg(F.bit_or("_steps").alias("_steps"))
    )
    every = F.array(*[F.lit(n) for n in range(1, len(steps) + 1)])
    listed = F.filter(every, lambda n: F.getbit("_steps", n) == 1)
    return (
        met.join(numbers.table, "person_id")
        .select(F.explode(listed).alias("step"), "site", (F.col("number") + 1).alias("_number"))
        .groupBy("step", "site", F.bitmap_bucket_number("_number").alias("bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("_number")).alias("members"))
    )


@dataclass(frozen=True)
class Cut:
    """A line of a funnel: the persons who are in all of some steps, at some sites or anywhere."""

    description: str
    steps: tuple[int, ...]
    sites: tuple[str, ...] | None = None


def funnel_of(sets: DataFrame, cuts: Sequence[Cut]) -> DataFrame:
    """Rows (step, descriptions, counts): distinct persons of each cut, in order; 0 where nobody is in it.

    With sites, a person counts if each of the steps holds at one of them.
    """
    wanted = F.array(*[
        F.struct(
            F.lit(number).alias("cut"),
            F.array(*map(F.lit, sorted(set(cut.steps)))).alias("steps"),
            (F.array(*map(F.lit, cut.sites)) if cut.sites else F.array().cast("array<string>")).alias("sites"),
            F.lit(cut.sites is None).alias("anywhere"),
        )
        for number, cut in enumerate(cuts, start=1)
    ])
    # the few stored bitmaps of a step go to the few cuts that ask for it
    asked = sets.withColumn("_cut", F.explode(wanted)).where(
        F.array_contains("_cut.steps", F.col("step")) & (F.col("_cut.anywhere") | F.array_contains("_cut.sites", F.col("site")))
    )
    by_step = asked.groupBy("_cut.cut", F.size("_cut.steps").alias("_size"), "step", "bucket").agg(
        F.bitmap_or_agg("members").alias("members")
    )
    # a step without members in a bucket leaves nothing there
    counted = (
        by_step.groupBy("cut", "_size", "bucket")
        .agg(F.bitmap_and_agg("members").alias("members"), F.count("*").alias("_found"))
        .where("_found = _size")
        .groupBy("cut")
        .agg(F.sum(F.bitmap_count("members")).alias("counts"))
    )
    lines = F.array(*[
        F.struct(F.lit(n).alias("step"), F.lit(cut.description).alias("descriptions")) for n, cut in enumerate(cuts, start=1)
    ])
    every = sets.sparkSession.range(1).select(F.inline(lines))
    return (
        every.join(counted, F.col("step") == F.col("cut"), "left")
        .select("step", "descriptions", F.coalesce("counts", F.lit(0).cast("bigint")).alias("counts"))
        .orderBy("step")
    )
