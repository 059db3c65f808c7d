"""A bitmap of hashed persons, to drop other persons' events before a shuffle.

A semi join with a cohort that is too large to broadcast shuffles every event
row. A sieve is about two bytes a person, so it can be broadcast long after
the persons themselves can't, and events of persons who are not in it are gone
right after the scan. It lets all members pass and a few others by chance (about
one in nine at eight bits a person), so a join with the cohort still decides.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlane.sources.sinks import stage

BITS_PER_PERSON = 8
# 64 bits are a row: the broadcast has 4 million rows of two numbers at most.
LARGEST = 1 << 28
SMALLEST = 1 << 10


def _slot(person: Column, bits: int) -> Column:
    return F.pmod(F.xxhash64(person), F.lit(bits))


@dataclass(frozen=True, eq=False)
class PersonSieve:
    """``words``: rows (word, marks) of 64 bits each; ``bits`` in all, for ``persons`` persons."""

    words: DataFrame
    bits: int
    persons: int

    @classmethod
    def checked(cls, cohort: DataFrame, bits: int | None = None) -> PersonSieve:
        """Count a stored cohort's persons and store their sieve: two jobs, at loading.

        Rows without a person don't count. Beyond 32 million persons the size
        stays and more events of others pass; results are the same.
        """
        persons = cohort.select("person_id").where(F.col("person_id").isNotNull()).distinct()
        n = persons.count()
        if bits is None:
            bits = min(LARGEST, max(SMALLEST, 1 << (BITS_PER_PERSON * n - 1).bit_length() if n else 0))
        slot = _slot(F.col("person_id"), bits)
        words = (
            persons.select(F.shiftright(slot, 6).alias("_word"), (slot % 64).cast("int").alias("_bit"))
            .groupBy("_word")
            .agg(F.bit_or(F.expr("shiftleft(1L, _bit)")).alias("_marks"))
        )
        return cls(stage(words, "sieve"), bits, n)

    def keep(self, events: DataFrame) -> DataFrame:
        """Events of members, and of others who share a bit with one. A NULL person never passes."""
        slot = _slot(F.col("person_id"), self.bits)
        marked = events.where(F.col("person_id").isNotNull()).withColumns({
            "_slot_word": F.shiftright(slot, 6), "_slot_bit": (slot % 64).cast("int"),
        })
        met = marked.join(F.broadcast(self.words), F.col("_slot_word") == F.col("_word"))
        return met.where("(shiftright(_marks, _slot_bit) & 1L) = 1").select(*events.columns)
