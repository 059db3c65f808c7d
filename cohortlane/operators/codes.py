"""Matching event tables against code sets."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A checked code set is broadcast up to this size.
BROADCAST_BYTES = 64 * 1024 * 1024


@dataclass(frozen=True, eq=False)
class CodeSet:
    """A code set with its size, found out once where it was loaded.

    Operators never count. They hint a broadcast for code sets known to be
    small; what else is best for a plain frame is the planner's choice, by its own
    statistics. ``spread`` is for a large code set with hot concepts: the events
    of one concept are dealt out over so many partitions.
    """

    frame: DataFrame
    rows: int
    bytes: int
    spread: int | None = None

    @classmethod
    def checked(cls, codes: DataFrame, spread: int | None = None) -> CodeSet:
        """Measure a code set: one job, at loading."""
        width = F.lit(16)
        for name, kind in codes.dtypes:
            width = width + (F.coalesce(F.octet_length(F.col(f"`{name}`")), F.lit(0)) if kind == "string" else F.lit(8))
        rows, size = codes.agg(F.count("*"), F.coalesce(F.sum(width), F.lit(0))).first()
        return cls(codes, rows, size, spread)

    @property
    def small(self) -> bool:
        return self.bytes <= BROADCAST_BYTES


Codes = DataFrame | CodeSet


def frame_of(codes: Codes) -> DataFrame:
    return codes.frame if isinstance(codes, CodeSet) else codes


def join_codes(
    events: DataFrame, concept_col: str, lookup: DataFrame, how: str, codes: Sequence[Codes]
) -> DataFrame:
    """Join events with a table keyed by ``_code`` that was made from code sets.

    Small checked code sets are broadcast. Otherwise the planner decides; with a
    ``spread`` the events of a concept are dealt out by a hash of the row, and the
    table is copied once for each share.
    """
    same = F.col(concept_col) == F.col("_code")
    checked = [c for c in codes if isinstance(c, CodeSet)]
    if len(checked) == len(codes) and sum(c.bytes for c in checked) <= BROADCAST_BYTES:
        return events.join(F.broadcast(lookup), same, how).drop("_code")
    spread = max((c.spread or 1 for c in checked), default=1)
    if spread == 1:
        return events.join(lookup, same, how).drop("_code")
    salted = events.withColumn("_salt", F.pmod(F.xxhash64(*events.columns), F.lit(spread)))
    salts = F.sequence(F.lit(0).cast("bigint"), F.lit(spread - 1).cast("bigint"))
    copies = lookup.withColumn("_copy", F.explode(salts))
    return salted.join(copies, same & (F.col("_salt") == F.col("_copy")), how).drop(
        "_code", "_salt", "_copy"
    )


def match_codes(
    events: DataFrame, concept_col: str, codes: Codes, dedupe: bool = True
) -> DataFrame:
    """Events whose concept is in the code set.

    ``dedupe=False`` joins the code set as it is, so a concept listed twice
    doubles its events.
    """
    wanted = frame_of(codes).select(F.col("concept_id").alias("_code"))
    return join_codes(events, concept_col, wanted, "left_semi" if dedupe else "inner", [codes])


def match_codes_with_attributes(
    events: DataFrame, concept_col: str, codes: Codes, attributes: Sequence[str]
) -> DataFrame:
    """Events in the code set, carrying the code set's attribute columns."""
    wanted = frame_of(codes).select(F.col("concept_id").alias("_code"), *attributes)
    return join_codes(events, concept_col, wanted, "inner", [codes])


def match_source_only(
    events: DataFrame, standard_col: str, source_col: str, codes: Codes
) -> DataFrame:
    """Events matched by their source concept but not by their standard one.

    One scan: an event that the standard code already matched is left out by a
    condition on the same row, not by an anti join of the table with itself.
    """
    flagged = _tag_each(events, (standard_col, source_col), {0: codes})
    return flagged.where(
        F.col("_tags_0").isNull() & F.col("_tags_1").isNotNull()
    ).drop("_tags_0", "_tags_1")


def _code_bits(codes_by_bit: Mapping[int, Codes]) -> DataFrame:
    """One row per concept: which of the code sets it belongs to, as a bit set."""
    tagged = [
        frame_of(codes).select(F.col("concept_id").alias("_code"), _bit(bit).alias("_tags"))
        for bit, codes in codes_by_bit.items()
    ]
    return (
        reduce(DataFrame.unionByName, tagged)
        .where(F.col("_code").isNotNull())
        .groupBy("_code")
        .agg(F.bit_or("_tags").alias("_tags"))
    )


def _tag_each(
    events: DataFrame, concept_cols: Sequence[str], codes_by_bit: Mapping[int, Codes]
) -> DataFrame:
    """Add ``_tags_<i>`` for each concept column, NULL where it is in no code set."""
    bits = _code_bits(codes_by_bit)
    for i, concept_col in enumerate(concept_cols):
        lookup = bits.withColumnRenamed("_tags", f"_tags_{i}")
        events = join_codes(events, concept_col, lookup, "left", list(codes_by_bit.values()))
    return events


def tag_events(
    events: DataFrame, concept_cols: Sequence[str], codes_by_bit: Mapping[int, Codes]
) -> DataFrame:
    """Events in any of at most 63 code sets, with ``_tags`` telling which ones.

    One scan of the events however many code sets there are. With a single
    concept column non-members drop out in an inner join; with several each
    column is looked up in turn and rows without any match are filtered.
    """
    if max(codes_by_bit) > 62:
        raise ValueError("at most 63 code sets fit one bit set; tag in several calls")
    if len(concept_cols) == 1:
        lookup = _code_bits(codes_by_bit)
        return join_codes(events, concept_cols[0], lookup, "inner", list(codes_by_bit.values()))
    flagged = _tag_each(events, concept_cols, codes_by_bit)
    found = [f"_tags_{i}" for i in range(len(concept_cols))]
    either = reduce(
        lambda a, b: a.bitwiseOR(b), [F.coalesce(F.col(c), F.lit(0)) for c in found]
    )
    return flagged.withColumn("_tags", either).drop(*found).where(F.col("_tags") != 0)


def _bit(bit: int) -> Column:
    return F.lit(1 << bit).cast("bigint")


def has_tag(bit: int, tags: str = "_tags") -> Column:
    return F.col(tags).bitwiseAND(_bit(bit)) != 0
