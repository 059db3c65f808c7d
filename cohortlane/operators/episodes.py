"""Stays of a service built from admission/transfer records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlane.operators.cohorts import (
    ADMISSION,
    CENSUS,
    DISCHARGE,
    TRANSFER_IN,
    TRANSFER_OUT,
)

START_TYPES = (ADMISSION, TRANSFER_IN)
END_TYPES = (DISCHARGE, TRANSFER_OUT)
IGNORED_TYPES = (CENSUS,)
MAX_GAP_SECONDS = 12 * 3600
START_BOOKEND_ID = -1
END_BOOKEND_ID = -2

STAY_KEYS = ("person_id", "visit_occurrence_id", "site")
EPISODE_COLUMNS = (
    "episode_id",
    "episode_start_date",
    "episode_start_datetime",
    "episode_end_date",
    "episode_end_datetime",
)

# Order of records of one stay. Bookends come after real records of their
# instant, the start bookend before the end bookend.
_SEQUENCE = ("_at", "_appended", "_id")


def _kind(start_types: Sequence[int], end_types: Sequence[int]) -> Column:
    concept = F.col("adt_type_concept_id")
    return (
        F.when(concept.isin(*start_types), "start")
        .when(concept.isin(*end_types), "end")
        .otherwise("other")
    )


def max_records_per_instant(
    adt: DataFrame,
    start_types: Sequence[int] = START_TYPES,
    end_types: Sequence[int] = END_TYPES,
) -> DataFrame:
    """Largest number of start/end (or of other) records of a person at one instant.

    Episodes are well defined only while this is at most 2, which
    ``adt_episodes`` checks.
    """
    return (
        adt.groupBy(
            "person_id",
            "adt_datetime",
            (_kind(start_types, end_types) != "other").alias("_start_or_end"),
        )
        .agg(F.count("*").alias("n"))
        .agg(F.max("n").alias("max_records"))
    )


def _time_slice(slice_seconds: int) -> Column:
    """Number of the stretch of time that ``_at`` falls in."""
    epoch = F.lit("1970-01-01").cast("timestamp_ntz")
    return F.floor(F.timestamp_diff("SECOND", epoch, "_at") / F.lit(slice_seconds))


def _records(
    adt: DataFrame, start_types, end_types, ignore_types, check_ties: bool, slice_seconds: int
) -> DataFrame:
    """Records of each stay, without start/end pairs at one and the same instant.

    ``check_ties`` fails the query if a person has more than two records of one
    sort at an instant. Records are dealt out by person and time slice, once:
    the guard, the pairs of an instant and the work on slices of a stay all
    stay within that.
    """
    rows = adt.select(
        *STAY_KEYS,
        F.col("adt_datetime").alias("_at"),
        F.col("adt_date").alias("_date"),
        F.col("adt_occurrence_id").alias("_id"),
        _kind(start_types, end_types).alias("_kind"),
        F.col("adt_type_concept_id").isin(*ignore_types).alias("_ignored"),
    ).withColumn("_slice", _time_slice(slice_seconds))
    if not check_ties:
        rows = rows.where(~F.col("_ignored"))
    # by slice even where the input is already partitioned by person
    rows = rows.repartition("person_id", "_slice")
    if check_ties:
        sort = Window.partitionBy("person_id", "_slice", "_at", F.col("_kind") == "other")
        rows = rows.withColumn("_ties", F.count("*").over(sort))
        few = F.assert_true(
            F.col("_ties") <= 2, F.lit("more than two records of a person at one instant")
        )
        rows = rows.where(few.isNull() & ~F.col("_ignored"))
    instant = Window.partitionBy(*STAY_KEYS, "_slice", "_at", F.col("_kind") == "other")
    both = F.bool_or(F.col("_kind") == "start").over(instant) & F.bool_or(
        F.col("_kind") == "end"
    ).over(instant)
    return (
        rows.withColumn("_both", both)
        .where(~F.col("_both"))
        .select(*STAY_KEYS, "_slice", "_at", "_date", F.lit(0).alias("_appended"), "_id", "_kind")
    )


def _bookends(records: DataFrame, visits: DataFrame, slice_seconds: int) -> DataFrame:
    """Start and end of the visit, for stays whose records lack one.

    A stay that does not begin with a start record gets both bookends; one that
    only fails to finish with an end record gets the end bookend. They are dealt
    out as the records are, so that the union of both is, too.
    """
    # all columns and a left join (which adds no filter): the same shuffle as that
    # of the records themselves, so Spark runs it once
    order = F.struct("_at", "_id", "_date")
    edges = records.groupBy(*STAY_KEYS).agg(
        F.min_by("_kind", order).alias("_first"), F.max_by("_kind", order).alias("_last")
    )
    times = visits.select(
        F.col("visit_occurrence_id").alias("_visit"),
        "visit_start_date",
        "visit_start_datetime",
        "visit_end_date",
        "visit_end_datetime",
    )
    no_start = F.col("_first") != "start"
    no_end = no_start | (F.col("_last") != "end")

    def bookend(needed: Column, edge: str, rank: int, identifier: int) -> Column:
        return F.when(
            needed & F.col(f"visit_{edge}_datetime").isNotNull(),
            F.struct(
                F.col(f"visit_{edge}_datetime").alias("_at"),
                F.col(f"visit_{edge}_date").alias("_date"),
                F.lit(rank).alias("_appended"),
                F.lit(identifier).cast("bigint").alias("_id"),
                F.lit(edge).alias("_kind"),
            ),
        )

    added = F.array_compact(
        F.array(
            bookend(no_start, "start", 1, START_BOOKEND_ID),
            bookend(no_end, "end", 2, END_BOOKEND_ID),
        )
    )
    return (
        edges.where(no_end)
        .join(times, F.col("visit_occurrence_id") == F.col("_visit"), "left")
        .select(*STAY_KEYS, F.inline(added))
        .withColumn("_slice", _time_slice(slice_seconds))
        .repartition("person_id", "_slice")
        .select(*records.columns)
    )


def _condense(sliced: DataFrame, max_gap: int) -> DataFrame:
    """Reduce each time slice of a stay to the few records that still matter.

    Works on slices, not whole stays, so a stay with very many records is spread
    over tasks. What remains per slice: the first record if it is of another
    type, starts that may open an episode, and last records of runs of ends that
    may close one. An end and the next start less than ``max_gap`` apart between
    two complete episodes of the slice will be merged whatever happens in other
    slices, so both go. A slice thus keeps at most a few records per ``max_gap``.
    """
    within = Window.partitionBy(*STAY_KEYS, "_slice").orderBy(*_SEQUENCE)
    before = within.rowsBetween(Window.unboundedPreceding, -1)
    up_to = within.rowsBetween(Window.unboundedPreceding, 0)

    is_start, is_end = F.col("_kind") == "start", F.col("_kind") == "end"
    decisive = F.when(F.col("_kind") != "other", F.col("_kind"))
    marked = sliced.select(
        "*",
        F.lag("_kind").over(within).alias("_previous"),
        F.lead("_kind").over(within).alias("_next"),
        F.last(decisive, ignorenulls=True).over(before).alias("_state"),
        (~F.bool_or(~is_end).over(up_to)).alias("_ends_only_so_far"),
    ).select(
        "*",
        # the state a run of ends began in, carried to the last end of the run
        F.last(
            F.when(
                is_end & ~F.col("_previous").eqNullSafe(F.lit("end")),
                F.coalesce("_state", F.lit("unknown")),
            ),
            ignorenulls=True,
        ).over(up_to).alias("_run_state"),
    )
    opens = is_start & ~F.col("_state").eqNullSafe(F.lit("start"))
    run_ends = (
        is_end
        & ~F.col("_next").eqNullSafe(F.lit("end"))
        & F.col("_run_state").isin("start", "unknown")
    )
    breaks = (F.col("_kind") == "other") & F.col("_previous").isNull()
    candidates = marked.where(opens | run_ends | breaks).select(
        *STAY_KEYS,
        "_slice",
        *_SEQUENCE,
        "_date",
        "_kind",
        (is_end & (F.col("_run_state") == "start")).alias("_closes"),
        (is_end & F.col("_ends_only_so_far")).alias("_from_slice_start"),
        (is_end & F.col("_next").isNull()).alias("_to_slice_end"),
    )

    def is_kind(offset: int, kind: str) -> Column:
        at = F.lag("_kind").over(within) if offset < 0 else F.lead("_kind", offset).over(within)
        return F.coalesce(at == kind, F.lit(False))

    close_gap = F.timestamp_diff("SECOND", F.col("_at"), F.lead("_at").over(within)) < max_gap
    open_gap = F.timestamp_diff("SECOND", F.lag("_at").over(within), F.col("_at")) < max_gap
    drop_close = F.col("_closes") & is_kind(1, "start") & is_kind(2, "end") & close_gap
    drop_open = (
        (F.col("_kind") == "start")
        & F.coalesce(F.lag("_closes").over(within), F.lit(False))
        & is_kind(1, "end")
        & open_gap
    )
    return (
        candidates.withColumn("_merged", F.coalesce(drop_close | drop_open, F.lit(False)))
        .where(~F.col("_merged"))
        .select(
            *STAY_KEYS, *_SEQUENCE, "_date", "_kind", "_from_slice_start", "_to_slice_end"
        )
    )


def _pair(condensed: DataFrame, max_gap: int) -> DataFrame:
    """Episodes of each stay from its condensed records, near ones merged."""
    within = Window.partitionBy(*STAY_KEYS).orderBy(*_SEQUENCE)
    before = within.rowsBetween(Window.unboundedPreceding, -1)
    up_to = within.rowsBetween(Window.unboundedPreceding, 0)

    is_start, is_end = F.col("_kind") == "start", F.col("_kind") == "end"
    decisive = F.when(F.col("_kind") != "other", F.col("_kind"))
    # a run of ends goes on when it reaches the border of a slice on both sides
    goes_on = F.coalesce(
        is_end & F.col("_from_slice_start") & F.lag("_to_slice_end").over(within), F.lit(False)
    )
    runs = condensed.select(
        "*",
        F.last(decisive, ignorenulls=True).over(before).alias("_state"),
        goes_on.alias("_goes_on"),
    ).select(
        "*",
        F.coalesce(F.lead("_goes_on").over(within), F.lit(False)).alias("_continued"),
        F.last(
            F.when(is_end & ~F.col("_goes_on"), F.col("_state").eqNullSafe(F.lit("start"))),
            ignorenulls=True,
        ).over(up_to).alias("_closing"),
    )
    opens = is_start & ~F.col("_state").eqNullSafe(F.lit("start"))
    closes = is_end & F.col("_closing") & ~F.col("_continued")
    # opening and closing records alternate, so neighbours are partners
    episodes = (
        runs.where(opens | closes)
        .select(
            *STAY_KEYS,
            *_SEQUENCE,
            "_date",
            "_kind",
            F.lag("_at").over(within).alias("_previous_end"),
            F.lead("_at").over(within).alias("_end_at"),
            F.lead("_date").over(within).alias("_end_date"),
        )
        .where(is_start & F.col("_end_at").isNotNull())
    )
    gap = F.timestamp_diff("SECOND", "_previous_end", "_at")
    is_new = F.coalesce(gap >= max_gap, F.lit(True))
    grouped = episodes.withColumn("_number", F.count_if(is_new).over(up_to))
    return (
        grouped.groupBy(*STAY_KEYS, "_number")
        .agg(
            F.min_by("_id", "_at").alias("episode_id"),
            F.min_by("_date", "_at").alias("episode_start_date"),
            F.min("_at").alias("episode_start_datetime"),
            F.max_by("_end_date", "_end_at").alias("episode_end_date"),
            F.max("_end_at").alias("episode_end_datetime"),
        )
        .select(*STAY_KEYS, *EPISODE_COLUMNS)
    )


def adt_episodes(
    adt: DataFrame,
    visits: DataFrame | None = None,
    start_types: Sequence[int] = START_TYPES,
    end_types: Sequence[int] = END_TYPES,
    ignore_types: Sequence[int] = IGNORED_TYPES,
    max_gap_seconds: int = MAX_GAP_SECONDS,
    slice_seconds: int = 86_400,
    check_ties: bool = True,
) -> DataFrame:
    """Episodes per (person, visit, site) between start and end records.

    The earliest of several starts in a row opens an episode, the latest of
    directly adjacent ends closes it; unclosed ones are dropped. Episodes less
    than ``max_gap_seconds`` apart become one, named after its first start
    record. With ``visits``, the visit's start and end stand in where the
    records of a stay do not begin with a start or finish with an end.

    The rules are defined for at most two records of one sort (start or end, or
    others) of a person at an instant; more fail the query unless ``check_ties``
    is False.

    ``slice_seconds`` only says how stays are cut up for processing; it does not
    change the result.
    """
    records = _records(adt, start_types, end_types, ignore_types, check_ties, slice_seconds)
    if visits is not None:
        records = records.unionByName(_bookends(records, visits, slice_seconds))
    return _pair(_condense(records, max_gap_seconds), max_gap_seconds)
