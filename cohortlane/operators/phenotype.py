"""Phenotypes: Boolean combinations of code-set criteria near index dates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlane.functions.dates import as_date
from cohortlane.operators.codes import Codes, has_tag, tag_events
from cohortlane.operators.proximity import (
    DateRange,
    date_filter,
    index_dates,
    join_near,
    reachable,
)
from cohortlane.operators.sieve import PersonSieve


@dataclass(frozen=True, eq=False)
class EventSource:
    """An event table and the columns criteria look at.

    Several concept columns mean "this code or that one", as with standard and
    source condition codes. Criteria with the same table and columns share one scan.
    """

    events: DataFrame
    date_col: str
    concept_cols: tuple[str, ...]

    def key(self) -> tuple:
        return id(self.events), self.date_col, self.concept_cols


@dataclass(frozen=True, eq=False)
class Criterion:
    name: str
    source: EventSource
    codes: Codes


def _matches(
    criteria: Sequence[Criterion],
    between: DateRange | None,
    members: DataFrame | PersonSieve | None = None,
) -> DataFrame:
    """Distinct (person_id, event_date) with the set of criteria met that day.

    The per-day aggregate runs before any join with a cohort: partial results
    are combined before the shuffle, and a person with very many events shrinks
    to one row per day. ``members`` drop other persons' events first: a sieve
    does so without a shuffle, a frame by a semi join that Spark broadcasts or
    shuffles as their size has it.
    """
    sources = {c.source.key(): c.source for c in criteria}
    per_source = []
    for key, source in sources.items():
        # a criterion's bit is its position among all criteria
        codes = {bit: c.codes for bit, c in enumerate(criteria) if c.source.key() == key}
        tagged = tag_events(
            date_filter(source.events, source.date_col, between),
            source.concept_cols,
            codes,
        )
        if isinstance(members, PersonSieve):
            tagged = members.keep(tagged)
        elif members is not None:
            tagged = tagged.join(members, "person_id", "left_semi")
        per_source.append(
            tagged.select("person_id", as_date(source.date_col).alias("event_date"), "_tags")
        )
    return (
        reduce(DataFrame.unionByName, per_source)
        .groupBy("person_id", "event_date")
        .agg(F.bit_or("_tags").alias("_tags"))
    )


def criteria_by_index(
    cohort: DataFrame,
    criteria: Sequence[Criterion],
    date_col: str,
    days_pre: int,
    days_post: int,
    index_between: DateRange | None = None,
    keep_unmatched: bool = False,
    day_buckets: bool = False,
    stored_cohort: bool = False,
    sieve: PersonSieve | None = None,
    by: Sequence[str] = (),
) -> DataFrame:
    """Per person and index date: one flag per criterion met in the window.

    Index dates without any match are left out unless ``keep_unmatched``.
    ``stored_cohort=True`` says that the cohort is a stored table, so that
    reading it twice is cheap: events of everybody else are dropped right after
    the scan instead of in the join. A ``sieve`` of the cohort's persons does the
    same for a cohort too large to broadcast. ``by`` are columns of the cohort that tell
    several index definitions apart; all are evaluated with one look at the events.

    The join and the aggregates are by person. A person with very many events or
    index dates has one row per day on either side; to split the join of such a
    person the session needs adaptive skew-join handling (``SESSION_SETTINGS``).
    """
    between = reachable(index_between, days_pre, days_post) if index_between else None
    members = sieve
    if sieve is None and stored_cohort:
        members = cohort.select("person_id").distinct()
    joined = join_near(
        index_dates(cohort, date_col, by),
        _matches(criteria, between, members),
        days_pre,
        days_post,
        how="left" if keep_unmatched else "inner",
        day_buckets=day_buckets,
    )
    met = joined.groupBy("person_id", *by, "index_date").agg(
        F.coalesce(F.bit_or("_tags"), F.lit(0)).alias("_tags")
    )
    flags = [has_tag(bit).alias(c.name) for bit, c in enumerate(criteria)]
    return met.select("person_id", *by, F.col("index_date").alias(date_col), *flags)


def _rule(rule: str | Column) -> Column:
    return F.expr(rule) if isinstance(rule, str) else rule


def phenotypes_by_person(
    by_index: DataFrame, date_col: str, rules: Mapping[str, str | Column], by: Sequence[str] = ()
) -> DataFrame:
    """Per person and rule: first, last and number of index dates that meet it.

    All rules are evaluated in one aggregate. Persons meeting none of them stay,
    with NULL dates and a count of 0.
    """
    aggregates = []
    for name, rule in rules.items():
        day = F.when(_rule(rule), F.col(date_col))
        aggregates += [
            F.min(day).alias(f"{name}_min_date"),
            F.max(day).alias(f"{name}_max_date"),
            F.count(day).alias(f"{name}_n_dates"),
        ]
    return by_index.groupBy("person_id", *by).agg(*aggregates)


def phenotype_near_index(
    cohort: DataFrame,
    criteria: Sequence[Criterion],
    rule: str | Column,
    date_col: str,
    days_pre: int,
    days_post: int,
    index_between: DateRange | None = None,
) -> DataFrame:
    """Persons meeting the rule at one and the same index date.

    ``rule`` is a Boolean expression over the criterion names, for example
    ``"(culture_px or culture_lab) and fluids and antibiotics"``.
    """
    by_index = criteria_by_index(cohort, criteria, date_col, days_pre, days_post, index_between)
    return (
        by_index.where(_rule(rule))
        .groupBy("person_id")
        .agg(
            F.min(date_col).alias("min_date"),
            F.max(date_col).alias("max_date"),
            F.count("*").alias("n_dates"),
        )
    )


def condition_near_index(
    codes: Codes,
    cohort: DataFrame,
    date_col: str,
    days_pre: int,
    days_post: int,
    conditions: DataFrame,
    index_between: DateRange | None = None,
) -> DataFrame:
    """Persons with a condition of the code set, by standard or source code."""
    source = condition_source(conditions)
    return phenotype_near_index(
        cohort,
        [Criterion("coded", source, codes)],
        "coded",
        date_col,
        days_pre,
        days_post,
        index_between,
    )


def condition_source(conditions: DataFrame) -> EventSource:
    return EventSource(
        conditions,
        "condition_start_date",
        ("condition_concept_id", "condition_source_concept_id"),
    )


def two_level_cohort(
    by_index: DataFrame,
    date_col: str,
    base_rule: str | Column,
    confirming_rule: str | Column,
    level: str = "person",
) -> DataFrame:
    """Persons meeting the confirming rule who also meet the base rule.

    With ``level="person"`` the two may hold at different index dates; with
    ``level="index"`` they have to hold at the same one. Dates and counts are
    those of the confirming rule.
    """
    if level not in ("person", "index"):
        raise ValueError("level is 'person' or 'index'")
    confirming = _rule(confirming_rule)
    if level == "index":
        confirming = confirming & _rule(base_rule)
    both = phenotypes_by_person(
        by_index, date_col, {"base": base_rule, "confirmed": confirming}
    )
    return both.where("base_n_dates > 0 and confirmed_n_dates > 0").select(
        "person_id",
        F.col("confirmed_min_date").alias("min_date"),
        F.col("confirmed_max_date").alias("max_date"),
        F.col("confirmed_n_dates").alias("n_dates"),
    )
