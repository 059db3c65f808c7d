"""Category labels derived from concept ids and ages."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Concept ids and the labels they get.
FEMALE = 8532
MALE = 8507
HISPANIC = 38003563
NOT_HISPANIC = 38003564
WHITE = 8527
MIDDLE_EASTERN = 38003615
BLACK = 8516
ASIAN = 8515
AMERICAN_INDIAN = 8657
PACIFIC_ISLANDER = 8557
MULTIPLE_RACE = 44814659
UNDISCLOSED = (44814649, 44814650, 44814653, 44814660)

SEX_LABELS = (
    ((FEMALE,), "Female"),
    ((MALE,), "Male"),
)
SEX_DEFAULT = "Other/unknown/ambiguous"

ETHNICITY_LABELS = (
    ((HISPANIC,), "Hispanic"),
    ((NOT_HISPANIC,), "Not_Hispanic"),
    (UNDISCLOSED, "Refuse_Other_Unknown"),
)
ETHNICITY_DEFAULT = "Other/Unknown"

ETHNICITY_SHORT_LABELS = (((HISPANIC,), "Hispanic"),)
ETHNICITY_SHORT_DEFAULT = "Not_Hispanic/Other/Unknown"

RACE_LABELS = (
    ((WHITE, MIDDLE_EASTERN), "White_or_Middle_Eastern_North_African"),
    ((BLACK,), "Black"),
    ((ASIAN,), "Asian"),
    ((AMERICAN_INDIAN,), "American_Indian_Alaska_Native"),
    ((PACIFIC_ISLANDER,), "Native_Hawaiian_Other_PI"),
    ((MULTIPLE_RACE,), "Multiple_Race"),
    (UNDISCLOSED, "Unknown_Other_Refuse"),
)

RACE_GROUPED_LABELS = (
    ((WHITE, MIDDLE_EASTERN), "White_or_Middle_Eastern_North_African"),
    ((BLACK,), "Black_or_African_American"),
    ((ASIAN,), "Asian"),
    ((AMERICAN_INDIAN, PACIFIC_ISLANDER, MULTIPLE_RACE), "Multiple_or_AI_AN_or_NH_OPI"),
    (UNDISCLOSED, "Unknown_Other_Refuse"),
)

RACE_WITHIN_NOT_HISPANIC_LABELS = (
    ((WHITE, MIDDLE_EASTERN), "NH_White_or_Middle_Eastern_North_African"),
    ((BLACK,), "NH_Black/AA"),
    ((ASIAN,), "NH_Asian"),
    ((MULTIPLE_RACE, AMERICAN_INDIAN, PACIFIC_ISLANDER), "NH_Multiple_or_AI_AN_NH_OPI"),
)
RACE_ETHNICITY_DEFAULT = "Other/Unknown"

# Upper age limit (exclusive) of each group; negative ages fall into the first.
AGE_GROUPS = ((1, "<1"), (5, "01 to 04"), (10, "05 to 09"), (14, "10 to 13"), (18, "14 to 17"))
AGE_DEFAULT = "Old or Unknown"

VARIABLE_LABELS = {
    "site": "Site",
    "raceth_cat": "Race/Ethnicity",
    "race_cat2": "Race",
    "eth_cat2": "Ethnicity",
    "sex_cat": "Sex",
    "age_group": "Age Group",
    "Total": "1_Total",
}


def first_match(cases: Sequence[tuple[Column, Column | str]], default: str | None = None) -> Column:
    """CASE WHEN over (condition, value) pairs; the first true one wins."""
    chain = reduce(lambda acc, case: acc.when(case[0], case[1]), cases, F)
    return chain.otherwise(default) if default is not None else chain


def label_ids(column: str, labels, default: str | None = None) -> Column:
    return first_match([(F.col(column).isin(*ids), text) for ids, text in labels], default)


def sex(column: str = "gender_concept_id") -> Column:
    return label_ids(column, SEX_LABELS, SEX_DEFAULT)


def ethnicity(column: str = "ethnicity_concept_id") -> Column:
    return label_ids(column, ETHNICITY_LABELS, ETHNICITY_DEFAULT)


def ethnicity_short(column: str = "ethnicity_concept_id") -> Column:
    return label_ids(column, ETHNICITY_SHORT_LABELS, ETHNICITY_SHORT_DEFAULT)


def race(column: str = "race_concept_id") -> Column:
    return label_ids(column, RACE_LABELS)


def race_grouped(column: str = "race_concept_id") -> Column:
    return label_ids(column, RACE_GROUPED_LABELS)


def race_ethnicity(
    race_column: str = "race_concept_id", ethnicity_column: str = "ethnicity_concept_id"
) -> Column:
    hispanic = F.col(ethnicity_column) == HISPANIC
    not_hispanic = F.col(ethnicity_column) == NOT_HISPANIC
    within = [
        (not_hispanic & F.col(race_column).isin(*ids), text)
        for ids, text in RACE_WITHIN_NOT_HISPANIC_LABELS
    ]
    return first_match([(hispanic, "Hispanic"), *within], RACE_ETHNICITY_DEFAULT)


def age_group(column: str = "age") -> Column:
    return first_match([(F.col(column) < limit, text) for limit, text in AGE_GROUPS], AGE_DEFAULT)


def variable_label(column: str = "variable") -> Column:
    cases = [(F.col(column) == name, F.lit(text)) for name, text in VARIABLE_LABELS.items()]
    return F.coalesce(first_match(cases), F.col(column))


def count_and_percent(count: str, percent: str) -> Column:
    """``12 (34.5)``: the percentage without a trailing ``.0``, NaN if undefined."""
    number = F.regexp_replace(F.col(percent).cast("string"), r"\.0$", "")
    number = F.coalesce(number, F.lit("NaN"))
    return F.concat(F.col(count).cast("string"), F.lit(" ("), number, F.lit(")"))
