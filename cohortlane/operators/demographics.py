"""Person attributes and derived categories for a cohort."""

from __future__ import annotations

from pyspark.sql import DataFrame

from cohortlane.functions import labels
from cohortlane.functions.dates import age_years

PERSON_ATTRIBUTES = (
    "site",
    "birth_date",
    "gender_concept_id",
    "race_concept_id",
    "ethnicity_concept_id",
)


def demographics(cohort: DataFrame, date_col: str, person: DataFrame) -> DataFrame:
    """Cohort rows with person attributes, age at ``date_col`` and category labels.

    Attributes the cohort already carries are replaced by the person table's.
    Persons without a person row stay, with NULL attributes.
    """
    return (
        cohort.drop(*PERSON_ATTRIBUTES, "age")
        .join(person.select("person_id", *PERSON_ATTRIBUTES), "person_id", "left")
        .withColumn("age", age_years("birth_date", date_col))
        .withColumns({
            "sex_cat": labels.sex(),
            "raceth_cat": labels.race_ethnicity(),
            "eth_cat": labels.ethnicity(),
            "race_cat": labels.race(),
            "eth_cat2": labels.ethnicity_short(),
            "race_cat2": labels.race_grouped(),
            "age_group": labels.age_group(),
        })
    )


def known_sex(df: DataFrame) -> DataFrame:
    return df.where(df["sex_cat"].isin("Male", "Female"))
