"""Category counts, cross-tabs and age statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlane.functions import labels
from cohortlane.operators.moments import mean_of, merged, moments, sd_of

SUMMARY_VARIABLES = ("site", "race_cat2", "eth_cat2", "sex_cat", "age_group")


def _count_persons_once(cohort: DataFrame, keys: list[str], variables: list[str]) -> DataFrame:
    """Collapse to distinct (keys, person, categories) and mark one row per person.

    The row counts survive as ``_rows``; the marks add up to distinct persons.
    """
    collapsed = cohort.groupBy(*keys, "person_id", *variables).agg(F.count("*").alias("_rows"))
    order = Window.partitionBy(*keys, "person_id").orderBy(*variables)
    first = F.row_number().over(order) == 1
    return collapsed.select(*keys, *variables, "_rows", first.cast("bigint").alias("_person"))


def demographic_summary(
    cohort: DataFrame,
    variables: Sequence[str] = SUMMARY_VARIABLES,
    by: Sequence[str] = (),
    one_row_per_person: bool = False,
    groups: Sequence[Sequence] = (),
) -> DataFrame:
    """Total persons, and rows and percentage per category of each variable.

    Rows are counted once, per combination of all categories; the grouping sets
    of the single variables are taken over those few thousand cells. ``by`` adds
    columns to report separately for each of their values, and ``groups`` lists
    values of theirs that have a total even without rows. The percentage
    refers to the number of distinct persons. ``one_row_per_person=True`` is
    the caller's word that persons are unique, and saves finding that out.
    """
    keys, names = list(by), list(variables)
    if one_row_per_person:
        rows = cohort.groupBy(*keys, *names).agg(F.count("*").alias("_rows")).withColumn("_person", F.col("_rows"))
    else:
        rows = (
            _count_persons_once(cohort, keys, names)
            .groupBy(*keys, *names)
            .agg(F.sum("_rows").alias("_rows"), F.sum("_person").alias("_person"))
        )
    # an empty cohort still reports a total of 0
    types = dict(rows.dtypes)
    for group in groups if keys else [()]:
        seed = cohort.sparkSession.range(1).select(
            *[F.lit(value).cast(types[k]).alias(k) for k, value in zip(keys, group, strict=True)],
            *[F.lit(None).cast(types[n]).alias(n) for n in names],
            F.lit(0).cast("bigint").alias("_rows"),
            F.lit(0).cast("bigint").alias("_person"),
        )
        rows = rows.unionByName(seed)

    everything = (1 << len(names)) - 1
    group_of = {n: everything ^ (1 << (len(names) - 1 - i)) for i, n in enumerate(names)}
    counted = rows.groupingSets([keys, *[[*keys, n] for n in names]], *keys, *names).agg(
        F.sum("_rows").alias("_rows"),
        F.sum("_person").alias("_persons"),
        F.grouping_id().alias("_group"),
    )
    # a NULL category and a rolled-up column differ only in the grouping id
    is_total = F.col("_group") == everything
    variable = labels.first_match(
        [(is_total, "Total"), *[(F.col("_group") == g, n) for n, g in group_of.items()]]
    )
    category = labels.first_match(
        [
            (is_total, F.lit("Total")),
            *[(F.col("_group") == g, F.col(n).cast("string")) for n, g in group_of.items()],
        ]
    )
    # this window sees one row per category, however large the cohort
    total = F.max(F.when(is_total, F.col("_persons"))).over(Window.partitionBy(*keys))
    n_patients = F.when(is_total, F.col("_persons")).otherwise(F.col("_rows"))
    return (
        counted.where(is_total | (F.col("_rows") > 0))
        .select(
            *keys,
            variable.alias("variable"),
            category.alias("category"),
            n_patients.alias("n_patients"),
            total.alias("_total"),
        )
        .withColumn(
            "percent_of_total",
            F.round(
                F.try_divide(F.lit(100.0) * F.col("n_patients"), F.col("_total").cast("double")), 2
            ),
        )
        .drop("_total")
    )


def labelled_summary(summary: DataFrame) -> DataFrame:
    """Display labels for the variables and an ``n (percent)`` column."""
    return summary.withColumns({
        "variable": labels.variable_label(),
        "n_pct": labels.count_and_percent("n_patients", "percent_of_total"),
    })


ETHNICITY_COLUMNS = ("Hispanic", "Not_Hispanic_or_Refuse_Other_Unknown")


def raceth_by_sex(cohort: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Race rows by ethnicity-and-sex columns; cells nobody falls in are 0.

    The four columns are fixed, so they are four conditional counts of a single
    aggregate and the result's schema does not depend on the data.
    """
    hispanic = F.coalesce(F.col("ethnicity_concept_id") == labels.HISPANIC, F.lit(False))
    in_ethnicity = dict(zip(ETHNICITY_COLUMNS, (hispanic, ~hispanic)))
    of_sex = {"Female": labels.FEMALE, "Male": labels.MALE}
    cells = [
        F.count_if(condition & (F.col("gender_concept_id") == sex_id)).alias(f"{ethnicity}_{sex}")
        for ethnicity, condition in in_ethnicity.items()
        for sex, sex_id in of_sex.items()
    ]
    return (
        cohort.where(F.col("gender_concept_id").isin(labels.FEMALE, labels.MALE))
        .groupBy(*by, "race_cat")
        .agg(*cells)
    )


def age_quantiles(
    cohort: DataFrame, probabilities: Sequence[float] = (0.2, 0.4, 0.6, 0.8)
) -> DataFrame:
    """Exact age quantiles, interpolated between neighbouring values.

    Ages are whole days over 365.25, so the distinct ages are as few as the days
    of a lifetime: counting rows per age first bounds what the final aggregate
    holds, whatever the size of the cohort.
    """
    per_age = cohort.where(F.col("age").isNotNull()).groupBy("age").agg(F.count("*").alias("n"))
    wanted = F.array(*[F.lit(p) for p in probabilities])
    quantiles = F.percentile("age", list(probabilities), F.col("n"))
    return per_age.agg(F.arrays_zip(wanted.alias("probability"), quantiles.alias("age")).alias("q")).select(
        F.inline("q").alias("probability", "age")
    )


CONTINUOUS_TABLE_VARIABLES = ("age_group", "site", "sex_cat", "raceth_cat")


def demographics_continuous(
    cohort: DataFrame, variables: Sequence[str] = CONTINUOUS_TABLE_VARIABLES
) -> DataFrame:
    """Mean and standard deviation of age, then counts per category.

    Category percentages refer to rows with a known category; a NULL category
    gets a count only. Cohort rows are aggregated once, per combination of all
    categories; the rest works on those cells, with mergeable moments of age.
    """
    names = list(variables)
    everything = (1 << len(names)) - 1
    group_of = {n: everything ^ (1 << (len(names) - 1 - i)) for i, n in enumerate(names)}
    types = dict(cohort.dtypes)
    # an empty cohort still has its row of ages
    nobody = cohort.sparkSession.range(1).select(
        *[F.lit(None).cast(types[n]).alias(n) for n in names],
        F.lit(0).cast("bigint").alias("_rows"),
        F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2")).alias("_age"),
    )
    cells = cohort.groupBy(*names).agg(F.count("*").alias("_rows"), moments("age").alias("_age")).unionByName(nobody)
    counted = cells.groupingSets([[], *[[n] for n in names]], *names).agg(
        F.sum("_rows").alias("_rows"),
        merged(F.col("_age")).alias("_age"),
        F.grouping_id().alias("_group"),
    ).where((F.col("_rows") > 0) | (F.col("_group") == everything))
    is_age = F.col("_group") == everything
    variable = labels.first_match(
        [(is_age, "age"), *[(F.col("_group") == g, n) for n, g in group_of.items()]]
    )
    category = labels.first_match(
        [(F.col("_group") == g, F.col(n).cast("string")) for n, g in group_of.items()]
    )
    table = counted.select(
        variable.alias("variable"),
        category.alias("category"),
        F.when(is_age, F.col("_age.n")).otherwise(F.col("_rows")).alias("n_patients"),
        F.when(is_age, mean_of(F.col("_age"))).alias("mean"),
        F.when(is_age, sd_of(F.col("_age"))).alias("sd"),
    )
    known = F.sum(F.when(F.col("category").isNotNull(), F.col("n_patients"))).over(
        Window.partitionBy("variable")
    )
    percent = F.round(F.lit(100.0) * F.col("n_patients") / known, 2)
    return table.withColumn(
        "percent_of_total", F.when(F.col("category").isNotNull(), percent)
    )
