"""Funnels from person bitmaps against plain sets."""

import random

import pytest
from pyspark.sql import functions as F

from cohortlane.operators.attrition import AttritionStep, attrition
from cohortlane.operators.person_sets import Cut, PersonNumbers, funnel_of, person_sets

SCHEMA = "person_id long, site string, x long"


def test_numbers_are_dense(spark):
    ids = spark.range(0, 10**12, 10**9).select(F.col("id").alias("person_id"))
    some = spark.createDataFrame([(None,), (5,), (5,), (10**9,)], "person_id long")
    numbers = PersonNumbers.checked(ids.repartition(7), some)
    rows = numbers.table.collect()
    assert numbers.persons == len(rows) == 1001
    assert sorted(r.number for r in rows) == list(range(1001))
    assert len({r.person_id for r in rows}) == 1001
    assert PersonNumbers.checked(some.limit(0)).table.count() == 0


@pytest.fixture(scope="module")
def study(spark):
    rng = random.Random(1)
    # ids far apart, persons at several sites, rows without a person or a site
    rows = [
        (rng.choice([None, *range(400)]), rng.choice([None, "a", "b", "c"]), rng.randrange(6)) for _ in range(3000)
    ]
    rows = [(p and p * 10**12 + 7, s, x) for p, s, x in rows]
    one, two = spark.createDataFrame(rows[:1800], SCHEMA), spark.createDataFrame(rows[1800:], SCHEMA)
    steps = [
        AttritionStep("one", one), AttritionStep("one x", one, "x > 2"), AttritionStep("two", two, F.col("x") == 1),
        AttritionStep("no site", two.drop("site")), AttritionStep("nobody", two, "x > 99"),
    ]
    sets = person_sets(steps, PersonNumbers.checked(one, two))
    plain = [
        {(p, s) for p, s, x in part if p is not None and test(x)}
        for part, test in (
            (rows[:1800], lambda x: True), (rows[:1800], lambda x: x > 2), (rows[1800:], lambda x: x == 1),
            (rows[1800:], lambda x: True), (rows[1800:], lambda x: False),
        )
    ]
    plain[3] = {(p, None) for p, _ in plain[3]}
    return steps, sets.cache(), plain


def test_whole_steps_are_the_funnel(study):
    steps, sets, _ = study
    cuts = [Cut(s.description, (i,)) for i, s in enumerate(steps, 1)]
    assert [tuple(r) for r in funnel_of(sets, cuts).collect()] == [tuple(r) for r in attrition(steps).collect()]


@pytest.mark.parametrize("sites", [None, ("a",), ("b", "c"), ("z",)])
@pytest.mark.parametrize("chosen", [(1,), (2, 3), (1, 2, 3), (4, 1), (1, 5), (3, 3)])
def test_cuts(study, chosen, sites):
    _, sets, plain = study
    held = [{p for p, s in plain[i - 1] if sites is None or s in sites} for i in chosen]
    row = funnel_of(sets, [Cut("all", (1,)), Cut("cut", chosen, sites)]).collect()[1]
    assert tuple(row) == (2, "cut", len(set.intersection(*held)))


def test_many_persons_fill_many_bitmaps(spark):
    everybody = spark.range(100_000).select(F.col("id").alias("person_id"), F.lit("s").alias("site"))
    steps = [AttritionStep("even", everybody, "person_id % 2 = 0"), AttritionStep("third", everybody, "person_id % 3 = 0")]
    sets = person_sets(steps, PersonNumbers.checked(everybody))
    got = [r.counts for r in funnel_of(sets, [Cut("e", (1,)), Cut("t", (2,)), Cut("both", (1, 2), ("s",))]).collect()]
    assert got == [50_000, 33_334, 16_667]


def test_too_many_steps(spark):
    frame = spark.createDataFrame([], SCHEMA)
    with pytest.raises(ValueError):
        person_sets([AttritionStep("x", frame)] * 63, PersonNumbers.checked(frame))
