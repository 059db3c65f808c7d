"""Windows around index dates, code matching and phenotypes on hand-made rows."""

from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from cohortlane.operators import codes as code_ops
from cohortlane.operators.phenotype import (
    Criterion,
    EventSource,
    condition_near_index,
    criteria_by_index,
    phenotype_near_index,
    phenotypes_by_person,
    two_level_cohort,
)
from cohortlane.operators.proximity import near_index, restrict_to_persons

D0 = date(2020, 3, 1)
CODE, OTHER = 100, 999


def day(n):
    return D0 + timedelta(days=n)


@pytest.fixture(scope="module")
def make(spark):
    class Make:
        def cohort(self, *rows):
            return spark.createDataFrame(list(rows), "person_id long, adt_date date")

        def conditions(self, *rows):
            numbered = [(i, *row) for i, row in enumerate(rows)]
            return spark.createDataFrame(
                numbered,
                "condition_occurrence_id long, person_id long, condition_concept_id long,"
                " condition_source_concept_id long, condition_start_date date",
            )

        def events(self, *rows):
            return spark.createDataFrame(
                list(rows), "person_id long, concept_id_ long, event_date_ date"
            )

        def codes(self, *ids):
            return spark.createDataFrame([(i,) for i in ids], "concept_id long")

    return Make()


def coded(make, conditions, cohort, pre=7, post=7, codes=(CODE,)):
    found = condition_near_index(
        make.codes(*codes), make.cohort(*cohort), "adt_date", pre, post, make.conditions(*conditions)
    )
    return {r.person_id: (r.min_date, r.max_date, r.n_dates) for r in found.collect()}


@pytest.mark.parametrize(
    ("offset", "pre", "post", "matches"),
    [
        (-8, 7, 7, False),
        (-7, 7, 7, True),
        (0, 7, 7, True),
        (7, 7, 7, True),
        (8, 7, 7, False),
        (-3, 2, 5, False),
        (-2, 2, 5, True),
        (5, 2, 5, True),
        (6, 2, 5, False),
    ],
)
def test_window_bounds(make, offset, pre, post, matches):
    found = coded(make, [(1, CODE, OTHER, day(offset))], [(1, D0)], pre, post)
    assert (1 in found) is matches


def test_null_dates_never_match(make):
    assert coded(make, [(1, CODE, OTHER, None)], [(1, D0)]) == {}
    assert coded(make, [(1, CODE, OTHER, D0)], [(1, None)]) == {}


@pytest.mark.parametrize(
    ("standard", "source", "matches"),
    [(CODE, OTHER, 1), (OTHER, CODE, 1), (CODE, CODE, 1), (OTHER, OTHER, 0), (None, CODE, 1), (None, None, 0)],
)
def test_standard_or_source_code(make, standard, source, matches):
    assert len(coded(make, [(1, standard, source, D0)], [(1, D0)])) == matches


def test_occurrence_matching_both_ways_counts_each_index_date_once(make):
    found = coded(make, [(1, CODE, CODE, day(2))], [(1, D0), (1, day(4))])
    assert found == {1: (D0, day(4), 2)}


def test_dates_counted_are_index_dates(make):
    events = [(1, CODE, OTHER, day(n)) for n in (0, 1, 2)] + [(1, CODE, OTHER, day(41))]
    found = coded(make, events, [(1, D0), (1, day(40)), (1, day(90))])
    assert found == {1: (D0, day(40), 2)}


def test_duplicates_change_nothing(make):
    once = coded(make, [(1, CODE, OTHER, D0)], [(1, D0)])
    many = coded(make, [(1, CODE, OTHER, D0)] * 3, [(1, D0)] * 2, codes=(CODE, CODE))
    assert once == many == {1: (D0, D0, 1)}


def sources(make, px=(), lab=(), drug=()):
    def source(rows):
        return EventSource(make.events(*rows), "event_date_", ("concept_id_",))

    drugs = source(drug)
    return [
        Criterion("px", source(px), make.codes(1)),
        Criterion("lab", source(lab), make.codes(2)),
        Criterion("fluids", drugs, make.codes(3, 5)),
        Criterion("abx", drugs, make.codes(4, 5)),
    ]


RULE = "(px or lab) and fluids and abx"


def test_criteria_have_to_meet_at_one_index_date(make):
    cohort = make.cohort((1, D0), (1, day(60)), (2, D0))
    criteria = sources(
        make,
        px=[(1, 1, D0)],
        lab=[(2, 2, day(1))],
        drug=[(1, 3, day(60)), (1, 4, day(61)), (2, 3, day(-2)), (2, 4, day(2))],
    )
    found = phenotype_near_index(cohort, criteria, RULE, "adt_date", 7, 7).collect()
    assert [r.person_id for r in found] == [2]


def test_one_drug_may_serve_two_criteria(make):
    criteria = sources(make, px=[(1, 1, D0)], drug=[(1, 5, D0)])
    assert phenotype_near_index(make.cohort((1, D0)), criteria, RULE, "adt_date", 7, 7).count() == 1


def test_two_levels(make):
    # suspected at one stay, coded at another
    cohort = make.cohort((1, D0), (1, day(60)))
    criteria = [
        *sources(make, px=[(1, 1, D0)], drug=[(1, 5, D0)]),
        Criterion("coded", EventSource(make.events((1, CODE, day(60))), "event_date_", ("concept_id_",)), make.codes(CODE)),
    ]
    by_index = criteria_by_index(cohort, criteria, "adt_date", 7, 7)
    person = two_level_cohort(by_index, "adt_date", RULE, "coded").collect()
    assert [(r.person_id, r.min_date, r.n_dates) for r in person] == [(1, day(60), 1)]
    assert two_level_cohort(by_index, "adt_date", RULE, "coded", "index").count() == 0
    with pytest.raises(ValueError):
        two_level_cohort(by_index, "adt_date", RULE, "coded", "visit")


def test_unmatched_persons_can_stay(make):
    cohort = make.cohort((1, D0), (2, D0), (3, None))
    by_index = criteria_by_index(
        cohort, sources(make, px=[(1, 1, D0)]), "adt_date", 7, 7, keep_unmatched=True
    )
    persons = phenotypes_by_person(by_index, "adt_date", {"x": "px"}).collect()
    assert {r.person_id: r.x_n_dates for r in persons} == {1: 1, 2: 0, 3: 0}


@pytest.mark.parametrize("keep", [False, True])
def test_day_buckets_change_nothing(make, keep):
    # dates on both sides of 1970, where day numbers turn negative
    base = date(1969, 12, 25)
    cohort = make.cohort(*[(p, base + timedelta(days=3 * k)) for p in (1, 2) for k in range(6)], (3, base))
    events = make.events(*[(p, CODE, base + timedelta(days=5 * k)) for p in (1, 2) for k in range(-3, 6)])
    criteria = [Criterion("c", EventSource(events, "event_date_", ("concept_id_",)), make.codes(CODE))]
    for pre, post in ((0, 0), (1, 0), (2, 5)):
        plain, bucketed = (
            sorted(
                map(tuple, criteria_by_index(
                    cohort, criteria, "adt_date", pre, post, keep_unmatched=keep, day_buckets=b
                ).collect())
            )
            for b in (False, True)
        )
        assert plain == bucketed


def test_wider_windows_only_add(make):
    cohort = [(p, D0) for p in range(1, 21)]
    events = [(p, CODE, OTHER, day(p - 10)) for p in range(1, 21)]
    sizes = [set(coded(make, events, cohort, d, d)) for d in range(0, 12)]
    assert all(a <= b for a, b in zip(sizes, sizes[1:]))


def test_index_range_only_prunes(make):
    cohort, events = [(1, D0), (2, day(9))], [(1, CODE, OTHER, day(7)), (2, CODE, OTHER, day(2))]
    found = condition_near_index(
        make.codes(CODE), make.cohort(*cohort), "adt_date", 7, 7, make.conditions(*events), (D0, day(9))
    )
    assert found.count() == 2


def test_near_index_keeps_every_event_row(make):
    events = make.events((1, CODE, D0), (1, CODE, D0), (1, CODE, day(9)))
    assert near_index(events, "event_date_", make.cohort((1, D0), (1, D0)), "adt_date", 7, 7).count() == 2


def test_hot_person(make):
    """One person with a third of the rows, on every day of a year."""
    hot = [(1, CODE, day(n % 365)) for n in range(3000)]
    rest = [(2 + n % 500, CODE, day(n % 365)) for n in range(6000)]
    cohort = [(1, day(n)) for n in range(0, 365, 10)] + [(p, day(50)) for p in range(2, 502)]
    criteria = [
        Criterion("c", EventSource(make.events(*hot, *rest), "event_date_", ("concept_id_",)), make.codes(CODE))
    ]
    found = criteria_by_index(make.cohort(*cohort), criteria, "adt_date", 2, 2)
    days = {}
    for p, _, d in hot + rest:
        days.setdefault(p, set()).add(d)
    expected = sum(any(abs((d - i).days) <= 2 for d in days.get(p, ())) for p, i in cohort)
    assert found.where("c").count() == expected


def test_restrict_to_persons(make):
    cohort = make.cohort((1, D0), (2, D0))
    assert restrict_to_persons(cohort, make.events((1, CODE, D0), (1, CODE, D0))).count() == 1


# code matching


def test_duplicate_codes(make):
    events, twice = make.events((1, CODE, D0), (1, OTHER, D0)), make.codes(CODE, CODE)
    assert code_ops.match_codes(events, "concept_id_", twice).count() == 1
    assert code_ops.match_codes(events, "concept_id_", twice, dedupe=False).count() == 2


def test_null_codes_never_match(make):
    events = make.events((1, None, D0))
    assert code_ops.match_codes(events, "concept_id_", make.codes(None)).count() == 0
    assert code_ops.tag_events(events, ("concept_id_",), {0: make.codes(None)}).count() == 0


def test_stored_cohort_gives_the_same(make):
    cohort = make.cohort((1, D0), (2, day(3)), (2, D0), (3, D0))
    criteria = sources(make, px=[(1, 1, D0), (2, 1, day(3)), (9, 1, D0)], drug=[(2, 5, day(4)), (3, 5, D0)])
    for keep in (False, True):
        plain, reduced = (
            criteria_by_index(
                cohort, criteria, "adt_date", 2, 2, keep_unmatched=keep, stored_cohort=stored
            )
            for stored in (False, True)
        )
        assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, reduced.collect()))


def large(codes):
    """A code set as if it were too large to broadcast."""
    return code_ops.CodeSet(codes, rows=10**9, bytes=10**11, spread=16)


def test_hot_concept_beyond_the_broadcast_limit(make, spark):
    """A concept with a third of all events is spread over partitions."""
    rows = [(n, 0 if n % 3 == 0 else n, D0) for n in range(6000)]
    events, wanted = make.events(*rows), make.codes(*range(0, 6000, 2))
    small = code_ops.tag_events(events, ("concept_id_",), {0: wanted, 3: make.codes(0)}).collect()
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        tagged = code_ops.tag_events(
            events, ("concept_id_",), {0: large(wanted), 3: large(make.codes(0))}
        )
        hot = tagged.where("concept_id_ = 0").groupBy(F.spark_partition_id()).count().count()
        found = tagged.collect()
        twice = code_ops.tag_events(events, ("concept_id_", "person_id"), {0: large(wanted)}).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sorted(map(tuple, small)) == sorted(map(tuple, found))
    assert hot > 1
    assert len(twice) == sum(c % 2 == 0 or p % 2 == 0 for p, c, _ in rows)


def test_only_checked_small_code_sets_are_hinted(make):
    events = make.events(*[(n, n % 7, D0) for n in range(100)])
    codes = make.codes(1, 2)
    small = code_ops.match_codes(events, "concept_id_", code_ops.CodeSet.checked(codes))
    others = [code_ops.match_codes(events, "concept_id_", c) for c in (codes, large(codes))]
    hinted = "strategy=broadcast"
    assert hinted in small._jdf.queryExecution().optimizedPlan().toString().lower()
    for other in others:
        assert hinted not in other._jdf.queryExecution().optimizedPlan().toString().lower()
        assert sorted(map(tuple, small.collect())) == sorted(map(tuple, other.collect()))


def test_size_check(make, spark):
    checked = code_ops.CodeSet.checked(make.codes(*range(10)))
    assert checked.rows == 10 and checked.small
    wide = spark.range(3).selectExpr("id as concept_id", "repeat('x', 30000000) as note")
    assert not code_ops.CodeSet.checked(wide).small
    assert code_ops.CodeSet.checked(make.codes(1).limit(0)).bytes == 0


def test_at_most_63_code_sets(make):
    with pytest.raises(ValueError):
        code_ops.tag_events(make.events((1, 1, D0)), ("concept_id_",), {63: make.codes(1)})
