"""Stays against a record-by-record state machine."""

import random
from datetime import date, datetime, timedelta

import pytest

from cohortlane.operators.cohorts import (
    ADMISSION,
    CENSUS,
    DISCHARGE,
    TRANSFER_IN,
    TRANSFER_OUT,
)
from cohortlane.operators.episodes import adt_episodes, max_records_per_instant

T0 = datetime(2020, 1, 1)
TRANSIT = 2000000090
ADT = (
    "adt_occurrence_id long, person_id long, visit_occurrence_id long, site string,"
    " adt_datetime timestamp_ntz, adt_date date, adt_type_concept_id long"
)
VISIT = (
    "visit_occurrence_id long, visit_start_date date, visit_start_datetime timestamp_ntz,"
    " visit_end_date date, visit_end_datetime timestamp_ntz"
)
KIND = {ADMISSION: "S", TRANSFER_IN: "S", DISCHARGE: "E", TRANSFER_OUT: "E"}
STARTS, ENDS, OTHERS = (ADMISSION, TRANSFER_IN), (DISCHARGE, TRANSFER_OUT), (TRANSIT,)


def hours(h):
    return T0 + timedelta(hours=h)


def machine(records, visit, gap):
    """Episodes of one stay: (id, start, end), walking record by record."""
    records = sorted((r for r in records if r[2] != CENSUS), key=lambda r: (r[1], r[0]))
    kinds_at = {}
    for _, at, kind in records:
        kinds_at.setdefault(at, set()).add(KIND.get(kind, "O"))
    rows = [
        (at, i, KIND.get(kind, "O"))
        for i, at, kind in records
        if KIND.get(kind, "O") == "O" or not {"S", "E"} <= kinds_at[at]
    ]
    if rows and visit:
        begin, finish = visit
        without_start = rows[0][2] != "S"
        without_end = rows[-1][2] != "E"
        if without_start:
            rows.append((begin, -1, "S"))
        if without_start or without_end:
            rows.append((finish, -2, "E"))
        rows.sort(key=lambda r: r[0])
    episodes, opened, closing = [], None, False
    for at, i, kind in rows:
        if closing and kind == "E":
            episodes[-1][2] = at
            continue
        closing = False
        if kind == "S" and opened is None:
            opened = (i, at)
        elif kind == "E" and opened is not None:
            episodes.append([*opened, at])
            opened, closing = None, True
    merged = []
    for episode in episodes:
        if merged and episode[1] - merged[-1][2] < gap:
            merged[-1][2] = episode[2]
        else:
            merged.append(list(episode))
    return [tuple(e) for e in merged]


def run(spark, stays, visits=None, **options):
    rows, number = [], 0
    for (person, visit, site), records in stays.items():
        rows += [(i, person, visit, site, at, at.date(), kind) for i, at, kind in records]
    adt = spark.createDataFrame(rows, ADT)
    frame = None
    if visits is not None:
        frame = spark.createDataFrame(
            [(v, s.date(), s, e.date(), e) for v, (s, e) in visits.items()], VISIT
        )
    found = {}
    for r in adt_episodes(adt, frame, **{"check_ties": False, **options}).collect():
        assert r.episode_start_date == r.episode_start_datetime.date()
        assert r.episode_end_date == r.episode_end_datetime.date()
        found.setdefault((r.person_id, r.visit_occurrence_id, r.site), []).append(
            (r.episode_id, r.episode_start_datetime, r.episode_end_datetime)
        )
    return {k: sorted(v, key=lambda e: e[1]) for k, v in found.items()}


def one(spark, *records, visit=None, **options):
    numbered = [(i, hours(h), kind) for i, (h, kind) in enumerate(records, start=1)]
    visits = {10: (hours(visit[0]), hours(visit[1]))} if visit else None
    found = run(spark, {(1, 10, "a"): numbered}, visits, **options).get((1, 10, "a"), [])
    as_hours = [
        (i, (s - T0).total_seconds() / 3600, (e - T0).total_seconds() / 3600) for i, s, e in found
    ]
    return as_hours


def test_earliest_start_and_latest_end(spark):
    assert one(spark, (0, STARTS[0]), (1, STARTS[1]), (5, ENDS[0]), (6, ENDS[1])) == [(1, 0, 6)]


def test_other_record_breaks_a_run_of_ends(spark):
    assert one(spark, (0, ADMISSION), (5, DISCHARGE), (6, TRANSIT), (7, DISCHARGE)) == [(1, 0, 5)]


def test_start_and_end_at_one_time_cancel(spark):
    assert one(spark, (0, ADMISSION), (2, DISCHARGE), (2, ADMISSION), (9, DISCHARGE)) == [(1, 0, 9)]


def test_unclosed_is_dropped(spark):
    assert one(spark, (0, ADMISSION)) == []


def test_census_is_ignored(spark):
    assert one(spark, (0, ADMISSION), (1, DISCHARGE), (2, CENSUS), (3, DISCHARGE)) == [(1, 0, 3)]


@pytest.mark.parametrize(("gap", "episodes"), [(11 + 59 / 60, 1), (12, 2)])
def test_gap_is_strict(spark, gap, episodes):
    found = one(spark, (0, ADMISSION), (1, DISCHARGE), (1 + gap, TRANSFER_IN), (30, TRANSFER_OUT))
    assert len(found) == episodes


def test_bookends(spark):
    # an end without a start gets both bookends
    assert one(spark, (5, DISCHARGE), visit=(0, 8)) == [(-1, 0, 8)]
    assert one(spark, (2, ADMISSION), visit=(0, 8)) == [(1, 2, 8)]
    assert one(spark, (2, ADMISSION), (3, DISCHARGE), visit=(0, 8)) == [(1, 2, 3)]
    assert one(spark, (2, TRANSIT), visit=(0, 8)) == [(-1, 0, 8)]


def test_stay_emptied_by_cancelling_has_no_episode(spark):
    assert one(spark, (2, ADMISSION), (2, DISCHARGE), visit=(0, 8)) == []


def test_missing_visit_key(spark):
    found = run(spark, {(1, None, None): [(1, hours(0), ADMISSION), (2, hours(3), DISCHARGE)]}, {})
    assert found == {(1, None, None): [(1, hours(0), hours(3))]}


def test_guard_counts_records_per_instant(spark):
    rows = [(i, 1, 10, "a", T0, T0.date(), ADMISSION) for i in range(3)]
    rows.append((9, 1, 10, "a", T0, T0.date(), CENSUS))
    assert max_records_per_instant(spark.createDataFrame(rows, ADT)).first()[0] == 3


def random_stays(seed, stays, longest, step_hours):
    rng, number, made = random.Random(seed), 0, {}
    for person in range(stays):
        at, records = 0.0, []
        for _ in range(rng.randint(1, longest)):
            at += rng.choice([0, 0.25, 1, step_hours, 3 * step_hours])
            number += 1
            pool = rng.choice([STARTS, ENDS, ENDS, STARTS, OTHERS, (CENSUS,)])
            records.append((number, hours(at), rng.choice(pool)))
        made[(person, person * 10, rng.choice(["a", "b", None]))] = records
    return made


@pytest.mark.parametrize("slice_seconds", [3600, 6 * 3600, 86_400, 365 * 86_400])
@pytest.mark.parametrize("with_visits", [False, True])
def test_random_stays(spark, slice_seconds, with_visits):
    stays = random_stays(slice_seconds + with_visits, 120, 25, 6)
    visits = None
    if with_visits:
        rng = random.Random(7)
        visits = {
            key[1]: (
                records[0][1] - timedelta(hours=rng.choice([0, 2, 30, -1])),
                records[-1][1] + timedelta(hours=rng.choice([0, 2, 30, -1])),
            )
            for key, records in stays.items()
            if rng.random() < 0.8
        }
    gap = timedelta(hours=12)
    expected = {
        key: episodes
        for key, records in stays.items()
        if (episodes := machine(records, (visits or {}).get(key[1]), gap))
    }
    assert run(spark, stays, visits, slice_seconds=slice_seconds) == expected


@pytest.mark.parametrize("gap_hours", [0, 1, 48])
def test_random_stays_with_other_gaps(spark, gap_hours):
    stays = random_stays(gap_hours, 80, 30, 5)
    gap = timedelta(hours=gap_hours)
    expected = {k: e for k, r in stays.items() if (e := machine(r, None, gap))}
    assert run(spark, stays, max_gap_seconds=gap_hours * 3600, slice_seconds=7200) == expected


def test_hot_stay(spark):
    """One stay with a third of all records: cut up, and the same result."""
    rng, records, at = random.Random(3), [], 0.0
    for number in range(1, 4001):
        at += rng.choice([0.02, 0.1, 0.5, 13])
        records.append((number, hours(at), rng.choice(STARTS + ENDS + OTHERS)))
    stays = {(0, 0, "a"): records}
    for person in range(1, 1001):
        base = 10_000 + person * 10
        stays[(person, person, "b")] = [
            (base + k, hours(k), kind) for k, kind in enumerate((ADMISSION, TRANSIT, DISCHARGE))
        ]
    gap = timedelta(hours=12)
    expected = {k: e for k, r in stays.items() if (e := machine(r, None, gap))}
    assert run(spark, stays) == expected


def test_three_records_at_an_instant_fail(spark):
    three = [(0, ADMISSION), (4, DISCHARGE), (4, DISCHARGE), (4, TRANSFER_OUT)]
    with pytest.raises(Exception, match="more than two records"):
        one(spark, *three, check_ties=True)
    two = [(0, ADMISSION), (4, DISCHARGE), (4, TRANSFER_OUT)]
    assert one(spark, *two, check_ties=True) == one(spark, *two)
    # other records, and those of other persons, are counted apart
    assert one(spark, (0, ADMISSION), (4, TRANSIT), (4, TRANSIT), (5, DISCHARGE), (5, TRANSFER_OUT), check_ties=True)
