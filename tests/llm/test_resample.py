"""Resampling against plain Python; the quickselect against sorting; edge rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from cohortlane.llm.resample import Settings, kth_key, ranked, resample


def features(text, runs):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    ws = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)
    return len(ws), [" ".join(ws[i : i + n]) for n in range(1, runs + 1) for i in range(len(ws) - n + 1)]


def brute(docs, target, s):
    def bucket(f):
        return zlib.crc32(f.encode()) % s.buckets

    corpus = Counter(bucket(f) for _, t in docs for f in features(t, s.runs)[1])
    wanted = Counter(bucket(f) for t in target for f in features(t, s.runs)[1])
    n, m = sum(corpus.values()) + s.buckets, sum(wanted.values()) + s.buckets
    out, drawn = {}, []
    for i, t in docs:
        n_words, fs = features(t, s.runs)
        weight = sum(
            math.floor(1000 * math.log((wanted[bucket(f)] + 1.0) * n / ((corpus[bucket(f)] + 1.0) * m))) for f in fs
        )
        h = int(hashlib.sha256(f"{s.seed}:{i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out[i] = [i, len(fs), weight, score, None]
        if n_words >= s.least:
            drawn.append((-score, i))
    for rank, (_, i) in enumerate(sorted(drawn)[: s.percent * len(drawn) // 100], 1):
        out[i][4] = rank
    return sorted(map(tuple, out.values()))


@pytest.mark.parametrize("settings", [
    Settings(),
    Settings(runs=3, buckets=50, percent=37, least=4, seed=7, pivots=3),
    Settings(percent=100, least=0, pivots=2),
])
def test_against_plain_python(spark, documents, settings):
    rng = random.Random(settings.runs)
    vocabulary = ["alpha", "Beta", "gämma", "DELTA9", "ÉTÉ", "x1-y2", "b,c"]
    docs = [(i, " ".join(rng.choices(vocabulary, k=rng.randrange(60)))) for i in range(80)]
    target = [" ".join(rng.choices(vocabulary[:3], k=30)) for _ in range(5)]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    got = resample(documents(*docs).repartition(5), frame, settings)
    assert [d for _, d in got.dtypes] == ["bigint"] * 5
    assert sorted(map(tuple, got.collect())) == brute(docs, target, settings)


@pytest.mark.parametrize("pivots", [1, 2, 16])
def test_kth_key(spark, pivots):
    rng = random.Random(pivots)
    # many equal scores, and some equal rows
    rows = [(rng.randrange(4), rng.randrange(40)) for _ in range(150)]
    frame = spark.createDataFrame(rows, "score long, doc_id long").repartition(4).cache()
    order = sorted(rows, key=lambda x: (-x[0], x[1]))
    for k in (1, 2, 75, 149, 150):
        assert kth_key(frame, k, pivots, seed=k) == order[k - 1]
    assert kth_key(frame, 0, pivots) is None
    assert kth_key(frame, 151, pivots) is None
    assert kth_key(frame.limit(0), 3, pivots) is None
    frame.unpersist()


def test_ranks_over_ranges(spark):
    frame = spark.range(1000).select((F.col("id") * 37 % 101).alias("score"), F.col("id").alias("doc_id")).repartition(7)
    got = sorted((r["rank"], r["score"], r["doc_id"]) for r in ranked(frame).collect())
    want = sorted(((i * 37 % 101, i) for i in range(1000)), key=lambda x: (-x[0], x[1]))
    assert got == [(n, *x) for n, x in enumerate(want, 1)]


def test_edges(spark, documents):
    target = spark.createDataFrame([(1, "alpha beta"), (2, None)], "item_id long, text string")
    long = "alpha " * 50_000
    df = documents((1, None), (2, ""), (3, "alpha " * 30), (3, "alpha " * 30), (None, "alpha " * 40), (4, long))
    df = df.withColumn("score", F.lit("s")).withColumn("rank", F.lit(1.5)).withColumn("n_words", F.lit(0))
    got = resample(df, target, Settings(percent=67)).collect()
    assert len(got) == 6
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert by[1][0].n_features == 0 and by[1][0].weight == 0 and by[1][0]["rank"] is None
    assert by[None][0].score is None and by[None][0]["rank"] is None
    # three rows are in the draw, two are drawn: repeated rows one by one
    # its word is rarer in the target, so the longest text comes last
    assert by[4][0].n_features == 50_000 and by[4][0]["rank"] is None
    assert sorted(r["rank"] for r in by[3]) == [1, 2]
    assert resample(df.limit(0), target).count() == 0
    assert {r["rank"] for r in resample(df, target.limit(0), Settings(percent=0)).collect()} == {None}
