"""The CRF against enumeration; held-out accuracy; edge rows."""

import itertools
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlane.llm import queries as q
from cohortlane.llm.crf import Model, marginals, train
from cohortlane.llm.quality_crf import OWN, WIDTH, Sample, describe, fit, keep_good, line_scores, score_documents, with_neighbours


def brute(model, scores):
    """Marginals of one chain by summing over all state sequences."""
    total, good = 0.0, np.zeros(len(scores))
    for states in itertools.product((0, 1), repeat=len(scores)):
        s = model.start[states[0]] + sum(scores[t] for t, x in enumerate(states) if x)
        s += sum(model.steps[a, b] for a, b in zip(states, states[1:]))
        total += np.exp(s)
        good += np.exp(s) * np.array(states)
    return good / total


def test_marginals():
    rng = np.random.default_rng(1)
    model = Model(rng.normal(size=3), rng.normal(size=(2, 2)), rng.normal(size=2))
    sizes = np.array([1, 4, 2, 9, 1, 3])
    features = rng.normal(size=(sizes.sum(), 3))
    got = marginals(model, features, sizes)
    first = np.cumsum(sizes) - sizes
    for at, size in zip(first, sizes):
        assert np.allclose(got[at : at + size], brute(model, features[at : at + size] @ model.weights))


def test_training_learns_neighbours():
    rng = np.random.default_rng(2)
    sizes = rng.integers(1, 12, 300)
    good = np.concatenate([np.repeat(rng.integers(0, 2), s) for s in sizes])
    # one line in two tells nothing by itself
    clue = np.where(rng.random(len(good)) < 0.5, good * 2 - 1, 0) + rng.normal(scale=0.1, size=len(good))
    features = np.stack((np.ones(len(good)), clue), 1)
    model = train(features, sizes, good)
    alone = ((features @ model.weights > 0) == good).mean()
    chained = ((marginals(model, features, sizes) > 0.5) == good).mean()
    assert chained > 0.93 and chained > alone + 0.05


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = q.op2_quality(spark, sf).collect()
    assert len(rows) == 1000
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    out = [r for r in rows if r.held_out and r.doc_id in labels]
    assert np.mean([r.predicted == labels[r.doc_id] for r in out]) > 0.9
    clean = [r for r in out if labels[r.doc_id] == 1]
    assert np.mean([r.predicted for r in clean]) > 0.95


@pytest.fixture
def flat():
    return Model(np.zeros(WIDTH), np.zeros((2, 2)), np.zeros(2))


def test_edges(spark, documents, flat):
    df = documents((1, None), (2, ""), (3, "\n \n"), (4, "a b.\n" * 5000), (4, "x"), (None, "y")).withColumn("score", F.lit("s"))
    rows = score_documents(df, flat).collect()
    assert len(rows) == 6 and all(r.score == pytest.approx(0.5) for r in rows)
    assert {r.n_lines for r in rows} == {1, 5000}
    kept = keep_good(df, flat)
    assert kept.columns == df.columns and kept.count() == 6
    assert keep_good(df, flat, 0.6).count() == 0
    assert score_documents(df.limit(0), flat).count() == 0
    none = fit(df, spark.createDataFrame([(9, 1, 0)], "doc_id long, quality int, toxic int"))
    assert not none.weights.any()


def test_scores_need_no_wide_features():
    rng = np.random.default_rng(3)
    model = Model(rng.normal(size=WIDTH), rng.normal(size=(2, 2)), rng.normal(size=2))
    texts = [None, "one line", "a b c\n\nd e f!\n \na b c\n" * 30, "x\ny"]
    for text in texts:
        ((own, lengths),) = describe(text)
        want = with_neighbours(own, np.array([len(own)])) @ model.weights
        for at_a_time in (1, 7, 1000):
            got, again = line_scores(text, model, at_a_time)
            assert np.allclose(got, want, atol=1e-4) and (again == lengths).all()
    assert own.shape[1] == OWN


def test_memory_of_many_lines_in_many_texts():
    """128 texts of 2000 lines in one batch: features exist for some lines at a time."""
    import tracemalloc

    import pyarrow as pa

    from cohortlane.llm import quality_crf

    model = Model(np.ones(WIDTH), np.zeros((2, 2)), np.zeros(2))
    text = "some words of a line\n" * 2000
    batch = pa.RecordBatch.from_arrays([pa.array(range(128)), pa.array([text] * 128)], names=["doc_id", "_text"])
    tracemalloc.start()
    rows = sum(b.num_rows for b in quality_crf._score(model)(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == 128 and peak < 60e6


def test_sample_does_not_hang_on_files(spark, documents):
    docs = documents(*((i, f"line {i} of many!\n" * (1 + i % 9)) for i in range(120)))
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(120)], "doc_id long, quality int, toxic int")
    some = Sample(documents=100, lines=200)
    first, second = (fit(docs.repartition(n), labels, some) for n in (1, 7))
    assert np.allclose(first.weights, second.weights)
