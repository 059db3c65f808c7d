"""Toxic spans: marginals against enumeration, held-out accuracy, places, edge rows."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlane.llm import queries as q
from cohortlane.llm.crf import Model
from cohortlane.llm.toxicity import (
    CHAIN,
    FORMS,
    WIDTH,
    Bags,
    Sample,
    Tagger,
    _Scores,
    chains,
    fit,
    forms,
    fresh_words,
    marginals,
    score_documents,
    summaries,
)
from test_quality_crf import brute


def test_marginals():
    rng = np.random.default_rng(1)
    model = Model(np.zeros(1), rng.normal(size=(2, 2)), rng.normal(size=2))
    lengths = np.array([1, 4, 2, 9, 1, 3])
    scores = rng.normal(scale=3, size=lengths.sum())
    got = marginals(model, scores, lengths)
    for at, size in zip(np.cumsum(lengths) - lengths, lengths):
        assert np.allclose(got[at : at + size], brute(model, scores[at : at + size]))


def test_chains():
    ends = np.zeros(200, bool)
    ends[[2, 9]] = True
    got = chains(ends, np.array([5, 0, 5, 190]))
    assert got.tolist() == [3, 2, 5, CHAIN, CHAIN, 190 - 2 * CHAIN]
    assert chains(np.zeros(0, bool), np.array([0, 0])).tolist() == []


def test_bags_are_a_matrix():
    rng = np.random.default_rng(2)
    numbers = rng.integers(1, 40, (30, WIDTH))
    dense = np.zeros((30, FORMS))
    for i, row in enumerate(numbers):
        np.add.at(dense[i], row, 1)
    w, x = rng.normal(size=FORMS), rng.normal(size=30)
    assert np.allclose(Bags(numbers) @ w, dense @ w)
    assert np.allclose(Bags(numbers).T @ x, dense.T @ x)


def test_scores_are_those_of_forms():
    weights = np.random.default_rng(3).normal(size=FORMS)
    weights[0] = 0.0
    known = _Scores(weights)
    for word in ("trash,", "a", "Été!", "...", "worthless", "worthlessly", "\ud800x"):
        assert known.score[known[word]] == pytest.approx(weights[forms(word)].sum())


def test_copied_passages_count_once():
    a, b = np.arange(30), np.concatenate((np.arange(100, 105), np.arange(30)))
    fresh = fresh_words([a, b, a[:3]])
    assert fresh[0].all() and fresh[1].tolist() == [True] * 5 + [False] * 30 and fresh[2].all()


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = q.op13_toxicity(spark, sf).collect()
    assert len(rows) == 10_000
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    out = [r for r in rows if r.held_out and r.doc_id in labels]
    toxic = [r.predicted for r in out if labels[r.doc_id] == 1]
    clean = [r.predicted for r in out if labels[r.doc_id] == 0]
    assert np.mean(toxic) > 0.85 and np.mean(clean) < 0.02


VILE = ("blurghish", "skronk", "vexxed")


@pytest.fixture(scope="module")
def tagger(spark, documents):
    rng = np.random.default_rng(4)
    plain = [f"word{i}" for i in range(60)]
    docs, labels = [], []
    for i in range(300):
        words = rng.choice(plain, 25).tolist()
        if i % 4 == 0:
            words[rng.integers(0, 25)] = str(rng.choice(VILE))
        docs.append((i, " ".join(words) + "."))
        labels.append((i, 1, int(i % 4 == 0)))
    return fit(documents(*docs), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))


def test_places(tagger, documents):
    text = "word1 Skronk! word2\n vexxed blurghish  word3"
    got = {r.doc_id: r for r in score_documents(documents((1, text), (2, "word1 word2 word3.")), tagger).collect()}
    assert [text[s.start : s.end] for s in got[1].spans] == ["Skronk!", "vexxed blurghish"]
    assert got[1].score > 0.5 > got[2].score and got[2].spans == []
    # one word in a very long text, at its very end
    far = "word1 word2. " * 20_000 + "skronk"
    (r,) = score_documents(documents((1, far)), tagger).collect()
    assert [far[s.start : s.end] for s in r.spans] == ["skronk"]


def test_edges(spark, tagger, documents):
    df = documents((1, None), (2, ""), (3, " \n"), (4, "word1"), (4, "word1"), (None, "skronk skronk"))
    df = df.withColumn("score", F.lit("s")).withColumn("spans", F.lit(0)).withColumn("n_words", F.lit("n"))
    got = score_documents(df, tagger).collect()
    assert len(got) == 6 and all(0 <= r.score <= 1 for r in got)
    empty = {round(r.score, 12) for r in got if r.n_words == 0}
    assert len(empty) == 1 and empty.pop() < 0.5
    assert len({round(r.score, 12) for r in got if r.doc_id == 4}) == 1
    assert next(r for r in got if r.doc_id is None).score > 0.5
    assert score_documents(df.limit(0), tagger).count() == 0
    # batches change nothing
    again = sorted(r.score for r in score_documents(df.repartition(5), tagger).collect())
    assert again == pytest.approx(sorted(r.score for r in got), rel=1e-9)


def test_fit_edges(spark, documents):
    schema = "doc_id long, quality int, toxic int"
    docs = documents((1, "a b"), (2, None), (None, "c"))
    for rows in ([], [(1, 1, 0), (2, 1, 0), (None, 0, 1), (1, 0, None), (2, 0, 7)]):
        none = fit(docs, spark.createDataFrame(rows, schema))
        assert not none.crf.weights.any()
        scores = {r.score for r in score_documents(docs, none).collect()}
        assert len(scores) == 1 and 0 < scores.pop() <= 0.5
    few = fit(docs, spark.createDataFrame([(1, 1, 1), (2, 1, 0)], schema), Sample(documents=4))
    assert isinstance(few, Tagger) and np.isfinite(few.document).all()


def test_summaries():
    x = summaries(np.array([0.5, 0.5, 1e-12]), np.array([2, 0, 1]))
    assert x[0, 2] == 0.5 and x[0, 3] == pytest.approx(np.log(2)) and x[1].tolist() == [1, -1.5, 0, 0, 0]
    assert x[2, 1] == -1.5
