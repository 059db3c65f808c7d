"""The base model against plain counting; the log-bilinear model's normalisation, learning and edges."""

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cohortlane.llm import lm_score
from cohortlane.llm import queries as q
from cohortlane.llm.logbilinear import contrast, initial, log_table


def tokens(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [*low.encode().split(), None]


def test_base_of_the_whole_table(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    counts = Counter()
    for i, text in texts.items():
        if zlib.crc32(str(i).encode()) % 7 != 2:
            counts.update(tokens(text))
    total, types = sum(counts.values()), len(counts)
    rows = q.op9_lm(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    base = score = 0.0
    for r in rows:
        t = tokens(texts[r.doc_id])
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(t), sum(counts[x] > 0 for x in t), total)
        expected = sum(math.log10((counts[x] + 1) / (total + types + 1)) for x in t)
        assert r.base_score == pytest.approx(expected, rel=1e-9)
        assert r.score < 0
        base, score = base + r.base_score, score + r.score
    assert score > base


def test_table_is_normalised_and_learned():
    rng = np.random.default_rng(1)
    words = 12
    # the word after (a, b) is most often 5 b + 1 mod 12
    grams = np.array([(a, b, (5 * b + 1) % words) for a in range(words) for b in range(words)])
    noise = rng.integers(0, words, (400, 3))
    grams, counts = np.concatenate((grams, noise)), np.concatenate((np.full(144, 20.0), np.ones(400)))
    unigram = np.bincount(grams[:, 2], counts, words) / counts.sum()
    w = initial(unigram, 12)
    start = log_table(w)
    assert np.allclose(np.exp(start).sum(1), 1, atol=1e-5)
    state = np.full(len(w.flat()), 1e-6)
    share = counts / counts.sum()
    for _ in range(300):
        contrast(w, state, grams[rng.choice(len(grams), 512, p=share)], unigram, rng)
    table = log_table(w)
    assert np.allclose(np.exp(table).sum(1), 1, atol=1e-5)
    gain = (table - start)[grams[:, 0] * words + grams[:, 1], grams[:, 2]] @ counts / counts.sum()
    assert gain > 0.1


@pytest.mark.parametrize("classes", [1, 3])
def test_probabilities_sum_to_one(spark, documents, classes):
    df = documents((1, "a a a b b c ef gh. gh. kl"), (2, "a b d kl mn"), (3, "a c ef ef ef"))
    settings = lm_score.Settings(words=4, classes=classes, dims=4)
    model, counts = lm_score.fit(df, settings)
    # words: first class, end, two frequent ones, further classes; the next word after (end, end)
    ids = lm_score.Ids(model.frequent, model.forms, 10)
    known = ["a", "b", "c", "d", "ef", "gh.", "kl", "mn"]
    symbols = {w: ids.symbol(w.encode()) for w in known}
    assert len(set(symbols.values()) - {2, 3}) == classes
    unseen = {}
    for w in ("zzz", "qb", "ef!", "xn", "vf", "h.", "ld"):
        # one unseen word stands for all of its class
        unseen.setdefault(ids.symbol(w.encode()), w)
    assert len(unseen) == classes
    words = [*known, *unseen.values()]
    probes = documents(*enumerate([*words, ""]))
    scores = {r.doc_id: r.score for r in lm_score.score_documents(probes, model, counts).collect()}
    table = np.exp(log_table(model.weights).astype(float))
    n = settings.symbols
    start = table[lm_score.END * n + lm_score.END]
    mass = start[lm_score.END]
    for i, word in enumerate(words):
        last = table[lm_score.END * n + ids.symbol(word.encode())][lm_score.END]
        mass += 10 ** scores[i] / last
    assert mass == pytest.approx(1, abs=1e-4)
    assert 10 ** scores[len(words)] == pytest.approx(start[lm_score.END], rel=1e-4)


def test_score_against_a_brute_force_model(spark, documents):
    """Whole texts, word by word, from the weights and plain counts."""
    texts = {1: "the cat sat on the mat. the dog", 2: "a cat a dog a mat.", 3: "new words here", 4: None, 5: "the the the"}
    df = documents(*texts.items())
    settings = lm_score.Settings(words=5, classes=3, dims=4, chunk_chars=20)
    model, counts = lm_score.fit(df, settings)
    seen = Counter(w for t in texts.values() for w in tokens(t))
    ids = lm_score.Ids(model.frequent, model.forms, 100)

    def symbol(word):
        return lm_score.END if word is None else ids.symbol(word)

    members = [w for w in seen if w is not None and symbol(w) not in range(1, 5)]
    w = model.weights
    for r in lm_score.score_documents(df, model, counts).collect():
        a = b = lm_score.END
        total = 0.0
        for word in tokens(texts[r.doc_id]):
            own = symbol(word)
            scores = (w.context[a] @ w.mix[0] + w.context[b] @ w.mix[1]) @ w.target.T + w.bias
            total += (scores[own] - np.log(np.exp(scores).sum())) / math.log(10)
            if own == 0 or own >= settings.words:
                alike = [m for m in members if symbol(m) == own]
                total += math.log10((seen[word] + 1) / (sum(seen[m] for m in alike) + len(alike) + 1))
            a, b = b, own
        assert r.score == pytest.approx(total, rel=1e-5)


def test_classes_stand_for_equally_many_words():
    rng = np.random.default_rng(1)
    words = [bytes(rng.choice(list(b"abcdeghmnrst.,"), rng.integers(1, 9)).tolist()) for _ in range(5000)]
    tokens_of = np.zeros(lm_score.FORMS, np.int64)
    for w in words:
        tokens_of[lm_score.form_of(w)] += 1
    settings = lm_score.Settings(words=10, classes=4)
    symbols = lm_score.class_symbols(tokens_of, settings)
    sums = [tokens_of[symbols == s].sum() for s in (0, 10, 11, 12)]
    assert sum(sums) == 5000 and min(sums) > 900 and symbols.max() == 12
    assert lm_score.class_symbols(np.zeros(lm_score.FORMS, np.int64), settings).max() == 0


def test_edges(spark, documents):
    texts = [None, "", " \n", "x " * 50_000, "É é", "É é"]
    df = documents(*enumerate(texts), (None, "x")).withColumn("h", F.lit(1)).withColumn("score", F.lit("s"))
    small = lm_score.Settings(chunk_chars=10, counter_words=1)
    model, counts = lm_score.fit(df, small)
    rows = lm_score.score_documents(df, model, counts).collect()
    assert len(rows) == 7
    by = {r.doc_id: r for r in rows}
    assert [by[i].n_tokens for i in range(6)] == [1, 1, 1, 50_001, 3, 3]
    assert all(r.n_tokens == r.n_known for r in rows)
    assert by[4].score == by[5].score
    none, no_counts = lm_score.fit(df.limit(0))
    rows = lm_score.score_documents(df, none, no_counts).collect()
    assert {r.n_known for r in rows} == {0} and none.tokens == 0
    assert all(r.base_score == 0 for r in rows)
    assert lm_score.score_documents(df.limit(0), model, counts).count() == 0


def test_every_triple_trains_with_its_whole_count(monkeypatch):
    # far more tokens than 400 steps of 8 draws
    count = np.concatenate(([40_000, 9_000], np.arange(1, 1999)))
    settings = lm_score.Settings(words=16, classes=1, dims=2, batch=8, steps=100)
    stands = np.zeros(16**3)

    def seen(w, state, grams, unigram, rng, noise=5, rate=0.1, weight=None):
        np.add.at(stands, (grams[:, 0] * 16 + grams[:, 1]) * 16 + grams[:, 2], np.ones(len(grams)) if weight is None else weight)

    monkeypatch.setattr(lm_score, "contrast", seen)
    unigram = np.full(16, 1 / 16)
    w = initial(unigram, 2)
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(len(count))), pa.array(count)], names=["triple", "c"])
    rows = list(lm_score._train_shard(w.flat(), w, unigram, settings, 0)(iter([batch])))
    assert rows[0].column(1).to_pylist() == [float(count.sum())]
    assert np.allclose(stands[: len(count)] / stands.sum(), count / count.sum(), rtol=1e-9)
