"""Near-duplicate classes against all pairs; the sketches' bounds; hot groups."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlane.llm import jaccard
from cohortlane.llm.components import components
from cohortlane.llm.jaccard import Join, cells, link_documents, one_of_each, shingles, sketch


def word_sets(texts, size=4):
    out = []
    for text in texts:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
        out.append({tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set())
    return out


def brute(texts):
    sets = word_sets(texts)
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(texts)), 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= 85 * len(sets[i] | sets[j]):
            a, b = sorted((find(i), find(j)))
            root[b] = a
    return {i: (len(sets[i]), find(i)) for i in range(len(texts))}


def edited(rng, words, share):
    out = [w if rng.random() > share else f"w{rng.randint(0, 10**9)}" for w in words]
    return out[: len(out) - rng.randint(0, 2)] if len(out) > 8 else out


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(11)
    texts = [None, "", " \t", "one", "One", "a b c", "a b c d", "a b c d e", "a b c"]
    for size in (7, 12, 30, 80, 200, 600):
        base = [f"v{rng.randint(0, 5000)}" for _ in range(size)]
        texts.append(" ".join(base))
        for share in (0.0, 0.005, 0.01, 0.015, 0.02, 0.03, 0.05, 0.1):
            for _ in range(4):
                texts.append(" ".join(edited(rng, base, share)))
    passage = " ".join(f"p{i}" for i in range(50))
    texts += [f"{passage} " + " ".join(f"q{rng.randint(0, 10**9)}" for _ in range(rng.randint(0, 150))) for _ in range(80)]
    return texts


@pytest.mark.parametrize("block", [4096, 3])
def test_against_all_pairs(spark, documents, corpus, block, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rows = link_documents(documents(*enumerate(corpus)).withColumn("n", F.lit(1)).repartition(5)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == brute(corpus)


def test_sketches_bound_the_difference():
    rng, join = np.random.default_rng(1), Join()
    for _ in range(300):
        n = int(rng.integers(1, 400))
        a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        cut = int(rng.integers(0, max(1, n // 8) + 1))
        b = np.unique(np.concatenate((a[cut:], rng.integers(0, 2**63, int(rng.integers(0, n // 8 + 1)), dtype=np.uint64))))
        if not len(b):
            continue
        both = len(np.intersect1d(a, b))
        d = len(a) + len(b) - 2 * both
        x, y = sketch(a, 10), sketch(b, 10)
        assert int(np.bitwise_count(x ^ y).sum()) <= d
        if 100 * both >= 85 * (len(a) + len(b) - both):
            assert d <= join.apart(len(a) + len(b))
            first, last = join.bands(1000)
            bands = [int(np.searchsorted(last, len(s))) for s in (a, b)]
            g = max(bands)
            assert g - min(bands) <= 1
            limit = join.apart(2 * int(last[g]))
            assert len(np.intersect1d(cells(a, g, limit), cells(b, g, limit)))


def test_shingles_fold_ascii_only():
    assert np.array_equal(shingles("A b C d", 4), shingles("a B c D", 4))
    assert not np.array_equal(shingles("É b c d", 4), shingles("é b c d", 4))
    assert len(shingles("a b", 4)) == 1


def test_components(spark):
    rng = random.Random(4)
    for _ in range(3):
        links = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(40)] + [(i, i + 1) for i in range(100, 140)]
        got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
        near = {}
        for a, b in links:
            if a != b:
                near.setdefault(a, set()).add(b)
                near.setdefault(b, set()).add(a)
        for start in near:
            reach, todo = {start}, [start]
            while todo:
                for x in near[todo.pop()] - reach:
                    reach.add(x)
                    todo.append(x)
            assert got[start] == min(reach)


def test_one_stays(documents, corpus):
    df = documents(*enumerate(corpus)).withColumn("node", F.lit("x")).withColumn("component_id", F.lit(2))
    kept = one_of_each(df)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, (_, c) in brute(corpus).items() if c == i}


def test_empty_and_null(spark, documents):
    assert link_documents(documents((1, "x")).limit(0)).count() == 0
    rows = link_documents(documents((1, "a b"), (None, "a b"), (1, "a b"), (3, "A b"))).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in rows) == [(0, 0), (1, 1), (1, 1), (3, 1)]


def test_components_extend(spark):
    """Links in two parts give the components of all links."""
    import random

    from cohortlane.llm.components import components, extended

    rng = random.Random(2)
    links = [(rng.randrange(120), rng.randrange(120)) for _ in range(110)]
    schema = "a long, b long"
    whole = {tuple(r) for r in components(spark.createDataFrame(links, schema)).collect()}
    for cut in (0, 40, 109, 110):
        first = components(spark.createDataFrame(links[:cut], schema))
        assert {tuple(r) for r in extended(first, spark.createDataFrame(links[cut:], schema)).collect()} == whole
