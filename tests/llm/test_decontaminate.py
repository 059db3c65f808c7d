"""The FM-index against plain search; edge rows; blocks of a large benchmark."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlane.llm.decontaminate import WINDOW, Phrases, _shard_hits, benchmark_hits, decontaminate, words_of
from cohortlane.llm.fm_index import FMIndex, WaveletMatrix, suffix_order

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def plain_words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items):
    windows = []
    for item, text in items:
        w = plain_words(text)
        windows += [(item, w[i : i + WINDOW]) for i in range(max(1, len(w) - WINDOW + 1))] if w else []
    out = []
    for text in docs:
        w, hit, found = plain_words(text), set(), set()
        for item, g in windows:
            for i in range(len(w) - len(g) + 1):
                if w[i : i + len(g)] == g:
                    hit.update(range(i, i + len(g)))
                    found.add(str(item))
        out.append((len(w), len(hit), sorted(found)))
    return out


@pytest.mark.parametrize("seed", range(30))
def test_index(seed):
    rng = np.random.default_rng(seed)
    n, k = int(rng.integers(1, 300)), int(rng.integers(2, 6))
    symbols = np.append(rng.integers(0, k, n), 0).astype(np.int32)
    bits = max(1, (k - 1).bit_length())
    suffixes = []
    for i in range(n + 1):
        j = i
        while symbols[j]:
            j += 1
        suffixes.append((*symbols[i:j].tolist(), 0, i))
    assert suffix_order(symbols, bits).tolist() == sorted(range(n + 1), key=suffixes.__getitem__)
    tree = WaveletMatrix(symbols, bits)
    ends = rng.integers(0, n + 2, 50)
    asked = rng.integers(0, k, 50)
    assert tree.rank(asked, ends).tolist() == [int((symbols[:e] == c).sum()) for c, e in zip(asked, ends)]
    index = FMIndex(symbols, k, sample=3)
    phrases = rng.integers(1, k, (20, 4))
    lengths = rng.integers(1, 5, 20)
    low, high = index.search(phrases, lengths)
    for p, size, a, b in zip(phrases, lengths, low, high):
        expected = [i for i in range(n + 1) if symbols[i : i + size].tolist() == p[:size].tolist()]
        assert sorted(index.locate(np.arange(a, b)).tolist()) == expected


def test_long_repeats():
    symbols = np.array(([1, 2] * 5000 + [0]) * 3, np.int32)
    index = FMIndex(symbols, 3)
    low, high = index.search(np.array([[1, 2, 1]]), np.array([3]))
    assert high[0] - low[0] == 3 * 4999


def test_words():
    text = "ÀB-c\x00d1 ​X_yÉ"
    assert [w.decode() for w in words_of(text)] == plain_words(text)


def test_random_corpus(spark, documents):
    rng = random.Random(2)
    word = lambda: rng.choice("abcd")
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([1, 2, 5, 13, 14, 20, 20])] + [(99, None), (98, " . ")]
    docs = [" ".join(word() for _ in range(rng.randint(0, 60))) for _ in range(60)]
    docs += [f"x {items[5][1]} y {items[4][1].upper()}", None, "", "z " * 50_000 + items[6][1], docs[0], docs[0]]
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = documents(*enumerate(docs)).withColumn("spans", F.lit("clash"))
    expected = brute(docs, items)
    for block in (8_000_000, 40):
        rows = {r.doc_id: r for r in benchmark_hits(df, bench, block_chars=block, shard_words=500).collect()}
        assert [(rows[i].n_words, rows[i].n_hit, sorted(rows[i].items)) for i in range(len(docs))] == expected
        assert all(r.n_hit == sum(s.end - s.start for s in r.spans) for r in rows.values())
    kept = decontaminate(df, bench).collect()
    assert {r.doc_id for r in kept} == {i for i, (n, h, _) in enumerate(expected) if not (h and 20 * h >= n)}
    assert kept[0].spans == "clash"


def test_empty_tables(spark, documents):
    bench = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert benchmark_hits(documents((1, "x")).limit(0), bench).count() == 0
    row = benchmark_hits(documents((1, "a b")), bench.limit(0)).collect()[0]
    assert (row.n_words, row.n_hit, row.contaminated) == (2, 0, False)


def test_shard_without_known_words():
    assert _shard_hits([np.zeros(3, np.int32)], Phrases.of([(1, "q")])).spans == [[]]
