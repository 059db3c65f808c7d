"""Spelling variants against plain Python; numbers of trie nodes; edge rows."""

import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from cohortlane.llm.spelling import Limits, Settings, common, group_variants, trie_paths, walk


def brute(docs, s):
    counts = Counter()
    for d, t in docs:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in w)
            h = zlib.crc32(f"{'' if d is None else d}:{w}".encode())
            if s.every and h % s.every == 0:
                i = h % len(w)
                w = w[:i] + w[i + 1 :]
            counts[w] += 1
    words = {w: n for w, n in counts.items() if len(w) >= s.shortest and n >= s.least}
    near, letters = defaultdict(set), set("".join(words))
    for w in words:
        for i in range(len(w)):
            shorter = w[:i] + w[i + 1 :]
            if shorter in words:
                near[w].add(shorter)
                near[shorter].add(w)
            near[w] |= {x for a in letters if (x := w[:i] + a + w[i + 1 :]) != w and x in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= s.ratio * n else None
    out = []
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), words[form[w]] if form[w] else None))
    return sorted(out, key=str)


def rows(frame):
    return sorted(map(tuple, frame.collect()), key=str)


@pytest.mark.parametrize("settings", [Settings(), Settings(shortest=1, least=1, ratio=2, every=0), Settings(2, 1, 3, 5)])
def test_against_plain_python(documents, settings):
    rng = random.Random(3)
    # few letters, so that words are close and hold runs of equal letters
    texts = [" ".join("".join(rng.choices("aabé×Y", k=rng.randrange(1, 9))) for _ in range(60)) for _ in range(25)]
    texts += ["forms forms forms forms formes form former"] * 30
    docs = [(i, t) for i, t in enumerate(texts)]
    got = group_variants(documents(*docs).repartition(3), settings)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert rows(got) == brute(docs, settings)


def test_chain_of_forms(documents):
    """A word's form has a form itself, several times."""
    chain = ["aaaaaaaaaa"]
    for i in range(4):
        chain.append(chain[-1][:i] + "b" + chain[-1][i + 1 :])
    docs = [(1, " ".join(w for k, w in enumerate(chain) for _ in range(2 * 3**k)))]
    s = Settings(ratio=3, every=0)
    got = group_variants(documents(*docs), s)
    assert rows(got) == brute(docs, s)
    assert {r.root for r in got.collect()} == {chain[-1]}


def test_common():
    rng = random.Random(1)
    for _ in range(300):
        a, b = ("".join(rng.choices("ab", k=rng.randrange(8))) for _ in range(2))
        want = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert common(a, b) == want


def test_nodes_are_beginnings(spark):
    """Equal numbers for equal beginnings, in whatever range their words are."""
    rng = random.Random(5)
    words = sorted({"".join(rng.choices("abc", k=rng.randrange(1, 10))) for _ in range(2000)})
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        found = trie_paths(spark.createDataFrame([(w,) for w in words], "word string"), "number", "path").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert [r.word for r in sorted(found, key=lambda r: r.number)] == words
    named = {}
    for r in found:
        assert len(r.path) == len(r.word) + 1
        for i, node in enumerate(r.path):
            assert named.setdefault(node, r.word[:i]) == r.word[:i]
    assert len(named) == len(set(named.values()))


def test_walk_and_limits():
    assert list(map(list, walk(["a", "ab", "b"], 5))) == [[5], [5, 6], [7]]
    limits = Limits(["dog", "cat"])
    assert limits.range_of("cat") == 0 and limits.range_of("cow") == 1 and limits.range_of("eel") == 2
    assert limits.shared("cow", 1) == limits.paths[0][:1] and limits.shared("do", 1) == limits.paths[1][:2]


def test_edges(documents):
    long = "z" * 3000
    df = documents((1, None), (2, ""), (3, "Wordings wordings"), (3, "Wordings wordings"), (None, f"{long} {long}x {long}"))
    df = df.withColumn("word", F.lit("w")).withColumn("n", F.lit(0)).withColumn("form", F.lit(None).cast("int"))
    s = Settings(every=0, least=1)
    assert rows(group_variants(df, s)) == brute([(3, "wordings " * 4), (None, f"{long} {long}x {long}")], s)
    assert group_variants(df.limit(0), s).count() == 0
