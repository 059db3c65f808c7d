"""Groups of spelling variants: exact neighbours at one edit, by pairs of trie nodes.

All words stand in two tries, one read forwards and one read backwards, whose
nodes are numbered. A word with one place left out is then a pair of integers:
the node of what comes before the place and the node of what comes after it.
Two words that differ by a replaced letter share such a pair, and a word with
a letter more shares it with a place of the shorter word where nothing is left
out. So equal pairs are exactly the neighbours, and no string is compared.

A trie is numbered by a walk over sorted words, since a word shares with the
word before it just the nodes of their common beginning. The words are dealt
out by ranges; only the beginnings of the words between two ranges occur on
both sides, and those are numbered first.
"""

from __future__ import annotations

import math
import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlane.sources.sinks import stage

_RUN = re.compile("[a-zÀ-ÿ]+")
#: Distinct words that a task counts before it sends them on.
_HELD = 200_000


@dataclass(frozen=True)
class Settings:
    """``every`` is the share (one in so many) of runs that lose a letter, which plants misspellings; 0: none."""

    shortest: int = 7
    least: int = 2
    ratio: int = 10
    every: int = 31


def _count(settings: Settings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, int] = {}

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])
            held.clear()
            return out

        for batch in batches:
            for doc_id, text in zip(*batch.columns):
                text, doc_id = text.as_py(), doc_id.as_py()
                if not text:
                    continue
                own: dict[str, int] = {}
                # lower case for A-Z alone
                for word in _RUN.findall(text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")):
                    own[word] = own.get(word, 0) + 1
                prefix = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                for word, n in own.items():
                    if len(word) < settings.shortest:
                        continue
                    if settings.every:
                        h = zlib.crc32(word.encode(), prefix)
                        if h % settings.every == 0:
                            at = h % len(word)
                            word = word[:at] + word[at + 1 :]
                            if len(word) < settings.shortest:
                                continue
                    held[word] = held.get(word, 0) + n
                if len(held) > _HELD:
                    yield flush()
        if held:
            yield flush()

    return run


def count_words(docs: DataFrame, settings: Settings = Settings(), text: str = "text") -> DataFrame:
    """Rows (word, n) of the words that count, each once."""
    parts = docs.select("doc_id", F.col(text).alias("_text")).mapInArrow(_count(settings), "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= settings.least)


# ---- numbering -----------------------------------------------------------------


def common(a: str, b: str) -> int:
    """Length of the common beginning."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n  # a and b agree on low characters, not on high
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


def walk(words: list[str], first: int) -> Iterator[list[int]]:
    """The nodes of each of some sorted words, the root left out, numbered from ``first``."""
    path: list[int] = []
    before = ""
    for word in words:
        shared = common(before, word)
        fresh = len(word) - shared
        path = path[:shared] + list(range(first, first + fresh))
        first += fresh
        before = word
        yield path


class Limits:
    """Words between ranges, sorted, and the numbers of their nodes (1, 2, 3...)."""

    def __init__(self, words: list[str]):
        self.words = sorted(set(words))
        self.paths = [list(p) for p in walk(self.words, 1)]

    def range_of(self, word: str) -> int:
        return bisect_left(self.words, word)

    def shared(self, word: str, place: int) -> list[int]:
        """Numbers of the word's nodes that limits of its range have."""
        best: list[int] = []
        for i in (place - 1, place):
            if 0 <= i < len(self.words):
                n = common(self.words[i], word)
                if n > len(best):
                    best = self.paths[i][:n]
        return best


def _place(limits: Limits):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = [limits.range_of(w.as_py()) for w in batch.column(0)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(places, pa.int32())], names=[*batch.schema.names, "place"])

    return run


def _number(limits: Limits, names: list[str]):
    """Of rows (word, ..., place) sorted by place and word: the same with the word's number and path.

    Numbers rise with the words. A node of this range alone has the range in
    its upper bits.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, before, path, node, row = -1, "", [], 0, 0
        for batch in batches:
            numbers, paths = [], []
            for word, place in zip(batch.column(0).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()):
                if place != now:
                    now, before, path, node, row = place, "", [], (place + 1) << 42, 0
                shared = common(before, word)
                path = path[:shared]
                if shared < len(word):
                    known = limits.shared(word, place)
                    path += known[shared:]
                    fresh = len(word) - len(path)
                    path += range(node, node + fresh)
                    node += fresh
                before = word
                numbers.append(((place + 1) << 42) + row)
                row += 1
                paths.append(np.array([0, *path], np.int64))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(numbers, pa.int64()), pa.array(paths, pa.list_(pa.int64()))], names=names
            )

    return run


def trie_paths(words: DataFrame, number: str, path: str) -> DataFrame:
    """Rows of a frame of distinct words (first column) with the word's number and its trie nodes.

    ``path`` holds one node per beginning, from the empty one (0) to the whole
    word; equal beginnings have equal numbers in all rows. Words are dealt out
    by ranges between sampled words, which are all that is kept of the whole:
    as many words as the session has shuffle partitions.
    """
    word = words.columns[0]
    ranges = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sample = words.select(word).orderBy(F.xxhash64(word)).limit(16 * ranges).collect()
    limits = Limits(sorted(r[0] for r in sample)[15::16])
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in words.schema.fields)
    names = [*words.columns, number, path]
    return (
        words.mapInArrow(_place(limits), f"{kinds}, place int")
        .repartition(len(limits.words) + 1, "place")
        .sortWithinPartitions("place", word)
        .mapInArrow(_number(limits, names), f"{kinds}, `{number}` long, `{path}` array<bigint>")
    )


# ---- neighbours ----------------------------------------------------------------


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (word, n, number, before, after): one row per pair of nodes.

    ``kind`` 0: nothing left out. 1: a letter left out. 2: the same, and the
    letter before it is equal, so that leaving out that one gives the same word.
    """
    names = ["p", "s", "kind", "number", "n"]
    for batch in batches:
        columns = [batch.column(i) for i in range(5)]
        out: list[list[np.ndarray]] = []
        held = 0
        for word, n, number, before, after in zip(*columns):
            p = before.values.to_numpy(zero_copy_only=False)
            # nodes of the reversed word, by how much of it is left
            s = after.values.to_numpy(zero_copy_only=False)[::-1]
            size = len(p) - 1
            letters = np.frombuffer(word.as_py().encode("utf-32-le", "surrogatepass"), np.uint32)
            kind = np.ones(size, np.int8)
            kind[1:][letters[1:] == letters[:-1]] = 2
            rows = 2 * size + 1
            out.append([
                np.concatenate((p, p[:-1])), np.concatenate((s, s[1:])), np.concatenate((np.zeros(size + 1, np.int8), kind)),
                np.full(rows, number.as_py()), np.full(rows, n.as_py()),
            ])
            held += rows
            if held > 100_000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], names=names)
                out, held = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], names=names)


def neighbours(numbered: DataFrame) -> DataFrame:
    """Per word with neighbours: (number, n_near, best_n, best), ``best`` the number of the most frequent one.

    ``numbered`` has rows (word, n, number, before, after). The rows of one
    pair of nodes are words that differ in one letter between the same
    beginning and ending, one row a letter of the alphabet at most, and one word
    without a letter there: few, whatever the corpus. So each word's figures
    are taken within its pairs first; no pair of words is written out.
    """
    pairs = numbered.select("word", "n", "number", "before", "after").mapInArrow(
        _pairs, "p long, s long, kind byte, number long, n long"
    )
    groups = (
        pairs.groupBy("p", "s")
        .agg(F.collect_list(F.struct("kind", "number", "n")).alias("m"), F.min("kind").alias("least"), F.count("*").alias("size"))
        .where("size > 1")
        .select("m", F.explode("m").alias("own"))
    )
    # a letter more: once a place, not for each of several equal letters
    others = F.filter(
        "m",
        lambda x: (x["number"] != F.col("own.number"))
        & ~((x["kind"] == 0) & (F.col("own.kind") == 2))
        & ~((x["kind"] == 2) & (F.col("own.kind") == 0)),
    )
    near = groups.select(
        F.col("own.number").alias("number"), F.transform(others, lambda x: F.struct(x["n"].alias("n"), (-x["number"]).alias("m"))).alias("near")
    ).where(F.size("near") > 0)
    return (
        near.select("number", F.size("near").alias("size"), F.array_max("near").alias("best"))
        .groupBy("number")
        .agg(F.sum("size").cast("long").alias("n_near"), F.max("best").alias("best"))
        .select("number", "n_near", F.col("best.n").alias("best_n"), (-F.col("best.m")).alias("best"))
    )


def group_variants(docs: DataFrame, settings: Settings = Settings(), text: str = "text") -> DataFrame:
    """Rows (word, form, root, n, n_near, form_n), one per word.

    A word's ``form`` is its most frequent neighbour (ties: the first in code
    point order) if that is ``ratio`` times as frequent; ``root`` is the last
    word that forms lead to. NULL and empty texts have no words; in the hash of
    a row without id the id is empty; repeated rows count each; an empty table
    gives an empty one; other columns are ignored. Words and numbers are stored
    in the session's shared folder.
    """
    words = stage(count_words(docs, settings, text), "words")
    forward = stage(trie_paths(words, "number", "before"), "forward")
    backward = trie_paths(forward.select(F.reverse("word").alias("drow"), "number"), "_row", "after")
    numbered = forward.join(backward.select("number", "after"), "number")
    found = neighbours(numbered)
    plain = forward.select("word", "n", "number")
    forms = F.when(F.col("best_n") >= settings.ratio * F.col("n"), F.col("best"))
    nodes = stage(
        plain.join(found, "number", "left").select(
            "word", "n", "number", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), forms.alias("form_number"),
            F.when(forms.isNotNull(), F.col("best_n")).alias("form_n"),
        ),
        "variants",
    )
    most = nodes.agg(F.max("n"), F.min("n")).first()
    # along forms the frequency rises by the ratio each time, and each round doubles the reach
    steps = int(math.log(most[0] / most[1], settings.ratio)) + 1 if most[0] else 0
    links = nodes.where("form_number IS NOT NULL").select("number", F.col("form_number").alias("root"))
    for _ in range(max(0, steps - 1).bit_length()):
        ahead = links.select(F.col("number").alias("root"), F.col("root").alias("next"))
        links = stage(links.join(ahead, "root", "left").select("number", F.coalesce("next", "root").alias("root")), "roots")
    name = nodes.select(F.col("number").alias("_number"), F.col("word").alias("_word"))
    rooted = links.join(name, F.col("root") == F.col("_number")).select("number", F.col("_word").alias("root"))
    formed = (
        nodes.where("form_number IS NOT NULL")
        .join(name, F.col("form_number") == F.col("_number"))
        .select("number", F.col("_word").alias("form"))
    )
    return (
        nodes.join(formed, "number", "left")
        .join(rooted, "number", "left")
        .select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
    )
