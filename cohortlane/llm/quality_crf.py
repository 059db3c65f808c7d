"""Document quality from the labels that a linear-chain CRF gives to lines.

Each line is described by its own form, by what it repeats of the document,
and by its neighbours' descriptions. The CRF is trained on lines that carry
their document's label. A document's score is the mean of its lines' marginal
probabilities of being good, weighted by their lengths.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlane.llm.crf import Model, marginals_of_scores, train

_UPPER = bytes(range(65, 91))
_LETTERS = _UPPER + bytes(range(97, 123))
_DIGITS = bytes(range(48, 58))
_SYMBOLS = b"!#*$%&|<>~^@{}[]=\\_/+"
_BLANK = b" \t\n\r\x0b\x0c"
_ENDS = (".", "!", "?", "…", ":", "\"", "”", "»")
OWN = 18
#: Lines whose features, and whose probabilities, are in memory at a time (a text is not divided for the latter).
LINES = 20_000
WIDTH = 1 + 3 * OWN


def _gone(data: bytes, chars: bytes) -> int:
    return len(data) - len(data.translate(None, chars))


def describe_line(line: str, words: list[str], seen: set, copies: int) -> list[float]:
    """Own features of one line; ``seen`` gets its word triples."""
    data = line.encode("utf-8", "surrogatepass")
    n = len(words)
    solid = max(1, len(data) - _gone(data, _BLANK))
    letters = _gone(data, _LETTERS)
    upper = _gone(data, _UPPER) / max(1, letters)
    symbols = _gone(data, _SYMBOLS) / solid
    triples = list(zip(words, words[1:], words[2:]))
    fresh = set(triples)
    known = len(fresh & seen) / max(1, len(fresh))
    seen |= fresh
    repeats = 1 - len(fresh) / max(1, len(triples))
    pairs = sum(map(str.__eq__, words, words[1:])) / max(1, n - 1)
    distinct = len(set(words)) / max(1, n)
    pipes = line.count("|") / max(1, n)
    return [
        np.log1p(len(line)) / 6,
        np.log1p(n) / 5,
        min(solid / max(1, n), 40.0) / 10,
        upper,
        float(upper > 0.5 and letters > 3),
        symbols,
        float(symbols > 0.06),
        float(symbols > 0.15),
        min(pipes, 1.0),
        _gone(data, _DIGITS) / solid,
        pairs,
        float(pairs > 0.2),
        distinct,
        repeats,
        known,
        float(copies > 1),
        float(line.rstrip().endswith(_ENDS)),
        min(line.count("!") / max(1, n), 2.0),
    ]


def describe(text: str | None, at_a_time: int = 1 << 62) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Own features of a text's lines that have words, and their lengths, so many lines at a time.

    A text without words is one empty line.
    """
    lines = [line for line in (text or "").split("\n") if line and not line.isspace()] or [""]
    copies: dict[str, int] = {}
    for line in lines:
        copies[line] = copies.get(line, 0) + 1
    seen: set = set()
    for part in (lines[i : i + at_a_time] for i in range(0, len(lines), at_a_time)):
        own = [describe_line(line, line.split(), seen, copies[line]) for line in part]
        yield np.array(own, np.float32), np.array([max(1, len(line)) for line in part], np.float64)


def line_scores(text: str | None, model: Model, at_a_time: int = LINES) -> tuple[np.ndarray, np.ndarray]:
    """Each line's score for "good", its neighbours' features included, and the lines' lengths.

    What a line adds to its own score and to those of its neighbours are three
    numbers, so features exist for ``at_a_time`` lines only.
    """
    columns = model.weights[1:].reshape(3, OWN).T
    parts = [(own @ columns, lengths) for own, lengths in describe(text, at_a_time)]
    added, lengths = (np.concatenate(x) for x in zip(*parts))
    scores = model.weights[0] + added[:, 0]
    scores[1:] += added[:-1, 1]
    scores[:-1] += added[1:, 2]
    return scores, lengths


def with_neighbours(own: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A constant, a line's own features, and those of the lines before and after it."""
    n = len(own)
    out = np.zeros((n, WIDTH))
    out[:, 0] = 1.0
    out[:, 1 : 1 + OWN] = own
    first = np.cumsum(sizes) - sizes
    before, after = np.ones(n, bool), np.ones(n, bool)
    before[first] = False
    after[first + sizes - 1] = False
    rows = np.flatnonzero(before)
    out[rows, 1 + OWN : 1 + 2 * OWN] = own[rows - 1]
    rows = np.flatnonzero(after)
    out[rows, 1 + 2 * OWN :] = own[rows + 1]
    return out


@dataclass(frozen=True)
class Sample:
    """Bounds of the training sample: documents, and lines in all."""

    documents: int = 4000
    lines: int = 400_000


def held_out(key: Column) -> Column:
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(5)) == 0


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            ((own, _),) = describe(batch.column(3)[i].as_py())
            found = [*(c.slice(i, 1) for c in batch.columns[:3]), pa.array([len(own)]), pa.array([own.tobytes()], pa.binary())]
            yield pa.RecordBatch.from_arrays(found, names=["good", "at", "doc_id", "lines", "own"])


def fit(docs: DataFrame, labels: DataFrame, sample: Sample = Sample()) -> Model:
    """Train on a bounded sample of labelled documents that are not held out.

    The sample is the labelled documents with the smallest hashes of their ids;
    half of it at most comes from each class, so a rare class is not lost; in
    the same order they go as far as the bound on lines, and a text of more than a
    twentieth of it is left out. NULL ids and labels are ignored, NULL texts are
    empty, of repeated labels of a document one counts, other columns are ignored.
    Without labelled documents the model scores one half everywhere.
    """
    known = labels.where("quality IN (0, 1) AND doc_id IS NOT NULL").where(~held_out(F.col("doc_id")))
    half = sample.documents // 2
    chosen = None
    for value in (0, 1):
        own = known.where(F.col("quality") == value).select("doc_id", F.lit(value).alias("good"), F.xxhash64("doc_id").alias("at"))
        # a top-k by hash: its size is the documented bound
        part = own.dropDuplicates(["doc_id"]).orderBy("at", "doc_id").limit(half)
        chosen = part if chosen is None else chosen.unionByName(part)
    rows = (
        docs.select("doc_id", "text")
        .join(F.broadcast(chosen), "doc_id")
        .select("good", "at", "doc_id", F.coalesce("text", F.lit("")).alias("text"))
        # a text with more lines than a sample may have of one document is no example
        .where(F.length("text") - F.length(F.translate("text", "\n", "")) < sample.lines // 20)
        .mapInArrow(_features, f"good int, at long, doc_id {docs.schema['doc_id'].dataType.simpleString()}, lines long, own binary")
    )
    # hash order, so that where the bound on lines falls does not hang on how files are cut
    running = Window.orderBy("at", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    bounded = rows.withColumn("upto", F.sum("lines").over(running)).where(F.col("upto") <= sample.lines)
    own, sizes, good = [], [], []
    for row in bounded.orderBy("at", "doc_id").select("good", "own").collect():
        lines = np.frombuffer(row.own, np.float32).reshape(-1, OWN)
        own.append(lines)
        sizes.append(len(lines))
        good += [row.good] * len(lines)
    if not sizes:
        return Model(np.zeros(WIDTH), np.zeros((2, 2)), np.zeros(2))
    counts = np.array(sizes)
    return train(with_neighbours(np.concatenate(own), counts), counts, np.array(good))


def _score(model: Model):
    def scored(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[list[int], list[float]]:
        sizes = np.array([len(lengths) for _, lengths in held])
        good = marginals_of_scores(model, np.concatenate([s for s, _ in held]), sizes)
        length = np.concatenate([x for _, x in held])
        first = np.cumsum(sizes) - sizes
        score = np.add.reduceat(good * length, first) / np.add.reduceat(length, first)
        return sizes.tolist(), np.clip(score, 0.0, 1.0).tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, scores, held, lines = [], [], [], 0
            texts = batch.column(batch.num_columns - 1)
            for i, text in enumerate(texts, 1):
                held.append(line_scores(text.as_py(), model))
                lines += len(held[-1][0])
                if lines >= LINES or i == len(texts):
                    for whole, new in zip((sizes, scores), scored(held)):
                        whole += new
                    held, lines = [], 0
            columns = [*batch.columns[:-1], pa.array(sizes, pa.int64()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:-1], "n_lines", "score"])

    return run


def score_documents(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """Quality of whole texts: the ``keep`` columns, ``n_lines`` and ``score`` (0 to 1).

    Each row is scored on its own text alone. NULL and empty texts are scored
    as one empty line; repeated rows get equal scores; an empty table stays
    empty.
    """
    kept = [f for f in docs.schema.fields if f.name in keep]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "n_lines long", "score double"])
    return docs.select(*[f.name for f in kept], F.col(text).alias("_text")).mapInArrow(_score(model), schema)


def keep_good(docs: DataFrame, model: Model, threshold: float = 0.3, text: str = "text") -> DataFrame:
    """Documents that score at least ``threshold``; all their columns stay.

    NULL and empty texts are scored as one empty line and NULL ids are kept like
    others; repeated rows stay or go together; an empty table stays empty.
    """
    plain = docs.toDF(*[f"_c{i}" for i in range(len(docs.columns))])
    scored = score_documents(plain, model, tuple(plain.columns), f"_c{docs.columns.index(text)}")
    return scored.where(F.col("score") >= threshold).select(*plain.columns).toDF(*docs.columns)
