"""Importance resampling of documents towards a target distribution.

Word runs are hashed into a fixed number of buckets; the logarithm of how much
likelier a bucket is in the target than in the corpus is its gain, and a
document's weight is the sum of its features' gains. A keyed Gumbel number on
top of it turns "draw by weight, without replacement" into "take the largest
scores".

The k-th score is found by a quickselect over the stored scores: some random
rows are pivots, one exact count of rows before, at and after each narrows the
search to the rows between two pivots, and so on until a pivot is the k-th.
Only rows up to it are sorted, spread by ranges, to be ranked.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlane.sources.sinks import stage

#: Runs of anything but ASCII signs, blanks and controls, letters in lower case; on UTF-8 bytes.
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


@dataclass(frozen=True)
class Settings:
    """``runs`` words at most make a feature; ``percent`` of documents of ``least`` words or more are drawn."""

    runs: int = 1
    buckets: int = 10_000
    percent: int = 10
    least: int = 20
    seed: int = 2024
    pivots: int = 32


def words(text: str | None) -> list[bytes]:
    """The words of a text as UTF-8, A-Z as a-z; none for NULL."""
    return _WORD.findall(text.encode("utf-8", "surrogatepass").lower()) if text else []


def bucket_numbers(found: list[bytes], settings: Settings) -> np.ndarray:
    """The bucket of each feature of a list of words: every run of up to ``runs`` of them."""
    parts = []
    for n in range(1, settings.runs + 1):
        features = found if n == 1 else map(b" ".join, zip(*(found[i:] for i in range(n))))
        parts.append(np.fromiter(map(zlib.crc32, features), np.int64))
    return np.concatenate(parts) % settings.buckets


def _counts(settings: Settings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(settings.buckets, np.int64)
        for batch in batches:
            for text in batch.column(0):
                total += np.bincount(bucket_numbers(words(text.as_py()), settings), minlength=settings.buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(total[held])], names=["bucket", "n"])

    return run


def bucket_counts(texts: DataFrame, text: str, settings: Settings) -> np.ndarray:
    """How many features of all texts fall in each bucket; a task sends one row a bucket."""
    parts = texts.select(F.col(text)).mapInArrow(_counts(settings), "bucket int, n long")
    out = np.zeros(settings.buckets, np.int64)
    for row in parts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[row["bucket"]] = row["n"]
    return out


def bucket_gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Per bucket: floor(1000 ln((t+1)(S+B) / ((s+1)(T+B))))."""
    n = len(corpus)
    all_s, all_t = float(corpus.sum() + n), float(target.sum() + n)
    ratios = ((t + 1.0) * all_s / ((s + 1.0) * all_t) for s, t in zip(corpus.tolist(), target.tolist()))
    return np.array([math.floor(1000 * math.log(x)) for x in ratios], np.int64)


def _weigh(settings: Settings, gains: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1):
                found = words(text.as_py())
                numbers = bucket_numbers(found, settings)
                rows.append((len(found), len(numbers), int(gains[numbers].sum())))
            figures = [pa.array(x, pa.int64()) for x in (zip(*rows) if rows else ((), (), ()))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *figures], names=["doc_id", "n_words", "n_features", "weight"]
            )

    return run


def _gumbel(doc_id: Column, seed: int) -> Column:
    key = F.sha2(F.concat(F.lit(f"{seed}:"), doc_id.cast("string")).cast("binary"), 256)
    h = F.conv(F.substring(key, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def score_documents(docs: DataFrame, target: DataFrame, settings: Settings = Settings(), text: str = "text") -> DataFrame:
    """Rows (doc_id, n_words, n_features, weight, score) of all documents, all long but the id."""
    gains = bucket_gains(bucket_counts(docs, text, settings), bucket_counts(target, text, settings))
    kind = docs.schema["doc_id"].dataType.simpleString()
    weighed = docs.select("doc_id", F.col(text).alias("_text")).mapInArrow(
        _weigh(settings, gains), f"doc_id {kind}, n_words long, n_features long, weight long"
    )
    return weighed.withColumn("score", F.col("weight") + _gumbel(F.col("doc_id"), settings.seed))


# ---- selection -----------------------------------------------------------------

Key = tuple[int, int]


def _before(score: int, doc_id: int) -> Column:
    """Rows that come before a key: larger scores, then smaller ids."""
    return (F.col("score") > score) | ((F.col("score") == score) & (F.col("doc_id") < doc_id))


def _at(key: Key) -> Column:
    return (F.col("score") == key[0]) & (F.col("doc_id") == key[1])


def kth_key(rows: DataFrame, k: int, pivots: int = 32, seed: int = 0) -> Key | None:
    """The k-th (score, doc_id) in order of falling score, then rising id; None for no row.

    Each round takes the rows whose hashes under a new seed are smallest as
    pivots, counts the rows before and at each of them exactly, and goes on
    between the two pivots around the k-th. A round leaves about one of
    ``pivots`` rows, so ten billion rows take seven rounds; each reads the
    stored scores once and returns two numbers a pivot. Equal keys are one
    pivot, however many they are.
    """
    inside, before, turn = rows, 0, 0
    while k > 0:
        turn += 1
        draw = F.xxhash64(F.lit(seed + turn), "score", "doc_id")
        sample = inside.select("score", "doc_id", draw.alias("draw")).orderBy("draw").limit(pivots).distinct().collect()
        if not sample:
            return None
        keys = sorted(((r["score"], r["doc_id"]) for r in sample), key=lambda x: (-x[0], x[1]))
        counted = inside.agg(
            *[F.count_if(_before(*key)).alias(f"b{i}") for i, key in enumerate(keys)],
            *[F.count_if(_at(key)).alias(f"e{i}") for i, key in enumerate(keys)],
        ).first()
        low = high = None
        for i, key in enumerate(keys):
            first = before + counted[f"b{i}"]
            if first >= k:
                high = key
                break
            if first + counted[f"e{i}"] >= k:
                return key
            low = (key, first + counted[f"e{i}"])
        inside = rows
        if high is not None:
            top = high
        elif turn == 1:
            top = None
        # bounds of earlier rounds stay where this one found none
        if low is not None:
            bottom, before = low
        elif turn == 1:
            bottom = None
        if bottom is not None:
            inside = inside.where(~_before(*bottom) & ~_at(bottom))
        if top is not None:
            inside = inside.where(_before(*top))
    return None


def ranked(rows: DataFrame) -> DataFrame:
    """Rows with ``rank`` 1, 2, 3... by falling score, then rising id.

    Rows are sorted by ranges and stored with their place in the order of their
    range; the sizes of the ranges, one number each, give the ranks.
    """
    order = [F.col("score").desc(), F.col("doc_id")]
    placed = (
        rows.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_place", F.monotonically_increasing_id())
        .withColumn("_range", F.shiftright("_place", 33).cast("int"))
        .withColumn("_place", F.col("_place").bitwiseAND((1 << 33) - 1))
    )
    placed = stage(placed, "ranked")
    sizes = sorted(tuple(r) for r in placed.groupBy("_range").agg(F.count("*")).collect())
    starts, total = [], 0
    for part, n in sizes:
        starts.append((part, total))
        total += n
    table = placed.sparkSession.createDataFrame(starts, "_range int, _start long")
    return (
        placed.join(F.broadcast(table), "_range")
        .withColumn("rank", F.col("_start") + F.col("_place") + 1)
        .drop("_range", "_place", "_start")
    )


def resample(docs: DataFrame, target: DataFrame, settings: Settings = Settings(), text: str = "text") -> DataFrame:
    """Every document's (doc_id, n_features, weight, score, rank), all long; ``rank`` is NULL where not drawn.

    NULL and empty texts have no features and weight 0; they get a score but
    too few words to be drawn. A row without id has no score and is neither
    counted nor drawn. Of equal scores the smaller id comes first; repeated
    rows count and are drawn one by one. An empty target or corpus is one of
    equal buckets; an empty table gives an empty one. Other columns are
    ignored. The scores are stored once in the session's shared folder.
    """
    scored = stage(score_documents(docs, target, settings, text), "scores")
    eligible = scored.where((F.col("n_words") >= settings.least) & F.col("score").isNotNull())
    k = settings.percent * eligible.count() // 100
    last = kth_key(eligible.select("score", "doc_id"), k, settings.pivots, settings.seed)
    names = ["doc_id", "n_features", "weight", "score"]
    none = F.lit(None).cast("long").alias("rank")
    if last is None:
        return scored.select(*names, none)
    wins = (F.col("n_words") >= settings.least) & (_before(*last) | _at(last))
    # rows that repeat the last key may be more than are drawn
    winners = ranked(scored.where(wins).select(*names)).withColumn("rank", F.when(F.col("rank") <= k, F.col("rank")))
    return winners.select(*names, "rank").unionByName(scored.where(~F.coalesce(wins, F.lit(False))).select(*names, none))
