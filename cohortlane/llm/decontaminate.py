"""Benchmark passages in a corpus, found through an FM-index per shard.

A task reads its part of the corpus shard by shard: a shard's documents become
symbols, the index is built, all test phrases are searched backwards at once,
their places located and merged into removal spans. No row is shuffled, and the
memory of a task is that of one shard (and of one document, if that is longer).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlane.llm.fm_index import FMIndex

WINDOW = 13
#: Bytes of words stay (A-Z as a-z), all others become blanks.
_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []


@dataclass
class Phrases:
    """A block of test phrases: every window of ``WINDOW`` words of its items."""

    vocabulary: dict[bytes, int]
    phrases: np.ndarray
    lengths: np.ndarray
    #: which items hold phrase i: items[first[i]:first[i + 1]]
    items: list[str]
    first: np.ndarray

    @classmethod
    def of(cls, rows: Iterable[tuple[str, str | None]]) -> Phrases:
        vocabulary: dict[bytes, int] = {}
        holders: dict[tuple[int, ...], set[str]] = {}
        for item, text in rows:
            ids = [vocabulary.setdefault(w, len(vocabulary) + 1) for w in words_of(text)]
            for i in range(max(1, len(ids) - WINDOW + 1) if ids else 0):
                holders.setdefault(tuple(ids[i : i + WINDOW]), set()).add(item)
        keys = list(holders)
        lengths = np.array([len(k) for k in keys], np.int64)
        phrases = np.zeros((len(keys), WINDOW), np.int64)
        for i, k in enumerate(keys):
            phrases[i, : len(k)] = k
        items = [x for k in keys for x in sorted(holders[k])]
        first = np.concatenate(([0], np.cumsum([len(holders[k]) for k in keys], dtype=np.int64))).astype(np.int64)
        return cls(vocabulary, phrases, lengths, items, first)


@dataclass
class _Hits:
    """Of the documents of one shard: words, hit word ranges and items."""

    spans: list[list[tuple[int, int]]]
    items: list[set[str]]


def _shard_hits(documents: list[np.ndarray], known: Phrases, block: int = 1 << 20) -> _Hits:
    """Search one shard: arrays of word symbols, 0 where the word is in no phrase."""
    n = len(documents)
    out = _Hits([[] for _ in range(n)], [set() for _ in range(n)])
    sizes = np.array([len(d) + 1 for d in documents], np.int64)
    stream = np.zeros(int(sizes.sum()), np.int32)
    start = np.concatenate(([0], np.cumsum(sizes)))
    for d, at in zip(documents, start):
        stream[at : at + len(d)] = d
    # of several separators in a row, one is enough
    kept = np.flatnonzero((stream != 0) | (np.concatenate(([1], stream[:-1])) != 0))
    symbols = stream[kept]
    if not symbols.any() or not len(known.lengths):
        return out
    index = FMIndex(symbols, len(known.vocabulary) + 1)
    low, high = index.search(known.phrases, known.lengths)
    found = np.flatnonzero(high > low)
    counts = (high - low)[found]
    cover = np.zeros(len(stream) + 1, np.int32)
    pairs: list[np.ndarray] = []
    done = 0
    while done < len(found):
        # as many phrases as have about ``block`` places together
        take = max(1, int(np.searchsorted(np.cumsum(counts[done:]), block, "right")))
        which, many = found[done : done + take], counts[done : done + take]
        done += take
        phrase = np.repeat(which, many)
        rows = np.repeat(low[which], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        place = kept[index.locate(rows)]
        # the words of a phrase stand side by side in the document as well
        np.add.at(cover, place, 1)
        np.add.at(cover, place + known.lengths[phrase], -1)
        pairs.append(np.unique((np.searchsorted(start, place, "right") - 1) * len(known.lengths) + phrase))
    hit = (np.cumsum(cover[:-1]) > 0).astype(np.int8)
    edge = np.diff(np.concatenate(([0], hit, [0])))
    begins, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    owners = np.searchsorted(start, begins, "right") - 1
    for d, s, e in zip(owners.tolist(), (begins - start[owners]).tolist(), (ends - start[owners]).tolist()):
        out.spans[d].append((s, e))
    for pair in np.unique(np.concatenate(pairs)).tolist() if pairs else ():
        d, phrase = divmod(pair, len(known.lengths))
        out.items[d].update(known.items[known.first[phrase] : known.first[phrase + 1]])
    return out


def _merged(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_MADE = (
    T.StructField("n_words", T.LongType()),
    T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
    T.StructField("items", T.ArrayType(T.StringType())),
)


def _search(known: Phrases, text: str, drop: tuple[str, ...], earlier: bool, shard_words: int):
    """The function of one pass: adds the hits of a block of phrases to its rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = known.vocabulary.get
        for held in _shards(batches, text, shard_words):
            table, documents = held
            symbols = [np.fromiter(map(get, d, repeat(0)), np.int32, len(d)) for d in documents]
            n_words = [len(d) for d in documents]
            documents.clear()
            hits = _shard_hits(symbols, known)
            spans, items = hits.spans, hits.items
            if earlier:
                old = table.column("spans").to_pylist()
                spans = [_merged([(x["start"], x["end"]) for x in a] + b) for a, b in zip(old, spans)]
                items = [set(a) | b for a, b in zip(table.column("items").to_pylist(), items)]
            names = [c for c in table.column_names if c not in drop and c not in ("n_words", "spans", "items")]
            made = {
                "n_words": pa.array(n_words, pa.int64()),
                "spans": pa.array([[{"start": s, "end": e} for s, e in x] for x in spans], _SPANS),
                "items": pa.array([sorted(x) for x in items], pa.list_(pa.string())),
            }
            out = table.select(names)
            for name, column in made.items():
                out = out.append_column(name, column)
            yield from out.combine_chunks().to_batches()

    return run


def _shards(batches: Iterable[pa.RecordBatch], text: str, shard_words: int):
    """Rows and their words, about ``shard_words`` words at a time."""
    rows: list[pa.RecordBatch] = []
    documents: list[list[bytes]] = []
    total = 0
    for batch in batches:
        at = 0
        column = batch.column(batch.schema.get_field_index(text))
        for i in range(batch.num_rows):
            documents.append(words_of(column[i].as_py()))
            total += len(documents[-1])
            if total >= shard_words:
                rows.append(batch.slice(at, i + 1 - at))
                yield pa.Table.from_batches(rows), documents
                rows, documents, total, at = [], [], 0, i + 1
        if at < batch.num_rows:
            rows.append(batch.slice(at))
    if documents:
        yield pa.Table.from_batches(rows), documents


def benchmark_hits(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    drop: tuple[str, ...] = (),
    block_chars: int = 8_000_000,
    shard_words: int = 400_000,
) -> DataFrame:
    """Which words of documents stand in windows of benchmark items.

    Adds ``n_words``, ``spans`` (merged ranges of hit words, from 0, end
    exclusive), ``n_hit``, ``items`` (ids of items with occurring windows, as
    strings, sorted) and ``contaminated``; columns with these names are
    replaced, ``drop`` names columns to leave out, the others pass through.

    The benchmark is sent to the tasks in blocks of at most ``block_chars``
    characters (one longer item is a block): the corpus passes through one
    search per block, so its size is bounded by the block however large the
    benchmark is. Items without words are ignored; an item shorter than a
    window is one window; equal items all count. A NULL or empty text has no
    words; each row is judged on its own, so repeated rows get equal results.
    """
    made = ("n_words", "spans", "n_hit", "items", "contaminated")
    frame = docs.drop(*[c for c in docs.columns if c in made])
    blocks = _blocks(benchmark, block_chars)
    for i, block in enumerate(blocks):
        last = i + 1 == len(blocks)
        run = _search(block, text, drop if last else (), i > 0, shard_words)
        names = [c for c in frame.columns if not (last and c in drop)]
        fields = [f for f in frame.schema.fields if f.name in names and f.name not in made] + list(_MADE)
        frame = frame.mapInArrow(run, T.StructType(fields))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return frame.withColumn("n_hit", n_hit).withColumn(
        "contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words"))
    )


def _blocks(benchmark: DataFrame, block_chars: int) -> list[Phrases]:
    """Items in blocks by running length; a block at a time is on the driver as rows."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), "text").where("text IS NOT NULL")
    out: list[Phrases] = []
    held: list[tuple[str, str]] = []
    size = 0
    for row in items.toLocalIterator():
        if held and size + len(row.text) > block_chars:
            out.append(Phrases.of(held))
            held, size = [], 0
        held.append((row.item or "", row.text))
        size += len(row.text)
    return [*out, Phrases.of(held)]


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """Documents without those that a benchmark contaminates; all their columns stay."""
    # by place, so that no name can clash
    plain = docs.toDF(*[f"_c{i}" for i in range(len(docs.columns))])
    hits = benchmark_hits(plain, benchmark, f"_c{docs.columns.index(text)}")
    return hits.where(~F.col("contaminated")).select(*plain.columns).toDF(*docs.columns)
