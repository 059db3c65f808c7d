"""Scoring texts by a log-bilinear language model learned from the corpus.

Everything the model knows is counted over all training documents by Spark: how
often each word occurs, and how often each triple of symbols does. A frequent
word is a symbol of its own; all others are dealt, by how they end, into classes
that stand for about equally many words of the corpus. The model is trained on
the triples, in shards whose weights are averaged each round. The probability of
a rare word is that of its class times its share of the class.

Words are known by 64-bit hashes. A document's frequent words are scored where
it is read; its rare words meet their counts in a join on the hash, as
postings that name the documents of a chunk which hold the word, so that
a word is one row per chunk however often it occurs.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlane.llm.logbilinear import Weights, contrast, initial, log_table
from cohortlane.sources.sinks import stage

RARE, END = 0, 1
_END_HASH = np.int64(0)


@dataclass(frozen=True)
class Settings:
    """``words``: frequent words that are symbols of their own, with the end and the first class of
    others; ``classes``: classes of other words, so that there are words + classes - 1 symbols.
    ``shards`` and ``rounds``: least number of parallel trainings, and how often they are
    averaged; ``shard``: triples for which there is one more training; ``steps``: least number of
    steps for a block of ``block`` triples, each of ``batch`` triples with ``noise`` words for each;
    ``chunk_chars``: text whose rare words are gathered at a time."""

    words: int = 241
    classes: int = 16
    dims: int = 16
    shards: int = 6
    shard: int = 1_500_000
    rounds: int = 2
    batch: int = 2048
    noise: int = 8
    steps: int = 100
    block: int = 300_000
    chunk_chars: int = 6_000_000
    counter_words: int = 400_000

    @property
    def symbols(self) -> int:
        return self.words + self.classes - 1


def held_out(key: Column) -> Column:
    """Documents that the model doesn't learn from; a NULL id is learned."""
    return F.coalesce(F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(7)) == 2, F.lit(False))


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def word_hash(word: bytes) -> int:
    """A signed 64-bit hash that is never that of the end."""
    h = xxhash.xxh3_64_intdigest(word) or 1
    return h - (1 << 64) if h >> 63 else h


#: 6 bits of a byte: letters, digits, other signs, bytes of other scripts.
_CODE = bytes(
    b - 97 if 97 <= b <= 122 else 26 if 48 <= b <= 57 else 27 if b < 128 else 28 + b % 32 for b in range(256)
)
FORMS = 1 << 13


def form_of(word: bytes) -> int:
    """A number for how a word ends: its last two signs, and whether punctuation follows them."""
    core = word.rstrip(b".,;:!?") or word
    return (_CODE[core[-2]] if len(core) > 1 else 63) << 7 | _CODE[core[-1]] << 1 | (len(core) < len(word))


def class_symbols(tokens: np.ndarray, settings: Settings) -> np.ndarray:
    """The symbol of each form: neighbouring forms are cut into classes of about equally many tokens."""
    before = np.cumsum(tokens) - tokens
    number = np.minimum(before * settings.classes // max(1, int(tokens.sum())), settings.classes - 1)
    return np.where(number > 0, settings.words + number - 1, RARE)


def _texts(batches: Iterable[pa.RecordBatch]) -> Iterator[list[bytes]]:
    for batch in batches:
        for text in batch.column(0):
            yield words_of(text.as_py())


def _count_words(limit: int):
    def flush(counts: Counter, documents: int) -> pa.RecordBatch:
        h = [word_hash(w) for w in counts] + [int(_END_HASH)]
        form = [form_of(w) for w in counts] + [-1]
        columns = [pa.array(h, pa.int64()), pa.array(form, pa.int16()), pa.array([*counts.values(), documents], pa.int64())]
        return pa.RecordBatch.from_arrays(columns, names=["h", "form", "c"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, documents = Counter(), 0
        for words in _texts(batches):
            counts.update(words)
            documents += 1
            if len(counts) > limit:
                yield flush(counts, documents)
                counts, documents = Counter(), 0
        if documents:
            yield flush(counts, documents)

    return run


class Ids:
    """Symbols of words, by a bounded table of the words met."""

    def __init__(self, frequent: dict[int, int], forms: np.ndarray, limit: int):
        self.frequent, self.limit = frequent, limit
        self.forms = forms.tolist()
        self.known: dict[bytes, int] = {}

    def symbol(self, word: bytes) -> int:
        known = self.frequent.get(word_hash(word))
        return self.forms[form_of(word)] if known is None else known

    def of(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        if len(known) > self.limit:
            known.clear()
        for w in set(words).difference(known):
            known[w] = self.symbol(w)
        return np.fromiter(map(known.__getitem__, words), np.int64, len(words))


def _chain(documents: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and second predecessor, and word, of every token; documents start after two ends."""
    padded = [np.concatenate(([END, END], d, [END])) for d in documents]
    line = np.concatenate(padded) if padded else np.empty(0, np.int64)
    real = np.ones(len(line), bool)
    first = np.cumsum([0, *map(len, padded)])[:-1]
    real[first] = False
    real[first + 1] = False
    at = np.flatnonzero(real)
    return line[at - 2], line[at - 1], line[at]


def _count_triples(frequent: dict[int, int], forms: np.ndarray, settings: Settings):
    n = settings.symbols

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, held, total = Ids(frequent, forms, settings.counter_words), [], 0
        keys, counts = np.empty(0, np.int64), np.empty(0, np.int64)

        def merged() -> tuple[np.ndarray, np.ndarray]:
            a, b, c = _chain(held)
            fresh, times = np.unique((a * n + b) * n + c, return_counts=True)
            every, place = np.unique(np.concatenate((keys, fresh)), return_inverse=True)
            return every, np.bincount(place, np.concatenate((counts, times))).astype(np.int64)

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], names=["triple", "c"])

        for words in _texts(batches):
            held.append(ids.of(words))
            total += len(words) + 1
            if total > 1_000_000:
                keys, counts = merged()
                held, total = [], 0
                if len(keys) > 2_000_000:
                    yield rows()
                    keys, counts = np.empty(0, np.int64), np.empty(0, np.int64)
        if held:
            keys, counts = merged()
        if len(keys):
            yield rows()

    return run


def _train_shard(start: np.ndarray, shape: Weights, unigram: np.ndarray, settings: Settings, turn: int):
    n = settings.symbols

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, seen = shape.like(start), 0
        state = np.full(len(start), 1e-6)
        rng = np.random.default_rng(turn)
        for grams, count in _blocks(batches, n, settings.block):
            for own, weight in _passes(count, settings, rng):
                contrast(w, state, grams[own], unigram, rng, settings.noise, weight=weight)
            seen += int(count.sum())
        if seen:
            yield pa.RecordBatch.from_arrays(
                [pa.array([w.flat().tobytes()], pa.binary()), pa.array([float(seen)])], names=["weights", "seen"]
            )

    return run


def _passes(
    count: np.ndarray, settings: Settings, rng: np.random.Generator
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Batches of places in ``count`` and their weights, 1 on average.

    A block that stands for fewer words than ``steps`` batches is drawn from
    by counts, more often than it has words. Of any other block every triple
    is passed over with its whole count; one counted more often than the
    mean is dealt out in equal shares, so that no step hangs on one triple,
    which at most doubles the places.
    """
    total = np.cumsum(count)
    if total[-1] <= settings.steps * settings.batch:
        for _ in range(settings.steps):
            drawn = np.searchsorted(total, rng.integers(0, total[-1], settings.batch), "right")
            yield drawn, np.ones(settings.batch)
        return
    times = -(-count * len(count) // int(total[-1]))
    places, share = np.repeat(np.arange(len(count)), times), count / times
    share = share / share[places].mean()
    done = 0
    while not done or done < settings.steps:
        # even batches: a step divides by its size, so rows of a short one would count for more
        for own in np.array_split(rng.permutation(places), -(-len(places) // settings.batch)):
            yield own, share[own]
            done += 1


def _blocks(batches: Iterable[pa.RecordBatch], n: int, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Triples and counts, about ``size`` at a time."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= size:
            yield _grams(held, n)
            held = []
    if sum(b.num_rows for b in held):
        yield _grams(held, n)


def _grams(held: list[pa.RecordBatch], n: int) -> tuple[np.ndarray, np.ndarray]:
    triple, count = (np.concatenate([np.asarray(b.column(i)) for b in held]) for i in (0, 1))
    return np.stack((triple // (n * n), triple // n % n, triple % n), 1), count


@dataclass
class Model:
    """What scoring needs: a bounded number of frequent words, and totals."""

    settings: Settings
    frequent: dict[int, int]  # hash -> symbol
    forms: np.ndarray  # form -> symbol of its class
    counts: np.ndarray  # by symbol; 0 for classes
    sizes: np.ndarray  # by symbol: tokens and types of a class, one unseen word included; 1 for words
    weights: Weights
    tokens: int
    types: int


def fit(docs: DataFrame, settings: Settings = Settings(), text: str = "text") -> tuple[Model, DataFrame]:
    """A model of all documents given, and the counts of all their words (h, c).

    Totals, the most frequent words and one set of weights per shard come to
    the driver: their number doesn't grow with the corpus.
    """
    texts = docs.select(text)
    counts = stage(
        texts.mapInArrow(_count_words(settings.counter_words), "h long, form short, c long")
        .groupBy("h")
        .agg(F.min("form").alias("form"), F.sum("c").alias("c"))
        .where("c > 0"),
        "counts",
    )
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("tokens"), F.count("*").alias("types")).first()
    # top-k of the vocabulary
    top = counts.where(F.col("h") != int(_END_HASH)).orderBy(F.desc("c"), "h").limit(settings.words - 2).collect()
    ends = counts.where(F.col("h") == int(_END_HASH)).collect()
    frequent = {int(_END_HASH): END} | {r.h: i + 2 for i, r in enumerate(top)}
    known = np.zeros(settings.symbols, np.int64)
    known[END] = ends[0].c if ends else 0
    known[2 : 2 + len(top)] = [r.c for r in top]
    # tokens and types of other words by form: a table of fixed size
    tokens, types = np.zeros(FORMS, np.int64), np.zeros(FORMS, np.int64)
    by_form = counts.where("form >= 0").groupBy("form").agg(F.sum("c").alias("c"), F.count("*").alias("n")).collect()
    for r in by_form:
        tokens[r.form], types[r.form] = r.c, r.n
    for r in top:
        tokens[r.form] -= r.c
        types[r.form] -= 1
    forms = class_symbols(tokens, settings)
    in_class = np.bincount(forms, tokens, settings.symbols)
    sizes = np.ones(settings.symbols)
    classes = np.r_[RARE, settings.words : settings.symbols]
    sizes[classes] += (in_class + np.bincount(forms, types, settings.symbols))[classes]
    unigram = known + 1.0 + in_class
    unigram /= unigram.sum()
    weights = initial(unigram, settings.dims)
    triples = stage(
        texts.mapInArrow(_count_triples(frequent, forms, settings), "triple long, c long")
        .groupBy("triple")
        .agg(F.sum("c").alias("c")),
        "triples",
    )
    shards = max(settings.shards, -(-triples.count() // settings.shard))
    for turn in range(settings.rounds):
        run = _train_shard(weights.flat(), weights, unigram, settings, turn)
        rows = (
            # any even deal will do: triples are distinct, and their number is bounded by the vocabulary
            triples.repartition(shards).mapInArrow(run, "weights binary, seen double").collect()
        )
        if rows:
            parts = np.stack([np.frombuffer(r.weights) for r in rows])
            weights = weights.like(np.average(parts, axis=0, weights=[r.seen for r in rows]))
    return Model(settings, frequent, forms, known, sizes, weights, int(total.tokens), int(total.types)), counts


_READ = (
    "chunk long, doc int, doc_id long, n_tokens long, n_frequent long, base double, score double, "
    "h long, posting long, more binary"
)


def _read(model: Model):
    """Rows of documents, scored as far as frequent words go, and postings of their rare words.

    A posting is one number: the document's place in the chunk, then how often
    the word occurs in it. Most rare words have one; ``more`` packs the others.
    """
    settings = model.settings
    n = settings.symbols
    log_count, log_size = np.log10(model.counts + 1.0), np.log10(model.sizes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = log_table(model.weights)
        chunk = TaskContext.get().partitionId() << 32
        names = [x.split()[0] for x in _READ.split(", ")]

        def batch_of(size: int, **columns: pa.Array) -> pa.RecordBatch:
            types = dict(
                chunk=pa.int64(), doc=pa.int32(), doc_id=pa.int64(), n_tokens=pa.int64(), n_frequent=pa.int64(),
                base=pa.float64(), score=pa.float64(), h=pa.int64(), posting=pa.int64(), more=pa.binary(),
            )
            return pa.RecordBatch.from_arrays([columns.get(k, pa.nulls(size, types[k])) for k in names], names=names)

        def close(doc_ids: list, documents: list[list[bytes]]) -> Iterator[pa.RecordBatch]:
            number: dict[bytes, int] = {}
            put = number.setdefault
            local = [np.array([put(w, len(number)) for w in d], np.int64) for d in documents]
            hashes = np.fromiter(map(word_hash, number), np.int64, len(number))
            forms = model.forms.tolist()
            ids = np.fromiter(
                (
                    forms[form_of(w)] if (known := model.frequent.get(h)) is None else known
                    for h, w in zip(hashes.tolist(), number)
                ),
                np.int64,
                len(number),
            )
            first, second, word = _chain([ids[d] for d in local])
            sizes = np.array([len(d) + 1 for d in local])
            starts = np.cumsum(sizes) - sizes
            logs = table[first * n + second, word].astype(np.float64) / np.log(10) - log_size[word]
            usual = (word != RARE) & (word < settings.words)
            yield batch_of(
                len(local),
                chunk=pa.array(np.full(len(local), chunk)),
                doc=pa.array(np.arange(len(local), dtype=np.int32)),
                doc_id=pa.array(doc_ids, pa.int64()),
                n_tokens=pa.array(sizes, pa.int64()),
                n_frequent=pa.array(np.add.reduceat(usual.astype(np.int64), starts)),
                base=pa.array(np.add.reduceat(np.where(usual, log_count[word], 0.0), starts)),
                score=pa.array(np.add.reduceat(logs, starts)),
            )
            if not len(number):
                return
            every = np.concatenate(local)
            owner = np.repeat(np.arange(len(local)), sizes - 1)
            rare = (ids[every] == RARE) | (ids[every] >= settings.words)
            pair, times = np.unique(every[rare] * len(local) + owner[rare], return_counts=True)
            which, posting = pair // len(local), pair % len(local) << 32 | times
            edge = np.flatnonzero(np.concatenate(([True], which[1:] != which[:-1]))) if len(which) else which
            data, ends = posting.tobytes(), np.append(edge[1:], len(which))
            for at in range(0, len(edge), 50_000):
                own, stop = edge[at : at + 50_000], ends[at : at + 50_000]
                more = [data[8 * a + 8 : 8 * b] if b - a > 1 else None for a, b in zip(own.tolist(), stop.tolist())]
                yield batch_of(
                    len(own),
                    chunk=pa.array(np.full(len(own), chunk)),
                    h=pa.array(hashes[which[own]]),
                    posting=pa.array(posting[own]),
                    more=pa.array(more, pa.binary()),
                )

        doc_ids, documents, size = [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                doc_ids.append(doc_id.as_py())
                value = text.as_py() or ""
                documents.append(words_of(value))
                size += len(value)
                if size >= settings.chunk_chars:
                    yield from close(doc_ids, documents)
                    doc_ids, documents, size = [], [], 0
                    chunk += 1
        if documents:
            yield from close(doc_ids, documents)

    return run


def _sum_postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (chunk, c, posting, more), chunks whole: log10 counts and known rare words per document."""
    logs: dict[int, np.ndarray] = {}
    known: dict[int, np.ndarray] = {}
    for batch in batches:
        chunks, c, first = (np.asarray(batch.column(k)) for k in (0, 1, 2))
        more = batch.column(3).to_pylist()
        sizes = np.array([len(x) // 8 if x else 0 for x in more], np.int64)
        postings = np.concatenate((first, np.frombuffer(b"".join(x for x in more if x), np.int64)))
        docs, times = postings >> 32, postings & 0xFFFFFFFF
        owner = np.concatenate((chunks, np.repeat(chunks, sizes)))
        value = np.concatenate((c, np.repeat(c, sizes)))
        value = np.log10(value + 1.0) * times
        for chunk in np.unique(chunks).tolist():
            own = owner == chunk
            sums, many = np.bincount(docs[own], value[own]), np.bincount(docs[own], times[own])
            for kept, new in ((logs, sums), (known, many)):
                old = kept.get(chunk, np.zeros(0))
                if len(old) < len(new):
                    old, new = new, old
                old = old.astype(np.float64)
                old[: len(new)] += new
                kept[chunk] = old
    for chunk, sums in logs.items():
        doc = np.flatnonzero(known[chunk])
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(len(doc), chunk)),
                pa.array(doc.astype(np.int32)),
                pa.array(sums[doc]),
                pa.array(np.rint(known[chunk][doc]).astype(np.int64)),
            ],
            names=["chunk", "doc", "logs", "known"],
        )


def score_documents(docs: DataFrame, model: Model, counts: DataFrame, text: str = "text") -> DataFrame:
    """Scores of whole texts: (doc_id, n_tokens, n_known, base_score, score), log10 probabilities.

    ``base_score`` is the add-one unigram model, ``score`` the log-bilinear
    one. Every row is scored; NULL and empty texts are one token, the end.
    Repeated rows get equal scores, a NULL id stays NULL, an empty table stays
    empty, other columns are ignored.
    """
    read = stage(docs.select("doc_id", text).mapInArrow(_read(model), _READ), "scored")
    # a word that was not counted adds nothing
    met = read.where("h IS NOT NULL").select("chunk", "h", "posting", "more").join(counts.select("h", "c"), "h")
    sums = (
        met.select("chunk", "c", "posting", "more")
        .repartition("chunk")
        .mapInArrow(_sum_postings, "chunk long, doc int, logs double, known long")
    )
    rows = read.where("doc IS NOT NULL").drop("h", "posting", "more").join(sums, ["chunk", "doc"], "left")
    logs, known = F.coalesce("logs", F.lit(0.0)), F.coalesce("known", F.lit(0).cast("long"))
    every = float(np.log10(model.tokens + model.types + 1.0))
    # a frequent word is one that was counted, except in an empty corpus
    ends = F.lit(0 if model.counts[END] else 1)
    return rows.select(
        "doc_id",
        "n_tokens",
        (F.col("n_frequent") - ends + known).alias("n_known"),
        (F.col("base") + logs - F.col("n_tokens") * every).alias("base_score"),
        (F.col("score") + logs).alias("score"),
    )
