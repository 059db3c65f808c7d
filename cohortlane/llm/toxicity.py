"""Toxic spans and document scores from a linear-chain CRF over words.

Labels mark whole documents, so the words to learn from are labelled first:
in toxic documents, those whose form (word, beginnings, ending) is tied to
toxic documents more firmly than chance allows among all forms looked at. The
CRF learns these labels along sentences. Forward-backward gives each word its
probability of being toxic; a document's score is a logistic function of
summaries of them, fitted on documents that the CRF has not seen, and words
above one half make the offending spans.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlane.llm.crf import Model, _groups, _padded, train

#: Hashed forms; a fixed size, whatever the corpus.
FORMS = 1 << 20
#: Forms of a word: itself, its first 3 to 9 characters, its last 4.
BEGINS = range(3, 10)
WIDTH = 2 + len(BEGINS)
#: A sentence of more words is several chains.
CHAIN = 64
#: Training text that repeats so many words of an earlier sample document counts once.
PASSAGE = 8
_EDGE = ".,;:!?|\"'()[]{}«»„“”…-"
_ENDS = (".", "!", "?", "…")
_WORD = re.compile(r"\S+")
#: Parts of the sample; each is summarised by a CRF of the others.
FOLDS = 2
#: Distinct words that a task remembers.
_REMEMBERED = 400_000
#: Texts are scored so many words at a time, give or take one text.
_WORDS = 200_000


def _number(form: str) -> int:
    return 1 + xxhash.xxh3_64_intdigest(form.encode("utf-8", "surrogatepass")) % (FORMS - 1)


def forms(word: str) -> list[int]:
    """Numbers of a word's forms; number 0 fills up."""
    w = word.lower().strip(_EDGE)
    named = ["=" + w, *("^" + w[:k] for k in BEGINS if len(w) >= k), "$" + w[-4:]] if w else []
    return [_number(x) for x in named] + [0] * (WIDTH - len(named))


class Bags:
    """Rows of ``WIDTH`` form numbers, used as a sparse 0/1 matrix."""

    def __init__(self, numbers: np.ndarray):
        self.numbers = numbers
        self.shape = (len(numbers), FORMS)

    def __getitem__(self, rows: np.ndarray) -> Bags:
        return Bags(self.numbers[rows])

    def __matmul__(self, weights: np.ndarray) -> np.ndarray:
        return weights[self.numbers].sum(axis=1)

    @property
    def T(self) -> _Turned:
        return _Turned(self.numbers)


class _Turned:
    def __init__(self, numbers: np.ndarray):
        self.numbers = numbers

    def __matmul__(self, values: np.ndarray) -> np.ndarray:
        out = np.bincount(self.numbers.ravel(), np.repeat(values, WIDTH), FORMS)
        out[0] = 0.0
        return out


class _Lexicon(dict):
    """Words met so far and their numbers, with rows of forms and sentence ends."""

    def __init__(self) -> None:
        self.rows: list[list[int]] = []
        self.ends: list[bool] = []

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self.rows)
        self.rows.append(forms(word))
        self.ends.append(word.rstrip("\"')”»").endswith(_ENDS))
        return number


class _Scores(dict):
    """Words met so far and their numbers, with scores under a model."""

    def __init__(self, weights: np.ndarray):
        self.weights = weights
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.score = array("d")
        self.ends = bytearray()
        self.begins: dict[str, float] = {}

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self.score)
        w = word.lower().strip(_EDGE)
        own = 0.0
        if w:
            begin = self.begins.get(w[: BEGINS[-1]])
            if begin is None:
                own = sum(self.weights[_number("^" + w[:k])] for k in BEGINS if len(w) >= k)
                begin = self.begins[w[: BEGINS[-1]]] = own
            own = float(begin + self.weights[_number("=" + w)] + self.weights[_number("$" + w[-4:])])
        self.score.append(own)
        self.ends.append(word.rstrip("\"')”»").endswith(_ENDS))
        return number


def chains(ends: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Lengths of the chains: sentences within documents of ``sizes`` words, cut at ``CHAIN`` words."""
    n = len(ends)
    first = np.zeros(n, bool)
    first[1:] = ends[:-1]
    starts = np.cumsum(sizes) - sizes
    first[starts[sizes > 0]] = True
    at = np.flatnonzero(first)
    since = np.arange(n) - np.repeat(at, np.diff(np.append(at, n)))
    at = np.flatnonzero(since % CHAIN == 0)
    return np.diff(np.append(at, n))


def marginals(model: Model, scores: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Each word's probability of state 1, by forward and backward odds of the two states.

    A word's odds are its score's times those of the words before it and those
    of the words after it, each carried along the chain by the 2 x 2 table.
    """
    step = np.exp(np.clip(model.steps, -30, 30))
    start = np.exp(np.clip(model.start[1] - model.start[0], -30, 30))
    out = np.empty(len(scores))
    for group, words in _groups(lengths, len(lengths)):
        table, live = _padded(np.clip(scores[words], -30, 30), lengths[group])
        odds = np.exp(table).T.copy()  # place x chain
        width = len(odds)
        before = np.empty_like(odds)
        before[0] = start
        for t in range(1, width):
            r = before[t - 1] * odds[t - 1]
            before[t] = (step[0, 1] + r * step[1, 1]) / (step[0, 0] + r * step[1, 0])
        after = np.ones_like(odds)
        for t in range(width - 2, -1, -1):
            r = after[t + 1] * odds[t + 1]
            ratio = (step[1, 0] + r * step[1, 1]) / (step[0, 0] + r * step[0, 1])
            after[t] = np.where(live[:, t + 1], ratio, 1.0)
        total = before * odds * after
        out[words] = (total / (1.0 + total)).T[live]
    return out


def summaries(p: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Per document: a constant, how surely some word is toxic, the surest word, their number and share."""
    out = np.zeros((len(sizes), 5))
    out[:, 0] = 1.0
    some = np.flatnonzero(sizes)
    out[:, 1] = -1.5
    if len(some):
        first = (np.cumsum(sizes) - sizes)[some]
        p = np.clip(p, 0.0, 1 - 1e-9)
        none = np.add.reduceat(np.log1p(-p), first)
        many = np.add.reduceat(p, first)
        out[some, 1] = np.clip(np.log10(np.maximum(-np.expm1(none), 1e-9)) - none / np.log(10), -6, 6) / 4
        out[some, 2] = np.maximum.reduceat(p, first)
        out[some, 3] = np.log1p(many)
        out[some, 4] = np.minimum(20 * many / sizes[some], 3.0)
    return out


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Weighted logistic regression by Newton steps."""
    beta = np.zeros(x.shape[1])
    weight = weight / weight.sum()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        gradient = x.T @ (weight * (y - p)) - ridge * beta
        curve = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + ridge * np.eye(len(beta))
        move = np.linalg.solve(curve, gradient)
        beta = beta + np.clip(move, -2, 2)
        if np.abs(move).max() < 1e-6:
            break
    return beta


@dataclass
class Tagger:
    crf: Model
    document: np.ndarray  # weights of ``summaries``


@dataclass(frozen=True)
class Sample:
    """Bounds of the training sample.

    ``documents`` are taken by hash of their ids, half at most from each class,
    none above ``longest`` characters, as far as ``chars`` go; the CRF is
    trained on all sentences of them with a toxic word and up to ``sentences``
    others.
    """

    documents: int = 4000
    longest: int = 200_000
    chars: int = 30_000_000
    sentences: int = 8_000


def held_out(key: Column) -> Column:
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(5)) == 0


def fresh_words(tokens: list[np.ndarray]) -> list[np.ndarray]:
    """Of each document, which words lie in no passage that an earlier document has.

    Words of copied text would otherwise seem tied to the class of what was copied.
    """
    out, known = [], set()
    for words in tokens:
        fresh = np.ones(len(words), bool)
        if len(words) >= PASSAGE:
            h = np.zeros(len(words) - PASSAGE + 1, np.uint64)
            for j in range(PASSAGE):
                h = h * np.uint64(0x9E3779B97F4A7C15) + words[j : j + len(h)].astype(np.uint64) + np.uint64(1)
                h ^= h >> np.uint64(29)
            hashes = h.tolist()
            for i in np.flatnonzero([x in known for x in hashes]).tolist():
                fresh[i : i + PASSAGE] = False
            known.update(hashes)
        out.append(fresh)
    return out


def label_words(
    tokens: list[np.ndarray], fresh: list[np.ndarray], toxic: np.ndarray, rows: np.ndarray
) -> list[np.ndarray]:
    """States of the words of documents whose classes are known; ``fresh`` words are counted.

    A form is tied to the class if the log-likelihood ratio of its document
    counts exceeds what the best of all forms reaches by chance.
    """
    seen = (np.zeros(FORMS), np.zeros(FORMS))
    for words, new, state in zip(tokens, fresh, toxic):
        if new.any():
            seen[int(state)][np.unique(rows[np.unique(words[new])])] += 1
    a, b = seen[1], seen[0]
    n1, n0 = max(1, toxic.sum()), max(1, (1 - toxic).sum())
    share = n1 / (n1 + n0)

    def part(x: np.ndarray, of: np.ndarray) -> np.ndarray:
        return x * np.log(np.maximum(x, 1e-9) / np.maximum((a + b) * of, 1e-9))

    ratio = 2 * (part(a, share) + part(b, 1 - share))
    limit = 2 * np.log(max(2, np.count_nonzero(a + b)))
    tied = (ratio > limit) & ((a + 0.5) / (n1 + 1) > 8 * (b + 0.5) / (n0 + 1))
    tied[0] = False
    marked = tied[rows].any(axis=1)
    return [marked[words] & bool(state) for words, state in zip(tokens, toxic)]


def _train_crf(
    tokens: list[np.ndarray], fresh: list[np.ndarray], toxic: np.ndarray, rows: np.ndarray, ends: np.ndarray, sentences: int
) -> Model:
    states = label_words(tokens, fresh, toxic, rows)
    words, state = np.concatenate(tokens), np.concatenate(states)
    lengths = chains(ends[words], np.array([len(t) for t in tokens]))
    if not len(lengths):
        return Model(np.zeros(FORMS), np.zeros((2, 2)), np.zeros(2))
    first = np.cumsum(lengths) - lengths
    holds = np.logical_or.reduceat(state, first)
    rest = np.flatnonzero(~holds)
    # sentences without a toxic word, evenly over all documents
    rest = rest[np.linspace(0, len(rest) - 1, min(sentences, len(rest))).astype(np.int64)] if len(rest) else rest
    chosen = np.sort(np.concatenate((np.flatnonzero(holds)[:sentences], rest)))
    at = np.concatenate([np.arange(first[c], first[c] + lengths[c]) for c in chosen])
    return train(Bags(rows[words[at]]), lengths[chosen], state[at].astype(np.int64), rounds=40, ridge=1e-6, rate=0.2)


def train_tagger(texts: list[str | None], toxic: np.ndarray, weight: np.ndarray, sample: Sample = Sample()) -> Tagger:
    """A tagger from texts with classes; ``weight`` is what each document stands for.

    The document weights are fitted on summaries by CRFs of the other folds.
    """
    lexicon = _Lexicon()
    tokens = [np.fromiter(map(lexicon.__getitem__, (t or "").split()), np.int64) for t in texts]
    rows = np.array(lexicon.rows or [[0] * WIDTH], np.int32)
    ends = np.array(lexicon.ends or [False])
    fresh = fresh_words(tokens)
    # copies are left out
    kept = [i for i, new in enumerate(fresh) if 2 * new.sum() >= len(new)]
    tokens, fresh = [tokens[i] for i in kept], [fresh[i] for i in kept]
    toxic, weight = toxic[kept], weight[kept]
    parts, order = [], np.arange(len(kept))
    for fold in range(FOLDS):
        inside, outside = order[order % FOLDS == fold], order[order % FOLDS != fold]
        model = _train_crf(
            [tokens[i] for i in outside], [fresh[i] for i in outside], toxic[outside], rows, ends, sample.sentences
        )
        words, sizes = np.concatenate([tokens[i] for i in inside]), np.array([len(tokens[i]) for i in inside])
        p = marginals(model, (Bags(rows) @ model.weights)[words], chains(ends[words], sizes)) if len(words) else words
        parts.append((inside, summaries(p, sizes)))
    at = np.concatenate([i for i, _ in parts])
    beta = _logistic(np.concatenate([x for _, x in parts]), toxic[at].astype(float), weight[at])
    return Tagger(_train_crf(tokens, fresh, toxic, rows, ends, sample.sentences), beta)


def fit(docs: DataFrame, labels: DataFrame, sample: Sample = Sample()) -> Tagger:
    """Train on a bounded sample of labelled documents that are not held out.

    NULL labels or ids and labels but 0 and 1 are ignored; of repeated ids one
    row counts; NULL texts are empty. With one class only, or no labelled
    document, every score is the share of that class, or one half.
    """
    known = (
        labels.where("toxic IN (0, 1) AND doc_id IS NOT NULL").where(~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.max("toxic").cast("int").alias("_toxic"))
    )
    totals = {r["_toxic"]: r["n"] for r in known.groupBy("_toxic").agg(F.count("*").alias("n")).collect()}
    half = sample.documents // 2
    chosen = None
    for value in (0, 1):
        # a top-k by hash: its size is the documented bound
        part = known.where(F.col("_toxic") == value).withColumn("_at", F.xxhash64("doc_id")).orderBy("_at", "doc_id").limit(half)
        chosen = part if chosen is None else chosen.unionByName(part)
    found = (
        docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
        .where(F.length("text") <= sample.longest)
        .join(F.broadcast(chosen), "doc_id")
    )
    # the running sum is over the sample alone
    running = Window.orderBy("_at", "doc_id", "text").rowsBetween(Window.unboundedPreceding, 0)
    rows = (
        found.withColumn("_sum", F.sum(F.length("text").cast("long")).over(running))
        .where(F.col("_sum") <= sample.chars)
        .dropDuplicates(["doc_id"])
        .orderBy("_at", "doc_id")
        .select("text", "_toxic")
        .collect()
    )
    toxic = np.array([r["_toxic"] for r in rows], np.int64)
    if len(set(toxic.tolist())) < 2:
        prior = np.log((toxic.sum() + 0.5) / (len(toxic) - toxic.sum() + 0.5)) if len(toxic) else 0.0
        return Tagger(Model(np.zeros(FORMS), np.zeros((2, 2)), np.zeros(2)), np.array([prior, 0, 0, 0, 0]))
    held = np.bincount(toxic, minlength=2)
    weight = np.array([totals[t] / held[t] for t in toxic.tolist()])
    return train_tagger([r["text"] for r in rows], toxic, weight, sample)


def _spans(text: str, flagged: np.ndarray) -> list[dict]:
    """Places of flagged words in code points; neighbours are one span."""
    out: list[dict] = []
    last = -2
    wanted = set(np.flatnonzero(flagged).tolist())
    for i, m in enumerate(_WORD.finditer(text)):
        if i in wanted:
            if i == last + 1:
                out[-1]["end"] = m.end()
            else:
                out.append({"start": m.start(), "end": m.end()})
            last = i
    return out


def _score(weights: np.ndarray, steps: np.ndarray, start: np.ndarray, document: np.ndarray):
    model = Model(weights, steps, start)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Scores(weights.astype(np.float64))

        def scored(part: list[str], tokens: list[np.ndarray]) -> tuple:
            sizes = np.array([len(t) for t in tokens])
            words = np.concatenate(tokens)
            p = np.empty(0)
            if len(words):
                ends = np.frombuffer(known.ends, bool)[words]
                p = marginals(model, np.frombuffer(known.score)[words], chains(ends, sizes))
            z = np.clip(summaries(p, sizes) @ document, -30, 30)
            spans = []
            for text, size, stop in zip(part, sizes, np.cumsum(sizes)):
                flagged = p[stop - size : stop] >= 0.5
                spans.append(_spans(text, flagged) if flagged.any() else [])
            return sizes, 1 / (1 + np.exp(-z)), spans

        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            sizes, scores, spans, part, tokens, held = [], [], [], [], [], 0
            for i in range(batch.num_rows):
                text = column[i].as_py() or ""
                part.append(text)
                tokens.append(np.fromiter(map(known.__getitem__, text.split()), np.int64))
                held += len(tokens[-1])
                if held > _WORDS or i + 1 == batch.num_rows:
                    for whole, new in zip((sizes, scores, spans), scored(part, tokens)):
                        whole.extend(new)
                    part, tokens, held = [], [], 0
                    if len(known) > _REMEMBERED:
                        known.reset()
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            arrays = [*batch.columns[:-1], pa.array(sizes, pa.int64()), pa.array(scores, pa.float64()), pa.array(spans, kind)]
            yield pa.RecordBatch.from_arrays(arrays, names=[*batch.schema.names[:-1], "n_words", "score", "spans"])

    return run


def score_documents(docs: DataFrame, tagger: Tagger, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """Toxicity of whole texts: the ``keep`` columns, ``n_words``, ``score`` (0 to 1) and ``spans``.

    ``spans`` are the offending places, (start, end) in code points, in order.
    Each row is scored on its own text alone: NULL and empty texts have no
    words and the score of a text without toxic words, repeated rows score
    alike, an empty table stays empty, other columns are ignored.
    """
    kept = [f for f in docs.schema.fields if f.name in keep]
    schema = ", ".join(
        [*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "n_words long, score double, spans array<struct<start:int,end:int>>"]
    )
    crf = tagger.crf
    run = _score(crf.weights.astype(np.float32), crf.steps, crf.start, tagger.document)
    return docs.select(*[F.col(f"`{f.name}`") for f in kept], F.col(text).alias("_text")).mapInArrow(run, schema)
