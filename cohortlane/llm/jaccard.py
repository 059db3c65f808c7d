"""Near-duplicate documents by a parity-sketch join on word shingles.

A document's shingles are hashed into the cells of a sketch; a cell keeps the
XOR of the hashes in it, the parity of a very long row of bits. Two sets that
differ by d shingles differ in at most d cells, so with more cells than the
largest d that a size band allows, some cells must be equal (pigeonhole). Cells
are the join keys; which of the colliding documents to compare is decided by a
short parity sketch whose Hamming distance never exceeds d. What passes is
verified on the sets themselves.

Links are gathered in three rounds. In the first two, each document takes part
in a few of its runs only, those with the smallest hashes, which alike documents
have in common. First it is compared with the first alike document; then each
component in a run that still has several is compared until one alike document
of another is found. The third round takes all runs that still have several
components and compares all documents that are alike, by a longer sketch, and in
different ones. So no link between components is lost, and a group of thousands
of copies costs a few rows per copy instead of all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlane.llm.components import components, extended
from cohortlane.llm.frames import Stored
from cohortlane.sources.sinks import stage

_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15))
#: A run longer than this is compared block by block.
BLOCK = 4096
#: Runs of a document in the first two rounds.
FIRST_RUNS = 4
BITMAP_BITS = 22
#: Bits of the long sketch per shingle of difference: sets that pass it hardly ever fail to link.
LONG = 16


@dataclass(frozen=True)
class Join:
    """``size`` words make a shingle; sets link at ``percent`` Jaccard similarity."""

    size: int = 4
    percent: int = 85

    def largest(self, n: int) -> int:
        """The largest set that may link with one of n shingles."""
        return 100 * n // self.percent

    def apart(self, total: int) -> int:
        """The most shingles by which two linked sets of ``total`` shingles together differ."""
        return (100 - self.percent) * total // (100 + self.percent)

    def bands(self, upto: int) -> tuple[np.ndarray, np.ndarray]:
        """First and last sizes of the bands; linked sets are in one band or in neighbouring ones."""
        first, last = [1], [self.largest(1)]
        while last[-1] < upto:
            first.append(last[-1] + 1)
            last.append(self.largest(first[-1]))
        first.append(last[-1] + 1)
        last.append(self.largest(first[-1]))
        return np.array(first), np.array(last)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles; A-Z count as a-z."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    k = min(size, len(words))
    total = np.zeros(len(words) - k + 1, np.uint64)
    for j in range(k):
        total = mix(total + _MIX[2] + h[j : len(words) - k + 1 + j])
    return np.unique(total)


def cells(hashes: np.ndarray, group: int, limit: int) -> np.ndarray:
    """Join keys of a set in the group of a size band whose linked sets differ by ``limit`` at most.

    There are some cells more than the pigeonhole needs, so that at least
    ``spare + 1`` cells of linked sets are equal. A set with at most ``spare``
    empty cells leaves them out: one of the equal cells is then not empty. A
    set with more empty cells keeps them as keys.
    """
    spare = 1 + limit // 20 if limit else 0
    n = limit + 1 + spare
    cell = ((hashes >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)
    # sorted hashes are sorted by cell
    starts = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1])))
    parity = np.bitwise_xor.reduceat(mix(hashes ^ _MIX[2]), starts)
    which = cell[starts]
    if n - len(starts) > spare:
        full = np.zeros(n, np.uint64)
        full[which] = parity
        which, parity = np.arange(n), full
    return mix(parity ^ mix(which.astype(np.uint64) + (np.uint64(group) << np.uint64(40))))


def sketch(hashes: np.ndarray, limit: int, per: int = 4) -> np.ndarray:
    """Parity sketch of about ``per`` bits per shingle of difference; a power of two, so that longer ones fold."""
    bits = max(64, 1 << (per * limit - 1).bit_length() if limit else 64)
    odd = np.bincount((hashes & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


# ---- tasks -------------------------------------------------------------------


def _describe(join: Join):
    """Rows (doc_id, n, h1, h2, keys, short, long): long and short sketch; a set that the task has seen has no keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, last = join.bands(1 << 12)
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            for part in (batch.slice(at, 512) for at in range(0, batch.num_rows, 512)):
                n, h1, h2, keys, short, long = [], [], [], [], [], []
                for text in part.column(1):
                    s = shingles(text.as_py(), join.size)
                    a = int(np.bitwise_xor.reduce(mix(s))) if len(s) else 0
                    b = int(mix(s + _MIX[0]).sum(dtype=np.uint64)) if len(s) else 0
                    n.append(len(s))
                    h1.append(a)
                    h2.append(b)
                    if not len(s) or (a, b) in seen:
                        keys.append(None)
                        short.append(None)
                        long.append(None)
                        continue
                    seen.add((a, b))
                    while len(s) > last[-2]:
                        first, last = join.bands(4 * len(s))
                    k = int(np.searchsorted(last, len(s)))
                    # sets of one band meet in the group of the next one at the latest
                    limits = [join.apart(int(last[g]) + (int(last[g - 1]) if g else 0)) for g in (k, k + 1)]
                    keys.append(np.concatenate([cells(s, g, x) for g, x in zip((k, k + 1), limits)]).view(np.int64))
                    short.append(sketch(s, limits[1]).tobytes())
                    long.append(sketch(s, limits[1], LONG).tobytes())
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array(n, pa.int64()),
                        _signed(np.array(h1, np.uint64)),
                        _signed(np.array(h2, np.uint64)),
                        pa.array(keys, pa.list_(pa.int64())),
                        pa.array(short, pa.binary()),
                        pa.array(long, pa.binary()),
                    ],
                    names=["doc_id", "n", "h1", "h2", "keys", "short", "long"],
                )

    return run


def _collisions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (key, h1) sorted by both: the runs of keys with several h1, as (r1, r2, block, members).

    Documents that share many cells meet in as many runs with the same members,
    so a run is named by its members: (r1, r2) are hashes of them. A run of
    several blocks is named by its key and has a row per block.
    """
    key_of: int | None = None
    members: list[int] = []
    block = 0
    rows: list[tuple[int, int, int, list[int]]] = []
    held = 0
    written: set[tuple[int, int]] = set()

    def close() -> None:
        nonlocal held
        if block:
            rows.append((key_of, -1, block, members))
        elif len(members) > 1:
            h = np.array(members, np.int64).view(np.uint64)
            name = int(np.bitwise_xor.reduce(mix(h))), int(mix(h + _MIX[0]).sum(dtype=np.uint64))
            if name in written:
                return
            if len(written) > 500_000:
                written.clear()
            written.add(name)
            # the second half is never that of a key
            rows.append((name[0] - (1 << 63), name[1] >> 1, 0, members))
        else:
            return
        held += len(members)

    def flush() -> pa.RecordBatch:
        nonlocal held
        held = 0
        r1, r2, at, own = zip(*rows)
        rows.clear()
        return pa.RecordBatch.from_arrays(
            [pa.array(r1, pa.int64()), pa.array(r2, pa.int64()), pa.array(at, pa.int64()), pa.array(own, pa.list_(pa.int64()))],
            names=["r1", "r2", "block", "members"],
        )

    for batch in batches:
        key, h1 = (np.asarray(batch.column(i)) for i in (0, 1))
        # most keys stand alone: only the others are looked at one by one
        alone = np.ones(len(key), bool)
        alone[1:] &= key[1:] != key[:-1]
        alone[:-1] &= key[:-1] != key[1:]
        if len(key):
            # a run may go on over the edges of a batch
            alone[0] = alone[-1] = False
        for at in np.flatnonzero(~alone).tolist():
            k, h = int(key[at]), int(h1[at])
            if k != key_of:
                close()
                key_of, members, block = k, [], 0
            if members and members[-1] == h:
                continue
            if len(members) == BLOCK:
                rows.append((k, -1, block, members))
                held += BLOCK
                members, block = [], block + 1
            members.append(h)
            if held > 200_000:
                yield flush()
    close()
    if rows:
        yield flush()


def _folded(values: list[np.ndarray], bits: int) -> np.ndarray:
    """Sketches brought to one length by XOR of their halves."""
    out = np.empty((len(values), bits // 64), np.uint64)
    for i, x in enumerate(values):
        while len(x) * 64 > bits:
            x = x[: len(x) // 2] ^ x[len(x) // 2 :]
        out[i] = x
    return out


def _compare(join: Join, rule: str):
    """Of runs sorted by (r1, r2, low, high, block, node): pairs (a, b) that may link.

    ``first``: each member with the first member before it that is like it.
    ``labels``: of members in different components, one alike pair per component
    at most. ``all``: all alike members in different components.
    """

    def pairs(members: list[tuple]) -> Iterator[tuple[int, int]]:
        # one row per class: h1, n, sketch, component, block
        n = np.array([m[1] for m in members])
        label = np.array([m[4] for m in members])
        node = [m[0] for m in members]
        if rule != "first" and len(set(label.tolist())) == 1:
            return
        sketches = [np.frombuffer(m[2], np.uint64) for m in members]
        table = _folded(sketches, min(map(len, sketches)) * 64)
        blocks = np.array([m[3] for m in members])
        cross = blocks[0] != blocks[-1]
        # members, or all of their components, that need no other pair
        free = np.ones(len(members), bool)
        for i in range(len(members) - 1):
            if (rule != "all" and not free[i]) or (cross and blocks[i] != blocks[0]):
                continue
            other = np.arange(len(members)) > i
            if cross:
                other &= blocks != blocks[0]
            if rule == "first":
                other &= free
            else:
                other &= label != label[i]
            j = np.flatnonzero(other)
            small, large = np.minimum(n[j], n[i]), np.maximum(n[j], n[i])
            j = j[100 * small >= join.percent * large]
            if not len(j):
                continue
            apart = np.bitwise_count(table[j] ^ table[i]).sum(axis=1, dtype=np.int64)
            j = j[apart <= (100 - join.percent) * (n[j] + n[i]) // (100 + join.percent)]
            if rule == "first":
                free[j] = False
            elif rule == "labels" and len(j):
                j = j[:1]
                free &= label != label[i]
            for x in j.tolist():
                yield (node[i], node[x]) if node[i] < node[x] else (node[x], node[i])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        run_of: tuple | None = None
        out: list[tuple[int, int]] = []
        written: set[tuple[int, int]] = set()

        def flush() -> pa.RecordBatch:
            a, b = zip(*out)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        def close() -> None:
            # several runs of a task often hold the same pair
            for pair in pairs(held) if len(held) > 1 else ():
                if pair not in written:
                    if len(written) > 500_000:
                        written.clear()
                    written.add(pair)
                    out.append(pair)

        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for r1, r2, low, high, block, node, n, bits, label in zip(*columns):
                if (r1, r2, low, high) != run_of:
                    close()
                    held, run_of = [], (r1, r2, low, high)
                    if len(out) > 4096:
                        yield flush()
                held.append((node, n, bits, block, label))
        close()
        if out:
            yield flush()

    return run


def _closer(join: Join):
    """Of rows (a, b, n, x, m, y): the pairs whose long sketches are not too far apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for n, x, m, y in zip(*(batch.column(i) for i in range(2, 6))):
                two = [np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y)]
                table = _folded(two, min(map(len, two)) * 64)
                apart = int(np.bitwise_count(table[0] ^ table[1]).sum())
                keep.append(apart <= join.apart(n.as_py() + m.as_py()))
            chosen = batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))
            if chosen.num_rows:
                yield chosen

    return run


def _sets(join: Join, bitmap: bytes):
    """Rows (doc_id, shingles) of documents whose id may be asked for."""
    asked = np.unpackbits(np.frombuffer(bitmap, np.uint8), bitorder="little").astype(bool)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.flatnonzero(asked[np.asarray(batch.column(1))])
            for at in range(0, len(rows), 512):
                part = batch.take(pa.array(rows[at : at + 512]))
                sets = [shingles(x.as_py(), join.size).tobytes() for x in part.column(2)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(sets, pa.binary())], names=["doc_id", "shingles"]
                )

    return run


def _verify(join: Join):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(batch.column(2), batch.column(3)):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (a, b))
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= join.percent * (len(x) + len(y) - both))
            chosen = batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))
            if chosen.num_rows:
                yield chosen

    return run


# ---- the join ------------------------------------------------------------------


def _bucket(column: str):
    return F.pmod(F.xxhash64(column), F.lit(1 << BITMAP_BITS))


def _bitmap(nodes: DataFrame) -> bytes:
    """A bitmap of hashed ids of fixed size, whatever their number: a first sieve before a join."""
    out = bytearray(1 << (BITMAP_BITS - 3))
    bucket = _bucket("node") + 1
    parts = (
        nodes.groupBy(F.bitmap_bucket_number(bucket).alias("part"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position(bucket)).alias("bits"))
        .collect()
    )
    for part, bits in parts:
        at = (part - 1) * len(bits)
        out[at : at + len(bits)] = bits
    return bytes(out)


def _verified(pairs: DataFrame, docs: DataFrame, join: Join) -> DataFrame:
    """Pairs of documents whose sets link, read from the texts themselves."""
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    sets = Stored(
        docs.select("doc_id", _bucket("doc_id").alias("bucket"), "text")
        .mapInArrow(_sets(join, _bitmap(nodes)), "doc_id long, shingles binary")
        .join(nodes.withColumnRenamed("node", "doc_id"), "doc_id", "left_semi")
        .dropDuplicates(["doc_id"]),
        "sets",
    )
    left = sets.frame.select(F.col("doc_id").alias("a"), F.col("shingles").alias("x"))
    right = sets.frame.select(F.col("doc_id").alias("b"), F.col("shingles").alias("y"))
    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y")
    links = stage(joined.mapInArrow(_verify(join), "a long, b long"), "verified")
    sets.discard()
    return links


def link_documents(docs: DataFrame, join: Join = Join(), text: str = "text") -> DataFrame:
    """Near-duplicate classes: rows (doc_id, n_shingles, component_id).

    ``component_id`` is the smallest id reachable over links, the document's
    own included. A document with fewer words than a shingle is one shingle; one
    without words, or without text, links with nothing. Rows with a NULL id keep
    a NULL component and link nothing. Each row of a repeated document gives a
    row (ids are expected to name one text). An empty table gives an empty one;
    other columns are ignored.

    Intermediates (descriptions with join keys, candidate runs, sets to verify,
    links) are written to the session's shared folder; the large ones, keys and
    sets, are removed as soon as what was made of them is written.
    """
    docs = docs.select("doc_id", F.col(text).alias("text"))
    with_keys = Stored(
        docs.mapInArrow(
            _describe(join), "doc_id long, n long, h1 long, h2 long, keys array<bigint>, short binary, long binary"
        ),
        "described",
    )
    figures = stage(with_keys.frame.select("doc_id", "n", "h1", "h2"), "figures")
    solid = with_keys.frame.where("n > 0 AND doc_id IS NOT NULL")
    # sets with equal texts are one node, named by its smallest document
    classes = stage(
        solid.groupBy("h1", "h2").agg(
            F.min("doc_id").alias("node"),
            F.first("n").alias("n"),
            F.first("short", ignorenulls=True).alias("short"),
            F.first("long", ignorenulls=True).alias("long"),
        ),
        "classes",
    )
    runs = (
        solid.select(F.explode("keys").alias("key"), "h1")
        .repartition("key")
        .sortWithinPartitions("key", "h1")
        .mapInArrow(_collisions, "r1 long, r2 long, block long, members array<bigint>")
    )
    # one run for each set of members
    runs = stage(runs.groupBy("r1", "r2", "block").agg(F.first("members").alias("members")), "runs")
    with_keys.discard()
    # members of a run longer than a block meet those of every other block
    long_runs = runs.where("block > 0").groupBy("r1", "r2").agg(F.max("block").alias("blocks"))
    spread = (
        runs.join(long_runs, ["r1", "r2"], "left")
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("blocks", F.lit(0).cast("long")))))
        .select(
            "r1", "r2", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"),
            F.explode("members").alias("h1"),
        )
    )
    members = stage(
        spread.join(classes.select("h1", "node"), "h1").select("r1", "r2", "low", "high", "block", "node"), "members"
    )

    names = ["r1", "r2"]

    def candidates(labelled: DataFrame, rule: str) -> DataFrame:
        order = ("r1", "r2", "low", "high", "block", "node")
        # the long sketch keeps pairs that don't quite link from coming out of every run they share
        kind = "long" if rule == "all" else "short"
        found = (
            labelled.join(classes.select("node", "n", F.col(kind).alias("sketch")), "node")
            .repartition("r1", "r2", "low", "high")
            .sortWithinPartitions(*order)
            .select(*order, "n", "sketch", "label")
            .mapInArrow(_compare(join, rule), "a long, b long")
            .distinct()
        )
        if kind == "long":
            return stage(found, "pairs")
        left = classes.select(F.col("node").alias("a"), "n", F.col("long").alias("x"))
        right = classes.select(F.col("node").alias("b"), F.col("n").alias("m"), F.col("long").alias("y"))
        pairs = found.join(left, "a").join(right, "b").select("a", "b", "n", "x", "m", "y")
        return stage(pairs.mapInArrow(_closer(join), "a long, b long"), "pairs")

    # a document's runs are few: as many as a set has cells
    by_hash = Window.partitionBy("node").orderBy(F.xxhash64(*names), *names)
    few = members.withColumn("_rank", F.dense_rank().over(by_hash)).where(F.col("_rank") <= FIRST_RUNS).drop("_rank")
    few = stage(few, "few")
    final = components(_verified(candidates(few.withColumn("label", F.col("node")), "first"), docs, join))
    for rule, own in (("labels", few), ("all", members)):
        labelled = own.join(final, "node", "left").withColumn("label", F.coalesce("component", "node"))
        # a run within one component has nothing left to compare
        spans = labelled.groupBy(*names).agg(F.min("label").alias("one"), F.max("label").alias("two"))
        still_open = labelled.join(spans.where("one <> two").select(*names), names, "left_semi")
        pairs = candidates(still_open, rule)
        if pairs.isEmpty():
            continue
        final = extended(final, _verified(pairs, docs, join))
    named = (
        figures.join(classes.select("h1", "h2", "node"), ["h1", "h2"], "left")
        .join(final, "node", "left")
    )
    own = F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.coalesce("component", "node"))
    return named.select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce(own, F.col("doc_id")).alias("component_id")
    )


def one_of_each(docs: DataFrame, join: Join = Join(), text: str = "text") -> DataFrame:
    """Documents without those that link, directly or not, with a smaller one.

    All columns stay. Of rows with one id, all or none stay.
    """
    gone = link_documents(docs, join, text).where("component_id <> doc_id").select("doc_id").distinct()
    plain = docs.toDF(*[f"_c{i}" for i in range(len(docs.columns))])
    key = f"_c{docs.columns.index('doc_id')}"
    return plain.join(gone, plain[key] == gone["doc_id"], "left_anti").toDF(*docs.columns)
