"""Packing tokenised documents into sequences of bounded length.

Documents become pieces in one pass over the texts. Pieces of full length are
sequences by themselves; the others are dealt out to blocks of a fixed size by
a hash, and each block is packed by a grouping genetic algorithm on several
islands that send their best packing around a ring between epochs. What the
blocks leave half empty is pooled and packed once more.
"""

from __future__ import annotations

import string
import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlane.llm.grouping import Block, Search, to_bins, to_numbers
from cohortlane.sources.sinks import stage

END_ID = 1
#: Python's split also parts at separators, and its lower case of sigma depends on what follows; special tokens are exact.
_SPECIAL = ("\x1c", "\x1d", "\x1e", "\x1f", "\u03a3", "\u0130", "<|")


@dataclass(frozen=True)
class Packing:
    """``block``: pieces per block. ``islands`` and ``epochs``: independent
    searches per block, and how often they go on after migration. ``pooled``:
    sequences of a block filled to a smaller share are dissolved and packed
    anew together with those of other blocks."""

    capacity: int = 4096
    block: int = 8192
    islands: int = 2
    epochs: int = 2
    pooled: float = 0.97
    search: Search = Search()


class WordIds:
    """Token ids by white-space separated word, as little-endian 32-bit bytes.

    The tokenizer lower-cases and never joins across white space, so a text's
    ids are those of its lower-case words. New words are parted into letters
    and the ASCII signs behind them, which the tokenizer parts as well, and
    many parts are encoded as one text: the vocabulary marks the last token of
    each part. Texts with special tokens, or with characters that are split or
    lower-cased otherwise, go to the tokenizer whole. Words are kept in a table
    that is thinned to the words in use when it has ``limit`` entries.
    """

    def __init__(self, path: str, limit: int = 700_000):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        # the same model for parts that are lower case, composed and parted already
        self.bare = Tokenizer(self.tokenizer.model)
        self.bare.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        )
        self.limit, self.known = limit, {}
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True

    def encode(self, texts: list[str]) -> list[bytes]:
        words = [None if any(map(t.__contains__, _SPECIAL)) else t.lower().split() for t in texts]
        used = set().union(*[w for w in words if w])
        if new := used.difference(self.known):
            if len(self.known) + len(new) > self.limit:
                self.known = {w: self.known[w] for w in used.intersection(self.known)}
            self._learn(new)
        get = self.known.__getitem__
        return [self.whole(t) if w is None else b"".join(map(get, w)) for t, w in zip(texts, words)]

    def _learn(self, new: set[str]) -> None:
        letters = [w for w in new if w.isalpha()]
        mixed = [(w, w.rstrip(string.punctuation)) for w in new.difference(letters)]
        ids = self._parts(letters)
        parted = [(w, core, w[len(core) :]) for w, core in mixed if core.isalpha()]
        parts = {part for _, core, tail in parted for part in (core, tail)}
        # a core may be a word by itself, of this batch or an earlier one
        have = {p: known for p in parts if (known := ids.get(p) or self.known.get(p)) is not None}
        have |= self._parts(list(parts.difference(have)))
        self.known |= ids
        self.known |= {w: have[core] + have[tail] for w, core, tail in parted}
        self.known |= {w: self.whole(w) for w, core in mixed if not core.isalpha()}

    def _parts(self, parts: list[str]) -> dict[str, bytes]:
        out: dict[str, bytes] = {}
        for at in range(0, len(parts), 2048):
            own = parts[at : at + 2048]
            line = unicodedata.normalize("NFC", " ".join(own))
            data = np.array(self.bare.encode_batch_fast([line], add_special_tokens=False)[0].ids, "<u4").tobytes()
            stops = 4 * (np.flatnonzero(self.ends[np.frombuffer(data, "<u4")]) + 1)
            if len(stops) != len(own):
                out |= {part: self.whole(part) for part in own}
                continue
            stops = stops.tolist()
            out |= {part: data[a:b] for part, a, b in zip(own, [0, *stops], stops)}
        return out

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


@cache
def _word_ids(path: str) -> WordIds:
    return WordIds(path)


def _cut(path: str, capacity: int, with_ids: bool):
    """Rows (uid, doc_id, piece, start, length, ids_crc32[, ids]) of documents (doc_id, text)."""
    end = np.array([END_ID], "<u4").tobytes()
    width = 4 * capacity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = _word_ids(path)
        uid = TaskContext.get().partitionId() << 40
        for batch in batches:
            for part in (batch.slice(at, 256) for at in range(0, batch.num_rows, 256)):
                doc_ids, texts = part.column(0).to_pylist(), [x or "" for x in part.column(1).to_pylist()]
                rows = []
                for doc_id, body in zip(doc_ids, ids.encode(texts)):
                    body += end
                    for k, at in enumerate(range(0, len(body), width)):
                        piece = body[at : at + width]
                        row = (uid, doc_id, k, at // 4, len(piece) // 4, zlib.crc32(piece))
                        rows.append((*row, np.frombuffer(piece, "<u4").astype(np.int64)) if with_ids else row)
                        uid += 1
                names = ["uid", "doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]
                types = [pa.int64()] * 6 + [pa.list_(pa.int64())] * with_ids
                columns = [pa.array(c, t) for c, t in zip(zip(*rows), types)]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def cut_documents(
    docs: DataFrame, path: str, capacity: int = 4096, text: str = "text", with_ids: bool = False
) -> DataFrame:
    """Pieces of at most ``capacity`` tokens: (uid, doc_id, piece, start, length, ids_crc32[, ids]).

    A document's ids are the tokenizer's, then the end id; NULL and empty texts
    are the end id alone. ``uid`` numbers pieces within a task and is fixed once
    the pieces are stored.
    """
    schema = "uid long, doc_id long, piece long, start long, length long, ids_crc32 long" + ", ids array<bigint>" * with_ids
    return docs.select("doc_id", text).mapInArrow(_cut(path, capacity, with_ids), schema)


_STATE = "block long, island int, uids array<bigint>, lengths array<bigint>, packings array<array<int>>, n_bins int, fill double"


def _evolve(params: Packing, epoch: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(k)[i].as_py() for k, name in enumerate(batch.schema.names)}
                block = Block(row["lengths"], params.capacity)
                start = [to_bins(p) for p in row["packings"] or []]
                ranked = block.evolve(start, params.search, (row["block"] * 31 + row["island"]) * 31 + epoch)
                ranked = ranked[: params.search.population]
                n_bins, fill = block.fitness(ranked[0])
                n = len(row["lengths"])
                values = (row["block"], row["island"], row["uids"], row["lengths"], [to_numbers(p, n) for p in ranked])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([v], t)
                        for v, t in zip(
                            (*values, -n_bins, fill),
                            (pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()),
                             pa.list_(pa.list_(pa.int32())), pa.int32(), pa.float64()),
                        )
                    ],
                    names=["block", "island", "uids", "lengths", "packings", "n_bins", "fill"],
                )

    return run


def _packed_blocks(pieces: DataFrame, params: Packing) -> DataFrame:
    """Pack (uid, length) rows: (uid, length, block, bin)."""
    n_blocks = max(1, round(pieces.count() / params.block))
    # uids are distinct, so a hash deals them out evenly: a block's size is bounded
    blocks = pieces.groupBy(F.pmod(F.xxhash64("uid"), F.lit(n_blocks)).alias("block")).agg(
        F.sort_array(F.collect_list(F.struct("uid", "length"))).alias("items")
    )
    states = blocks.select(
        "block",
        F.explode(F.sequence(F.lit(0), F.lit(params.islands - 1))).alias("island"),
        F.col("items.uid").alias("uids"),
        F.col("items.length").alias("lengths"),
        F.lit(None).cast("array<array<int>>").alias("packings"),
    )
    for epoch in range(params.epochs):
        states = stage(
            states.repartition("block", "island").mapInArrow(_evolve(params, epoch), _STATE), "islands"
        )
        if epoch + 1 < params.epochs:
            elite = states.select(
                "block",
                F.pmod(F.col("island") + 1, F.lit(params.islands)).cast("int").alias("island"),
                F.slice("packings", 1, 1).alias("guest"),
            )
            states = states.join(elite, ["block", "island"]).select(
                "block", "island", "uids", "lengths", F.concat("guest", "packings").alias("packings")
            )
    best = states.groupBy("block").agg(
        F.max_by(
            F.struct("uids", "lengths", F.col("packings")[0].alias("bins")),
            F.struct(-F.col("n_bins"), "fill", -F.col("island")),
        ).alias("best")
    )
    return best.select(
        "block", F.inline(F.arrays_zip(F.col("best.uids"), F.col("best.lengths"), F.col("best.bins")))
    ).toDF("block", "uid", "length", "bin")


def pack_pieces(pieces: DataFrame, params: Packing = Packing()) -> DataFrame:
    """Places of pieces (uid, length): rows (uid, sequence_id, offset).

    Pieces of full length are sequences by themselves. Sequence ids are any
    distinct numbers; a sequence is filled from 0 without gaps, in uid order.
    """
    full = pieces.where(F.col("length") >= params.capacity).select(
        "uid", (-F.col("uid") - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    packed = stage(_packed_blocks(pieces.where(F.col("length") < params.capacity), params), "packed")
    loads = packed.groupBy("block", "bin").agg(F.sum("length").alias("load"))
    poor = loads.where(F.col("load") < F.lit(params.pooled * params.capacity)).select("block", "bin")
    pool = packed.join(poor, ["block", "bin"], "left_semi").select("uid", "length")
    again = _packed_blocks(pool, params)
    good = packed.join(poor, ["block", "bin"], "left_anti")
    numbered = good.withColumn("level", F.lit(0)).unionByName(again.withColumn("level", F.lit(1)))
    items = F.aggregate(
        F.sort_array(F.collect_list(F.struct("uid", "length"))),
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<uid:bigint,offset:bigint>>").alias("out")),
        lambda s, x: F.struct(
            (s["at"] + x["length"]).alias("at"),
            F.concat(s["out"], F.array(F.struct(x["uid"].alias("uid"), s["at"].alias("offset")))).alias("out"),
        ),
    )["out"]
    # a sequence holds at most ``capacity`` pieces
    placed = numbered.groupBy("level", "block", "bin").agg(items.alias("items"))
    return placed.select(
        (F.col("block") * F.lit(2) + F.col("level")).alias("_b"), "bin", F.inline("items")
    ).select("uid", (F.col("_b") * F.lit(1 << 24) + F.col("bin")).alias("sequence_id"), "offset").unionByName(full)


def pack_documents(
    docs: DataFrame, path: str, params: Packing = Packing(), text: str = "text", with_ids: bool = False
) -> DataFrame:
    """Tokenise, cut and pack: (doc_id, piece, start, length, ids_crc32, sequence_id, offset[, ids]).

    Only documents longer than the capacity are cut. NULL and empty texts are
    one token long. Each row gives its own pieces, also where rows or ids
    repeat; a NULL id stays NULL; an empty table gives an empty one; other
    columns are ignored.
    """
    pieces = stage(cut_documents(docs, path, params.capacity, text, with_ids), "pieces")
    places = pack_pieces(pieces.select("uid", "length"), params)
    return pieces.join(places, "uid").select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *["ids"] * with_ids
    )
