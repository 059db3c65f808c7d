"""Formatting conversations by a compiled template, with marks of the text to learn from."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlane.llm.templates import Piece, compile_template, unescape

START, SEPARATOR, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>\n"
TEMPLATE = (
    "{%- for m in messages -%}"
    "{{ '<|im_start|>' ~ (m.role | escape_controls) }}{{ '<|im_sep|>' }}"
    "{%- if m.role == 'assistant' -%}"
    "{% generation %}{{ m.text | escape_controls }}{% endgeneration %}"
    "{%- else -%}{{ m.text | escape_controls }}{%- endif -%}"
    "{{ '<|im_end|>' ~ '\\n' }}"
    "{%- endfor -%}"
)


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(column.to_pylist() for column in batch.columns), strict=True)


def _conversations(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    """Each conversation's id and its messages, read as they are asked for."""
    for conv_id, rows in groupby(_rows(batches), key=itemgetter(0)):
        yield conv_id, ({"role": role or "", "text": text or ""} for _, _, role, text in rows)


def _sorted(conversations: DataFrame) -> DataFrame:
    return (
        conversations.select("conv_id", "turn", "role", "text")
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", "turn", "role", "text")
    )


def _emit(rows: Iterable[tuple], schema: pa.Schema, size: int = 256) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def format_conversations(conversations: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """Render conversations: rows (conv_id, part, formatted, loss).

    The parts of a conversation in order are its formatted text; ``loss`` marks
    those inside a generation block. Turns are sorted by turn, then role and
    text (NULL first); NULL roles and texts are empty, rows with a NULL conv_id
    are one conversation, repeated rows are repeated turns. An empty table gives
    an empty one; other columns are ignored. A conversation is streamed through
    one task turn by turn, so that memory doesn't grow with its length.
    """
    conv_type = dict(conversations.dtypes)["conv_id"]

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = compile_template(template)
        schema = pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), ("formatted", pa.string()), ("loss", pa.bool_())])
        rows = (
            (conv_id, i, text, loss)
            for conv_id, messages in _conversations(batches)
            for i, (text, loss) in enumerate(run({"messages": messages}))
        )
        yield from _emit(rows, schema)

    return _sorted(conversations.withColumn("conv_id", F.col("conv_id").cast("long"))).mapInArrow(
        render, "conv_id long, part long, formatted string, loss boolean"
    ).withColumn("conv_id", F.col("conv_id").cast(conv_type))


class Readback:
    """Reads formatted pieces of one conversation back into turns and the learned text."""

    def __init__(self) -> None:
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.formatted_chars = 0
        self._open: list[str] = []
        self._masked: list[str] = []

    def add(self, piece: Piece) -> None:
        text, loss = piece
        self.formatted_chars += len(text)
        self._open.append(text)
        if loss:
            self._masked.append(text)
        else:
            self._learn()
        # the end mark of a turn can't stand inside an escaped text
        if text.endswith(END) or END in text:
            *whole, rest = "".join(self._open).split(END)
            for turn in whole:
                self._turn(turn)
            self._open = [rest] if rest else []

    def _learn(self) -> None:
        if self._masked:
            text = unescape("".join(self._masked))
            self.loss.update(text.encode())
            self.loss_chars += len(text)
            self._masked = []

    def _turn(self, turn: str) -> None:
        head, separator, text = turn.partition(SEPARATOR)
        if not head.startswith(START) or not separator:
            raise ValueError(f"not a turn: {turn[:80]!r}")
        self.n_turns += 1
        self.turns.update(f"{unescape(head[len(START):])}\n{unescape(text)}\n".encode())

    def figures(self) -> tuple:
        self._learn()
        if self._open:
            raise ValueError("the last turn has no end")
        return (
            self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.formatted_chars
        )


READBACK = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def read_back(conversations: DataFrame, template: str = TEMPLATE, reader: Callable = Readback) -> DataFrame:
    """Format every conversation and read turns and learned text back from the output.

    One row per conversation: ``n_turns``, ``turns_sha256``, ``loss_chars``,
    ``loss_sha256``, ``formatted_chars``. Formatting and reading are one stream;
    edge cases are those of ``format_conversations``.
    """

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = compile_template(template)
        schema = pa.schema([
            ("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()),
            ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()),
        ])

        def rows() -> Iterator[tuple]:
            for conv_id, messages in _conversations(batches):
                back = reader()
                for piece in run({"messages": messages}):
                    back.add(piece)
                yield conv_id, *back.figures()

        yield from _emit(rows(), schema)

    return _sorted(conversations).mapInArrow(digest, READBACK)
