"""Personal data in texts, also where it is disguised.

Plain identifiers are found by patterns. Then transducers rewrite disguises to
plain text - homoglyphs and full-width characters, spelled digits, "at" and "dot"
in words or brackets - and keep for every rewritten character the source span
it came from. The same detectors run on the rewritten text; what they find is
mapped back to source characters and added if a rewritten piece is part of it.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int, int]  # start, kind, end

# ---- detectors ---------------------------------------------------------------

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# a match starts where a run of digits does; saying so keeps long runs cheap
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")
#: A cheap necessary condition of a card: twelve digits and separators in a row.
_LONG = re.compile(r"[0-9][0-9\x20-]{10,}[0-9]")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches from the left. A match starts with the run of name characters
    before its @, so looking at each @ once gives what a search would give."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            done = m.end()
            yield start, done
            at = text.find("@", done)
        else:
            # no later match may start before this @
            done, at = at + 1, text.find("@", at + 1)


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = ord(d) - 48
        if i % 2:
            x = x * 2 - 9 if x > 4 else x * 2
        total += x
    return total % 10 == 0


def _cards(text: str) -> Iterator[tuple[int, int]]:
    if not _LONG.search(text):
        return
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = _NOT_DIGIT.sub("", m[0])
            if 12 <= len(digits) <= 19 and _luhn(digits):
                yield m.span()


def detect(text: str) -> list[Span]:
    """Plain identifiers, sorted by start and kind."""
    out = [(s, 0, e) for s, e in _emails(text)]
    out += [
        (m.start(), 1, m.end())
        for m in _IP.finditer(text)
        if all(len(x) <= 3 and int(x or "0") <= 255 for x in (y.lstrip("0") for y in m[0].split(".")))
    ]
    out += [(s, 2, e) for s, e in _cards(text)]
    if "+" in text:
        out += [
            (m.start(), 3, m.end())
            for m in _PHONE.finditer(text)
            if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15
        ]
    return sorted(out)


# ---- transducers ---------------------------------------------------------------

#: Letters that look like an ASCII letter.
HOMOGLYPHS = {
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P",
    "Τ": "T", "Χ": "X", "ο": "o", "ν": "v", "ı": "i", "․": ".", "。": ".", "﹒": ".", "‐": "-", "‑": "-", "–": "-",
}
#: Digits in the languages of the corpus.
DIGIT_WORDS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6",
    "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7",
    "acht": "8", "neun": "9",
    "zéro": "0", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7",
    "ocho": "8", "nueve": "9",
}

Edit = tuple[int, int, str]  # start, end, replacement


class Mapped:
    """A text rewritten by edits, each output span known by its source span."""

    def __init__(self, source: str):
        self.text = source
        # output start, source start, output length, source length of each rewritten piece
        self.pieces: list[tuple[int, int, int, int]] = []

    def rewrite(self, edits: list[Edit]) -> None:
        """Apply non-overlapping edits, sorted by start, to the present text."""
        if not edits:
            return
        out: list[str] = []
        places: list[tuple[int, int, int, int]] = []
        read = written = 0
        for start, end, new in map(self._widened, edits):
            if start < read:
                continue
            out += [self.text[read:start], new]
            written += start - read
            places.append((written, start, len(new), end - start))
            written += len(new)
            read = end
        out.append(self.text[read:])
        self.pieces = self._composed(places)
        self.text = "".join(out)

    def _widened(self, edit: Edit) -> Edit:
        """An edit that covers the pieces it touches wholly: a piece can't be split."""
        start, end, new = edit
        for out, _, length, _ in self.pieces[max(bisect_right(self.pieces, (start, 1 << 60)) - 1, 0) :]:
            if out >= end:
                break
            if out < start < out + length:
                start, new = out, self.text[out:start] + new
            if out < end < out + length:
                end, new = out + length, new + self.text[end : out + length]
        return start, end, new

    def _composed(self, places: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
        """Earlier pieces moved to the new text, joined with the new ones by which they were rewritten again."""
        made = []
        for new_at, old_at, new_len, old_len in places:
            start, end = self.source(old_at, old_at + old_len)
            made.append((new_at, start, new_len, end - start))
        starts = [p[1] for p in places]
        for old_at, source_at, length, source_len in self.pieces:
            k = bisect_right(starts, old_at) - 1
            if k >= 0 and old_at < places[k][1] + places[k][3]:
                continue  # inside a newer piece
            shift = places[k][0] + places[k][2] - places[k][1] - places[k][3] if k >= 0 else 0
            made.append((old_at + shift, source_at, length, source_len))
        return sorted(made)

    def source(self, start: int, end: int) -> tuple[int, int]:
        """The source span of a span of the present text; a piece counts as a whole."""
        return self._one(start, False), self._one(end, True)

    def _one(self, at: int, is_end: bool) -> int:
        k = bisect_right(self.pieces, (at - is_end, 1 << 60)) - 1
        if k < 0:
            return at
        out, src, length, src_len = self.pieces[k]
        if at - is_end < out + length:
            return src + src_len if is_end else src
        return src + src_len + at - out - length

    def rewritten(self, start: int, end: int) -> bool:
        k = bisect_right(self.pieces, (start, 1 << 60)) - 1
        near = self.pieces[max(k, 0) : k + 2]
        return any(out < end and start < out + max(length, 1) for out, _, length, _ in near)


_FOLD = dict(HOMOGLYPHS)
_FOLD |= {chr(c): chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)}  # full-width forms
_FOLD |= {c: "" for c in "​‌‍⁠﻿­"}  # invisible
_ODD = re.compile("[" + "".join(map(re.escape, _FOLD)) + "]|[^\\W\\x00-\\u024F]")


def homoglyphs(text: str) -> list[Edit]:
    if text.isascii():
        return []
    edits = []
    for m in _ODD.finditer(text):
        c = m[0]
        new = _FOLD.get(c)
        if new is None:
            value = unicodedata.digit(c, None)
            if value is None:
                continue
            new = str(value)
        edits.append((m.start(), m.end(), new))
    return edits


_WORD = "|".join(sorted(DIGIT_WORDS, key=len, reverse=True))
#: Three or more digit words with nothing but blanks or hyphens between them; single digits may be mixed in.
_SPELLED = re.compile(rf"(?i)(?<!\w)(?:{_WORD})(?:[\x20-]+(?:{_WORD}|[0-9])(?!\w)){{2,}}(?!\w)")
_DIGIT_WORD = re.compile(rf"(?i){_WORD}|[0-9]")
_HAS_WORD = re.compile(rf"(?i)(?<!\w)(?:{_WORD})[\x20-]+(?:{_WORD}|[0-9])(?!\w)")


def spelled_digits(text: str) -> list[Edit]:
    if not _HAS_WORD.search(text):
        return []
    return [
        (m.start(), m.end(), "".join(DIGIT_WORDS.get(x.lower(), x) for x in _DIGIT_WORD.findall(m[0])))
        for m in _SPELLED.finditer(text)
    ]


_OPEN, _CLOSE = r"[\[({<]", r"[\])}>]"
_AT = rf"(?:\x20*{_OPEN}\x20*(?:at|@|arroba)\x20*{_CLOSE}\x20*|\x20+(?:at|arroba)\x20+|\x20*@\x20*)"
_DOT = rf"(?:\x20*{_OPEN}\x20*(?:dot|punkt|point|punto|\.)\x20*{_CLOSE}\x20*|\x20+(?:dot|punkt|point|punto)\x20+|\.)"
_BRACKETED = rf"\x20*{_OPEN}\x20*(?:at|@|arroba|dot|punkt|point|punto|\.)\x20*{_CLOSE}\x20*"
_LOCAL_PART = rf"[A-Za-z0-9_%+-]+(?:{_DOT}[A-Za-z0-9_%+-]+)*"
_DISGUISED = re.compile(rf"(?i){_LOCAL_PART}{_AT}[A-Za-z0-9-]+(?:{_DOT}[A-Za-z0-9-]+)+")
#: An @ or "at" that is disguised, or a dot that is, close to it: where to look for an address.
_SIGN = re.compile(
    rf"(?i){_OPEN}\x20*(?:at|@|arroba)\x20*{_CLOSE}|\x20(?:at|arroba)\x20+[A-Za-z0-9-]+(?={_DOT}[A-Za-z0-9-])"
    rf"|@\x20*[A-Za-z0-9-]+(?:\x20+(?:dot|punkt|point|punto)\x20|\x20*{_OPEN}\x20*(?:dot|punkt|point|punto|\.))"
)
_AT_ONE = re.compile(rf"(?i){_AT}")
_DOT_ONE = re.compile(rf"(?i){_DOT}")


def at_and_dot(text: str) -> list[Edit]:
    """Rewrite disguised signs of addresses; plain words "at" and "dot" stay.

    A blank-separated "at" counts only if a spelled or bracketed dot follows,
    since "look at example.com" is prose.
    """
    edits, done = [], 0
    for sign in _SIGN.finditer(text):
        if sign.start() < done:
            continue
        m = _DISGUISED.match(text, _name_start(text, sign.start(), done, not sign[0].startswith("@")))
        if not m or m.end() <= sign.start():
            continue
        whole = m[0]
        at = _AT_ONE.search(whole)
        dots = [d for d in _DOT_ONE.finditer(whole, at.end())]
        plain_at, plain_dots = at[0] == "@", all(d[0] == "." for d in dots)
        worded = at[0].strip().lower() in ("at", "arroba")
        if (plain_at and plain_dots and _BRACKET.search(whole) is None) or (worded and plain_dots):
            continue
        base = m.start()
        edits += [(base + d.start(), base + d.end(), ".") for d in _DOT_ONE.finditer(whole, 0, at.start()) if d[0] != "."]
        if not plain_at:
            edits.append((base + at.start(), base + at.end(), "@"))
        edits += [(base + d.start(), base + d.end(), ".") for d in dots if d[0] != "."]
        done = m.end()
    return sorted(edits)


_BRACKET = re.compile(rf"(?i){_BRACKETED}")
_DOT_WORDS = ("dot", "punkt", "point", "punto")
_PART = _LOCAL - {"."}


def _name_start(text: str, sign: int, low: int, spelled: bool) -> int:
    """Where the name before a sign starts: back over parts and the dots between them.

    A dot is plain, in brackets or, with ``spelled``, a word between blanks.
    """
    at = _back_over(text, sign, low, " ")
    while True:
        part = at
        while part > low and text[part - 1] in _PART:
            part -= 1
        if part == at:
            # a dot before which there is no name
            return at
        dot = _dot_before(text, part, low, spelled)
        if dot is None or dot == low or text[dot - 1] not in _PART:
            return part
        at = dot


def _back_over(text: str, at: int, low: int, signs: str) -> int:
    while at > low and text[at - 1] in signs:
        at -= 1
    return at


def _dot_before(text: str, at: int, low: int, spelled: bool) -> int | None:
    """Where the dot that ends at a place starts, blanks around it included."""
    if at > low and text[at - 1] == ".":
        return at - 1
    end = _back_over(text, at, low, " ")
    if end > low and text[end - 1] in "])}>":
        end = _back_over(text, end - 1, low, " ")
        word = next((w for w in (*_DOT_WORDS, ".") if text[max(low, end - len(w)) : end].lower() == w), None)
        start = _back_over(text, end - len(word), low, " ") if word else low
        if start > low and text[start - 1] in "[({<":
            return _back_over(text, start - 1, low, " ")
    elif spelled and end < at:
        word = next((w for w in _DOT_WORDS if text[max(low, end - len(w)) : end].lower() == w), None)
        start = _back_over(text, end - len(word), low, " ") if word else end
        if word and start < end - len(word):
            return start
    return None


_TRANSDUCERS = (homoglyphs, spelled_digits, at_and_dot)


def deobfuscate(text: str) -> Mapped:
    mapped = Mapped(text)
    for transducer in _TRANSDUCERS:
        mapped.rewrite(transducer(mapped.text))
    return mapped


def find(text: str | None) -> tuple[list[Span], list[Span]]:
    """Plain spans, and all spans, of one text (code points, end exclusive)."""
    text = text or ""
    base = detect(text)
    mapped = deobfuscate(text)
    if not mapped.pieces:
        return base, base
    known, extra = set(base), set()
    for start, kind, end in detect(mapped.text):
        if mapped.rewritten(start, end):
            s, e = mapped.source(start, end)
            if (s, kind, e) not in known:
                extra.add((s, kind, e))
    return base, sorted(known | extra)


# ---- frames --------------------------------------------------------------------

SPANS = "array<struct<start:bigint,kind:int,end:bigint>>"
_ARROW = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())]))


def find_pii(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Find personal data in whole texts: rows (key, base, spans).

    ``base`` holds plain identifiers, ``spans`` those and the disguised ones,
    as (start, kind, end) sorted by start and kind; kinds are numbered as in
    ``KINDS``. NULL and empty texts have none. Each row is read on its own: a
    NULL key or a repeated row gives a row of its own, an empty table an empty
    one, other columns are ignored.
    """
    key_type = next(f for f in docs.schema.fields if f.name == key).dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [find(x.as_py()) for x in batch.column(1)]
            columns = [
                pa.array([[{"start": s, "kind": k, "end": e} for s, k, e in pair[i]] for pair in found], _ARROW)
                for i in (0, 1)
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=[key, "base", "spans"])

    return docs.select(key, text).mapInArrow(scan, f"`{key}` {key_type}, base {SPANS}, spans {SPANS}")
