"""A small sandboxed template language, compiled to Python closures.

Text is copied; ``{{ expression }}`` prints; ``{% if %} / {% elif %} / {% else %} /
{% endif %}``, ``{% for x in xs %} / {% endfor %}``, ``{% set x = expression %}`` and
``{% generation %} / {% endgeneration %}`` steer; ``{# ... #}`` is a comment; a ``-``
inside a tag trims the white space beside it. Expressions know literals, names,
``a.b`` and ``a['b']`` on mappings, filters, arithmetic ``+`` and ``~``, comparisons,
``in``, ``and / or / not``, ``is defined`` and ``x if c else y``.

Sandbox: there are no calls and no Python attributes. ``a.b`` looks up the key ``b``
of a mapping, filters come from a fixed table, and loops run over given data only.

A template is parsed to a tree, constant parts are folded (pure expressions of
constants, branches with known conditions, neighbouring text), and the tree
becomes closures. Rendering yields ``(text, in_generation)`` pieces one by one, so
a conversation of any length needs the memory of one turn.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, replace
from typing import Any


class TemplateError(ValueError):
    """A template that can't be parsed, or that asks for what the sandbox has not."""


# ---- tree -------------------------------------------------------------------


@dataclass(frozen=True)
class Const:
    value: Any


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Item:
    base: Any
    key: Any


@dataclass(frozen=True)
class Filter:
    base: Any
    name: str


@dataclass(frozen=True)
class Unary:
    op: str
    value: Any


@dataclass(frozen=True)
class Binary:
    op: str
    left: Any
    right: Any


@dataclass(frozen=True)
class Choice:
    test: Any
    yes: Any
    no: Any


@dataclass(frozen=True)
class Print:
    value: Any


@dataclass(frozen=True)
class If:
    test: Any
    yes: tuple
    no: tuple


@dataclass(frozen=True)
class For:
    name: str
    over: Any
    body: tuple


@dataclass(frozen=True)
class Assign:
    name: str
    value: Any


@dataclass(frozen=True)
class Generation:
    body: tuple


# ---- parsing ----------------------------------------------------------------

_TAG = re.compile(r"(\{\{-?.*?-?\}\}|\{%-?.*?-?%\}|\{#-?.*?-?#\})", re.DOTALL)
_TOKEN = re.compile(
    r"\s*(?:(?P<number>\d+)|(?P<string>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")"
    r"|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|<=|>=|[<>+~|.()\[\]]))"
)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}
_WORDS = {"and", "or", "not", "in", "is", "if", "else"}
_CONSTANTS = {"true": True, "false": False, "none": None}


class _Expression:
    """Recursive descent over the tokens of one expression."""

    def __init__(self, source: str):
        self.tokens: list[tuple[str, str]] = []
        at, source = 0, source.strip()
        while at < len(source):
            m = _TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"can't read {source[at:]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def peek(self) -> str | None:
        if self.at == len(self.tokens) or self.tokens[self.at][0] == "string":
            return None
        return self.tokens[self.at][1]

    def take(self, *options: str) -> str | None:
        if (word := self.peek()) in options and word is not None:
            self.at += 1
            return word
        return None

    def need(self, kind: str) -> str:
        if self.at == len(self.tokens) or kind not in self.tokens[self.at]:
            raise TemplateError(f"expected {kind}")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def whole(self):
        node = self.choice()
        if self.at != len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return node

    def choice(self):
        value = self.either()
        if self.take("if"):
            test = self.either()
            self.need("else")
            return Choice(test, value, self.choice())
        return value

    def either(self):
        node = self.both()
        while self.take("or"):
            node = Binary("or", node, self.both())
        return node

    def both(self):
        node = self.negated()
        while self.take("and"):
            node = Binary("and", node, self.negated())
        return node

    def negated(self):
        return Unary("not", self.negated()) if self.take("not") else self.compared()

    def compared(self):
        node = self.sum()
        while op := self.take("==", "!=", "<", ">", "<=", ">=", "in", "not", "is"):
            if op == "not":
                self.need("in")
                node = Unary("not", Binary("in", node, self.sum()))
            elif op == "is":
                test = Unary("not", Unary("defined", node)) if self.take("not") else Unary("defined", node)
                self.need("defined")
                node = test
            else:
                node = Binary(op, node, self.sum())
        return node

    def sum(self):
        node = self.filtered()
        while op := self.take("+", "~"):
            node = Binary(op, node, self.filtered())
        return node

    def filtered(self):
        node = self.postfix()
        while self.take("|"):
            name = self.need("name")
            if name not in FILTERS:
                raise TemplateError(f"no filter {name!r}")
            node = Filter(node, name)
        return node

    def postfix(self):
        node = self.atom()
        while op := self.take(".", "["):
            if op == ".":
                key = self.need("name")
                if key.startswith("_"):
                    raise TemplateError(f"no access to {key!r}")
                node = Item(node, Const(key))
            else:
                node = Item(node, self.choice())
                self.need("]")
        return node

    def atom(self):
        if self.at == len(self.tokens):
            raise TemplateError("an expression ends early")
        kind, word = self.tokens[self.at]
        if kind == "name" and word in _WORDS:
            raise TemplateError(f"unexpected {word!r}")
        self.at += 1
        if kind == "number":
            return Const(int(word))
        if kind == "string":
            return Const(re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), word[1:-1], flags=re.DOTALL))
        if kind == "name":
            return Const(_CONSTANTS[word.lower()]) if word.lower() in _CONSTANTS else Name(word)
        if word == "(":
            node = self.choice()
            self.need(")")
            return node
        raise TemplateError(f"unexpected {word!r}")


class _Pieces:
    """The template as text and tags, with white space trimmed."""

    def __init__(self, source: str):
        parts = _TAG.split(source)
        self.items: list[tuple[str, str]] = []
        for i, part in enumerate(parts):
            if i % 2:
                self.items.append((part[:2], part[2:-2].strip("-").strip()))
            else:
                if i and parts[i - 1][-3] == "-":
                    part = part.lstrip()
                if i + 1 < len(parts) and parts[i + 1][2] == "-":
                    part = part.rstrip()
                if "{%" in part or "{{" in part:
                    raise TemplateError("a tag isn't closed")
                self.items.append(("text", part))
        self.at = 0

    def block(self, *ends: str) -> tuple[tuple, str]:
        """Nodes up to one of the tags ``ends``; that tag."""
        out: list = []
        while self.at < len(self.items):
            kind, body = self.items[self.at]
            self.at += 1
            if kind == "text":
                out += [Print(Const(body))] if body else []
            elif kind == "{{":
                out.append(Print(_Expression(body).whole()))
            elif kind == "{%":
                word, _, rest = body.partition(" ")
                if word in ends:
                    return tuple(out), body
                out.append(self.statement(word, rest))
        if ends:
            raise TemplateError(f"no {' or '.join(ends)}")
        return tuple(out), ""

    def statement(self, word: str, rest: str):
        if word == "if":
            return self.branch(rest)
        if word == "for":
            if not (m := re.fullmatch(r"\s*([A-Za-z]\w*)\s+in\s+(.+)", rest, re.DOTALL)):
                raise TemplateError(f"can't read 'for {rest}'")
            body, _ = self.block("endfor")
            return For(m[1], _Expression(m[2]).whole(), body)
        if word == "set":
            name, equals, value = rest.partition("=")
            if not equals or not re.fullmatch(r"[A-Za-z]\w*", name.strip()):
                raise TemplateError(f"can't read 'set {rest}'")
            return Assign(name.strip(), _Expression(value).whole())
        if word == "generation":
            return Generation(self.block("endgeneration")[0])
        raise TemplateError(f"no statement {word!r}")

    def branch(self, test: str) -> If:
        yes, end = self.block("elif", "else", "endif")
        if end.startswith("elif"):
            no: tuple = (self.branch(end[4:]),)
        else:
            no = self.block("endif")[0] if end == "else" else ()
        return If(_Expression(test).whole(), yes, no)


def parse(source: str) -> tuple:
    return _Pieces(source).block()[0]


# ---- folding ----------------------------------------------------------------


def _folded(node):
    """An expression with its constant parts computed."""
    if isinstance(node, (Const, Name)):
        return node
    # what a constant test leaves out is not looked at
    if isinstance(node, Choice) and isinstance(test := _folded(node.test), Const):
        return _folded(node.yes if test.value else node.no)
    if getattr(node, "op", "") in ("and", "or") and isinstance(left := _folded(node.left), Const):
        return left if bool(left.value) == (node.op == "or") else _folded(node.right)
    parts = {k: _folded(v) for k, v in vars(node).items() if not isinstance(v, str)}
    node = replace(node, **parts)
    if all(isinstance(v, Const) for v in parts.values()):
        return Const(_expression(node)({}))
    return node


def fold(nodes: Iterable) -> tuple:
    """A tree without constant work: what it prints stays the same."""
    out: list = []
    for node in nodes:
        if isinstance(node, Print):
            value = _folded(node.value)
            made = [Print(Const(_text(value.value)) if isinstance(value, Const) else value)]
        elif isinstance(node, If):
            test = _folded(node.test)
            if isinstance(test, Const):
                made = list(fold(node.yes if test.value else node.no))
            else:
                made = [If(test, fold(node.yes), fold(node.no))]
        elif isinstance(node, For):
            made = [For(node.name, _folded(node.over), fold(node.body))]
        elif isinstance(node, Assign):
            made = [Assign(node.name, _folded(node.value))]
        else:
            made = [Generation(fold(node.body))]
        for x in made:
            constant = isinstance(x, Print) and isinstance(x.value, Const)
            last = out[-1] if out else None
            if constant and not x.value.value:
                continue
            if constant and isinstance(last, Print) and isinstance(last.value, Const):
                out[-1] = Print(Const(last.value.value + x.value.value))
            else:
                out.append(x)
    return tuple(out)


# ---- closures ---------------------------------------------------------------

Piece = tuple[str, bool]


def _text(value) -> str:
    return "" if value is None else value if isinstance(value, str) else str(value)


def _item(base, key):
    if isinstance(base, dict):
        return base.get(key)
    if isinstance(base, (list, tuple)) and isinstance(key, int) and -len(base) <= key < len(base):
        return base[key]
    return None


_BINARY: dict[str, Callable] = {
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "<": lambda a, b: a < b,
    ">": lambda a, b: a > b,
    "<=": lambda a, b: a <= b,
    ">=": lambda a, b: a >= b,
    "in": lambda a, b: a in (b or ()),
    "+": lambda a, b: a + b,
    "~": lambda a, b: _text(a) + _text(b),
}


def _expression(node) -> Callable[[dict], Any]:
    if isinstance(node, Const):
        return lambda scope: node.value
    if isinstance(node, Name):
        return lambda scope: scope.get(node.name)
    if isinstance(node, Item):
        base, key = _expression(node.base), _expression(node.key)
        return lambda scope: _item(base(scope), key(scope))
    if isinstance(node, Filter):
        base, use = _expression(node.base), FILTERS[node.name]
        return lambda scope: use(base(scope))
    if isinstance(node, Unary):
        value = _expression(node.value)
        if node.op == "defined":
            return lambda scope: value(scope) is not None
        return lambda scope: not value(scope)
    if isinstance(node, Choice):
        test, yes, no = map(_expression, (node.test, node.yes, node.no))
        return lambda scope: yes(scope) if test(scope) else no(scope)
    left, right = _expression(node.left), _expression(node.right)
    if node.op == "and":
        return lambda scope: left(scope) and right(scope)
    if node.op == "or":
        return lambda scope: left(scope) or right(scope)
    use = _BINARY[node.op]

    def operate(scope: dict):
        a, b = left(scope), right(scope)
        try:
            return use(a, b)
        except TypeError:
            raise TemplateError(f"can't apply {node.op!r} to {a!r} and {b!r}") from None

    return operate


def _ahead(values: Iterable) -> Iterator[tuple[int, Any, bool]]:
    """Place, value, whether it is the last; reads one value ahead."""
    values, i = iter(values), 0
    for held in values:
        for value in values:
            yield i, held, False
            held, i = value, i + 1
        yield i, held, True


def _block(nodes: tuple, masked: bool) -> Callable[[dict], Iterator[Piece]]:
    steps = [_statement(node, masked) for node in nodes]

    def run(scope: dict) -> Iterator[Piece]:
        for step in steps:
            yield from step(scope)

    return run


def _statement(node, masked: bool) -> Callable[[dict], Iterable[Piece]]:
    if isinstance(node, Print):
        if isinstance(node.value, Const):
            piece = ((node.value.value, masked),)
            return lambda scope: piece
        value = _expression(node.value)
        return lambda scope: ((_text(value(scope)), masked),)
    if isinstance(node, Generation):
        return _block(node.body, True)
    if isinstance(node, If):
        test, yes, no = _expression(node.test), _block(node.yes, masked), _block(node.no, masked)
        return lambda scope: yes(scope) if test(scope) else no(scope)
    if isinstance(node, Assign):
        value = _expression(node.value)

        def put(scope: dict) -> tuple:
            scope[node.name] = value(scope)
            return ()

        return put
    over, body = _expression(node.over), _block(node.body, masked)

    def loop(scope: dict) -> Iterator[Piece]:
        # assignments inside a loop end with its turn
        for i, value, last in _ahead(over(scope) or ()):
            place = {"index": i + 1, "index0": i, "first": i == 0, "last": last}
            yield from body({**scope, node.name: value, "loop": place})

    return loop


def compile_template(source: str) -> Callable[[dict], Iterator[Piece]]:
    """A closure from variables to the rendered pieces, each with its generation mark."""
    return _block(fold(parse(source)), False)


# ---- control strings ----------------------------------------------------------

#: Strings that steer models or mark turns; inside texts they are escaped.
CONTROLS = (
    "<s>",
    "</s>",
    "[INST]",
    "[/INST]",
    "<<SYS>>",
    "<</SYS>>",
    "<|im_start|>",
    "<|im_sep|>",
    "<|im_end|>",
    "<|endoftext|>",
)
_BREAK = re.compile("|".join(rf"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in CONTROLS))


def escape(text) -> str:
    """Double every backslash, and break control strings by one after their first character."""
    text = _text(text).replace("\\", "\\\\")
    return _BREAK.sub(lambda m: m[0] + "\\", text) if "<" in text or "[" in text else text


def unescape(text: str) -> str:
    """The text that ``escape`` was given: of each backslash and what follows, only the latter stays."""
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL) if "\\" in text else text


FILTERS: dict[str, Callable] = {
    "escape_controls": escape,
    "trim": lambda x: _text(x).strip(),
    "lower": lambda x: _text(x).lower(),
    "upper": lambda x: _text(x).upper(),
    "length": lambda x: len(x or ()),
}
