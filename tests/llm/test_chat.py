"""Templates, escaping and the round trip of conversations."""

import hashlib

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cohortlane.llm import chat
from cohortlane.llm.templates import (
    CONTROLS,
    Const,
    Print,
    TemplateError,
    compile_template,
    escape,
    fold,
    parse,
    unescape,
)


def render(source, **scope):
    return "".join(text for text, _ in compile_template(source)(scope))


@pytest.mark.parametrize(
    ("source", "expected"),
    [
        ("a{# no #}b", "ab"),
        ("{{ 1 + 2 }}{{ 'x' ~ 3 }}", "3x3"),
        ("{% for m in ms %}{{ loop.index }}{{ m.a }}{% if not loop.last %},{% endif %}{% endfor %}", "1p,2q"),
        ("{% if x == 'y' %}1{% elif x is defined %}2{% else %}3{% endif %}", "2"),
        ("{% set k = x | upper %}{{ k }} {{ nothing }}|", "Z |"),
        ("  {%- if true -%}  t  {%- endif -%}  ", "t"),
        ("{{ 'yes' if 'z' in x and not none else 'no' }}", "yes"),
        ("{{ ms[1]['a'] }}{{ ms[7].a }}", "q"),
    ],
)
def test_language(source, expected):
    assert render(source, ms=[{"a": "p"}, {"a": "q"}], x="z") == expected


@pytest.mark.parametrize("source", ["{{ x.__class__ }}", "{{ x | eval }}", "{{ f(1) }}", "{% if x %}", "{% import os %}", "{{ x"])
def test_sandbox(source):
    with pytest.raises(TemplateError):
        compile_template(source)
    assert render("{{ x.upper }}", x="no attributes") == ""


def test_folding():
    tree = fold(parse("a{{ 'b' ~ 'c' | upper }}{% if 1 == 2 %}{{ x }}{% else %}d{% endif %}"))
    assert tree == (Print(Const("abCd")),)


def test_generation_marks():
    pieces = list(compile_template("u{% generation %}{{ x }}!{% endgeneration %}v")({"x": "y"}))
    assert pieces == [("u", False), ("y", True), ("!", True), ("v", False)]


@given(st.lists(st.sampled_from([*CONTROLS, "\\", "<", "[", "|", "s>", "é", "\n"])).map("".join))
def test_escape_is_reversible(text):
    safe = escape(text)
    assert unescape(safe) == text
    assert not any(c in safe for c in CONTROLS)


def test_round_trip_and_edges(spark):
    rows = [
        (1, 1, "assistant", "a\\</s>"),
        (1, 0, "user", None),
        (1, 1, "assistant", "a\\</s>"),
        (2, 0, "as\nsistant<|im_sep|>", "x<|im_end|>\n" * 3000),
        (None, None, None, ""),
        (3, 0, "assistant", ""),
        (3, 1, "assistant", "😀"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("loss", F.lit(1))
    got = {r.conv_id: r for r in chat.read_back(df).collect()}
    assert set(got) == {1, 2, 3, None}
    for conv_id in got:
        own = sorted(((t or -1, r or "", x or "") for c, t, r, x in rows if c == conv_id))
        learned = "".join(x for _, r, x in own if r == "assistant")
        r = got[conv_id]
        assert r.n_turns == len(own)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for _, a, b in own).encode()).hexdigest()
        assert (r.loss_chars, r.loss_sha256) == (len(learned), hashlib.sha256(learned.encode()).hexdigest())
    parts = chat.format_conversations(df).orderBy("conv_id", "part").collect()
    for conv_id in got:
        assert sum(len(p.formatted) for p in parts if p.conv_id == conv_id) == got[conv_id].formatted_chars
    assert chat.read_back(df.limit(0)).count() == 0


def test_dead_branches_are_not_folded():
    from cohortlane.llm.templates import TemplateError

    def render(source, **scope):
        return "".join(text for text, _ in compile_template(source)(scope))

    assert render("a{% if false %}{{ 1 + 'a' }}{% endif %}b") == "ab"
    assert render("{% if true %}x{% else %}{{ 1 + 'a' }}{% endif %}") == "x"
    assert render("{{ 'x' if true else 1 + 'a' }}{{ false and 1 + 'a' }}{{ true or 1 + 'a' }}") == "xFalseTrue"
    with pytest.raises(TemplateError):
        compile_template("{% if x %}{{ 1 + 'a' }}{% endif %}")
    with pytest.raises(TemplateError):
        render("{{ x + 1 }}", x="a")
    with pytest.raises(TemplateError):
        render("{{ x < 'b' }}", x=1)
