"""Identifiers against plain regular expressions, disguises, and offsets."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from cohortlane.llm import queries as q
from cohortlane.llm.pii import KINDS, Mapped, detect, find, find_pii


def luhn(d):
    return sum(sum(divmod(int(x) * (1 + i % 2), 10)) for i, x in enumerate(reversed(d))) % 10 == 0


def brute(text):
    text = text or ""
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [
        (m.start(), 1, m.end())
        for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text)
        if max(map(int, m[0].split("."))) <= 255
    ]
    out += [
        (m.start(), 2, m.end())
        for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text)
        if 12 <= len(digits(m)) <= 19 and luhn(digits(m))
    ]
    out += [
        (m.start(), 3, m.end())
        for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text)
        if 9 <= len(digits(m)) <= 15
    ]
    return sorted(out)


def test_base_of_the_whole_table(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = q.op10_pii(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        expected = brute(texts[r.doc_id])
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == x[1] for x in expected) for k in range(4))
        joined = ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in expected)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert set(joined.split(",")) <= set(r.spans.split(","))


def test_detectors_on_random_strings():
    rng = random.Random(5)
    for alphabet in ("ab.@-", "0123.", "01 -", "+12() .-", "a1.@+ -é"):
        for _ in range(3000):
            text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40)))
            assert detect(text) == brute(text)


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("write to jane.doe [at] mail [dot] example [dot] com now", [("email", "jane.doe [at] mail [dot] example [dot] com")]),
        ("é x jane at mail dot example dot com.", [("email", "jane at mail dot example dot com")]),
        ("jаne@mаil.cоm", [("email", "jаne@mаil.cоm")]),
        ("ip １９２.168.0.1 !", [("ip", "１９２.168.0.1")]),
        ("call +one two three four five six seven eight nine zero", [("phone", "+one two three four five six seven eight nine zero")]),
        ("card four one one one one one one one one one one one one one one one", [("card", "four one one one one one one one one one one one one one one one")]),
        ("jane(at)mail.example.com", [("email", "jane(at)mail.example.com")]),
        ("a​@b.c", [("email", "a​@b.c")]),
        ("look at example.com and at dot one", []),
        ("two or three of four, one at a time", []),
        ("plain@mail.com", []),
    ],
)
def test_disguises(text, expected):
    base, spans = find(text)
    assert base == brute(text)
    added = [(KINDS[k], text[s:e]) for s, k, e in spans if (s, k, e) not in set(base)]
    assert [x for x in added] == expected


AT_FORMS = ("@", " @ ", "[at]", " [at] ", " (at) ", "{ AT }", " <@> ", " at ", "   at   ", " arroba ", " " * 40 + "[at]" + " " * 40)
DOT_FORMS = (".", "[dot]", " [dot] ", " (dot) ", "[.]", " { punkt } ", " dot ", "  DOT  ", " punto ", " " * 30 + "[dot]" + " " * 30)


@pytest.mark.parametrize("at", AT_FORMS)
def test_whole_addresses(at):
    """Every form of the sign with every form of dot in name and domain, alone and in company."""
    for dot in DOT_FORMS:
        for name_dot in DOT_FORMS:
            for names, domains in ((("jane",), ("mail", "com")), (("jane", "q", "doe"), ("mail", "example", "org"))):
                address = name_dot.join(names) + at + dot.join(domains)
                disguised_at, disguised_dot = at != "@", dot != "."
                # blanks around a sign, or a word in its place, say little without a disguised dot
                if not disguised_dot and at.strip() in ("at", "arroba", "@"):
                    continue
                spelled = name_dot.strip().lower() in ("dot", "punto") and len(names) > 1
                if spelled and "@" in at and "<" not in at:
                    continue
                if not (disguised_at or disguised_dot or (name_dot != "." and len(names) > 1)):
                    continue
                if at == "@" and not disguised_dot:
                    continue  # a plain address follows the name's last part
                for before, after in (("", ""), ("é write to: ", ", please"), ("x" * 500 + "; ", "\n" + "y" * 500)):
                    text = before + address + after
                    base, spans = find(text)
                    added = [text[s:e] for s, k, e in spans if k == 0 and (s, k, e) not in set(base)]
                    assert added == [address], (text, added)


def test_spelled_dots_in_prose_stay():
    for text in ("he made a point at noon", "the dot at the end", "jane dot doe@mail.com", "a point at example.com"):
        base, spans = find(text)
        assert spans == base == brute(text)


def test_a_far_reaching_name():
    text = "see " + " [dot] ".join(["name"] * 200) + " [at] mail [dot] com"
    _, spans = find(text)
    assert [text[s:e] for s, _, e in spans] == [text[4:]]


@pytest.mark.parametrize("text", ["1" * 300_000, "0" * 300_000 + ".1.1.1", "+1" + "(" * 300_000, "at " * 100_000, "a@" * 100_000, " " * 300_000,
    "a [dot] " * 50_000 + "[at]", "a dot " * 50_000 + " at b dot c", "[at] " * 60_000, ("a" + " " * 3000 + "[at]") * 100])
def test_long_runs_are_cheap(text):
    base, _ = find(text)
    assert base == detect(text)


def test_offsets_survive_two_rewrites():
    mapped = Mapped("abcXXdefYYghi")
    mapped.rewrite([(3, 5, "1"), (8, 10, "234")])
    assert mapped.text == "abc1def234ghi"
    mapped.rewrite([(0, 1, ""), (7, 9, "z")])
    assert mapped.text == "bc1defz4ghi"
    assert mapped.source(2, 3) == (3, 5)
    assert mapped.source(3, 6) == (5, 8)
    assert mapped.source(8, 11) == (10, 13)


def test_edges(spark, documents):
    long = ("x" * 50 + " a@b.cd ") * 3000 + "a" * 200_000
    df = documents((1, None), (2, ""), (3, long), (4, "a@b.c"), (4, "a@b.c"), (None, "1.2.3.4")).withColumn("base", F.lit(1))
    rows = find_pii(df).collect()
    assert len(rows) == 6
    by = {r.doc_id: r for r in rows}
    assert not by[1].spans and not by[2].spans
    assert len(by[3].base) == 3000
    assert [tuple(s) for s in by[None].spans] == [(0, 1, 7)]
    assert find_pii(df.limit(0)).count() == 0
