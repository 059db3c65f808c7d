"""Line rules against plain Python; edge rows."""

import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from cohortlane.llm import queries as q
from cohortlane.llm.quality_rules import LineRules, clean_lines, line_fails

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def figures(text):
    text = text or ""
    words = WORD.findall(text)
    at = defaultdict(list)
    for i in range(len(words) - 4):
        at[tuple(words[i : i + 5])].append(i)
    repeated = {i + k for places in at.values() if len(places) > 1 for i in places for k in range(5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (
        len(words),
        sum(map(len, words)),
        sum(c in "#*$%&|<>" for c in text),
        len(lines) - len(set(lines)),
        len(repeated),
        len(words) < 10 or 100 * len(repeated) > 20 * len(words),
    )


TEXTS = [
    None,
    "",
    " \n\t\n",
    "one two three four five six seven eight nine ten",
    "a b c d e a b c d e",
    "a a a a a a a a a a a a",
    "x y z\nx y z\n\nx y z \n" + "w " * 30,
    "# * $ % & | < > é😀 ​word",
    "\x1ca\x0bb\x85c d",
    "the same five words again and " * 4000,
    "\n".join(f"line {i} says something of its own." for i in range(300)) + "\nhome\nMENU\n a | b | c | d \nclick here now",
]


def test_base_figures(documents):
    df = documents(*enumerate(TEXTS), (4, TEXTS[4]), (None, "a")).withColumn("n_words", F.lit("clash")).withColumn("_q_words", F.lit(1))
    rows = clean_lines(df).collect()
    assert len(rows) == len(TEXTS) + 2
    for r in rows:
        text = TEXTS[r.doc_id] if r.doc_id is not None else "a"
        got = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
        assert got == figures(text)
        assert not (r.base_failed and r.kept)
    assert clean_lines(df.limit(0)).count() == 0


def test_whole_table(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in q.op7_line_rules(spark, sf_dir).collect():
        got = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
        assert got == figures(texts[r.doc_id])


@pytest.mark.parametrize(
    ("line", "fails"),
    [
        ("A plain sentence, with commas; and more.", False),
        ("Yes!", False),
        ("50% of A & B", False),
        ("BUY!! NOW!! CHEAP!! OFFERS!!", True),
        ("word*** other&&& third###", True),
        ("home | about | news | login", True),
        ("Skip to content", True),
        ("All rights reserved 2020.", True),
        ("Startseite", True),
        (" IMPRESSUM ", True),
        ("Datenschutz", True),
        ("Alle Rechte vorbehalten.", True),
        ("Accueil", True),
        ("Tous droits réservés", True),
        ("Mentions légales | Contact", True),
        ("Inicio", True),
        ("Todos los derechos reservados", True),
        ("Haga clic aquí", True),
        ("He told me that you have to click here and there a lot until the thing works as it should do.", False),
        ("Der Datenschutz ist ein Thema.", False),
        ("", False),
    ],
)
def test_lines(spark, line, fails):
    assert spark.range(1).select(line_fails(F.lit(line))).first()[0] is fails


def test_lines_go_first_and_then_documents(documents):
    good = "This sentence is quite fine and it has a number of words.\n"
    rows = {r.doc_id: r for r in clean_lines(documents((1, good + "menu\nhome"), (2, good + "BAD!! " * 40))).collect()}
    assert rows[1].cleaned == good.rstrip("\n") and rows[1].kept and rows[1].n_failed_lines == 2
    assert not rows[2].kept and rows[2].lost_chars == 200
    loose = clean_lines(documents((1, good + "BAD!! x1!! x2!! x3!! " * 3)), LineRules(max_lost_percent=100)).first()
    assert loose.kept == (not loose.base_failed)


def test_menus(documents):
    """Four short lines in a row without a sign at their ends, in any language."""
    prose = "Ein Satz, der länger ist und mit einem Punkt endet.\n"
    cases = {
        1: (prose + "Produkte\nPreise\nHilfe\nÜber die Firma\n" + prose, 4),
        2: (prose + "Produits\nTarifs\nAide\n" + prose, 0),
        3: (prose + "uno\ndos\ntres\n\ncuatro\ncinco\nseis\n" + prose, 0),
        4: ("a\nb b\nc c c\nd d d d\ne\nf\ng\nh.", 0),
        5: ("a\nb b\nc c c\nd d d\ne\nf\ng\nh.", 7),
        6: ("a\nb\nc\nd \n", 4),
        7: ("a,\nb!\nc:\nd)", 0),
    }
    rows = {r.doc_id: r for r in clean_lines(documents(*((i, t) for i, (t, _) in cases.items()))).collect()}
    assert {i: r.n_failed_lines for i, r in rows.items()} == {i: n for i, (_, n) in cases.items()}
    assert rows[1].cleaned == prose + prose


def test_native(spark, sf_dir):
    plan = q.op7_line_rules(spark, sf_dir)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
