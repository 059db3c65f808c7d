"""Line-first cleaning by fixed rules, with column expressions only.

Every line is judged on its own (punctuation, navigation, boilerplate), failing
lines go, and a document that loses too much of its text goes as a whole. No
shuffle is needed: all figures of a document come from its own row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlane.llm.frames import let, words

SYMBOLS = "#*$%&|<>"
#: Characters that fill a line of junk but are rare in prose.
NOISE = "!#*$%&|<>~^"
SEPARATORS = "|»›•"

#: Phrases of page furniture in the languages of the corpus, lower case; a short
#: line holding one is boilerplate.
BOILERPLATE = (
    "all rights reserved", "privacy policy", "terms of service", "terms of use", "cookie policy", "accept cookies",
    "enable javascript", "lorem ipsum", "click here", "subscribe to our newsletter",
    "alle rechte vorbehalten", "allgemeine geschäftsbedingungen", "cookies akzeptieren", "javascript aktivieren",
    "hier klicken", "newsletter abonnieren",
    "tous droits réservés", "politique de confidentialité", "mentions légales", "accepter les cookies",
    "cliquez ici", "abonnez-vous à notre",
    "todos los derechos reservados", "política de privacidad", "aviso legal", "aceptar cookies", "haga clic aquí",
    "suscríbase a nuestro",
)

#: Lines that consist of nothing but one of these are navigation.
NAVIGATION = (
    "home", "menu", "search", "login", "log in", "sign in", "sign up", "register", "next", "previous", "back to top",
    "skip to content", "read more", "share", "contact us", "about us",
    "startseite", "suche", "anmelden", "registrieren", "weiter", "zurück", "nach oben", "zum inhalt springen",
    "mehr lesen", "teilen", "kontakt", "über uns", "impressum", "datenschutz",
    "accueil", "rechercher", "connexion", "s'inscrire", "suivant", "précédent", "haut de page", "aller au contenu",
    "lire la suite", "partager", "contactez-nous", "à propos",
    "inicio", "buscar", "iniciar sesión", "registrarse", "siguiente", "anterior", "volver arriba", "ir al contenido",
    "leer más", "compartir", "contacto", "sobre nosotros",
)

#: Signs at the end of a line that is part of a text.
ENDS = ".!?:;,…)\"”»"


@dataclass(frozen=True)
class LineRules:
    """``noise_percent``: a line fails with more noise among its non-blank
    characters, if it has at least ``least_noise`` of it.
    ``least_separators``: so many separators make a line navigation if there is
    one for every ``words_per_separator`` words. ``boilerplate_words``: a line of
    more words is prose, whatever phrase it holds. ``menu_lines``: so many lines in
    a row of at most ``menu_words`` words without a sign at the end are a menu.
    ``max_lost_percent``: a document that loses more of its non-blank characters
    is rejected.
    """

    noise_percent: int = 15
    least_noise: int = 3
    least_separators: int = 3
    words_per_separator: int = 4
    boilerplate_words: int = 15
    menu_lines: int = 4
    menu_words: int = 3
    max_lost_percent: int = 40


def _count(text: Column, characters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, characters, ""))


def _solid(text: Column) -> Column:
    """Characters that are not white space."""
    return F.length(F.translate(text, " \t\n\x0b\f\r", ""))


def line_fails(line: Column, rules: LineRules = LineRules()) -> Column:
    """True for a line that breaks a punctuation, navigation or boilerplate rule."""
    noise, separators = _count(line, NOISE), _count(line, SEPARATORS)
    low = F.lower(line)
    return (
        ((noise >= rules.least_noise) & (noise * 100 > _solid(line) * rules.noise_percent))
        | (
            (separators >= rules.least_separators)
            & (separators * rules.words_per_separator >= F.size(words(line)))
        )
        | F.trim(low).isin(*NAVIGATION)
        | (low.rlike("|".join(BOILERPLATE)) & (F.size(words(line)) <= rules.boilerplate_words))
    )


def menu_like(line: Column, rules: LineRules = LineRules()) -> Column:
    """True for a short line that ends like an item of a menu."""
    return F.size(words(line)).between(1, rules.menu_words) & ~F.rtrim(line).rlike(f"[{ENDS}]$")


def failing(lines: Column, rules: LineRules = LineRules()) -> Column:
    """For each line of a text: whether it fails by itself or stands in a menu."""
    length = rules.menu_lines

    def in_menu(like: Column, i: Column) -> Column:
        out = F.lit(False)
        for first in range(length):
            whole = F.lit(True)
            for k in range(length):
                whole = whole & F.coalesce(F.get(like, i + (k - first)), F.lit(False))
            out = out | whole
        return out

    return let(
        F.transform(lines, lambda line: menu_like(line, rules)),
        lambda like: F.transform(
            lines, lambda line, i: line_fails(line, rules) | (F.get(like, i) & in_menu(like, i))
        ),
    )


def _repeated_words(hashes: Column) -> Column:
    """Words inside five-word windows that occur twice or more.

    Equal windows are neighbours once (hash, place) pairs are sorted; the words
    covered follow from the sorted places.
    """

    def covered(pairs: Column) -> Column:
        def twin(pair, i):
            return F.coalesce(pair["h"] == F.get(pairs, i - 1)["h"], F.lit(False)) | F.coalesce(
                pair["h"] == F.get(pairs, i + 1)["h"], F.lit(False)
            )

        places = F.sort_array(F.transform(F.filter(pairs, twin), lambda pair: pair["i"]))
        return let(
            places,
            lambda at: F.aggregate(
                F.transform(at, lambda x, i: F.least(F.lit(5), F.coalesce(F.get(at, i + 1) - x, F.lit(5)))),
                F.lit(0).cast("long"),
                lambda total, x: total + x,
            ),
        )

    pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(
        let(pairs, covered)
    )


def clean_lines(docs: DataFrame, rules: LineRules = LineRules(), text: str = "text") -> DataFrame:
    """Judge documents line by line.

    Adds ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``,
    ``n_repeat_words``, ``base_failed``, ``n_lines``, ``n_failed_lines``,
    ``lost_chars``, ``cleaned`` (the text without failing lines) and ``kept``.
    All other columns pass through; columns with these names are replaced.

    NULL and empty texts have no words and fail (fewer than ten words). Rows
    are judged one by one, so repeated rows get equal results, an empty table
    gives an empty one, and a text of any length is judged whole.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    made = (
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        "n_lines", "n_failed_lines", "lost_chars", "cleaned", "kept",
    )
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in made and not c.startswith("_q_")]
    split = docs.select(
        *rest,
        words(F.col(text)).alias("_q_words"),
        F.split(body, "\n", -1).alias("_q_lines"),
    )
    w = F.col("_q_words")
    windows = F.when(
        F.size(w) >= 5,
        F.transform(F.sequence(F.lit(0), F.size(w) - 5), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(5)])),
    ).otherwise(F.array().cast("array<bigint>"))
    solid = F.filter(F.col("_q_lines"), lambda line: line.rlike("[^\\x20\\x09-\\x0D]"))
    measured = split.select(
        *rest,
        F.size(w).cast("long").alias("n_words"),
        windows.alias("_q_windows"),
        solid.alias("_q_solid"),
        failing(F.col("_q_lines"), rules).alias("_q_fails"),
        F.col("_q_lines"),
    )
    failed_lines = F.filter("_q_lines", lambda line, i: F.get("_q_fails", i))
    lost = F.aggregate(
        F.transform(failed_lines, _solid), F.lit(0).cast("long"), lambda total, x: total + x
    )
    counted = measured.select(
        *rest,
        "n_words",
        _solid(body).cast("long").alias("word_chars"),
        _count(body, SYMBOLS).cast("long").alias("n_symbols"),
        (F.size("_q_solid") - F.size(F.array_distinct("_q_solid"))).cast("long").alias("n_dup_lines"),
        _repeated_words(F.col("_q_windows")).alias("n_repeat_words"),
        F.size("_q_solid").cast("long").alias("n_lines"),
        F.size(F.filter("_q_fails", lambda x: x)).cast("long").alias("n_failed_lines"),
        lost.alias("lost_chars"),
        F.concat_ws("\n", F.filter("_q_lines", lambda line, i: ~F.get("_q_fails", i))).alias("cleaned"),
    )
    failed = (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)
    return counted.withColumn("base_failed", failed).withColumn(
        "kept", ~F.col("base_failed") & (F.col("lost_chars") * 100 <= F.col("word_chars") * rules.max_lost_percent)
    )
