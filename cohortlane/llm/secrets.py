"""Secrets in texts: fixed patterns plus a battery of randomness tests, with column expressions only.

Candidate strings are tested for what a key has and a word has not: symbols
spread evenly over the alphabet of the inferred encoding and over its capitals,
small letters and other signs (chi-squared, twice), as many runs above and below
the alphabet's middle as chance gives, and no correlation between neighbours.
The four p-values are combined by Fisher's method. Text in base64 is text: a
string whose bytes are printable has no encoding to test.

A string is reported if it looks more random than ordinary strings do. Those
are made of words, joined as paths, slugs and identifiers are: the words of the
corpus itself, from all over each text, and a short list of common ones. Within
each encoding and length band, since the tests gain power with length, a
candidate's p-value is the share of ordinary strings that look as random, and
Benjamini-Hochberg bounds the share of ordinary strings among those reported.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlane.llm.frames import let, prefix_sums
from cohortlane.sources.sinks import stage

#: Base patterns: kind, pattern, group whose length counts, least length.
ASSIGN = (
    "(?i)(password|passwd|secret|token|api_?key)(?-i)[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
BASE = (
    ("assign", ASSIGN, 2, 12),
    ("access", "AKIA[A-Z0-9]+", 0, 18),
    # maximal runs; shorter ones could not be kept
    ("hex", "[0-9a-f]{16,}", 0, 16),
)
KINDS = ("assign", "access", "hex", "random")

#: Encodings in the order in which they are tried: name, shape, alphabet.
ENCODINGS = (
    ("hex", "^([0-9a-f]+|[0-9A-F]+)$", "0123456789abcdef"),
    ("base32", "^[A-Z2-7]+=*$", string.ascii_uppercase + "234567"),
    ("base36", "^([a-z0-9]+|[A-Z0-9]+)$", string.digits + string.ascii_lowercase),
    ("base64", "^[A-Za-z0-9+/]+=*$", string.ascii_uppercase + string.ascii_lowercase + string.digits + "+/"),
    ("base64url", "^[A-Za-z0-9_-]+=*$", string.ascii_uppercase + string.ascii_lowercase + string.digits + "-_"),
)
ONE_CASE = ("hex", "base36")
#: Base64 of printable ASCII: the bits that say so leave these symbols at three of four places.
PRINTABLE = (
    "^([I-Za-f][C-HS-Xi-ny-z0-3][ABEFIJMNQRUVYZcdghklopstwx014589][A-Za-z0-9+/_-]){4,}"
    "([I-Za-f][A-Za-z0-9+/_-]{0,2})?=*$"
)
#: p-values are counted by the integer part of -PER_E * ln(p), up to LAST_BIN.
PER_E, LAST_BIN = 20, 800
#: As many strings of the corpus weigh as much as the common ones.
PRIOR = 200


#: Common words of paths, slugs and identifiers.
COMMON = (
    "admin api app archive auth base build bundle cache client cloud cluster code common config container content core "
    "create data database default deploy device dist docs document domain download element email engine error event "
    "example export factory field file filter folder frame gateway global group guide handler header home host html http "
    "image import index info install integration internal java javascript job json kernel kubernetes lambda language layer "
    "lib library license list local login manager map master message method metrics model module monitor network node "
    "object openssl option package page parser path payload performance pipeline platform plugin policy private process "
    "product production profile project protocol provider proxy public python query queue reader record registry release "
    "remote report request resource response result route runtime sample schema script search security server service "
    "session settings share site software source stage standard state static status storage stream string style system "
    "table target task template test text theme thread time tools transaction update upload user usr utils value vendor "
    "version video view web widget window worker workflow"
).split()


@dataclass(frozen=True)
class Battery:
    """``least``: shortest candidate. ``bands``: lower bounds of the length bands.
    ``alpha``: share of ordinary strings among those reported. ``stretch``: an
    ordinary string is taken from each stretch of so many characters of a text;
    ``common`` are made of common words."""

    least: int = 20
    bands: tuple[int, ...] = (20, 28, 40, 64, 128)
    alpha: float = 0.05
    stretch: int = 400
    common: int = 40_000


def _long(value: int) -> Column:
    return F.lit(value).cast("long")


def _found(text: Column, pattern: str, group: int, least: int, kind: int) -> Column:
    """Matches as (start, kind, end, value); code points, end exclusive."""
    empty = F.array().cast("array<struct<start:bigint,kind:int,end:bigint,value:string>>")

    def placed(gaps: Column, found: Column, values: Column) -> Column:
        sizes = F.transform(found, lambda m, i: (F.length(F.get(gaps, i)) + F.length(m)).cast("long"))
        spans = let(
            prefix_sums(sizes),
            lambda at: F.transform(
                found,
                lambda m, i: F.struct(
                    (F.get(at, i) + F.length(F.get(gaps, i))).alias("start"),
                    F.lit(kind).alias("kind"),
                    (F.get(at, i) + F.length(F.get(gaps, i)) + F.length(m)).alias("end"),
                    F.get(values, i).alias("value"),
                ),
            ),
        )
        return F.filter(spans, lambda s: F.length(s["value"]) >= least)

    every = let(
        F.split(text, pattern, -1),
        lambda gaps: let(
            F.regexp_extract_all(text, F.lit(pattern), 0),
            lambda found: placed(gaps, found, F.regexp_extract_all(text, F.lit(pattern), group) if group else found),
        ),
    )
    return F.when(text.rlike(pattern), every).otherwise(empty)


def _tail(z: Column) -> Column:
    """Upper tail of the normal distribution (rational approximation, error below 1e-7)."""
    # fixed values: Abramowitz and Stegun 26.2.17
    c = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)

    def upper(x: Column, t: Column) -> Column:
        poly = F.lit(0.0)
        for a in reversed(c):
            poly = (poly + F.lit(a)) * t
        return F.exp(-x * x / 2) * F.lit(0.3989422804014327) * poly

    def both(x: Column) -> Column:
        share = let(F.lit(1.0) / (F.lit(1.0) + F.lit(0.2316419) * F.abs(x)), lambda t: upper(x, t))
        return let(share, lambda u: F.when(x >= 0, u).otherwise(1 - u))

    return let(z, both)


def _chi_tail(x: Column, df: Column) -> Column:
    """Upper tail of chi-squared by the cube-root transformation of Wilson and Hilferty."""
    spread = F.lit(2.0) / (df * 9)
    return _tail((F.pow(F.greatest(x, F.lit(0.0)) / df, F.lit(1 / 3)) - 1 + spread) / F.sqrt(spread))


def _floor_p(p: Column) -> Column:
    return F.greatest(F.least(p, F.lit(1.0)), F.lit(1e-15))


def encoding_of(value: Column) -> Column:
    """The first encoding whose shape fits a string that holds letters and digits; NULL for none and for text in base64."""
    guess = F.lit(None).cast("string")
    for name, shape, _ in reversed(ENCODINGS):
        guess = F.when(value.rlike(shape), F.lit(name)).otherwise(guess)
    return F.when(value.rlike("[0-9]") & value.rlike("[A-Za-z]") & ~value.rlike(PRINTABLE), guess)


def battery_p(value: Column, encoding: Column) -> Column:
    """Combined p-value of the null hypothesis that the string is random."""
    core = F.rtrim(F.translate(value, "=", " "))
    low = F.when(encoding.isin(*ONE_CASE), F.lower(core)).otherwise(core)

    def of_encoding(figure) -> Column:
        out = F.lit(figure(ENCODINGS[0][2]))
        for name, _, symbols in ENCODINGS[1:]:
            out = F.when(encoding == name, F.lit(figure(symbols))).otherwise(out)
        return out

    alphabet, size = of_encoding(str), of_encoding(len)
    in_capitals = of_encoding(lambda x: sum(map(str.isupper, x)))
    in_small = of_encoding(lambda x: sum(map(str.islower, x)))

    def tests(ranks: Column, n: Column, k: Column) -> Column:
        # squares of the symbols' counts; moments are those of chi-squared, however few symbols a cell expects
        squares = F.aggregate(
            F.transform(
                F.array_distinct(F.split(low, "")), lambda c: F.length(low) - F.length(F.replace(low, c, F.lit("")))
            ),
            F.lit(0.0),
            lambda total, x: total + x * x,
        )
        uniform = _chi_tail(squares * k / n - n, (k - 1).cast("double"))
        capitals, small = (F.length(F.regexp_replace(low, f"[^{x}]", "")).cast("double") for x in ("A-Z", "a-z"))
        parts = [(capitals, in_capitals), (small, in_small), (n - capitals - small, k - in_capitals - in_small)]
        # alphabets of one case have two classes
        apart = sum((F.when(m > 0, (c - n * m / k) * (c - n * m / k) * k / (n * m)).otherwise(F.lit(0.0)) for c, m in parts), F.lit(0.0))
        classes = _chi_tail(apart, F.when((in_capitals > 0) & (in_small > 0), F.lit(2.0)).otherwise(F.lit(1.0)))
        high = F.size(F.filter(ranks, lambda r: r * 2 >= k)).cast("double")
        turns = F.size(
            F.filter(ranks, lambda r, i: (i > 0) & ((r * 2 >= k) != (F.get(ranks, i - 1) * 2 >= k)))
        )

        def runs_p(twice: Column) -> Column:
            spread = twice * (twice - n) / (n * n * (n - 1))
            z = F.abs((turns - twice / n) / F.sqrt(spread))
            return F.when(spread > 0, _tail(z) * 2).otherwise(F.lit(1e-15))

        def serial_p(mean: Column) -> Column:
            around = F.aggregate(ranks, F.lit(0.0), lambda total, r: total + (r - mean) * (r - mean))
            lagged = F.aggregate(
                F.transform(ranks, lambda r, i: F.coalesce((r - mean) * (F.get(ranks, i + 1) - mean), F.lit(0.0))),
                F.lit(0.0),
                lambda total, x: total + x,
            )
            z = let(around, lambda a: F.when(a > 0, F.abs(lagged / a * F.sqrt(n) + F.lit(1.0) / F.sqrt(n))))
            return F.coalesce(_tail(z) * 2, F.lit(1e-15))

        runs = let(high * 2 * (n - high), runs_p)
        serial = let(F.aggregate(ranks, F.lit(0.0), lambda total, r: total + r) / n, serial_p)
        fisher = sum((F.log(_floor_p(p)) for p in (uniform, classes, runs, serial)), F.lit(0.0)) * -2
        return _floor_p(_chi_tail(fisher, F.lit(8.0)))

    # ranks of the symbols; a symbol outside the alphabet counts as the first
    ranks = F.transform(F.split(low, ""), lambda c: F.greatest(F.instr(alphabet, c), F.lit(1)) - 1)
    return let(
        ranks, lambda r: let(F.size(r).cast("double"), lambda n: let(size, lambda k: tests(r, n, k)))
    )


def _band(length: Column, battery: Battery) -> Column:
    band = F.lit(battery.bands[0])
    for bound in battery.bands[1:]:
        band = F.when(length >= bound, F.lit(bound)).otherwise(band)
    return band


def _tested(value: Column, encoding: Column, battery: Battery) -> tuple[Column, Column]:
    """Stratum of a candidate, and the bin of its p-value: the smaller, the more random it looks."""
    stratum = F.concat_ws("/", encoding, _band(F.length(value), battery))
    p_bin = F.least(F.floor(F.log(battery_p(value, encoding)) * -PER_E), F.lit(LAST_BIN)).cast("int")
    return stratum.alias("stratum"), p_bin.alias("bin")


def candidates(
    docs: DataFrame, battery: Battery = Battery(), text: str = "text", with_text: bool = False
) -> DataFrame:
    """Adds ``_base``, the kept base spans, and ``_tested``, other candidates with stratum and p-value bin."""
    body = F.coalesce(F.col(text), F.lit(""))
    rest = [c for c in docs.columns if c not in ("_base", "_tested", "_wide") and (with_text or c != text)]
    base = F.concat(*[_found(body, p, g, n, k) for k, (_, p, g, n) in enumerate(BASE)])
    wide = _found(body, f"[A-Za-z0-9+/_=-]{{{battery.least},}}", 0, battery.least, 3)
    found = docs.select(*[F.col(f"`{c}`") for c in rest], F.sort_array(base).alias("_base"), wide.alias("_wide"))
    fresh = F.filter(
        F.col("_wide"),
        lambda s: ~F.exists(F.col("_base"), lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])),
    )
    named = F.filter(
        F.transform(fresh, lambda s: F.struct(s.alias("span"), encoding_of(s["value"]).alias("encoding"))),
        lambda x: x["encoding"].isNotNull(),
    )
    tested = F.transform(
        named, lambda x: F.struct(x["span"].alias("span"), *_tested(x["span"]["value"], x["encoding"], battery))
    )
    return found.select(*[F.col(f"`{c}`") for c in rest], "_base", tested.alias("_tested"))


# ---- ordinary strings ------------------------------------------------------------


def _glued(words: Column, turn: Column) -> Column:
    """Words joined to one string, with a digit in it, in one of eight ways by ``turn``."""
    digit = (turn % 10).cast("string")
    first = F.concat(F.get(words, 0), digit)
    marked = F.concat(F.array(first), F.slice(words, 2, 1000))
    low = F.transform(marked, F.lower)
    capitals = F.transform(marked, F.initcap)
    # only some letters of the words can stand in hexadecimal
    hexed = F.concat(F.translate(F.array_join(low, ""), "ghijklmnopqrstuvwxyz", ""), digit)
    ways = [
        F.array_join(low, "/"),
        F.array_join(low, "-"),
        F.array_join(low, "_"),
        F.array_join(low, ""),
        F.upper(F.array_join(low, "")),
        F.concat(F.lower(F.get(capitals, 0)), F.array_join(F.slice(capitals, 2, 1000), "")),
        F.upper(hexed),
        F.concat(F.lit("/"), F.array_join(capitals, "/")),
    ]
    out = ways[0]
    for i, way in enumerate(ways[1:], 1):
        out = F.when(F.pmod(turn, F.lit(len(ways))) == i, way).otherwise(out)
    return out


def ordinary(docs: DataFrame, battery: Battery = Battery(), text: str = "text") -> DataFrame:
    """Rows (source, stratum, bin, n): how random ordinary strings look, counted per stratum and bin.

    ``corpus`` strings are made of the words of every stretch of every text, 3 to
    34 words each; ``common`` ones of common words.
    """
    stretches = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(f"(?s).{{1,{battery.stretch}}}"), F.lit(0))
    own = docs.select(F.posexplode(stretches).alias("at", "part"), F.length(text).alias("size")).select(
        F.lit("corpus").alias("source"),
        F.hash("at", "size", "part").alias("turn"),
        F.filter(
            F.split(F.regexp_replace("part", "[^A-Za-z]+", " "), " "), lambda w: w != ""
        ).alias("words"),
    )
    listed = F.array(*[F.lit(w) for w in COMMON])
    seeded = docs.sparkSession.range(battery.common).select(
        F.lit("common").alias("source"),
        F.hash("id").alias("turn"),
        F.transform(
            F.sequence(F.lit(1), F.lit(40)), lambda j: F.get(listed, F.pmod(F.hash(F.col("id"), j), F.lit(len(COMMON))))
        ).alias("words"),
    )
    # as many strings of 3 to 6 words as of 6 to 12 and so on
    spread = F.pmod(F.shiftright("turn", 8), F.lit(1024)) / 1024
    long = F.floor(F.lit(3.0) * F.pow(F.lit(2.0), spread * 3.5)).cast("int")
    # the first word of a stretch may have lost its beginning
    strings = own.unionByName(seeded).where("size(words) > 3").select(
        "source", _glued(F.slice("words", 2, long), F.col("turn")).alias("value")
    )
    named = strings.where(F.length("value") >= battery.least).withColumn("encoding", encoding_of(F.col("value")))
    tested = named.where("encoding IS NOT NULL").select("source", *_tested(F.col("value"), F.col("encoding"), battery))
    return tested.groupBy("source", "stratum", "bin").agg(F.count("*").alias("n"))


def accepted_from(tested: DataFrame, null: DataFrame, alpha: float) -> dict[str, int]:
    """Per stratum the last p-value bin that is reported.

    A bin's p-value is the share of ordinary strings in it or in bins that look
    more random: the larger of the shares among the corpus' strings and among the
    common ones. Of the candidates up to the last bin that passes, a share of
    ``alpha`` at most is expected to be ordinary. Only counts per stratum and bin
    are gathered: at most encodings x bands x bins, whatever the input.
    """
    found: dict[str, dict[int, int]] = {}
    counts = (
        tested.select(F.explode("_tested").alias("t"))
        .groupBy(F.col("t.stratum").alias("stratum"), F.col("t.bin").alias("bin"))
        .count()
    )
    for r in counts.collect():
        found.setdefault(r["stratum"], {})[r["bin"]] = r["count"]
    shares: dict[str, dict[str, dict[int, int]]] = {}
    for r in null.collect() if found else ():
        shares.setdefault(r["stratum"], {}).setdefault(r["source"], {})[r["bin"]] = r["n"]
    def up_to(b: int, bins: dict[int, int]) -> int:
        return sum(n for at, n in bins.items() if at <= b)

    last: dict[str, int] = {}
    for stratum, bins in found.items():
        total, reported = sum(bins.values()), 0
        common, own = (shares.get(stratum, {}).get(source, {}) for source in ("common", "corpus"))
        for b in sorted(bins):
            reported += bins[b]
            # one more on both sides: no share is zero, and an unknown null accepts nothing
            p = (1 + up_to(b, common)) / (1 + sum(common.values()))
            # a small corpus says little: its share starts from that of the common strings
            p = max(p, (up_to(b, own) + PRIOR * p) / (sum(own.values()) + PRIOR))
            if p * total <= alpha * reported:
                last[stratum] = b
    return last


def find_secrets(docs: DataFrame, battery: Battery = Battery(), text: str = "text") -> DataFrame:
    """Find secrets in whole texts.

    Replaces the text by ``base`` and ``spans``, arrays of (start, kind, end,
    value) sorted by start and kind; kinds are numbered as in ``KINDS``. Other
    columns pass through. What the patterns find is staged once, then the
    false-discovery bound of the corpus is applied to it.

    NULL and empty texts have no spans; repeated rows give equal rows; an empty
    table an empty one. Candidates that overlap a base span are not added.
    """
    tested = stage(candidates(docs, battery, text), "secrets")
    last = accepted_from(tested, ordinary(docs, battery, text), battery.alpha)
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in ("_base", "_tested", "_wide", text, "base", "spans")]
    return tested.select(*rest, F.col("_base").alias("base"), _all_spans(last).alias("spans"))


def _all_spans(last: dict[str, int]) -> Column:
    """Base spans and the candidates of the bins that their strata report."""

    def random(x: Column) -> Column:
        limit = F.lit(-1)
        for stratum, b in sorted(last.items()):
            limit = F.when(x["stratum"] == stratum, F.lit(b)).otherwise(limit)
        return x["bin"] <= limit

    added = F.transform(F.filter(F.col("_tested"), random), lambda x: x["span"])
    return F.sort_array(F.concat("_base", added))


def redact(docs: DataFrame, battery: Battery = Battery(), text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """Documents with every secret replaced by ``mark``; all rows and columns stay.

    Overlapping secrets become one mark. The false-discovery bound needs the
    candidates of all documents, so texts are scanned twice instead of being
    stored or joined. NULL texts stay NULL and texts without a secret stay as
    they are; repeated rows give equal rows; an empty table an empty one.
    """
    names = [f"_c{i}" for i in range(len(docs.columns))]
    plain, body = docs.toDF(*names), f"_c{docs.columns.index(text)}"
    last = accepted_from(candidates(plain.select(body), battery, body), ordinary(plain, battery, body), battery.alpha)
    found = candidates(plain, battery, body, with_text=True).withColumn("_spans", _all_spans(last))

    def rebuilt(spans: Column) -> Column:
        # where the text before a span starts: after all spans before it
        ends = F.transform(
            spans, lambda s, i: F.coalesce(F.array_max(F.transform(F.slice(spans, 1, i), lambda x: x["end"])), F.lit(0).cast("long"))
        )
        return let(
            ends,
            lambda end: F.concat(
                F.concat_ws(
                    "",
                    F.transform(
                        spans,
                        lambda s, i: F.when(
                            s["start"] < F.get(end, i), F.lit("")
                        ).otherwise(
                            F.concat(
                                F.substr(F.col(body), (F.get(end, i) + 1).cast("int"), (s["start"] - F.get(end, i)).cast("int")),
                                F.lit(mark),
                            )
                        ),
                    ),
                ),
                F.substr(F.col(body), (F.array_max(F.transform(spans, lambda x: x["end"])) + 1).cast("int")),
            ),
        )

    clean = F.when(F.size("_spans") > 0, let(F.col("_spans"), rebuilt)).otherwise(F.col(body))
    return found.withColumn(body, clean).select(*names).toDF(*docs.columns)


def joined(spans: Column, kinds: tuple[str, ...] = KINDS) -> Column:
    """Spans as ``kind:start:end``, comma-joined."""
    names = F.array(*[F.lit(k) for k in kinds])
    return F.concat_ws(
        ",", F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"]))
    )


def count_kind(spans: Column, kind: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
