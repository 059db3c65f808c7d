"""Licences of texts, recognised sentence by sentence, with column expressions only.

Comment marks go, a line that is no known sentence by itself is joined with the
next one until a sentence ends, and sentences are normalised and looked up in a
table of known licence sentences.
What remains of a text is a sequence of sentence identifiers, on which ordered
rules are matched: full licence texts before notices, longer notices before
shorter ones. A rule uses up the sentences it matches.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Normalised sentences and their identifiers. "under" stands for
#: any lead-in such as "this work is licensed under the terms of the".
SENTENCES = {
    "under mit license": "mit_notice",
    "under mit expat license": "mit_notice",
    "the mit license mit": "mit_title",
    "the mit license": "mit_title",
    "mit license": "mit_title",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "mit_grant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit_condition",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "mit_warranty",
    "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software": "mit_liability",
    "under apache license version 2.0": "apache2_notice",
    "under apache license 2.0": "apache2_notice",
    "under apache 2.0 license": "apache2_notice",
    "under apache license version 2.0 the license": "apache2_notice",
    "you may not use this file except in compliance with the license": "apache2_condition",
    "you may obtain a copy of the license at http www.apache.org licenses license-2.0": "apache2_copy",
    "you may obtain a copy of the license at": "apache2_copy",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "apache2_warranty",
    "see the license for the specific language governing permissions and limitations under the license": "apache2_see",
    "under gnu general public license version 2": "gpl2_notice",
    "under gnu general public license version 3": "gpl3_notice",
    "under gnu gpl version 3": "gpl3_notice",
    "under gnu gpl version 2": "gpl2_notice",
    "under gpl-3.0 license": "gpl3_notice",
    "under gpl-2.0 license": "gpl2_notice",
    "under gnu lesser general public license version 2.1": "lgpl21_notice",
    "under gnu lesser general public license version 3": "lgpl3_notice",
    "under gnu affero general public license version 3": "agpl3_notice",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation": "gpl_grant",
    "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation": "lgpl_grant",
    "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation": "agpl_grant",
    "you can redistribute it and or modify it under the terms of the gnu general public license version 2 as published by the free software foundation": "gpl2_notice",
    "you can redistribute it and or modify it under the terms of the gnu general public license version 3 as published by the free software foundation": "gpl3_notice",
    "either version 2.1 of the license or at your option any later version": "v21_later",
    "either version 2 of the license or at your option any later version": "v2_later",
    "either version 3 of the license or at your option any later version": "v3_later",
    "under mozilla public license version 2.0": "mpl2_notice",
    "under mozilla public license v 2.0": "mpl2_notice",
    "this source code form is subject to the terms of the mozilla public license v 2.0": "mpl2_notice",
    "under bsd license": "bsd_notice",
    "under bsd 2-clause license": "bsd2_notice",
    "under bsd 3-clause license": "bsd3_notice",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd_grant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsd_source",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bsd_binary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd_name",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc_grant",
    "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc_grant",
    "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness": "isc_warranty",
    "isc license": "isc_title",
    "the isc license isc": "isc_title",
    "under isc license": "isc_notice",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "under unlicense": "unlicense",
    "spdx-license-identifier mit": "mit_notice",
    "spdx-license-identifier apache-2.0": "apache2_notice",
    "spdx-license-identifier bsd-2-clause": "bsd2_notice",
    "spdx-license-identifier bsd-3-clause": "bsd3_notice",
    "spdx-license-identifier isc": "isc_notice",
    "spdx-license-identifier mpl-2.0": "mpl2_notice",
    "spdx-license-identifier gpl-2.0-only": "gpl2_notice",
    "spdx-license-identifier gpl-3.0-only": "gpl3_notice",
    "spdx-license-identifier gpl-2.0-or-later": "gpl2_later",
    "spdx-license-identifier gpl-3.0-or-later": "gpl3_later",
    "spdx-license-identifier unlicense": "unlicense",
    "spdx-license-identifier cc0-1.0": "cc0_notice",
    "under cc0 1.0": "cc0_notice",
    "under cc by 4.0": "ccby_notice",
    "under cc by-sa 4.0": "ccbysa_notice",
    "under cc by-nd 4.0": "ccbynd_notice",
    "under cc by-nc 4.0": "ccbync_notice",
    "under cc by-nc-sa 4.0": "ccbyncsa_notice",
    "under cc by-nc-nd 4.0": "ccbyncnd_notice",
    "under creative commons attribution 4.0 international license": "ccby_notice",
    "under creative commons attribution-sharealike 4.0 international license": "ccbysa_notice",
    "under creative commons attribution-noncommercial 4.0 international license": "ccbync_notice",
    "all rights reserved": "reserved",
}

# The notices of the GNU licences that are one sentence, by rule: licence and version.
for _name, _family in (("gpl", "general"), ("lgpl", "lesser general"), ("agpl", "affero general")):
    for _version in ("2", "2.1", "3"):
        SENTENCES[
            "you can redistribute it and or modify it under the terms of the "
            f"gnu {_family} public license as published by the free software foundation "
            f"either version {_version} of the license or at your option any later version"
        ] = f"{_name}{_version.replace('.', '')}_later"

#: Rules in the order in which they are tried: licence and the identifiers in
#: order. ``?`` marks one that may be missing.
RULES = (
    ("MIT", "reserved? mit_title? reserved? mit_grant? mit_condition mit_warranty mit_liability?"),
    ("MIT", "mit_title? reserved? mit_grant"),
    ("BSD-3-Clause", "reserved? bsd_grant bsd_source bsd_binary bsd_name"),
    ("BSD-2-Clause", "reserved? bsd_grant bsd_source bsd_binary"),
    ("Apache-2.0", "apache2_notice apache2_condition apache2_copy? apache2_warranty? apache2_see?"),
    ("GPL-3.0-or-later", "gpl3_notice v3_later"),
    ("GPL-2.0-or-later", "gpl2_notice v2_later"),
    ("AGPL-3.0-or-later", "agpl3_notice v3_later"),
    ("LGPL-3.0-or-later", "lgpl3_notice v3_later"),
    ("LGPL-2.1-or-later", "lgpl21_notice v21_later"),
    ("GPL-3.0-or-later", "gpl_grant v3_later"),
    ("GPL-2.0-or-later", "gpl_grant v2_later"),
    ("LGPL-3.0-or-later", "lgpl_grant v3_later"),
    ("LGPL-2.1-or-later", "lgpl_grant v21_later"),
    ("AGPL-3.0-or-later", "agpl_grant v3_later"),
    ("GPL-3.0-or-later", "gpl3_later"),
    ("GPL-2.0-or-later", "gpl2_later"),
    ("LGPL-3.0-or-later", "lgpl3_later"),
    ("LGPL-2.1-or-later", "lgpl21_later"),
    ("AGPL-3.0-or-later", "agpl3_later"),
    ("ISC", "isc_title? reserved? isc_grant isc_warranty?"),
    ("ISC", "isc_notice"),
    ("ISC", "isc_title"),
    ("MIT", "mit_notice"),
    ("MIT", "mit_title"),
    ("Apache-2.0", "apache2_notice"),
    ("GPL-3.0-only", "gpl3_notice"),
    ("GPL-2.0-only", "gpl2_notice"),
    ("AGPL-3.0-only", "agpl3_notice"),
    ("LGPL-2.1-only", "lgpl21_notice"),
    ("LGPL-3.0-only", "lgpl3_notice"),
    ("MPL-2.0", "mpl2_notice"),
    ("BSD-3-Clause", "bsd3_notice"),
    ("BSD-2-Clause", "bsd2_notice"),
    ("BSD", "bsd_notice"),
    ("Unlicense", "unlicense"),
    ("CC0-1.0", "cc0_notice"),
    ("CC-BY-4.0", "ccby_notice"),
    ("CC-BY-SA-4.0", "ccbysa_notice"),
    ("CC-BY-ND-4.0", "ccbynd_notice"),
    ("CC-BY-NC-4.0", "ccbync_notice"),
    ("CC-BY-NC-SA-4.0", "ccbyncsa_notice"),
    ("CC-BY-NC-ND-4.0", "ccbyncnd_notice"),
    ("Proprietary", "reserved"),
)

#: Licences that let a text be copied and changed.
OPEN = (
    "MIT", "BSD-3-Clause", "BSD-2-Clause", "BSD", "Apache-2.0", "ISC", "MPL-2.0", "Unlicense", "CC0-1.0", "CC-BY-4.0",
)

#: A text without any of these words holds no known sentence, whatever stands between words.
HINT = (
    "(?i)licen[sc]e|reserved|warrant|copyright|permission|unencumbered|redistribut|gpl|cc0|cc[^a-z0-9.+-]+by|liable"
)
#: Marks that begin comment lines, and line ends that are more than a line feed.
COMMENT = "(^|\n)[ \t]*(//+|/\\*+|\\*+/?|#+|--+|;+|%+|<!--)+[ \t]*"
#: "v. 2.0" and "identifier: x" don't end sentences.
VERSION = "([ \t][vV]|-[iI]dentifier)[.:][ \t]*([0-9A-Za-z])"
#: Where a sentence ends within a line.
ENDS = "([.!?;:])[ \t]+"
#: The first line of a script.
SCRIPT = "^#![^\n]*"
LEAD = (
    "^(this |the )?((work|software|program|code|source code|file|project|library|text|document|content|material) )?"
    "((is|are) )?((re)?distributed|released|licensed|made available|provided|available|published) "
    "(under|by) (the )?(terms of )?(the )?"
)
#: Names in sentences: any holder.
NAMED = (
    ("^neither the name of .+ nor the names of its contributors", "neither the name of the copyright holder nor the names of its contributors"),
)


def pattern(rule: str) -> str:
    """A rule as a pattern over identifiers, each with a blank on both sides."""
    parts = []
    for word in rule.split():
        name = word.rstrip("?")
        parts.append(f"( {name} )?" if word.endswith("?") else f" {name} ")
    return "".join(parts)


def normalised(sentence: Column) -> Column:
    """Lower case, one blank between words, "licence" as "license", lead-ins as "under", names left out."""
    low = F.regexp_replace(F.regexp_replace(F.lower(sentence), "licence", "license"), "https", "http")
    plain = F.regexp_replace(low, "[^a-z0-9.+-]+", " ")
    bare = F.regexp_replace(F.trim(plain), "([.+-]+( |$))|(^[.+-]+)", " ")
    out = F.regexp_replace(F.trim(F.regexp_replace(bare, " +", " ")), LEAD, "under ")
    for form, instead in NAMED:
        out = F.regexp_replace(out, form, instead)
    return out


def pieces(text: Column) -> Column:
    """Lines without comment marks, cut further where a sentence ends within."""
    plain = F.regexp_replace(text, "\r", "")
    for form, instead in ((SCRIPT, "\n"), (COMMENT, "$1"), (VERSION, "$1 $2"), (ENDS, "$1\n")):
        plain = F.regexp_replace(plain, form, instead)
    return F.split(plain, "\n")


def sentences(text: Column, known: Column) -> Column:
    """Whole sentences, over the ends of wrapped lines.

    A piece that is a known sentence by itself stands alone (titles and notices
    on one line); others go on until one ends a sentence or a line is empty.
    """

    def joined(piece: Column) -> Column:
        bare = F.trim(piece)
        alone = F.element_at(known, normalised(bare)).isNotNull()
        ends = bare.rlike("[.!?;:]$") | (bare == "")
        return (
            F.when(alone, F.concat(F.lit("\n"), bare, F.lit("\n")))
            .when(ends, F.concat(bare, F.lit("\n")))
            .otherwise(F.concat(bare, F.lit(" ")))
        )

    return F.split(F.array_join(F.transform(pieces(text), joined), ""), "\n")


def find_licenses(docs: DataFrame, text: str = "text") -> DataFrame:
    """Licences of whole texts.

    Adds ``sentences`` (identifiers of known sentences, in order),
    ``licenses`` (those of the matching rules, in rule order, each once) and
    ``open`` (at least one licence, and all of them allow reuse); columns of these names are replaced,
    others pass through. NULL and empty texts have none; rows are read one by
    one, so repeated rows get equal results and an empty table stays empty.
    """
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in ("sentences", "licenses", "open", "_ids")]
    body = F.col(text)
    known = F.from_json(F.lit(json.dumps(SENTENCES)), "map<string,string>")
    ids = F.when(
        body.rlike(HINT),
        F.filter(
            F.transform(sentences(body, known), lambda s: F.element_at(known, normalised(s))), lambda x: x.isNotNull()
        ),
    )
    found = docs.select(*rest, F.coalesce(ids, F.array().cast("array<string>")).alias("_ids"))
    rules = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(pattern(rule)).alias("rule")) for name, rule in RULES])
    start = F.struct(
        F.concat(F.lit(" "), F.array_join("_ids", "  "), F.lit(" ")).alias("left"), F.array().cast("array<string>").alias("names")
    )

    def apply(state: Column, rule: Column) -> Column:
        return F.struct(
            # a mark keeps what a rule has used up from joining its neighbours
            F.regexp_replace(state["left"], rule["rule"], F.lit(" | ")).alias("left"),
            F.when(
                F.regexp_like(state["left"], rule["rule"]), F.concat(state["names"], F.array(rule["name"]))
            ).otherwise(state["names"]).alias("names"),
        )

    matched = F.aggregate(rules, start, apply, lambda state: F.array_distinct(state["names"]))
    none = F.array().cast("array<string>")
    named = found.select(
        *rest,
        F.col("_ids").alias("sentences"),
        F.when(F.size("_ids") > 0, matched).otherwise(none).alias("licenses"),
    )
    return named.withColumn(
        "open", (F.size("licenses") > 0) & (F.size(F.array_except("licenses", F.array(*map(F.lit, OPEN)))) == 0)
    )
