"""Licence sentences over wrapped lines, rule order, repeats and edge rows."""

import re
import textwrap

import pytest
from pyspark.sql import functions as F

from cohortlane.llm.licenses import RULES, SENTENCES, find_licenses, pattern

# Licence texts and notices as they are found in files.
GNU = (
    "This {what} is free software{sep} you can redistribute it and/or modify it under the terms of the GNU {kind}General "
    "Public License as published by the Free Software Foundation{sep2} either version {version} of the License, or (at your "
    "option) any later version.\n\nThis {what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; "
    "without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."
)
BSD2 = (
    "Copyright (c) 2020, Jane Doe. All rights reserved.\n\nRedistribution and use in source and binary forms, with or without "
    "modification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must "
    "retain the above copyright notice, this list of conditions and the following disclaimer.\n\n2. Redistributions in binary "
    "form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
    "documentation and/or other materials provided with the distribution.\n\n"
)
MIT = (
    "MIT License\n\nCopyright (c) 2021 Jane Doe\n\nPermission is hereby granted, free of charge, to any person obtaining a "
    'copy of this software and associated documentation files (the "Software"), to deal in the Software without '
    "restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
    "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
    "following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or "
    'substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR '
    "IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND "
    "NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
    "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE "
    "SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
TEXTS = {
    "MIT": MIT,
    "BSD-2-Clause": BSD2,
    "BSD-3-Clause": BSD2 + "3. Neither the name of the copyright holder nor the names of its contributors may be used to "
    "endorse or promote products derived from this software without specific prior written permission.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
    "granted, provided that the above copyright notice and this permission notice appear in all copies.\n\nTHE SOFTWARE "
    'IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED '
    "WARRANTIES OF MERCHANTABILITY AND FITNESS.",
    "Apache-2.0": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in '
    "compliance with the License. You may obtain a copy of the License at\n\n    http://www.apache.org/licenses/LICENSE-2.0"
    '\n\nUnless required by applicable law or agreed to in writing, software distributed under the License is distributed '
    'on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the '
    "specific language governing permissions and limitations under the License.",
    "GPL-3.0-or-later": GNU.format(what="program", sep=":", kind="", sep2=",", version="3"),
    "GPL-2.0-or-later": GNU.format(what="program", sep=";", kind="", sep2=";", version="2"),
    "LGPL-2.1-or-later": GNU.format(what="library", sep=";", kind="Lesser ", sep2=";", version="2.1"),
    "LGPL-3.0-or-later": GNU.format(what="library", sep=":", kind="Lesser ", sep2=",", version="3"),
    "AGPL-3.0-or-later": GNU.format(what="program", sep=":", kind="Affero ", sep2=",", version="3"),
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL "
    "was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
}


def wrapped(text, width, mark=""):
    return "\n".join(
        (mark + line).rstrip() for part in text.split("\n") for line in (textwrap.wrap(part, width) or [""])
    )


FORMS = {
    "whole": lambda t: t,
    "wrapped": lambda t: wrapped(t, 70),
    "narrow": lambda t: wrapped(t, 38),
    "hash": lambda t: "#!/bin/sh\n" + wrapped(t, 72, "# ") + "\nexit 0",
    "stars": lambda t: "/*\n" + wrapped(t, 66, " * ") + "\n */\nint x;",
    "slashes": lambda t: wrapped(t, 60, "// ").replace("\n", "\r\n"),
    "twice": lambda t: f"{wrapped(t, 70)}\n\n{wrapped(t, 70)}",
    "thrice on a line": lambda t: " ".join([t.replace("\n", " ")] * 3),
}


@pytest.fixture(scope="module")
def standard(documents):
    rows = [(name, form) for name in TEXTS for form in FORMS]
    found = find_licenses(documents(*((i, FORMS[form](TEXTS[name])) for i, (name, form) in enumerate(rows)))).collect()
    return {rows[r.doc_id]: r for r in found}


@pytest.mark.parametrize("form", FORMS)
@pytest.mark.parametrize("name", TEXTS)
def test_standard_texts(standard, name, form):
    assert standard[name, form].licenses == [name]


CASES = [
    (None, [], False),
    ("", [], False),
    ("Released under the MIT License.", ["MIT"], True),
    ("x y.\n  Licensed under the Apache Licence, Version 2.0!! more", ["Apache-2.0"], True),
    ("some heading\nLicensed under the Apache License, Version 2.0. More words", ["Apache-2.0"], True),
    ("THIS WORK IS LICENSED UNDER THE GNU GENERAL PUBLIC LICENSE, VERSION 3.", ["GPL-3.0-only"], False),
    (
        "This program is distributed under the terms of the GNU General Public License, version 3. "
        "Either version 3 of the License, or (at your option) any later version.",
        ["GPL-3.0-or-later"],
        False,
    ),
    ("Licensed under CC BY-NC 4.0. All rights reserved.", ["CC-BY-NC-4.0", "Proprietary"], False),
    ("Released under the MIT License. " * 500, ["MIT"], True),
    ("a license to kill under the sea", [], False),
    ("Either version 3 of the License, or (at your option) any later version.", [], False),
    ("// SPDX-License-Identifier: BSD-3-Clause\nint x;", ["BSD-3-Clause"], True),
    ("Frobnicator is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public\n"
     "License as published by the Free Software Foundation, either version 3\nof the License, or (at your option) any "
     "later version.", ["GPL-3.0-or-later"], False),
    ("All rights reserved.\n\n" + BSD2, ["BSD-2-Clause", "Proprietary"], False),
    ("word " * 200_000 + "\nReleased under the MIT License.", ["MIT"], True),
]


@pytest.fixture(scope="module")
def found(documents):
    rows = [(i, t) for i, (t, _, _) in enumerate(CASES)]
    return {r.doc_id: r for r in find_licenses(documents(*rows, rows[2]).withColumn("open", F.lit(1))).collect()}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_case(found, i):
    assert (found[i].licenses, found[i].open) == CASES[i][1:]


def test_order_of_rules(documents):
    text = (
        "Licensed under the Apache License, Version 2.0.\nYou may not use this file except in compliance with the License.\n"
        "Released under the MIT License."
    )
    row = find_licenses(documents((1, text))).collect()[0]
    assert row.sentences == ["apache2_notice", "apache2_condition", "mit_notice"]
    assert row.licenses == ["Apache-2.0", "MIT"]


def by_hand(ids):
    """Rules over a list of identifiers, without patterns: each takes its leftmost matches and uses them up."""
    left, names = list(ids), []
    for name, rule in RULES:
        i, hit = 0, False
        while i < len(left):
            at = i
            for word in rule.split():
                if at < len(left) and left[at] == word.rstrip("?"):
                    at += 1
                elif not word.endswith("?"):
                    at = None
                    break
            if at is not None and at > i:
                left[i:at] = ["|"]
                hit = True
            i += 1
        if hit and name not in names:
            names.append(name)
    return names


def test_rules_against_a_matcher_without_patterns(documents):
    """Random sequences of known sentences, as texts, with repeats."""
    import random

    rng = random.Random(8)
    by_id = {}
    for sentence, name in SENTENCES.items():
        by_id.setdefault(name, sentence)
    wanted = ["mit_title", "mit_condition", "mit_warranty", "gpl3_notice", "v3_later", "bsd_grant", "bsd_source",
              "bsd_binary", "bsd_name", "reserved", "gpl_grant", "v2_later", "apache2_notice", "apache2_condition"]
    sequences = [[rng.choice(wanted) for _ in range(rng.randrange(1, 14))] for _ in range(150)]
    docs = documents(*((i, ".\n".join(by_id[x] for x in ids)) for i, ids in enumerate(sequences)))
    for r in find_licenses(docs).collect():
        assert r.sentences == sequences[r.doc_id]
        assert r.licenses == by_hand(r.sentences)


def test_patterns_leave_neighbours():
    assert re.sub(pattern("a b?"), " | ", " a  a  b  a ") == " |  |  | "


def test_empty_table(documents):
    assert find_licenses(documents((1, "x")).limit(0)).count() == 0


def test_every_known_sentence_is_looked_up(documents):
    leads = ["under ", "Distributed by ", "This work is licensed under the terms of the\t", "released by/"]
    texts = [(lead + s[6:], name) for s, name in SENTENCES.items() if s.startswith("under ") for lead in leads]
    texts += [(s.upper().replace(" ", "  "), name) for s, name in SENTENCES.items()]
    rows = find_licenses(documents(*enumerate(t for t, _ in texts))).collect()
    assert {r.doc_id: r.sentences for r in rows} == {i: [name] for i, (_, name) in enumerate(texts)}
