"""Licences of several lines and paragraphs inside longer texts."""

from __future__ import annotations

import random

import pytest

licences = pytest.importorskip("timberline.llm.licences")

APACHE = """   Licensed under the Apache License, Version 2.0 (the "License");
   you may not use this file except in compliance with the License.
   You may obtain a copy of the License at

       http://www.apache.org/licenses/LICENSE-2.0

   Unless required by applicable law or agreed to in writing, software
   distributed under the License is distributed on an "AS IS" BASIS,
   WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
   See the License for the specific language governing permissions and
   limitations under the License.
"""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice,
   this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
PROSE = "\n".join(f"Some lines of prose number {i} that tell of rivers, of towns and of the people there." for i in range(40))


def test_inside_prose(spark):
    texts = dict(licences.full_texts())
    rows = [APACHE, BSD, *(texts[n] for n in licences.TEXTS), licences.NOTICES[0][1].replace(" under ", "\n")]
    rows = [(i, f"{PROSE}\n{t}\n{PROSE}") for i, t in enumerate(rows)] + [(99, PROSE)]
    got = {r.doc_id: r for r in licences.scan(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert [got[i].licence for i in range(len(rows) - 1)] == ["Apache-2.0", "BSD-2-Clause", *licences.TEXTS, "AGPL-3.0"]
    assert got[0].dice > 0.9 and got[1].dice > 0.9 and got[99].licence is None and got[99].licences == ""


def test_runs_against_all_runs():
    rng = random.Random(4)
    for turn in range(300):
        templates = licences.Templates((("t", " ".join(rng.choice("abcdefg") for _ in range(rng.randrange(3, 9)))),), 0.8)
        text = "".join(rng.choice("abcdefgh") + rng.choice([" ", " ", "\n", "\n\n"]) for _ in range(rng.randrange(2, 30)))
        lines = text.split("\n")
        best, single = 0.0, set()
        for i in range(len(lines)):
            for j in range(i, len(lines)):
                found = templates.of(set(licences._bigrams("\n".join(lines[i : j + 1]).encode())[0].tolist()))
                best = max([best, *(f[0] for f in found)])
                single |= {i} if i == j and found else set()
        grams, at, to = licences._bigrams(text.encode())
        number = [[text[:x].count("\n") for x in places.tolist()] for places in (at, to - 1)]
        found_best, found_single = templates.runs(0, grams.tolist(), *number)
        assert (found_best[0], found_single) == (best, single), (turn, text)


def scanned(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    return {r.doc_id: (r.licence, r.licences) for r in licences.scan(rows).collect()}


def test_each_full_text_names_itself_alone(spark):
    texts = dict(licences.full_texts())
    got = scanned(spark, [texts[n] for n in licences.TEXTS])
    assert [got[i] for i in range(len(texts))] == [(n, n) for n in licences.TEXTS]


def test_notices_that_differ_in_a_word(spark):
    notices = [(n, t) for n, t in (*licences.NOTICES, *licences.TEMPLATES) if n.startswith(("GPL", "LGPL", "AGPL"))]
    got = scanned(spark, [f"{PROSE}\n{t}\n{PROSE}" for _, t in notices])
    assert [got[i] for i in range(len(notices))] == [(n, n) for n, _ in notices]


def test_files_of_a_foundation_and_bare_rights(spark):
    bsd = dict(licences.full_texts())["BSD-3-Clause"]
    own = "Copyright (c) 2009, The Example Foundation\nAll rights reserved.\n\n" + bsd.replace("the copyright holder nor the names of its", "the Example Foundation nor the names of its")
    two = "Licensed under CC BY 4.0.\nsome words between\nReleased under the MIT License."
    got = scanned(spark, [own, "All rights reserved.", "All rights reserved.\nReleased under the MIT License.", two, "All rights reserved.\n" * 3])
    assert got[0] == ("BSD-3-Clause", "BSD-3-Clause")
    assert got[1] == got[4] == ("Proprietary", "Proprietary") and got[2] == ("MIT", "MIT")
    assert got[3] == ("CC-BY-4.0", "CC-BY-4.0,MIT")
