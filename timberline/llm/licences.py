"""Licence scans: Dice coefficient over word bigrams against licence templates.

A text is compared as a whole, by paragraphs (cut at two line feeds), by lines and by runs of consecutive
lines, so that notices of several lines or paragraphs are found inside longer texts. Normalised words are
runs of letters and digits with A-Z lower-cased; a unit's set holds its distinct word bigrams. As
2 * |A and B| / (|A| + |B|) can't reach the threshold t unless the sizes lie within t / (2 - t) of each
other, templates of other sizes are never compared; nor are units that share no bigram with any.

Runs are sought where a text holds t / (2 - t) of a template's bigrams, and only those are compared whose
first line has a bigram of the template that the rest of the run lacks: any other run scores no less
without its first line.

Of matches that overlap, the one that shares the most bigrams stands, so that of notices that differ in a word the right
one is told, and a licence's text doesn't name what it quotes; a bare reservation of rights counts where nothing else is found.

Cases: null and empty texts, and units of fewer than two words, match nothing; of equal scores the licence
that shares more, then the one first in the alphabet is best; repeated rows each get a row; texts of any length are whole; extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import pkgutil
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import released
from .words import _LOWER, _TABLE, mixed, spans, text_blocks

#: A unit is under a licence at this score or above.
THRESHOLD = 0.8

#: The licence of a bare reservation of rights, which other licences' texts hold too.
BARE = "Proprietary"

# Notices and texts of licences, as published.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("Proprietary", "All rights reserved."),
)

#: Notices that are sought besides, and the licences whose texts are in ``licence_texts``.
NOTICES = (
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
)
TEXTS = ("Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "CC0-1.0", "GPL-2.0", "GPL-3.0", "ISC", "LGPL-2.1", "LGPL-3.0", "MIT", "MPL-2.0", "Unlicense", "Zlib")

#: Bytes outside words: ASCII but letters and digits.
_CUTS = np.ones(256, bool)
_CUTS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def _bigrams(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the word bigrams of a block, and the places where the first word starts and the second ends."""
    buf = _LOWER[np.frombuffer(raw, np.uint8)]
    inside = np.zeros(len(buf) + 2, bool)
    np.logical_not(_CUTS[buf], out=inside[1:-1])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edges[0::2], edges[1::2]
    words = spans(_TABLE[buf], start, end)
    return mixed(words[:-1] * np.uint64(0x9E3779B97F4A7C15) + words[1:]), start[:-1], end[1:]


def full_texts() -> tuple[tuple[str, str], ...]:
    return tuple((name, pkgutil.get_data(__package__, f"licence_texts/{name}.txt").decode()) for name in TEXTS)


class Templates:
    def __init__(self, templates: tuple[tuple[str, str], ...], threshold: float, more: tuple[tuple[str, str], ...] = ()):
        self.threshold = threshold
        self.sets = sorted((name, set(_bigrams(text.encode())[0].tolist())) for name, text in templates)
        self.known = np.array(sorted({b for _, s in self.sets for b in s}), np.uint64)
        #: for runs: all templates, their bigrams, which of these each has, and how many a run needs
        self.all = self.sets + sorted((name, set(_bigrams(text.encode())[0].tolist())) for name, text in more)
        self.sought = np.array(sorted({b for _, s in self.all for b in s}), np.uint64)
        self.has = np.array([[b in s for _, s in self.all] for b in self.sought.tolist()], bool).reshape(len(self.sought), len(self.all))
        self.need = np.array([max(1, int(np.ceil(threshold / (2 - threshold) * len(s) - 1e-9))) for _, s in self.all])

    def candidates(self, grams: np.ndarray, text_of: np.ndarray) -> Iterator[tuple[int, int]]:
        """Texts, and templates of which they hold bigrams enough for a run."""
        place = np.minimum(np.searchsorted(self.sought, grams), len(self.sought) - 1)
        hit = np.flatnonzero(self.sought[place] == grams)
        if not len(hit):
            return
        kinds = np.unique(text_of[hit] * np.int64(len(self.sought)) + place[hit])
        owner, place = kinds // len(self.sought), kinds % len(self.sought)
        texts, first = np.unique(owner, return_index=True)
        for i, a, b in zip(texts.tolist(), first.tolist(), [*first[1:].tolist(), len(owner)], strict=True):
            if b - a >= self.need.min():
                for t in np.flatnonzero(self.has[place[a:b]].sum(axis=0) >= self.need).tolist():
                    yield i, t

    def runs(self, t: int, grams: list[int], line: list[int], to_line: list[int]) -> tuple[tuple[float, int, int, int], set[int]]:
        """The best run of lines by template ``t`` (its score, the bigrams that it shares, its first line below 0 and its
        last), and the single lines that match, from a text's bigrams with the lines where they start and end."""
        template, need = self.all[t][1], self.need[t]
        largest = (2 - self.threshold) / self.threshold * len(template) + 1e-9
        hits = [p for p, g in enumerate(grams) if g in template]
        # for each hit, the line where its next occurrence in a later line ends
        later: dict[int, float] = {}
        ends: dict[int, float] = {}  # by line: the last line that a run from here may need
        k = len(hits)
        while k:
            first, at = k - 1, line[hits[k - 1]]
            while first and line[hits[first - 1]] == at:
                first -= 1
            ends[at] = max(later.get(grams[p], float("inf")) for p in hits[first:k])
            for p in reversed(hits[first:k]):
                later[grams[p]] = to_line[p]
            k = first
        best, single = (0.0, 0, 0, 0), set()
        for k, p in enumerate(hits):
            at = line[p]
            if k and line[hits[k - 1]] == at:
                continue
            if len(hits) - k < need:
                break
            first = p
            while first and line[first - 1] == at:
                first -= 1
            seen: set[int] = set()
            shared = 0
            for q in range(first, len(grams)):
                if to_line[q] > at and to_line[q] >= ends[at]:
                    break
                if grams[q] not in seen:
                    seen.add(grams[q])
                    shared += grams[q] in template
                    if len(seen) > largest:
                        break
                if shared >= need and (q + 1 == len(grams) or to_line[q + 1] > to_line[q]):
                    score = 2 * shared / (len(seen) + len(template))
                    if score >= self.threshold:
                        best = max(best, (score, shared, -at, to_line[q]))
                        if to_line[q] == at:
                            single.add(at)
        return best, single

    def of(self, unit: set[int]) -> list[tuple[float, str, int]]:
        """(score, licence, shared bigrams) of the templates that a unit matches."""
        out = []
        for name, template in self.sets:
            small, large = sorted((len(unit), len(template)))
            if 2 * small >= self.threshold * (small + large):
                shared = len(unit & template)
                score = 2 * shared / (small + large)
                if score >= self.threshold:
                    out.append((score, name, shared))
        return out


def told(matches: list[tuple[float, str, int, int, int]]) -> list[tuple[float, str, int, int, int]]:
    """Of matches (score, licence, shared bigrams, first line, last line) those that stand: of matches that overlap, the one
    that shares the most (then the better score, then the name); a bare reservation of rights only where nothing else is found."""
    taken: list[tuple[float, str, int, int, int]] = []
    for m in sorted(matches, key=lambda m: (-m[2], -m[0], m[1], m[3], m[4])):
        if all(m[4] < t[3] or t[4] < m[3] for t in taken):
            taken.append(m)
    others = [m for m in taken if m[1] != BARE]
    return others or taken


def _scanner(templates: tuple[tuple[str, str], ...], threshold: float, more: tuple[tuple[str, str], ...]):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Templates(templates, threshold, more)
        for batch in batches:
            best, score, units, names = [], [], [], []
            for first, last, texts in text_blocks(batch.column(1)):
                part = [t or b"" for t in texts]
                ends = np.cumsum([len(t) + 1 for t in part])
                raw = b"\x00".join(part)
                grams, at, to = _bigrams(raw)
                text_of = np.searchsorted(ends, at, side="right")
                within = to <= ends[text_of] - 1 if len(at) else np.zeros(0, bool)
                grams, at, to, text_of = grams[within], at[within], to[within], text_of[within]
                buf = np.frombuffer(raw, np.uint8)
                feeds = np.flatnonzero(buf == 10)
                pairs = feeds[:-1][np.diff(feeds) == 1] if len(feeds) else feeds
                if len(pairs):  # cuts at two line feeds take them from the left, two by two
                    taken, end = [], -1
                    for p in pairs.tolist():
                        if p >= end:
                            taken.append(p)
                            end = p + 2
                    pairs = np.array(taken)
                found: dict[int, list[tuple[float, str, int, int, int]]] = {}
                single_lines: dict[int, set[int]] = {}
                hit = np.flatnonzero(known.known[np.minimum(np.searchsorted(known.known, grams), len(known.known) - 1)] == grams)
                for level, cuts in enumerate((feeds, pairs, feeds[:0])):
                    if not len(hit):
                        break
                    unit = np.searchsorted(cuts, at, side="right")
                    whole = np.searchsorted(cuts, to, side="left") == unit  # not across a cut
                    key = text_of * np.int64(len(cuts) + 1) + unit
                    for k in np.unique(key[hit[whole[hit]]]).tolist():
                        a, b = np.searchsorted(key, [k, k + 1])
                        held = np.flatnonzero(whole[a:b]) + a
                        for value, name, shared in known.of(set(grams[held].tolist())):
                            i = k // (len(cuts) + 1)
                            lines = int(np.searchsorted(feeds, at[held[0]], side="right")), int(np.searchsorted(feeds, to[held[-1]], side="left"))
                            found.setdefault(i, []).append((value, name, shared, *lines))
                            if level == 0:
                                single_lines.setdefault(i, set()).add(lines[0])
                for i, t in known.candidates(grams, text_of):
                    a, b = np.searchsorted(text_of, [i, i + 1])
                    lines = [np.searchsorted(feeds, x[a:b], side=s).tolist() for x, s in ((at, "right"), (to, "left"))]
                    (value, shared, start, end), single = known.runs(t, grams[a:b].tolist(), *lines)
                    if value:
                        found.setdefault(i, []).append((value, known.all[t][0], shared, -start, end))
                        single_lines.setdefault(i, set()).update(single)
                for i in range(last - first):
                    matches = told(found.get(i, []))
                    top = min(((-v, -n_shared, n) for v, n, n_shared, _, _ in matches), default=(0.0, 0, None))
                    best.append(top[2])
                    score.append(-top[0] + 0.0)
                    units.append(len(single_lines.get(i, ())))
                    names.append(",".join(sorted({m[1] for m in matches})))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(best, pa.string()), pa.array(score, pa.float64()), pa.array(units, pa.int64()), pa.array(names, pa.string())],
                ["doc_id", "licence", "dice", "n_lines", "licences"],
            )

    return released(scan)


def scan(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = THRESHOLD, more: tuple[tuple[str, str], ...] | None = None) -> DataFrame:
    """doc_id, the best licence (null for none) and its score (0), the lines that match, and all licences found, for every row.

    ``more``: templates sought besides, by default NOTICES and the texts of the common licences."""
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    more = (*NOTICES, *full_texts()) if more is None else more
    return rows.mapInArrow(_scanner(templates, threshold, more), "doc_id bigint, licence string, dice double, n_lines bigint, licences string")
