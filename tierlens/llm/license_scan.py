"""License scans (operator 5): common word runs pick candidates, banded alignment measures them.

Licence templates are bounded reference texts.  Their words are numbered; every run of ``GRAM`` words of a long template
is kept in an inverted index that is broadcast.  A document is cut into words once; only runs of words that templates
know can hold a match, so only those are looked up.  Short templates need not keep any run whole: there every word
votes for the place where the template would start.  A candidate suggests a template and an offset; a banded alignment
around it reports which template words occur, in order, and the span they cover.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# a fifth of more than SHORT words and a band's insertions leave a run of GRAM words whole; shorter templates go by words
GRAM, WINDOW, SHORT = 3, 3, 20
_WORD = re.compile(r"\w+")

# fixed values: licence notices as their stewards publish them, by SPDX name
TEMPLATES = {
    "MIT-notice": "Released under the MIT License",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0",
    "CC-BY-4.0-notice": "Licensed under a Creative Commons Attribution 4.0 International License",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3",
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance "
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless "
        "required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        "\"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the "
        "specific language governing permissions and limitations under the License."),
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
        "permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright "
        "notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    "BSD-2-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: Redistributions of source code must retain the above copyright notice, this list of "
        "conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, "
        "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
        "distribution."),
    "GPL-3.0-or-later": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later "
        "version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the "
        "implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
}


def winnow(hashes: list[int], window: int = WINDOW) -> list[int]:
    """Places of the smallest hash of every window, the rightmost of equals."""
    out = []
    for s in range(max(1, len(hashes) - window + 1) if hashes else 0):
        part = hashes[s:s + window]
        low = min(part)
        at = s + len(part) - 1 - part[::-1].index(low)
        if not out or out[-1] != at:
            out.append(at)
    return out


class Index:
    """Template words by number, and fingerprint -> [(template, place)]."""

    def __init__(self, templates: dict[str, str]):
        self.names = sorted(templates)
        self.number: dict[str, int] = {}
        self.words = [[self.number.setdefault(w, len(self.number) + 1) for w in _WORD.findall(templates[n].lower())] for n in self.names]
        self.prints: dict[tuple[int, ...], list[tuple[int, int]]] = {}
        self.votes: dict[int, list[tuple[int, int]]] = {}
        for t, words in enumerate(self.words):
            if len(words) <= SHORT:
                for at, w in enumerate(words):
                    self.votes.setdefault(w, []).append((t, at))
            else:
                for at, gram in enumerate(zip(*[words[k:] for k in range(GRAM)])):
                    self.prints.setdefault(gram, []).append((t, at))

    @staticmethod
    def band(template: list[int]) -> int:
        return max(2, len(template) // 8)

    def candidates(self, words: list[int], least: float) -> dict[int, list[int]]:
        """Template -> sorted document places where the template would start."""
        found: dict[int, set[int]] = {}
        cast: dict[int, list[tuple[int, int]]] = {}
        end, n = 0, len(words)
        while end < n:
            if not words[end]:
                end += 1
                continue
            start = end
            while end < n and words[end]:
                for t, place in self.votes.get(words[end], ()):
                    cast.setdefault(t, []).append((end - place, place))
                end += 1
            for at in range(start, end - GRAM + 1):
                for t, place in self.prints.get(tuple(words[at:at + GRAM]), ()):
                    found.setdefault(t, set()).add(at - place)
        for t, votes in cast.items():
            starts = self.supported(votes, least * len(self.words[t]), self.band(self.words[t]))
            if starts:
                found[t] = starts
        return {t: sorted(starts) for t, starts in found.items()}

    @staticmethod
    def supported(votes: list[tuple[int, int]], least: float, band: int) -> set[int]:
        """Starts around which, at most ``band`` away, at least ``least`` different template words vote."""
        if len(votes) < least:
            return set()
        votes = sorted(votes)
        out, held, low, high = set(), {}, 0, 0
        for start, _ in votes:
            while high < len(votes) and votes[high][0] <= start + band:
                held[votes[high][1]] = held.get(votes[high][1], 0) + 1
                high += 1
            while votes[low][0] < start - band:
                place = votes[low][1]
                held[place] -= 1
                if not held[place]:
                    del held[place]
                low += 1
            if len(held) >= least:
                out.add(start)
        return out

    def matches(self, words: list[int], least: float) -> list[tuple[str, int, int, int, int]]:
        """(name, matched, of, first, last): alignments that cover at least ``least`` of a template, by place."""
        out = []
        for t, starts in self.candidates(words, least).items():
            template, done = self.words[t], -1
            band = self.band(template)
            i = 0
            while i < len(starts):
                j = i
                while j + 1 < len(starts) and starts[j + 1] - starts[j] <= band:
                    j += 1  # offsets this close belong to one occurrence
                low, high = starts[i] - band, starts[j] + band
                matched, first, last = align(template, words, low, high)
                if matched >= least * len(template) and first > done:
                    out.append((self.names[t], matched, len(template), first, last))
                    done = last
                i = j + 1
        return sorted(out, key=lambda m: (m[3], m[0]))


def align(template: list[int], words: list[int], low: int, high: int) -> tuple[int, int, int]:
    """(matched, first, last): most template words found in order, at diagonals ``low`` to ``high``.

    Row i of the band holds template word i against document words i + low .. i + high; of equal counts the shorter
    span wins.  (0, -1, -1) without a match.
    """
    width = high - low + 1
    before = [(0, 0, -1)] * (width + 1)  # (matched, minus the span's first place, last place)
    for i, w in enumerate(template):
        row = [(0, 0, -1)] * (width + 1)
        best_left = (0, 0, -1)
        for d in range(width):
            j = i + low + d
            cell = max(best_left, before[d + 1])
            if 0 <= j < len(words) and words[j] == w:
                n, first, _ = before[d]  # the diagonal ended one word earlier in both
                cell = max(cell, (n + 1, first if n else j, j), key=lambda c: (c[0], c[1] - c[2]))
            row[d] = best_left = cell
        before = row
    matched, first, last = max(before, key=lambda c: (c[0], c[1] - c[2]))
    return (matched, first, last) if matched else (0, -1, -1)


def _scan(shared, least: float):
    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        number = index.number.get
        for batch in batches:
            rows, found = [], []
            for i, text in enumerate(batch.column(1)):
                text = text.as_py() or ""
                words = [number(w, 0) for w in _WORD.findall(text.lower())]
                matches = index.matches(words, least)
                if matches:
                    spans = [m.span() for m in _WORD.finditer(text)]
                    for name, n, of, first, last in matches:
                        rows.append(i)
                        found.append((name, n / of, first, last, spans[min(first, len(spans) - 1)][0], spans[min(last, len(spans) - 1)][1]))
            kinds = (pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), *[pa.array([f[k] for f in found], kind) for k, kind in enumerate(kinds)]],
                ["id", "license", "coverage", "first_word", "last_word", "start", "end"])

    return compute


def scan_licenses(docs: DataFrame, id_column: str = "doc_id", text: str = "text", templates: dict[str, str] | None = None, coverage: float = 0.8) -> DataFrame:
    """(id, license, coverage, first_word, last_word, start, end), a row per match; start and end count characters.

    NULL and empty texts match nothing; repeated rows repeat their matches; one text may match several templates and
    one template several times.  Case and punctuation do not matter.  Texts are scanned whole.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Index(templates or TEMPLATES))
    rows = docs.select(F.col(id_column).alias("id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(
        _scan(shared, coverage),
        f"id {rows.schema['id'].dataType.simpleString()}, license string, coverage double, first_word long, last_word long, start long, end long")
