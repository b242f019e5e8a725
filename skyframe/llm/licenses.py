"""License scans: winnowed fingerprints of templates in an inverted index pick candidates, a banded word alignment reports coverage and spans.

The index holds the templates only, a table of fixed size that goes to every task. Whole texts are scanned where they lie: every word window of a
text is looked up, hits are gathered along diagonals, and each gathering is aligned with its template within a band, so edited notices are found
with the characters they take up. Nothing is shuffled and no pair of documents is formed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GRAM = 3
WINDOW = 2
BAND = 12
COVERAGE = 0.8
WORD = re.compile(r"[^\W_]+")
SEED = 42

# Notices as their licenses state or recommend them.
TEMPLATES = {
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0 header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the
        License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in
        writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either
        express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "MIT notice": "Released under the MIT License",
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the
        "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish,
        distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the
        following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
        Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
        MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY
        CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE
        SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "GPL-3.0 notice": "This work is licensed under the GNU General Public License, version 3",
    "GPL-3.0-or-later header": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public
        License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is
        distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR
        A PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
        conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
        disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer
        in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its
        contributors may be used to endorse or promote products derived from this software without specific prior written permission.""",
    "CC-BY-NC-4.0 notice": "Licensed under CC BY-NC 4.0",
    "CC-BY-4.0 notice": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "CC0 notice": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",
}


def words_of(text: str) -> list[str]:
    return [w.lower() for w in WORD.findall(text)]


def winnowed(words: list[str], gram: int = GRAM, window: int = WINDOW) -> list[int]:
    """Places of the fingerprints: in every `window` windows of `gram` words the one of least hash, the last of equals."""
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i:i + gram]), SEED) for i in range(len(words) - gram + 1)]
    if len(hashes) <= window:
        return [min(range(len(hashes)), key=lambda i: (hashes[i], -i))] if hashes else []
    return sorted({min(range(i, i + window), key=lambda j: (hashes[j], -j)) for i in range(len(hashes) - window + 1)})


@dataclass(frozen=True)
class Index:
    """Templates as word numbers, the number of every word, and the inverted index from the fingerprints' words to (template, place)."""

    names: tuple[str, ...]
    words: tuple[np.ndarray, ...]
    number: Mapping[str, int]
    places: Mapping[tuple[int, ...], list[tuple[int, int]]]
    gram: int

    @staticmethod
    def of(templates: Mapping[str, str], gram: int = GRAM, window: int = WINDOW) -> Index:
        """Templates shorter than a window can't be found and are refused."""
        number: dict[str, int] = {}
        places: dict[tuple[int, ...], list[tuple[int, int]]] = {}
        rows = []
        for k, (name, text) in enumerate(templates.items()):
            words = words_of(text)
            if len(words) < gram:
                raise ValueError(f"template {name} has fewer than {gram} words")
            rows.append(np.array([number.setdefault(w, len(number)) for w in words], dtype=np.int64))
            for i in winnowed(words, gram, window):
                places.setdefault(tuple(rows[-1][i:i + gram].tolist()), []).append((k, i))
        return Index(tuple(templates), tuple(rows), number, places, gram)


def align(template: np.ndarray, text: np.ndarray, shift: int, band: int = BAND) -> tuple[int, int, int]:
    """(matched words, first and last place in the text) of the best common subsequence whose diagonals are within the band of `shift`.

    Of alignments with as many matches the one with the fewest text words between the first and the last is taken.
    """
    width = 2 * band + 1
    # per diagonal the matches so far, minus the text place where they began in a fraction: later starts win ties
    best, start = np.zeros(width), np.full(width, -1, dtype=np.int64)
    top, found = 0.0, (0, -1, -1)
    for i, word in enumerate(template.tolist()):
        places = i + shift - band + np.arange(width)
        inside = (places >= 0) & (places < len(text))
        same = np.zeros(width, dtype=bool)
        same[inside] = text[places[inside]] == word
        # skip a template word: the diagonal above; skip a text word: from the left
        from_above, above_start = np.append(best[1:], -1.0), np.append(start[1:], -1)
        take = np.where(same, best + 1, -1.0)
        begun = np.where(start < 0, places, start)
        new, new_start = np.where(take > from_above, take, from_above), np.where(take > from_above, begun, above_start)
        equal = (take == from_above) & same
        new_start = np.where(equal, np.maximum(begun, above_start), new_start)
        hits = np.flatnonzero(same & (take >= new))
        for d in hits.tolist():
            span = int(places[d] - new_start[d])
            score = new[d] - span / (4.0 * (len(text) + 1))
            if score > top:
                top, found = score, (int(new[d]), int(new_start[d]), int(places[d]))
        run, run_start = new.copy(), new_start.copy()
        for d in range(1, width):
            if run[d - 1] > run[d] or run[d - 1] == run[d] and run_start[d - 1] > run_start[d]:
                run[d], run_start[d] = run[d - 1], run_start[d - 1]
        best, start = np.maximum(run, 0), np.where(run > 0, run_start, -1)
    return found


def scan(text: str | None, index: Index, band: int = BAND, coverage: float = COVERAGE) -> list[tuple[str, int, int, float, int, int]]:
    """(template, matched words, its words, coverage, start, end) by start: every place where at least `coverage` of a template stands.

    Characters are code points, the end exclusive. Of overlapping places of one template the one with most matched words, then the first, is told.
    """
    if not text:
        return []
    found = WORD.findall(text)
    number = index.number.get
    numbers = np.fromiter((number(w.lower(), -1) for w in found), dtype=np.int64, count=len(found))
    known = numbers >= 0
    whole = known[: max(0, len(found) - index.gram + 1)].copy()
    for k in range(1, index.gram):
        whole &= known[k:len(whole) + k]
    hits: dict[int, list[int]] = {}
    for i in np.flatnonzero(whole).tolist():
        for k, place in index.places.get(tuple(numbers[i:i + index.gram].tolist()), ()):
            hits.setdefault(k, []).append(i - place)
    if not hits:
        return []
    out = []
    offsets: list[tuple[int, int]] | None = None
    for k, shifts in hits.items():
        template, told = index.words[k], []
        own = np.bincount(template, minlength=len(index.number))
        shifts = sorted(set(shifts))
        groups = [[shifts[0]]]
        for s in shifts[1:]:
            if s - groups[-1][0] > band:
                groups.append([])
            groups[-1].append(s)
        for group in groups:
            shift = (group[0] + group[-1]) // 2
            open_parts = [(max(0, group[0] - band), min(len(numbers), group[-1] + len(template) + band))]
            while open_parts:  # one place per alignment; what is left of the group lies before and behind it
                lo, hi = open_parts.pop()
                part = numbers[lo:hi]
                if np.minimum(own, np.bincount(part[part >= 0], minlength=len(own))).sum() < coverage * len(template):
                    continue  # not enough of the template's words stand here, in whatever order
                matched, first, last = align(template, part, shift - lo, band)
                if matched >= coverage * len(template):
                    told.append((-matched, lo + first, lo + last))
                    open_parts += [(lo, lo + first), (lo + last + 1, hi)]
        taken: list[tuple[int, int]] = []
        for minus, first, last in sorted(told):
            if all(last < a or first > b for a, b in taken):
                taken.append((first, last))
                offsets = offsets or [m.span() for m in WORD.finditer(text)]
                out.append((index.names[k], -minus, len(template), -minus / len(template), offsets[first][0], offsets[last][1]))
    return sorted(out, key=lambda r: (r[4], r[0]))


def scan_licenses(docs: DataFrame, templates: Mapping[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text", band: int = BAND,
                  coverage: float = COVERAGE, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """One row per place where a template stands: doc_id, license, matched_words, template_words, coverage, start, end.

    Texts without a notice, null and empty ones give no row. Rows without an id and repeated rows give rows of their own; other columns are not read.
    """
    index = Index.of(TEMPLATES if templates is None else templates, gram, window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(key, *r) for key, text in zip(batch.column(0).to_pylist(), batch.column(1)) for r in scan(text.as_py(), index, band, coverage)]
            kinds = [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.float64(), pa.int32(), pa.int32()]
            columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "license", "matched_words", "template_words", "coverage", "start", "end"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, license string, matched_words int, template_words int, coverage double, start int, end int")
