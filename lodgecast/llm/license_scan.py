"""License scan: winnowed fingerprints of notice templates pick candidates, a banded alignment reports the match.

Texts and templates are compared as words: lower case, outer punctuation removed. Of the hashes of all three-word runs,
the smallest in every ``WINNOW`` neighbours is a fingerprint, so a shared passage of ``RUN + WINNOW - 1`` words always
shares one. Templates shorter than that are looked up in all runs of a text, so that a line of ``RUN`` words is found
wherever it stands. The inverted index holds the fingerprints of all templates; a text's hits on one template that lie on
near diagonals are one candidate, which an alignment within a band around these diagonals accepts or not.

Null and empty texts match nothing. Every match is a row: the same notice twice in a text gives two rows, repeated rows
of the input repeat, a null id stays null. Other columns are ignored. Templates are a parameter; they are code, not data.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodgecast.llm.words import first_minima, rolling, rows, word_hashes

RUN = 3
WINNOW = 3
BAND = 6
COVERAGE_PERCENT = 80

#: Public license notices, as they are written into files.
TEMPLATES: dict[str, str] = {
    "Apache-2.0 line": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 notice": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
        "compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software "
        "distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY "
        "KIND, either express or implied. See the License for the specific language governing permissions and "
        "limitations under the License."
    ),
    "MIT line": "Released under the MIT License.",
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without "
        "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
        "Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
        "conditions: The above copyright notice and this permission notice shall be included in all copies or "
        "substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, "
        "EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR "
        "PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, "
        "DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN "
        "CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "GPL-3.0 line": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-or-later notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY "
        "WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the "
        "GNU General Public License for more details."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies."
    ),
    "BSD conditions": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met: Redistributions of source code must retain the above copyright notice, this "
        "list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above "
        "copyright notice, this list of conditions and the following disclaimer in the documentation and/or other "
        "materials provided with the distribution."
    ),
    "MPL-2.0 notice": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was "
        "not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."
    ),
    "CC-BY-NC-4.0 line": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0 line": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "All rights reserved line": "All rights reserved.",
    "All rights reserved": "Copyright. All rights reserved. No part may be reproduced without permission.",
}

_OUTER = b".,;:!?\"'()[]{}*#%$&|<>"
MATCH_SCHEMA = "doc_id long, template string, matched long, coverage double, first_word long, end_word long"


def normal_words(text: str | None) -> list[bytes]:
    """Lower-case words without outer punctuation; one entry for each white-space word, so places stay comparable."""
    return [w.strip(_OUTER) for w in text.encode().lower().split()] if text else []


def winnowed(runs: np.ndarray) -> np.ndarray:
    """Places of the fingerprints among the hashes of all runs of a text."""
    return np.unique(first_minima(runs, min(WINNOW, len(runs)))) if len(runs) else np.zeros(0, np.int64)


def aligned(template: list[bytes], text: list[bytes], low: int, high: int) -> tuple[int, int, int]:
    """Most words of the template matched in order, within text place minus template place in [low, high], and the
    span [first, end) of the text over which that happens."""
    width = high - low + 1
    best = [(0, 0, 0)] * width  # matched, minus the first place, minus the end: of ties the earliest, shortest span
    for i, word in enumerate(template):
        row = []
        for k in range(width):
            j = i + low + k
            found = best[k + 1] if k + 1 < width else (0, 0, 0)  # the template word is skipped
            if k and row[k - 1] > found:
                found = row[k - 1]  # the text word is skipped
            if 0 <= j < len(text) and text[j] == word:
                n, first, _ = best[k]
                hit = (n + 1, first if n else -j, -(j + 1))
                found = max(found, hit)
            row.append(found)
        best = row
    n, first, end = max(best)
    return n, -first, -end


class Index:
    """Inverted index from fingerprints to template places."""

    def __init__(self, templates: Mapping[str, str], coverage_percent: int):
        self.coverage = coverage_percent
        self.templates = [(name, normal_words(body)) for name, body in templates.items()]
        postings: dict[int, list[tuple[int, int]]] = defaultdict(list)
        short: set[int] = set()
        for t, (_, words) in enumerate(self.templates):
            runs = rolling(word_hashes(words), RUN)
            for place in winnowed(runs).tolist():
                postings[int(runs[place])].append((t, place))
                if len(words) < RUN + WINNOW - 1:
                    short.add(int(runs[place]))
        self.postings = dict(postings)
        self.known = np.array(sorted(self.postings), np.uint64)
        self.short = np.array(sorted(short), np.uint64)

    def find(self, text: str | None) -> list[tuple[str, int, float, int, int]]:
        words = normal_words(text)
        runs = rolling(word_hashes(words), RUN)
        chosen = winnowed(runs)
        hit = np.union1d(chosen[np.isin(runs[chosen], self.known)], np.flatnonzero(np.isin(runs, self.short)))
        diagonals: dict[int, set[int]] = defaultdict(set)
        for h, place in zip(runs[hit].tolist(), hit.tolist(), strict=True):
            for t, at in self.postings[h]:
                diagonals[t].add(place - at)
        found = []
        for t, seen in diagonals.items():
            name, body = self.templates[t]
            group: list[int] = []
            spans = set()
            for d in [*sorted(seen), None]:
                if group and (d is None or d - group[-1] > BAND):
                    n, first, end = aligned(body, words, group[0] - BAND, group[-1] + BAND)
                    if 100 * n >= self.coverage * len(body) and (first, end) not in spans:
                        spans.add((first, end))
                        found.append((name, n, n / len(body), first, end))
                    group = []
                group.append(d)
        return found


def license_scan(
    docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, coverage_percent: int = COVERAGE_PERCENT,
    doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """doc_id, template, matched words, coverage of the template, and the span of words [first_word, end_word)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = Index(templates, coverage_percent).find
        names = [part.split()[0] for part in MATCH_SCHEMA.split(", ")]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]
        for batch in batches:
            out = [(id_, *match) for id_, body in rows(iter([batch])) for match in find(body)]
            columns = zip(*out, strict=True) if out else ((),) * 6
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names
            )

    return docs.select(F.col(doc_id).cast("long"), F.col(text)).mapInArrow(run, MATCH_SCHEMA)
