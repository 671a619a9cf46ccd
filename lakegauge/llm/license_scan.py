"""Licence notices in texts: Dice coefficient over word bigrams against templates.

Texts and templates are normalised to lower-cased words (runs of letters, digits and bytes beyond ASCII; punctuation and line breaks only part
words). A passage of a text matches a template when 2 * common / (bigrams of the passage + bigrams of the template) reaches the
threshold t, bigrams counted as often as they occur.

The coefficient bounds sizes: a passage must have between n * t / (2 - t) and n * (2 - t) / t bigrams for a template of n, and must have at
least the lower bound in common with it. So a template is only tried where that many of its bigrams lie within its upper bound.
A passage begins and ends with bigrams of the template, since cutting others off raises the coefficient. Of overlapping matches the one
with the highest coefficient stays (ties: the longer, the earlier, the template's name).

Null texts and texts with fewer than two words have no bigrams and no match; so have templates without bigrams. Repeated rows give repeated
matches. An empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from math import ceil, floor

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakegauge.llm.words import Words, find_words, pieces, text_buffer

_GAP = np.ones(256, bool)
_GAP[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
_BLOCK = 1 << 19

_GNU = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {kind} Public License as published by "
    "the Free Software Foundation, either version {version} of the License, or (at your option) any later version."
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
    "documentation and/or other materials provided with the distribution. "
)
_BSD_AS_IS = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED "
    "TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR "
    "CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, "
    "PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF "
    "LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS "
    "SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_FEE = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
_FEE_AS_IS = (
    "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF "
    "MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES "
    "WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF "
    "OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)

#: Notices by licence identifier; several wordings of one licence are templates of their own.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
        "writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, "
        "either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
        "\"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, "
        "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to "
        "the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions "
        "of the Software.",
    ),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    (
        "GPL-3.0-or-later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    *[(name, _GNU.format(kind=kind, version=version)) for name, kind, version in (
        ("GPL-2.0-or-later", "General", "2"), ("LGPL-2.1-or-later", "Lesser General", "2.1"), ("LGPL-3.0-or-later", "Lesser General", "3"),
        ("AGPL-3.0-or-later", "Affero General", "3"),
    )],
    (
        "MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this "
        "file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
    ("BSD-2-Clause", _BSD + _BSD_AS_IS),
    (
        "BSD-3-Clause",
        _BSD + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from "
        "this software without specific prior written permission. " + _BSD_AS_IS,
    ),
    ("0BSD", _FEE + "hereby granted. " + _FEE_AS_IS),
    (
        "ISC",
        _FEE + "hereby granted, provided that the above copyright notice and this permission notice appear in all copies. " + _FEE_AS_IS,
    ),
)


class Template:
    def __init__(self, name: str, text: str, threshold: float):
        raw = np.frombuffer(text.encode(), np.uint8)
        words = find_words(raw, np.array([0, len(raw)]), 1, lower=True, gap=_GAP)
        bigrams = words.sequences(2)
        self.name = name
        self.count = Counter(bigrams.tolist())
        self.size = len(bigrams)
        self.vocabulary = np.unique(bigrams)
        self.least = ceil(self.size * threshold / (2 - threshold) - 1e-9)
        self.most = floor(self.size * (2 - threshold) / threshold + 1e-9)

    def matches(self, at: np.ndarray, bigram: np.ndarray, doc: np.ndarray, threshold: float) -> Iterator[tuple]:
        """(coefficient, first bigram, bigrams) of all passages that reach the threshold; at: where the template's bigrams lie."""
        near = np.searchsorted(at, at + self.most) - np.arange(len(at))
        for i in np.flatnonzero(near >= self.least).tolist():
            used: Counter = Counter()
            common = 0
            for j in range(i, i + int(near[i])):
                if doc[j] != doc[i]:
                    break
                b = int(bigram[j])
                used[b] += 1
                common += used[b] <= self.count[b]
                size = int(at[j] - at[i]) + 1
                if size >= self.least and 2 * common >= threshold * (size + self.size) - 1e-9:
                    yield 2 * common / (size + self.size), int(at[i]), size


def _found(words: Words, templates: list[Template], threshold: float) -> list[tuple]:
    """(doc, name, coefficient, first word, words) of the matches that stay, in order of their place."""
    bigram = words.sequences(2)
    at = np.flatnonzero(words.inside(2))
    found = []
    for t in templates:
        if t.size:
            value = bigram[at]
            known = t.vocabulary[np.minimum(np.searchsorted(t.vocabulary, value), len(t.vocabulary) - 1)] == value
            own = at[known]
            found += [(-dice, -size, first, t.name) for dice, first, size in t.matches(own, bigram[own], words.doc[own], threshold)]
    taken: set[int] = set()
    out = []
    for dice, size, first, name in sorted(found):
        place = range(first, first - size + 1)
        if taken.isdisjoint(place):
            taken.update(place)
            doc = int(words.doc[first])
            out.append((doc, name, -dice, int(first - words.first[doc]), len(place)))
    return sorted(out, key=lambda m: (m[0], m[3]))


def scan(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = 0.85) -> DataFrame:
    """Matches in docs (doc_id, text): doc_id, license, dice, start_word, n_words and the matched text as it stands there."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = [Template(name, text, threshold) for name, text in templates]
        for batch in batches:
            raw, bounds = text_buffer(batch["text"])
            ids = batch["doc_id"]
            for a, b in pieces(bounds, _BLOCK):
                own = raw[bounds[a] : bounds[b]]
                words = find_words(own, bounds[a : b + 1] - bounds[a], 1, lower=True, gap=_GAP)
                found = _found(words, known, threshold)
                if found:
                    doc, name, dice, start, size = zip(*found)
                    first = words.first[list(doc)] + start
                    text = [own[words.start[i] : words.end[i + n - 1]].tobytes().decode() for i, n in zip(first, size)]
                    yield pa.RecordBatch.from_arrays(
                        [ids.take(pa.array([a + d for d in doc])), pa.array(name, pa.string()), pa.array(dice), pa.array(start, pa.int64()), pa.array(size, pa.int64()), pa.array(text, pa.string())],
                        ["doc_id", "license", "dice", "start_word", "n_words", "matched"],
                    )

    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return base.mapInArrow(task, "doc_id long, license string, dice double, start_word long, n_words long, matched string")
