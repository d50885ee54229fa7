"""License texts in documents: winnowed fingerprints pick candidates, banded alignment measures them."""

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

GRAM = 3
#: Grams of which the one with the smallest hash is a fingerprint.
WINNOW = 2
BAND = 4
LEAST_COVERAGE = 0.8
WORD = re.compile(r"\w+")

# Texts of public licenses, whole where they are short, else the notices that name them.
_MIT_GRANT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
    'files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, '
    "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software "
    "is furnished to do so, subject to the following conditions:"
)
_MIT_CONDITION = (
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
)
_MIT_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES '
    "OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE "
    "LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR "
    "IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_BSD_GRANT = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
    "conditions are met:"
)
_BSD_TWO = (
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer "
    "in the documentation and/or other materials provided with the distribution."
)
_BSD_THIRD = (
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived "
    "from this software without specific prior written permission."
)
_BSD_WARRANTY = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT '
    "NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL "
    "THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES "
    "(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS "
    "INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE "
    "OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_ISC_GRANT = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided "
    "that the above copyright notice and this permission notice appear in all copies."
)
_GNU_NOTICE = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the "
    "Free Software Foundation, either version {version} of the License, or (at your option) any later version."
)
TEMPLATES = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to "
        'in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY '
        "KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at",
    ),
    "GPL-3.0": (
        "licensed under the GNU General Public License, version 3", _GNU_NOTICE.format(name="General Public License", version=3),
    ),
    "GPL-2.0": (
        "licensed under the GNU General Public License, version 2", _GNU_NOTICE.format(name="General Public License", version=2),
    ),
    "LGPL-3.0": (
        "licensed under the GNU Lesser General Public License, version 3",
        _GNU_NOTICE.format(name="Lesser General Public License", version=3),
    ),
    "LGPL-2.1": (
        "licensed under the GNU Lesser General Public License, version 2.1",
        _GNU_NOTICE.format(name="Lesser General Public License", version=2.1),
    ),
    "AGPL-3.0": (
        "licensed under the GNU Affero General Public License, version 3",
        _GNU_NOTICE.format(name="Affero General Public License", version=3),
    ),
    "MIT": (
        "Released under the MIT License", "Licensed under the MIT License", _MIT_GRANT, _MIT_WARRANTY,
        " ".join((_MIT_GRANT, _MIT_CONDITION, _MIT_WARRANTY)),
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
        'files (the "Software"), to deal in the Software without restriction',
    ),
    "BSD": (_BSD_GRANT, _BSD_WARRANTY),
    "BSD-2-Clause": (f"{_BSD_GRANT} {_BSD_TWO}", f"{_BSD_GRANT} {_BSD_TWO} {_BSD_WARRANTY}"),
    "BSD-3-Clause": (f"{_BSD_GRANT} {_BSD_TWO} {_BSD_THIRD}", f"{_BSD_GRANT} {_BSD_TWO} {_BSD_THIRD} {_BSD_WARRANTY}"),
    "ISC": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", _ISC_GRANT),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with "
        "this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
    "CC-BY-NC-4.0": (
        "Licensed under CC BY-NC 4.0", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
    ),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    "CC-BY-4.0": ("Licensed under CC BY 4.0", "licensed under a Creative Commons Attribution 4.0 International License"),
    "CC0-1.0": ("dedicated to the public domain under CC0 1.0 Universal",),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, "
        "sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or "
        "non-commercial, and by any means.",
    ),
    "all rights reserved": ("All rights reserved",),
}
#: Words that tell licenses apart, beside numbers of versions. A passage has those of its license, and no other of these.
TELLING = ("nc", "sa", "nd", "noncommercial", "sharealike", "lesser", "affero", "neither", "gnu", "apache", "mozilla", "mit")


@dataclass
class Index:
    """The inverted index: fingerprint to the templates and places that have it."""

    names: list[str] = field(default_factory=list)
    words: list[list[int]] = field(default_factory=list)
    vocabulary: dict[str, int] = field(default_factory=dict)
    postings: dict[int, list[tuple[int, int]]] = field(default_factory=lambda: defaultdict(list))
    prints: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    #: Grams of templates too short for a fingerprint of their own; every gram of a document is looked up among these.
    short: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    #: Per template: how often it has each telling word or number.
    telling: list[dict[int, int]] = field(default_factory=list)
    telling_ids: frozenset[int] = frozenset()


def _grams(ids: np.ndarray) -> np.ndarray:
    """A hash of every three word numbers in a row."""
    out = np.zeros(max(0, len(ids) - GRAM + 1), np.uint64)
    for k in range(GRAM):
        out = (out ^ ids[k : len(ids) - GRAM + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(31)
    return out


def winnowed(ids: np.ndarray, grams: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints and their places: the smallest hash of every WINNOW grams in a row, the last of equals.

    Two texts that share WINNOW + GRAM - 1 words in a row share a fingerprint; fewer words have none.
    """
    grams = _grams(ids) if grams is None else grams
    if len(grams) < WINNOW:
        return grams[:0], np.zeros(0, np.int64)
    views = np.lib.stride_tricks.sliding_window_view(grams, WINNOW)
    places = np.unique(np.arange(len(views)) + WINNOW - 1 - np.argmin(views[:, ::-1], axis=1))
    return grams[places], places


def build_index(templates: dict[str, tuple[str, ...]]) -> Index:
    """Templates have GRAM words at least."""
    index, short = Index(), set()
    for name, texts in templates.items():
        for text in texts:
            words = WORD.findall(text.lower())
            if len(words) < GRAM:
                raise ValueError(f"a template of {name} has fewer than {GRAM} words")
            ids = [index.vocabulary.setdefault(w, len(index.vocabulary) + 1) for w in words]
            grams = _grams(np.array(ids, np.uint64))
            places = winnowed(np.array(ids, np.uint64), grams)[1]
            if len(ids) < WINNOW + GRAM - 1:
                places = np.arange(len(grams))
                short |= set(grams.tolist())
            for h, place in zip(grams[places].tolist(), places.tolist()):
                index.postings[h].append((len(index.names), place))
            index.names.append(name)
            index.words.append(ids)
            index.telling.append(Counter(i for w, i in zip(words, ids) if w in TELLING or w.isdigit()))
    index.prints = np.array(sorted(set(index.postings) - short), np.uint64)
    index.short = np.array(sorted(short), np.uint64)
    index.telling_ids = frozenset(index.vocabulary.setdefault(w, len(index.vocabulary) + 1) for w in TELLING)
    return index


def _tells(ids: list[int], wanted: dict[int, int], telling: frozenset[int]) -> bool:
    """Whether a passage has the telling words of a template, and no telling word beside them."""
    found = Counter(ids)
    return all(found[i] >= n for i, n in wanted.items()) and all(found[i] <= wanted.get(i, 0) for i in telling)


def align(template: list[int], ids: list[int], diagonal: int, band: int = BAND) -> tuple[int, int, int]:
    """The most template words in order found in the document near a diagonal: matches, first and last place.

    A longest common subsequence within ``band`` places of the diagonal.
    """
    width = 2 * band + 1
    best = [(0, -1, -1)] * (width + 1)  # per place in the band: matches, minus the first place, last place
    for i, word in enumerate(template):
        now = [(0, -1, -1)] * (width + 1)
        for k in range(width):
            j = i + diagonal - band + k
            above, left, corner = best[k + 1], now[k - 1] if k else (0, -1, -1), best[k]
            option = max(above, left, key=lambda x: (x[0], x[1]))
            if 0 <= j < len(ids) and ids[j] == word:
                found = (corner[0] + 1, corner[1] if corner[0] else -j, j)
                option = max(option, found, key=lambda x: (x[0], x[1]))
            now[k] = option
        best = now
    matches, first, last = max(best, key=lambda x: (x[0], x[1]))
    return matches, -first, last


def find(text: str, index: Index, least_coverage: float) -> list[tuple[str, int, int, float, int]]:
    """License passages of a text: name, begin, end (characters), coverage, matched words.

    Of passages that overlap the one with most matched words stays, of equals the better covered one.
    """
    spans, lowered = [], text.lower()
    if len(lowered) != len(text):  # a letter that becomes two would shift the places
        lowered = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    known = index.vocabulary
    words = WORD.findall(lowered)
    ids = np.array([known.get(w, 0) for w in words], np.uint64)
    grams = _grams(ids)
    prints, places = winnowed(ids, grams)
    places = np.union1d(places[np.isin(prints, index.prints)], np.flatnonzero(np.isin(grams, index.short)))
    if not len(places):
        return []
    bands = {}
    for h, place in zip(grams[places].tolist(), places.tolist()):
        for template, at in index.postings[h]:
            bands.setdefault((template, (place - at) // BAND), place - at)
    numbers, matches = ids.tolist(), set()
    for (template, _), diagonal in bands.items():
        n, first, last = align(index.words[template], numbers, diagonal)
        if n >= least_coverage * len(index.words[template]) and _tells(numbers[first : last + 1], index.telling[template], index.telling_ids):
            matches.add((n, first, last, template))
    if not matches:
        return []
    spans = [m.span() for m in WORD.finditer(lowered)]
    kept: list[tuple[int, int, int, int]] = []
    # The passage with most matched words first, of equals the better covered; what overlaps it belongs to it.
    for n, first, last, template in sorted(matches, key=lambda m: (-m[0], -m[0] / len(index.words[m[3]]), m[1], m[3])):
        if all(last < f or first > l for _, f, l, _ in kept):
            kept.append((n, first, last, template))
    return [
        (index.names[t], spans[first][0], spans[last][1], n / len(index.words[t]), n) for n, first, last, t in sorted(kept, key=lambda m: m[1])
    ]


def _scan(batches: Iterator[pa.RecordBatch], index: Index, least_coverage: float) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "license", "begin", "end", "coverage", "n_words"]
    kinds = [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.float64(), pa.int32()]
    for batch in batches:
        rows = [
            (doc_id, *found)
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()) if text
            for found in find(text, index, least_coverage)
        ]
        columns = list(zip(*rows)) if rows else [[] for _ in names]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)


def scan(
    docs: DataFrame, templates: dict[str, tuple[str, ...]] | None = None, least_coverage: float = LEAST_COVERAGE
) -> DataFrame:
    """One row per license passage: doc_id, license, begin, end (characters of the text), coverage, n_words.

    A passage needs a fingerprint in common with a template, that is four of its words in a row (all three, if it has no
    more), ``least_coverage`` of the template's words in order within a band of BAND words, and the template's telling words
    and numbers with no other telling word among them. Null and empty texts have none. Repeated rows are scanned each. The index of the templates, a
    parameter, travels with the tasks; no shuffle.
    """
    index = build_index(templates or TEMPLATES)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(
        lambda batches: _scan(batches, index, least_coverage),
        "doc_id long, license string, begin int, end int, coverage double, n_words int",
    )
