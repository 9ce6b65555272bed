"""Licence texts in documents, by the Dice coefficient of word bigrams.

Texts are normalised to lower-case words (ASCII case folded, marks dropped). Each whole text, each
paragraph and each line is compared, as a set of bigrams, with every template:
2 |A and B| / (|A| + |B|). A template can only reach the threshold t if its size is within
t / (2 - t) times and (2 - t) / t times that of the unit, and a unit only if enough of its bigrams occur in any
template; texts without enough distinct bigrams of any template are passed over, and the size bounds are
checked on the counts before any set is built.

A licence that none of these units shows is sought in every run of consecutive words of the text, over
lines and paragraphs: the run most similar to a template counts. Only texts that hold enough distinct
bigrams of a template are searched. A best run starts and ends with a bigram of the template, its first
bigram doesn't come again in it, and few of its bigrams are foreign, so every such run is looked at.

The templates are a bounded table in the code or given by the caller and travel with the tasks. A
text is worked on by itself: no shuffle, nothing shared, and a lost executor costs its tasks only.

Defined results: null and empty texts, and units of fewer than two words, match nothing; of equal
similarities for one licence the first unit counts, whole texts before paragraphs before lines, and
runs only where these show no such licence;
repeated rows get equal results; other columns pass through, those named like the output are
replaced; an empty table stays empty; without templates nothing matches.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..session import map_arrow
from .bpe import schema_with, with_column
from .license_texts import COMMON
from .text import Words, lower_ascii, text_slices, window_hashes, words_of

THRESHOLD = 0.9

#: Notices and licence texts by their SPDX names; callers extend them by TEMPLATES + [(name, text)].
TEMPLATES: list[tuple[str, str]] = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by
applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES
OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations
under the License."""),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General
Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a
copy of the GNU General Public License along with this program. If not, see http://www.gnu.org/licenses/."""),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS"
AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.
IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING
FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN
CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use,
copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software
is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in
all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO
EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT,
TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("MPL-2.0", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was
not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."""),
    ("proprietary", "All rights reserved."),
    *COMMON,
]

UNITS = ("text", "paragraph", "line", "run")


def word_bytes() -> np.ndarray:
    """Kind of each byte: 1 for letters, digits and all beyond ASCII, 0 for the rest."""
    table = np.zeros(256, dtype=np.uint8)
    for low, high in ((48, 58), (65, 91), (97, 123), (128, 256)):
        table[low:high] = 1
    return table


class Templates:
    def __init__(self, texts: list[tuple[str, str]], threshold: float):
        self.names = [name for name, _ in texts]
        self.threshold = threshold
        self.sets = [np.unique(bigrams_of(text)) for _, text in texts]
        self.all = np.unique(np.concatenate([np.zeros(0, dtype=np.uint64), *self.sets]))
        sizes = [len(s) for s in self.sets if len(s)]
        bound = threshold / (2 - threshold)
        self.least = min(sizes) * bound if sizes else np.inf  # fewest shared bigrams that can be enough
        self.needs = np.array([max(len(s) * bound, 1) for s in self.sets]) - 1e-9  # the same of each template
        self.holds = np.stack([is_in(self.all, s) for s in self.sets], axis=1) if self.sets else np.zeros((0, 0), dtype=bool)


def bigrams_of(text: str) -> np.ndarray:
    data = np.frombuffer(text.encode(), dtype=np.uint8)
    words = words_of(0, data, np.array([0, len(data)]), word_bytes(), lower_ascii())
    return window_hashes(words.hashes, 2)


def is_in(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(values), dtype=bool)
    at = np.minimum(np.searchsorted(known, values), len(known) - 1)
    return known[at] == values


def unit_starts(words: Words, unit: str) -> np.ndarray:
    """Number of the unit that each word is in; units never cross texts and count up."""
    text = np.repeat(np.arange(len(words.counts)), words.counts)
    if unit == "text":
        return text
    feeds = np.flatnonzero(words.data == 10)
    line = np.searchsorted(feeds, words.starts)
    new = np.zeros(len(text), dtype=bool)
    if len(new):
        new[0] = True
        new[1:] = text[1:] != text[:-1]
        if unit == "line":
            new[1:] |= line[1:] != line[:-1]
        else:  # two line feeds or more with nothing but blanks between them
            step = np.flatnonzero(line[1:] - line[:-1] > 1) + 1
            ink = np.cumsum(words.data > 32)
            for w in step.tolist():
                lines = feeds[line[w - 1] : line[w]]
                new[w] |= bool((ink[lines[1:]] == ink[lines[:-1]]).any())
    return np.cumsum(new) - 1


def matches(words: Words, known: Templates):
    """(text, unit kind, place of the unit in its text, template, similarity) at the threshold or over it."""
    n = len(words.hashes)
    if n < 2:
        return
    pairs = window_hashes(words.hashes, 2)
    text = np.repeat(np.arange(len(words.counts)), words.counts)
    hits = is_in(pairs, known.all)
    within = text[1:] == text[:-1]
    promising = candidate_texts(text[:-1][within & hits], pairs[within & hits], known)
    if not promising:
        return
    texts = np.zeros(len(words.counts), dtype=bool)
    texts[[t for t, _ in promising]] = True
    of_template = {template for _, template in promising}
    bound = known.threshold / (2 - known.threshold)
    seen = set()
    for kind, unit in enumerate(UNITS[:3]):
        number = unit_starts(words, unit)
        inside = number[1:] == number[:-1]
        shared = np.bincount(number[:-1][inside & hits], minlength=number[-1] + 1)
        heads = np.searchsorted(number, np.arange(number[-1] + 1))
        candidates = (shared >= known.least) & texts[text[heads]]
        if not candidates.any():
            continue
        take = inside & candidates[number[:-1]]
        of, values = number[:-1][take], pairs[take]
        order = np.lexsort((values, of))
        of, values = of[order], values[order]
        first = np.concatenate([[True], (of[1:] != of[:-1]) | (values[1:] != values[:-1])])
        of, values = of[first], values[first]
        sizes = np.bincount(of, minlength=number[-1] + 1)
        first_of_text = number[np.minimum(words.text_starts[:-1], n - 1)]
        for template, content in enumerate(known.sets):
            if template not in of_template:
                continue
            fits = (sizes >= bound * len(content)) & (sizes * bound <= len(content)) & (sizes > 0)
            if not len(content) or not fits.any():
                continue
            chosen = fits[of]
            common = np.bincount(of[chosen][is_in(values[chosen], content)], minlength=len(sizes))
            similarity = 2 * common / np.maximum(sizes + len(content), 1)
            for u in np.flatnonzero(fits & (similarity >= known.threshold)).tolist():
                t = int(text[heads[u]])
                seen.add((t, known.names[template]))
                yield t, kind, u - int(first_of_text[t]), template, float(similarity[u])
    for t, template in promising:
        if (t, known.names[template]) not in seen:
            low, high = words.text_starts[t : t + 2]
            similarity, place = best_run(pairs[low : high - 1], known.sets[template], known.threshold)
            if similarity >= known.threshold:
                yield t, len(UNITS) - 1, place, template, similarity


def candidate_texts(text: np.ndarray, values: np.ndarray, known: Templates) -> list[tuple[int, int]]:
    """(text, template) where the text has enough distinct bigrams of the template; ``values`` are bigrams of any."""
    if not len(values):
        return []
    keys = np.unique(text * len(known.all) + np.searchsorted(known.all, values))
    of = keys // len(known.all)
    heads = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
    shared = np.add.reduceat(known.holds[keys % len(known.all)], heads, axis=0, dtype=np.int32)
    rows, templates = np.nonzero(shared >= known.needs)
    return list(zip(of[heads[rows]].tolist(), templates.tolist()))


def best_run(pairs: np.ndarray, content: np.ndarray, threshold: float) -> tuple[float, int]:
    """Similarity and first word of the run of a text's bigrams that is most like ``content``."""
    n, size = len(pairs), len(content)
    order = np.argsort(pairs, kind="stable")
    same = pairs[order[1:]] == pairs[order[:-1]]
    before, after = np.full(n, -1), np.full(n, n)
    before[order[1:][same]], after[order[:-1][same]] = order[:-1][same], order[1:][same]
    hit = is_in(pairs, content)
    left = np.cumsum((hit & (after == n))[::-1])[::-1]  # distinct bigrams of the template from here on
    best, place = 0.0, 0
    for start in np.flatnonzero(hit & (left >= size * threshold / (2 - threshold) - 1e-9)).tolist():
        at, distinct, common = start, 0, 0
        while at < after[start] and common < size and threshold * (distinct - common) <= 2 * size * (1 - threshold) + 1e-9:
            end = min(int(after[start]), at + 2 * size)
            new = before[at:end] < start
            sizes, commons = distinct + np.cumsum(new), common + np.cumsum(new & hit[at:end])
            similarity = 2 * commons / (sizes + size)
            k = int(np.argmax(similarity))
            if similarity[k] > best:
                best, place = float(similarity[k]), start
            at, distinct, common = end, int(sizes[-1]), int(commons[-1])
    return best, place


FOUND = T.ArrayType(
    T.StructType([
        T.StructField("license", T.StringType()), T.StructField("similarity", T.DoubleType()),
        T.StructField("unit", T.StringType()), T.StructField("place", T.IntegerType()),
    ])
)
_ARROW = pa.list_(pa.struct([("license", pa.string()), ("similarity", pa.float64()), ("unit", pa.string()), ("place", pa.int32())]))


def with_licenses(
    docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD, text: str = "text", out: str = "licenses"
) -> DataFrame:
    """``docs`` with the licences found in each text, by name: the best similarity, the unit it was
    found in ('text', 'paragraph', 'line' or 'run') and the number of that unit among those with words,
    of a run that of its first word in the text."""

    def run(batches):
        known, kinds, fold = Templates(templates, threshold), word_bytes(), lower_ascii()
        for batch in batches:
            best: dict[int, dict[str, tuple]] = {}
            for first, data, offsets in text_slices(batch.column(batch.schema.get_field_index(text))):
                words = words_of(first, data, offsets, kinds, fold)
                for t, kind, place, template, similarity in matches(words, known):
                    of, name = best.setdefault(first + t, {}), known.names[template]
                    if name not in of or (-similarity, kind, place) < of[name]:
                        of[name] = (-similarity, kind, place)
            rows = [
                [{"license": n, "similarity": -s, "unit": UNITS[k], "place": p} for n, (s, k, p) in sorted(best.get(i, {}).items())]
                for i in range(batch.num_rows)
            ]
            yield with_column(batch, out, pa.array(rows, _ARROW))

    return map_arrow(docs, run, schema_with(docs.schema, out, FOUND))
