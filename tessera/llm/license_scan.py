"""License scan: word windows, lines and whole texts against licence templates, by the Dice coefficient of word bigrams.

Texts are normalised (lower case, words of letters, digits and dots). With threshold t only templates whose number
of bigrams is between t / (2 - t) and (2 - t) / t times the text's can reach it; others are not compared. In
``scan`` (lines and whole texts) reading stops where one has more distinct bigrams than the largest template allows.
``scan_windows`` also compares every run of words, over line ends, of up to (2 - t) / t times a template's bigrams.
Only templates of which a text has enough bigrams at all are looked at, and only runs that start and end with one
of a template's bigrams, as others are no better.

Defined results: null and empty texts, texts of one word and texts without letters or digits match nothing, and
nothing matches an empty list of templates; of equal coefficients the first template wins; repeated rows are scanned
each; null doc_ids stay null; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices, trim

#: Common one-line licence notices.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "MIT": "Released under the MIT License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
}


def _gnu(name: str, version: str) -> str:
    return (
        f"This program is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation, either version {version} of the License, "
        f"or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or "
        f"FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details."
    )


_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain "
    "the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the "
    "following disclaimer in the documentation and/or other materials provided with the distribution. {}THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS "
    "OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR "
    "CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF "
    "USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY "
    "WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_CLAUSE_3 = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
)
#: (license, text): the notices above first, then other short notices, headers, titles and whole short licences.
LICENSES = [
    *TEMPLATES.items(),
    ("MIT", "Licensed under the MIT License."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("ISC", "Licensed under the ISC License."),
    ("MPL-2.0", "Licensed under the Mozilla Public License, Version 2.0."),
    *[(f"CC-{x}-4.0", f"Licensed under CC {x} 4.0.") for x in ("BY", "BY-SA", "BY-ND", "BY-NC-SA", "BY-NC-ND")],
    (
        "Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT "
        "WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without "
        "restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
        "Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the "
        "Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE "
        "AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, "
        "OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice "
        "appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN "
        "NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF "
        "CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    ("BSD-2-Clause", _BSD.format("")),
    ("BSD-3-Clause", _BSD.format(_CLAUSE_3)),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("GPL-2.0", _gnu("General Public License", "2")),
    ("GPL-3.0", _gnu("General Public License", "3")),
    ("LGPL-2.1", _gnu("Lesser General Public License", "2.1")),
    ("LGPL-3.0", _gnu("Lesser General Public License", "3")),
    ("AGPL-3.0", _gnu("Affero General Public License", "3")),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
]
_WORDS = re.compile(r"[^\W_]+(?:\.[0-9]+)*").finditer
_WORDS_OF = re.compile(r"[^\W_]+(?:\.[0-9]+)*").findall


def bigrams(text: str, limit: float = float("inf")) -> set[tuple[str, str]]:
    """The distinct word bigrams; none of a text that has more than ``limit``."""
    found: set[tuple[str, str]] = set()
    before = None
    for m in _WORDS(text):
        word = m[0].lower()
        if before is not None:
            found.add((before, word))
            if len(found) > limit:
                return set()
        before = word
    return found


def best(text: str | None, templates: dict[str, set], threshold: float) -> tuple[str | None, float]:
    """The template nearest to the whole text or a line of it, if any reaches the threshold."""
    if not text or not templates:
        return None, 0.0
    ratio = (2 - threshold) / threshold
    largest = max(map(len, templates.values())) * ratio
    first, score = len(templates), 0.0
    for part in {text, *text.split("\n")}:
        b = bigrams(part, largest)
        for place, t in enumerate(templates.values()):
            if b and t and max(len(b), len(t)) <= ratio * min(len(b), len(t)):
                dice = 2 * len(b & t) / (len(b) + len(t))
                if dice >= threshold and (dice, -place) > (score, -first):
                    first, score = place, dice
    return [*templates, None][first], score


def index_of(templates: list[set]) -> dict[tuple[str, str], list[int]]:
    """The places of the templates that have a bigram."""
    index: dict[tuple[str, str], list[int]] = {}
    for place, t in enumerate(templates):
        for b in t:
            index.setdefault(b, []).append(place)
    return index


def best_window(text: str | None, templates: list[set], index: dict, threshold: float) -> tuple[int | None, float]:
    """The place of the template nearest to a run of words, a line or the whole of the text, if any reaches the threshold."""
    if not text:
        return None, 0.0
    ratio = (2 - threshold) / threshold
    words = [w.lower() for w in _WORDS_OF(text)]
    known = [(i, b) for i, b in enumerate(pairwise(words)) if b in index]
    has = Counter(place for b in {b for _, b in known} for place in index[b])
    near = {place: templates[place] for place in sorted(has) if has[place] * ratio >= len(templates[place])}
    if not near:
        return None, 0.0
    found, score = best(text, near, threshold)
    for place, t in near.items():
        hits = [i for i, b in known if b in t]
        longest = int(ratio * len(t))
        for a, start in enumerate(hits):
            if score == 1.0 and found <= place:
                break
            end = bisect_left(hits, start + longest)
            if (end - a) * ratio < len(t):
                continue  # too few of the template's bigrams within reach
            seen: set[tuple[str, str]] = set()
            common = 0
            for b in pairwise(words[start : hits[end - 1] + 2]):
                if b in seen:
                    continue
                seen.add(b)
                if b in t:
                    common += 1
                    dice = 2 * common / (len(seen) + len(t))
                    if dice >= threshold and (found is None or (dice, -place) > (score, -found)):
                        found, score = place, dice
    return found, score


def _scanned(docs: DataFrame, judge: Callable[[str | None], tuple[str | None, float]]) -> DataFrame:
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("license", T.StringType()), T.StructField("dice", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text"):
                got = [judge(t) for t in piece.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], names=schema.names)
        trim()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, threshold: float = 0.8) -> DataFrame:
    """doc_id, license (null: none) and dice of every whole text, by whole texts and single lines."""
    known = {n: bigrams(t) for n, t in templates.items()}
    return _scanned(docs, lambda text: best(text, known, threshold))


def scan_windows(docs: DataFrame, templates: list[tuple[str, str]] = LICENSES, threshold: float = 0.8) -> DataFrame:
    """doc_id, license (null: none) and dice of every whole text, by runs of words, lines and whole texts."""
    names, sets = [n for n, _ in templates], [bigrams(t) for _, t in templates]
    index = index_of(sets)

    def judge(text: str | None) -> tuple[str | None, float]:
        place, dice = best_window(text, sets, index, threshold)
        return (None if place is None else names[place]), dice

    return _scanned(docs, judge)
