"""Operator 9 - license scans by patience alignment.

Words that occur once in the text and once in the template are anchors; the longest
increasing subsequence of their places is kept, and each gap between two anchors is aligned the
same way.  Where a gap has no anchors, equal words at its two ends are matched.  Outside the
outermost anchors only a margin as long as the template's own rest is aligned.  Coverage is
the share of the template's words that are matched; a template is reported if it reaches
``min_coverage`` and its matched words stand densely enough (``min_density``).

A license note is often shorter than the text's vocabulary makes unique, so a text is aligned
inside windows: around each place where a rare word of the template stands, as many words as twice
the template has.  A very long text goes through in overlapping stretches.  Texts that lack so
many of the template's words that the coverage can't be reached are turned away by one set
intersection.

A license has several templates: a short note (TEMPLATES), and its standard header or permission text (TEXTS).  Each has words that name it (NAMING): its phrases
that a template holds must be matched word by word and next to each other, so that a near miss, such as another version or a name with one part more, is not
taken for it, however much of the rest is equal.  Permission texts that name nothing go by their coverage alone.  A text that lacks the words which every
alignment needs (a naming word, or one of so many rare ones that the coverage can't do without them all) is not taken apart.

Defined results: null or empty texts match nothing; words are compared in lower case and without
punctuation at their ends; every place where a license stands is a row;
of alignments that share words the one with most matched words counts (then the best coverage, the name and the place), and the words between those that count are searched again; repeated rows and
null ids are judged one by one; an empty table or no templates give no rows; extra columns play no part.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

#: Short license notes as they are commonly written.
TEMPLATES = {
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "MIT": "Released under the MIT License.",
    "BSD-3-Clause": "Released under the BSD 3-Clause License.",
    "MPL-2.0": "This work is subject to the terms of the Mozilla Public License, version 2.0.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-ND-4.0": "Licensed under CC BY-ND 4.0.",
    "CC0-1.0": "Dedicated to the public domain under CC0 1.0.",
    "Proprietary": "All rights reserved.",
    "ISC": "Released under the ISC License.",
    "BSD-2-Clause": "Released under the BSD 2-Clause License.",
    "LGPL-2.1": "This work is licensed under the GNU Lesser General Public License, version 2.1.",
    "CC-BY-NC-SA-4.0": "Licensed under CC BY-NC-SA 4.0.",
    "CC-BY-NC-ND-4.0": "Licensed under CC BY-NC-ND 4.0.",
    "CC-BY-3.0": "Licensed under CC BY 3.0.",
    "CC-BY-SA-3.0": "Licensed under CC BY-SA 3.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "BSL-1.0": "Distributed under the Boost Software License, Version 1.0.",
    "Zlib": "Released under the zlib License.",
    "EPL-2.0": "This program is made available under the terms of the Eclipse Public License 2.0.",
}
_GNU = """This {kind} is free software: you can redistribute it and/or modify it under the terms of the GNU {gnu}General Public License
as published by the Free Software Foundation, either version {v} of the License, or (at your option) any later version.
This {kind} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {gnu}General Public License for more details."""
_GNU_SHORT = """under the terms of the GNU {gnu}General Public License as published by the Free Software Foundation, either version {v} of the License"""
_GNU_ONLY = """under the terms of the GNU {gnu}General Public License version {v} as published by the Free Software Foundation"""
_AS_IS = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT
LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT
HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED
TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF
LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS
SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_BSD = """All rights reserved. Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in
the documentation and/or other materials provided with the distribution."""
_NAME = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from
this software without specific prior written permission."""
_CC = "licensed under a Creative Commons {name} {version} License."
_CC_THE = "licensed under the Creative Commons {name} {version} License. To view a copy of this license, visit"
_CC_NAMES = {
    "BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives",
    "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives",
}
_CC_VERSIONS = {"4.0": "4.0 International", "3.0": "3.0 Unported"}

#: Standard headers and permission texts, several a license.
TEXTS = {
    **{
        f"{short}GPL-{v}.0": (
            _GNU.format(kind="program", gnu=gnu, v=v),
            _GNU.format(kind="library", gnu=gnu, v=v),
            _GNU_SHORT.format(gnu=gnu, v=v),
            _GNU_ONLY.format(gnu=gnu, v=v),
        )
        for short, gnu, v in (("", "", 3), ("", "", 2), ("L", "Lesser ", 3), ("A", "Affero ", 3))
    },
    "LGPL-2.1": tuple(t.format(kind="library", gnu="Lesser ", v="2.1") for t in (_GNU, _GNU_SHORT, _GNU_ONLY)),
    "ISC": (
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the
        above copyright notice and this permission notice appear in all copies.""",
    ),
    "BSL-1.0": (
        """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation
        covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software""",
    ),
    "Zlib": (
        """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages
        arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial
        applications, and to alter it and redistribute it freely, subject to the following restrictions""",
    ),
    "Apache-2.0": (
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You
        may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing,
        software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or
        implied. See the License for the specific language governing permissions and limitations under the License.""",
    ),
    "MIT": (
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the
        "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish,
        distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the
        following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
        Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES
        OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR
        ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE
        SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
        "Licensed under the MIT License.",
    ),
    "BSD-2-Clause": (f"{_BSD} {_AS_IS}",),
    "BSD-3-Clause": (f"{_BSD} {_NAME} {_AS_IS}",),
    "MPL-2.0": (
        """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this
        file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    ),
    **{f"CC-{short}-{v}": tuple(t.format(name=name, version=full) for t in (_CC, _CC_THE)) for short, name in _CC_NAMES.items() for v, full in _CC_VERSIONS.items()},
}
LICENSES = {name: (*((TEMPLATES[name],) if name in TEMPLATES else ()), *TEXTS.get(name, ())) for name in {**TEMPLATES, **TEXTS}}
#: The phrases that name a license; those that a template holds must stand in the text as they are.
NAMING = {
    **{f"{short}GPL-{v}": (f"gnu {gnu}general public license", f"version {v.removesuffix('.0')}") for short, gnu, v in (("", "", "3.0"), ("", "", "2.0"), ("L", "lesser ", "3.0"), ("L", "lesser ", "2.1"), ("A", "affero ", "3.0"))},
    **{f"CC-{short}-{v}": (f"cc {short.lower()} {v}", f"creative commons {name.lower()} {v}") for short, name in _CC_NAMES.items() for v in _CC_VERSIONS},
    "CC0-1.0": ("cc0",),
    "Apache-2.0": ("apache license version 2.0",),
    "MIT": ("mit license",),
    "ISC": ("isc license",),
    "BSD-2-Clause": ("bsd 2-clause",),
    "BSD-3-Clause": ("bsd 3-clause",),
    "MPL-2.0": ("mozilla public license", "version 2.0"),
    "EPL-2.0": ("eclipse public license 2.0",),
    "BSL-1.0": ("boost software license version 1.0",),
    "Zlib": ("zlib license",),
    "Unlicense": ("free and unencumbered software",),
    "Proprietary": ("all rights reserved",),
}
MIN_COVERAGE, MIN_DENSITY = 0.75, 0.6
SCHEMA = "doc_id long, license string, coverage double, matched long, template_words long, start long, n_words long, n_anchors long"
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_EDGES = "\"'()[]{}<>.,;:!?*#_`"


def words_of(text: str) -> list[str]:
    """Words in lower case without punctuation at their ends; bare punctuation stays as it is."""
    return [w.strip(_EDGES) or w for w in _WORD.findall(text.lower())]


def blocks_of(text: str, size: int, overlap: int):
    """(index of the first word, words) of stretches that share ``overlap`` words with the next one."""
    if len(text) <= size:
        yield 0, words_of(text)
        return
    base, words = 0, []
    for m in _WORD.finditer(text.lower()):
        words.append(m[0].strip(_EDGES) or m[0])
        if len(words) == size:
            yield base, words
            base += size - overlap
            words = words[-overlap:]
    if not base or len(words) > overlap:
        yield base, words


def increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest subsequence of pairs (sorted by the first) that rises in the second: patience piles."""
    tops: list[int] = []
    ends: list[int] = []
    back: list[int] = []
    for i, (_, b) in enumerate(pairs):
        p = bisect_left(tops, b)
        back.append(ends[p - 1] if p else -1)
        if p == len(tops):
            tops.append(b)
            ends.append(i)
        else:
            tops[p] = b
            ends[p] = i
    out, i = [], ends[-1] if ends else -1
    while i >= 0:
        out.append(pairs[i])
        i = back[i]
    return out[::-1]


def align(text: list[str], template: list[str], a: int, b: int, c: int, d: int) -> tuple[list[tuple[int, int]], int]:
    """Matches of template[a:b] in text[c:d] as (template place, text place), and the number of anchors."""
    matches: list[tuple[int, int]] = []
    anchors = 0
    todo = [(a, b, c, d)]
    while todo:
        a, b, c, d = todo.pop()
        if a >= b or c >= d:
            continue
        once_t = {w: i for w, i in zip(template[a:b], range(a, b), strict=True)}
        count_t, count_x = Counter(template[a:b]), Counter(w for w in text[c:d] if w in once_t)
        place_x = {w: i for w, i in zip(text[c:d], range(c, d), strict=True) if count_x.get(w) == 1}
        pairs = sorted((once_t[w], i) for w, i in place_x.items() if count_t[w] == 1)
        chain = increasing(pairs)
        if chain:
            anchors += len(chain)
            matches += chain
            edges = [(a - 1, c - 1), *chain, (b, d)]
            todo += [(p + 1, q, x + 1, y) for (p, x), (q, y) in zip(edges, edges[1:], strict=False)]
            continue
        while a < b and c < d and template[a] == text[c]:
            matches.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and template[b - 1] == text[d - 1]:
            b, d = b - 1, d - 1
            matches.append((b, d))
    return sorted(matches), anchors


class Template:
    """phrases: places in the template of each phrase that names the license; naming: their words, the rarest first."""

    def __init__(self, name: str, text: str, rarity: Counter, naming: tuple[str, ...] = ()):
        self.name, self.words = name, words_of(text)
        self.vocabulary = set(self.words)
        order = lambda w: (rarity[w], -len(w), w)
        self.rarest = sorted(self.vocabulary, key=order)
        found = ([(i, len(p)) for i in range(len(self.words)) if self.words[i : i + len(p)] == p] for p in map(words_of, naming))
        self.phrases = [places for places in found if places]
        self.naming = sorted({w for places in self.phrases for i, n in places[:1] for w in self.words[i : i + n]}, key=order)

    def seeds(self, min_coverage: float) -> list[str]:
        """Words one of which any alignment that is good enough holds: a naming word, or so many rare ones that the rest can't make up the coverage."""
        if self.naming:
            return self.naming[:1]
        counts, spare, out = Counter(self.words), len(self.words) - int(-(-len(self.words) * min_coverage // 1)), []
        for w in self.rarest:
            out.append(w)
            spare -= counts[w]
            if spare < 0:
                break
        return out

    def named(self, matches: list[tuple[int, int]]) -> bool:
        """Whether each phrase is matched somewhere, and unbroken."""
        at = dict(matches)
        unbroken = lambda i, n: i in at and all(at.get(i + j) == at[i] + j for j in range(n))
        return all(any(unbroken(i, n) for i, n in places) for places in self.phrases)


def alignments(text: list[str], where: dict[str, list[int]], t: Template, min_coverage: float, min_density: float):
    """(matched, start, n_words, anchors) of every window that is good enough."""
    m = len(t.words)
    required = -(-m * min_coverage // 1)
    seeds = t.seeds(min_coverage)
    places = sorted({p for w in seeds for p in where.get(w, ())})
    last = -1
    for p in places:
        if p <= last:
            continue  # inside the window before
        last = p + m // 2
        # Where words stand twice in the wide window, as in notes close together, they can't be anchors: then the tight ones.
        wide = (max(0, p - m), min(len(text), p + 2 * m))
        tight = [(max(0, p - j), min(len(text), p - j + m)) for j, w in enumerate(t.words) if w == text[p]]
        for low, high in (wide, *tight):
            # No alignment matches more words than the window has of the template's.
            if len(t.vocabulary.intersection(text[low:high])) < required - (m - len(t.vocabulary)):
                continue
            matches, anchors = align(text, t.words, 0, m, low, high)
            while len(matches) > 1:  # a stray word far from the others isn't part of the note
                span = matches[-1][1] - matches[0][1] + 1
                if len(matches) >= min_density * span:
                    break
                head, tail = matches[1][1] - matches[0][1], matches[-1][1] - matches[-2][1]
                matches = matches[1:] if head >= tail else matches[:-1]
            if len(matches) >= required and t.named(matches):
                yield len(matches), matches[0][1], matches[-1][1] - matches[0][1] + 1, anchors
                break


def clear_of(hits: list[tuple]) -> list[tuple]:
    """Of hits (template, (matched, start, n_words, anchors)) that share words the one with most matched words, then of the best coverage."""
    places: list[tuple[int, int]] = []
    out = []
    for t, h in sorted(hits, key=lambda x: (-x[1][0], -x[1][0] / len(x[0].words), x[0].name, x[1][1])):
        at = bisect_left(places, (h[1] + h[2], -1))  # the places before it start before the hit's end
        if not at or places[at - 1][1] <= h[1]:
            places.insert(at, (h[1], h[1] + h[2]))
            out.append((t, h))
    return out


def scan(templates: dict[str, str | tuple[str, ...]], min_coverage: float, min_density: float, best_only: bool, block_words: int = 200_000, naming: dict[str, tuple[str, ...]] = NAMING):
    def run(batches):
        texts = [(n, text) for n, t in templates.items() for text in ((t,) if isinstance(t, str) else t)]
        rarity = Counter(w for _, text in texts for w in words_of(text))
        rarity += Counter({w: 1000 for w in ("the", "is", "under", "this", "to", "of", "all", "by", "in")})
        known = [Template(n, text, rarity, naming.get(n, ())) for n, text in texts]
        # A template can only stand in a text that has all its naming words, or enough of its own if it names nothing: one pass finds which are there.
        spotted = []
        for t in known:
            words = set(t.naming) or {w for w in t.vocabulary if len(w) > 3}  # short words stand in every text
            least = len(t.vocabulary) - len(t.words) + int(-(-len(t.words) * min_coverage // 1)) - (len(t.vocabulary) - len(words))
            spotted.append((t, words, len(words) if t.naming else least))
        spotter = ahocorasick.Automaton()
        for w in {w for _, words, _ in spotted for w in words}:
            spotter.add_word(w, w)
        if known:
            spotter.make_automaton()
        vocabulary = set().union(*(t.vocabulary for t in known)) if known else set()
        longest = max((len(t.words) for t in known), default=1)

        def search(words: list[str], chosen: list[Template]):
            here = vocabulary.intersection(words)
            where: dict[str, list[int]] | None = None
            for t in chosen if here else ():
                if not here.issuperset(t.naming) or len(t.vocabulary & here) < min_coverage * len(t.vocabulary) - (len(t.words) - len(t.vocabulary)):
                    continue
                if where is None:
                    where = {}
                    for i, w in enumerate(words):
                        if w in here:
                            where.setdefault(w, []).append(i)
                for hit in alignments(words, where, t, min_coverage, min_density):
                    yield t, hit

        def every(words: list[str], chosen: list[Template]):
            """All hits; with best_only of those that share words the best, then again in the words between those."""
            if not best_only:
                yield from search(words, chosen)
                return
            todo = [(0, len(words))]
            while todo:
                a, b = todo.pop()
                found = clear_of([*search(words[a:b], chosen)])
                at = a
                for t, (n, start, size, anchors) in sorted(found, key=lambda x: x[1][1]):
                    yield t, (n, a + start, size, anchors)
                    todo.append((at, a + start))
                    at = a + start + size
                if found:
                    todo.append((at, b))

        for b in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                text = text.as_py() or ""
                held = {w for _, w in spotter.iter(text.lower())} if known else ()
                chosen = [t for t, words, least in spotted if len(words.intersection(held)) >= least]
                if not chosen:
                    continue
                hits = [(t, (hit[0], hit[1] + base, *hit[2:])) for base, words in blocks_of(text, max(block_words, 8 * longest), 4 * longest) for t, hit in every(words, chosen)]
                # Stretches of a long text overlap: a hit in two of them is one.
                for t, hit in clear_of(hits) if best_only else sorted(dict.fromkeys(hits), key=lambda x: (x[1][1], x[0].name)):
                    rows.append((doc_id, t.name, hit[0] / len(t.words), hit[0], len(t.words), *hit[1:]))
            names = [f.split()[0] for f in SCHEMA.split(", ")]
            types = [pa.int64(), pa.string(), pa.float64()] + [pa.int64()] * 5
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)

    return run


def scan_licenses(
    docs: DataFrame,
    templates: dict[str, str | tuple[str, ...]] = LICENSES,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_coverage: float = MIN_COVERAGE,
    min_density: float = MIN_DENSITY,
    best_only: bool = True,
    naming: dict[str, tuple[str, ...]] = NAMING,
) -> DataFrame:
    """One row per place where a license stands in a document: coverage of the template, and where (in words).

    best_only: of alignments that share words the best one.  naming: phrases that must stand unbroken, by license; licenses without any need none.
    """
    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(scan(templates, min_coverage, min_density, best_only, naming=naming), SCHEMA)


def op9_license_scan(spark, sf_dir):
    """Every place of a license in all documents."""
    return scan_licenses(table(spark, sf_dir, "documents"))
