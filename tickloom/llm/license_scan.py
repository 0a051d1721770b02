"""License scans by patience alignment.

Text and template are words (letters and digits, lower case). A region of a
text is a stretch in which at most `GAP` words in a row are foreign to the
template. Alignment anchors on words that occur once in the region and once in
the template, keeps the longest run of them that is in order in both, and
aligns the gaps between neighbouring anchors in the same way. Where a gap has no
such word, equal words at its ends are matched and the rest is aligned by longest
common subsequence. Coverage is the share of the template's words that are
matched; regions with `coverage` or more are found.

Every region is aligned unless its words, counted, cannot reach the coverage.
Where a text has overlapping regions of one template they are one region by
definition, so results are one row per region.

A copy that longer foreign passages interrupt is no region. What the regions
found leave open is searched for such copies in windows of `SPREAD` template
lengths that start at words of the template that ordinary text is not full of;
a copy spread over one length less is in one of them as a whole. The shortest
part of a window that aligns as much as all of it is a row, and the rest is
searched again. A region found in part grows by what lies that near and aligns.

Templates are an argument; `TEMPLATES` are those included. Wordings of one family
hold or resemble each other (BSD with two and three clauses, notices of the GNU
licenses, an opening and its license): of copies that lie over each other those stay that
match most words in all.

Defined cases: null and empty texts have no regions; a region may hold copies
of a template one behind the other and is found once, from the first to the
last of them; rows with a null or
repeated doc_id are scanned like any other; other columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

import math
import pkgutil
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tickloom.llm.common import prepare, record, texts

GAP = 6
COVERAGE = 0.8
SPREAD = 4

DISCLAIMER = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED
    WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR
    PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT,
    INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE
    GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF
    LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT
    OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
# What stands before the warranty part, which many files leave out.
OPENINGS = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
        associated documentation files (the "Software"), to deal in the Software without restriction, including without
        limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the
        Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
        The above copyright notice and this permission notice shall be included in all copies or substantial portions of
        the Software.""",
    "BSD": """Redistribution and use in source and binary forms, with or without modification, are permitted
        provided that the following conditions are met: Redistributions of source code must retain the above copyright
        notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the
        above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other
        materials provided with the distribution.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
        hereby granted, provided that the above copyright notice and this permission notice appear in all copies.""",
} | {
    name: f"""This {work} is free software{stop} you can redistribute it and/or modify it under the terms of the GNU {kind}
        Public License as published by the Free Software Foundation, either version {version} of the License, or (at
        your option) any later version."""
    for name, work, stop, kind, version in [
        ("GPL-2.0", "program", ";", "General", "2"),
        ("GPL-3.0", "program", ":", "General", "3"),
        ("LGPL-2.1", "library", ";", "Lesser General", "2.1"),
        ("LGPL-3.0", "program", ":", "Lesser General", "3"),
        ("AGPL-3.0", "program", ":", "Affero General", "3"),
    ]
}


def gnu_notice(name: str, work: str, kind: str, end: str) -> str:
    return f"""{OPENINGS[name]} This {work} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;
        without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {kind}
        Public License for more details. You should have received a copy of the GNU {kind} Public License along with
        this {work}{end}"""


WRITE_TO = "; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA"
SEE = ". If not, see https://www.gnu.org/licenses/"
# Licenses of several pages, as files of their names.
FULL_TEXTS = ["AGPL-3.0", "Apache-2.0", "CC0-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0"]

# Wording of public licenses and license notices (fixed values): whole licenses and whole notices by their names,
# `-opening` without what follows the grant, `-notice` for short references, `-text` for licenses of several pages.
TEMPLATES = {
    "MIT": f"""{OPENINGS["MIT"]} THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED,
        INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND
        NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
        LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE
        SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "MIT-notice": "Released under the MIT License.",
    "MIT-licensed-notice": "Licensed under the MIT License.",
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
        compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
        Unless required by applicable law or agreed to in writing, software distributed under the License is distributed
        on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License
        for the specific language governing permissions and limitations under the License.""",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "BSD-2-Clause": f"{OPENINGS['BSD']} {DISCLAIMER}",
    "BSD-3-Clause": f"""{OPENINGS["BSD"]} Neither the name of the copyright holder nor the names of its contributors may be
        used to endorse or promote products derived from this software without specific prior written permission.
        {DISCLAIMER}""",
    "ISC": f"""{OPENINGS["ISC"]} THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO
        THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE
        LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS
        OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF
        OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "GPL-2.0": gnu_notice("GPL-2.0", "program", "General", WRITE_TO),
    "GPL-3.0": gnu_notice("GPL-3.0", "program", "General", SEE),
    "LGPL-2.1": gnu_notice("LGPL-2.1", "library", "Lesser General", WRITE_TO),
    "LGPL-3.0": gnu_notice("LGPL-3.0", "program", "Lesser General", SEE),
    "AGPL-3.0": gnu_notice("AGPL-3.0", "program", "Affero General", SEE),
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the
        MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-notice": "Licensed under CC BY 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC0-1.0": "To the extent possible under law, the person has waived all copyright and related or neighboring rights to this work.",
    "Proprietary-notice": "All rights reserved.",
}
TEMPLATES |= {f"{name}-opening": body for name, body in OPENINGS.items()}
TEMPLATES |= {f"{name}-text": pkgutil.get_data(__package__, f"licenses/{name}.txt").decode() for name in FULL_TEXTS}
# Wordings that hold or resemble each other: of copies that lie over each other those stay that match most words.
FAMILIES = [
    {"MIT", "MIT-opening"},
    {"ISC", "ISC-opening"},
    {"BSD-2-Clause", "BSD-3-Clause", "BSD-opening"},
    {x for name in ("GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0") for x in (name, f"{name}-opening")},
    {"GPL-3.0-text", "AGPL-3.0-text"},
]
# Words that ordinary text is full of (fixed values); they alone never start an alignment.
COMMON = "a all and any are as at be by can do for from he if in is it not of on one or that the this to was were with you your".split()

# Letters and digits stay, upper case becomes lower, everything else parts words.
SPLIT = bytes(
    c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or 48 <= c <= 57 or c >= 128 else 32 for c in range(256)
)


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(SPLIT).split()


def in_order(places: list[int]) -> list[int]:
    """Indices of a longest increasing subsequence."""
    tails: list[int] = []
    ends: list[int] = []
    back = [-1] * len(places)
    for i, x in enumerate(places):
        at = bisect_left(tails, x)
        if at:
            back[i] = ends[at - 1]
        tails[at : at + 1] = [x]
        ends[at : at + 1] = [i]
    chain = [ends[-1]] if ends else []
    while chain and back[chain[-1]] >= 0:
        chain.append(back[chain[-1]])
    return chain[::-1]


def common_length(a: list[bytes], b: list[bytes]) -> int:
    """Length of the longest common subsequence, bit by bit over a."""
    masks: dict[bytes, int] = {}
    for i, x in enumerate(a):
        masks[x] = masks.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for x in b:
        hit = row & masks.get(x, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def aligned(template: list[bytes], text: list[bytes]) -> int:
    """How many words of the template the alignment matches."""
    total, gaps = 0, [(0, len(template), 0, len(text))]
    while gaps:
        a, b, c, d = gaps.pop()
        while a < b and c < d and template[a] == text[c]:
            a, c, total = a + 1, c + 1, total + 1
        while a < b and c < d and template[b - 1] == text[d - 1]:
            b, d, total = b - 1, d - 1, total + 1
        if a == b or c == d:
            continue
        ours, theirs = Counter(template[a:b]), Counter(text[c:d])
        where = {w: i for i, w in enumerate(text[c:d], c) if theirs[w] == 1 and ours.get(w) == 1}
        anchors = [(i, where[w]) for i, w in enumerate(template[a:b], a) if w in where]
        chain = [anchors[i] for i in in_order([y for _, y in anchors])]
        if not chain:
            total += common_length(template[a:b], text[c:d])
            continue
        total += len(chain)
        for (x, y), (x2, y2) in zip([(a - 1, c - 1), *chain], [*chain, (b, d)], strict=True):
            gaps.append((x + 1, x2, y + 1, y2))
    return total


class Scanner:
    def __init__(self, templates: dict[str, str], coverage: float = COVERAGE, gap: int = GAP, families: list[set[str]] = FAMILIES):
        self.coverage, self.gap, self.families = coverage, gap, families
        self.templates = {name: words_of(body) for name, body in templates.items()}
        self.counts = {name: Counter(words) for name, words in self.templates.items()}
        # Words of which a region needs at least one: without them the rest falls short of the coverage.
        self.needed: dict[str, frozenset[bytes]] = {}
        common = {w.encode() for w in COMMON}
        for name, words in self.templates.items():
            rest = sum(w in common for w in words)
            self.needed[name] = frozenset(words) - common if rest < coverage * len(words) else frozenset(words)
        self.any_needed = frozenset().union(*self.needed.values())
        # How many words must be matched, how many of them are needed ones, and how many others may stand before these.
        self.least = {name: math.ceil(coverage * len(words) - 1e-9) for name, words in self.templates.items()}
        self.least_needed = {name: self.least[name] - sum(w not in self.needed[name] for w in words) for name, words in self.templates.items()}
        self.lead = {name: gap + next((i for i, w in enumerate(words) if w in self.needed[name]), 0) for name, words in self.templates.items()}

    def regions(self, name: str, words: list[bytes]) -> Iterator[tuple[int, int]]:
        own = self.counts[name]
        places = np.array([i for i, w in enumerate(words) if w in own], np.int64)
        if len(places):
            cuts = np.flatnonzero(np.diff(places) > self.gap + 1) + 1
            for part in np.split(places, cuts):
                yield int(part[0]), int(part[-1]) + 1

    def covered(self, name: str, words: list[bytes]) -> int:
        """How many words of the template are matched, 0 if they cannot be enough."""
        if len(words) < self.least[name]:
            return 0
        own = Counter(words)
        most = sum(min(n, own[w]) for w, n in self.counts[name].items())
        return aligned(self.templates[name], words) if most >= self.least[name] else 0

    def tight(self, name: str, words: list[bytes], a: int, b: int, core: tuple[int, int] | None = None) -> tuple[int, int, int]:
        """The shortest part of words[a:b] that aligns as much as all of it, the first if there are
        several, and how many words of the template it matches; words of `core` stay in."""
        first, last = core or (b, a)
        template = self.templates[name]
        full = aligned(template, words[a:b])
        b = last + bisect_left(range(last, b), full, key=lambda i: aligned(template, words[a:i]))
        ends = range(a, first + 1)
        a = a + max(0, bisect_left(ends, True, key=lambda i: aligned(template, words[i:b]) < full) - 1)
        return a, b, aligned(template, words[a:b])

    def spread(self, name: str, words: list[bytes], needed: np.ndarray, a: int, b: int) -> Iterator[tuple[int, int, int]]:
        """First word, last word + 1 and matched words of interrupted copies in words[a:b];
        needed are the places of needed words."""
        length, least = len(self.templates[name]), self.least_needed[name]
        anchors = needed[np.searchsorted(needed, a) : np.searchsorted(needed, b)]
        if len(anchors) < least:
            return
        starts = anchors[: len(anchors) - least + 1]
        after = a
        for start in starts[anchors[least - 1 :] - starts < SPREAD * length].tolist():
            if start < after:
                continue
            first = max(a, start - self.lead[name])
            last = min(b, start + SPREAD * length)
            if self.covered(name, words[first:last]) < self.least[name]:
                after = start + length
                continue
            first, last, n = self.tight(name, words, first, last)
            yield from self.spread(name, words, needed, a, first)
            yield first, last, n
            a = after = last

    def found(self, name: str, words: list[bytes]) -> Iterator[tuple[int, int, int]]:
        """First word, last word + 1 and matched words of all that is found of one template."""
        length = len(self.templates[name])
        whole = [(a, b, n) for a, b in self.regions(name, words) if (n := self.covered(name, words[a:b])) >= self.least[name]]
        needed = np.array([i for i, w in enumerate(words) if w in self.needed[name]], np.int64)
        before = 0
        for i, (a, b, n) in enumerate(whole):
            if n < length:
                after = whole[i + 1][0] if i + 1 < len(whole) else len(words)
                wide = max(before, a - (SPREAD - 1) * length), min(after, b + (SPREAD - 1) * length)
                if aligned(self.templates[name], words[wide[0] : wide[1]]) > n:
                    a, b, n = self.tight(name, words, *wide, (a, b))
            yield from self.spread(name, words, needed, before, a)
            yield a, b, n
            before = b
        yield from self.spread(name, words, needed, before, len(words))

    def copies(self, name: str, words: list[bytes], a: int, b: int) -> Iterator[tuple[int, int, int]]:
        """First word, last word + 1 and matched words of each copy in words[a:b]."""
        if self.covered(name, words[a:b]) >= self.least[name]:
            first, last, n = self.tight(name, words, a, b)
            yield from self.copies(name, words, a, first)
            yield first, last, n
            yield from self.copies(name, words, last, b)

    def best(self, rows: list[tuple[str, int, int, float]], words: list[bytes]) -> set[tuple[str, int, int, float]]:
        """The rows of a family with a copy among those, none over another, that match most
        words in all; of equals those of shorter wordings."""
        copies = sorted((last, first, n, len(self.templates[r[0]]), r) for r in rows for first, last, n in self.copies(r[0], words, r[1], r[2]))
        ends = [c[0] for c in copies]
        most: list[tuple[tuple[int, int], frozenset]] = [((0, 0), frozenset())]
        for i, (_, first, n, length, row) in enumerate(copies):
            (total, lengths), kept = most[bisect_right(ends, first, 0, i)]
            here = (total + n, lengths - length)
            most.append((here, kept | {row}) if here > most[i][0] else most[i])
        return set(most[-1][1])

    def __call__(self, text: str) -> list[tuple[str, int, int, float]]:
        """name, first word, last word + 1, coverage of all that is found."""
        words = words_of(text)
        present = self.any_needed.intersection(words)
        found = []
        for name, template in self.templates.items() if present else ():
            if len(words) >= self.least[name] and present & self.needed[name]:
                found += [(name, a, b, n / len(template)) for a, b, n in self.found(name, words)]
        for family in self.families:
            own = [r for r in found if r[0] in family]
            if len({r[0] for r in own}) > 1:
                gone = set(own) - self.best(own, words)
                found = [r for r in found if r not in gone]
        return found


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, coverage: float = COVERAGE, gap: int = GAP, families: list[set[str]] = FAMILIES) -> DataFrame:
    """doc_id, license, first_word, end_word, coverage of every region found."""
    prepare(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("license", pa.string()), ("first_word", pa.int64()), ("end_word", pa.int64()), ("coverage", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, coverage, gap, families)
        for batch in batches:
            rows = [
                (doc_id, *hit)
                for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True)
                for hit in scanner(text or "")
            ]
            if rows:
                yield record(schema, *zip(*rows, strict=True))

    return texts(docs).mapInArrow(run, "doc_id long, license string, first_word long, end_word long, coverage double")
