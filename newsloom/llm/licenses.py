"""License scans by patience alignment of documents and license texts."""

from __future__ import annotations

import bisect
import functools
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COVERAGE = 0.8
#: A copy is at most so many times as long as its license: words put in may take the rest.
STRETCH = 4
_WORD = re.compile(rb"[a-z0-9\x80-\xff]+")

_BSD_CONDITIONS = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
    "and/or other materials provided with the distribution. "
)
_BSD_NAMES = (
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software "
    "without specific prior written permission. "
)
_BSD_DISCLAIMER = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE '
    "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE "
    "LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE "
    "GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT "
    "LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, '
_DEALINGS = "ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_BSL_OPENING = (
    "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by "
    'this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the '
    "Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following"
)
_UNLICENSE_OPENING = (
    "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this "
    "software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."
)
_ISC_OPENING = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided "
    "that the above copyright notice and this permission notice appear in all copies."
)
_MIT_OPENING = (
    'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), '
    "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, "
    "sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
    "following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
)


def _gpl_header(name: str, version: int) -> str:
    return (
        f"This program is free software: you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation, "
        f"either version {version} of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but "
        f"WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {name} for more details."
    )


# The license texts that are looked for. Any others are given as `texts`.
TEMPLATES = {
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to "
        'in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY '
        "KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."
    ),
    "CC-BY-NC-4.0 notice": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0 notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL header": _gpl_header("GNU General Public License", 3),
    "GPL-2.0 header": _gpl_header("GNU General Public License", 2),
    "AGPL-3.0 header": _gpl_header("GNU Affero General Public License", 3),
    "LGPL-3.0 header": _gpl_header("GNU Lesser General Public License", 3),
    "BSD-2-Clause": _BSD_CONDITIONS + _BSD_DISCLAIMER,
    "BSD-3-Clause": _BSD_CONDITIONS + _BSD_NAMES + _BSD_DISCLAIMER,
    "CC-BY-4.0 notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0 long notice": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "CC-BY-SA-4.0 notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC0-1.0 notice": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "MPL-2.0 header": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can "
        "obtain one at https://mozilla.org/MPL/2.0/."
    ),
    "Zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the "
        "use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and "
        "redistribute it freely, subject to the following restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote "
        "the original software. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. This notice "
        "may not be removed or altered from any source distribution."
    ),
    "MIT notice": "Released under the MIT License.",
    "BSL-1.0": (
        _BSL_OPENING + ": The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following "
        "disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative "
        "works are solely in the form of machine-executable object code generated by a source language processor. " + _AS_IS + "FITNESS FOR A PARTICULAR PURPOSE, "
        "TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, "
        "WHETHER IN CONTRACT, TORT OR OTHERWISE, " + _DEALINGS
    ),
    "BSL-1.0 opening": _BSL_OPENING,
    "Unlicense": (
        _UNLICENSE_OPENING + " In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the "
        "software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend "
        "this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. " + _AS_IS
        + "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN "
        "ACTION OF CONTRACT, TORT OR OTHERWISE, " + _DEALINGS
    ),
    "Unlicense opening": _UNLICENSE_OPENING,
    "ISC": (
        _ISC_OPENING + ' THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF '
        "MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER "
        "RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH "
        "THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "ISC opening": _ISC_OPENING,
    "MIT": (
        _MIT_OPENING + " " + _AS_IS + "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY "
        "CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, " + _DEALINGS
    ),
    "MIT opening": _MIT_OPENING,
}
# Words too common to tell where a license may stand.
COMMON = frozenset(b"a all and any at be by for in is it of on or that the this to with without you".split())


def words_of(text: bytes) -> list[bytes]:
    return _WORD.findall(text.lower())


@dataclass
class Template:
    name: str
    words: list[bytes]
    telling: frozenset[bytes] = field(init=False)

    def __post_init__(self):
        self.telling = frozenset(self.words) - COMMON


def templates_of(texts: dict[str, str]) -> list[Template]:
    return [Template(name, w) for name, text in sorted(texts.items()) if (w := words_of(text.encode()))]


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest subsequence of pairs, sorted by the first, whose second increases: by patience sorting."""
    tops: list[int] = []
    piles: list[int] = []
    before: list[int] = []
    for k, (_, b) in enumerate(pairs):
        p = bisect.bisect_left(tops, b)
        before.append(piles[p - 1] if p else -1)
        tops[p : p + 1] = [b]
        piles[p : p + 1] = [k]
    out, k = [], piles[-1] if piles else -1
    while k >= 0:
        out.append(pairs[k])
        k = before[k]
    return out[::-1]


def align(text: list[bytes], template: list[bytes]) -> list[tuple[int, int]]:
    """Pairs (place in text, place in template) of equal words, increasing in both.

    Equal ends are taken off; words that occur once in either part are anchors, of which the
    longest increasing run stays; the gaps between anchors are aligned in the same way. Where a gap
    has no such word, the first occurrence of the word that is rarest in the text, and occurs once
    in the template, is the anchor: a text may hold its notice twice.
    """
    found: list[tuple[int, int]] = []
    work = [(0, len(text), 0, len(template))]
    while work:
        a, b, c, d = work.pop()
        while a < b and c < d and text[a] == template[c]:
            found.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and text[b - 1] == template[d - 1]:
            b, d = b - 1, d - 1
            found.append((b, d))
        if a == b or c == d:
            continue
        n = Counter(template[c:d])
        once = {w: i for i, w in enumerate(template[c:d], c) if n[w] == 1}
        places: dict[bytes, list[int]] = {}
        for i in range(a, b):
            if text[i] in once:
                places.setdefault(text[i], []).append(i)
        if not places:
            continue
        anchors = _increasing([(p[0], once[w]) for w, p in sorted(places.items(), key=lambda x: x[1][0]) if len(p) == 1])
        if not anchors:
            w = min(places, key=lambda w: (len(places[w]), places[w][0]))
            anchors = [(places[w][0], once[w])]
        found += anchors
        ends = [(a - 1, c - 1), *anchors, (b, d)]
        work += [(i + 1, j, k + 1, m) for (i, k), (j, m) in zip(ends, ends[1:])]
    return sorted(found)


@dataclass
class Bounds:
    """What a stretch of text that covers `coverage` of a template has at least: `words` words in the template's order, and
    `need` different ones out of `telling`. ahead and back: each word's places in the template, and in it read backwards, as bits."""

    telling: frozenset[bytes]
    need: int
    words: int
    ahead: dict[bytes, int]
    back: dict[bytes, int]


@functools.lru_cache(maxsize=4096)
def _bounds(words: tuple[bytes, ...], telling: frozenset[bytes], coverage: float) -> Bounds:
    missed = min(len(words), math.floor((1 - coverage) * len(words) + 1e-9))
    left, need = missed, len(telling)
    for n in sorted(Counter(w for w in words if w in telling).values()):  # a word is missed only if all its places are
        left -= n
        need -= left >= 0
    if need < 1 and len(telling) < len(set(words)):
        return _bounds(words, frozenset(words), coverage)
    ahead: dict[bytes, int] = {}
    back: dict[bytes, int] = {}
    for i, w in enumerate(words):
        ahead[w] = ahead.get(w, 0) | 1 << i
        back[w] = back.get(w, 0) | 1 << (len(words) - 1 - i)
    return Bounds(telling, max(need, 1), max(len(words) - missed, 1), ahead, back)


class _Stretches:
    """Stretches of a text that hold enough of a template's words in their order to be a copy of it.

    at: places of the template's words in the text. How many words of a stretch can be had in order (its longest common
    subsequence with the template, which no alignment exceeds) is counted by one sum of bit rows a word.
    """

    def __init__(self, at: list[int], words: list[bytes], n: int, x: Bounds, wide: int):
        self.at, self.n, self.x, self.wide = at, n, x, wide
        self.ahead, self.back = [x.ahead[words[i]] for i in at], [x.back[words[i]] for i in at]

    def _more(self, row: int, bits: int) -> int:
        common = row & bits
        return ((row + common) | (row - common)) & ((1 << self.n) - 1)

    def _reach(self, bits: list[int], ks: range, limit: int) -> int | None:
        """First of ks up to which (and less than limit words off) enough words are in order."""
        row = (1 << self.n) - 1
        for k in ks:
            if abs(self.at[k] - self.at[ks[0]]) >= limit:
                return None
            row = self._more(row, bits[k])
            if self.n - row.bit_count() >= self.x.words:
                return k
        return None

    def first(self, b: int) -> tuple[int, int] | None:
        """Of the stretches from the b-th place on, up to `wide` words long, that with the first end; of those the shortest."""
        while b < len(self.at):
            e = self._reach(self.ahead, range(b, len(self.at)), 2 * self.wide)
            if e is None:  # what begins up to `wide` words further on would have ended in what was read
                b = bisect.bisect_right(self.at, self.at[b] + self.wide)
                continue
            s = self._reach(self.back, range(e, b - 1, -1), 2 * self.wide)
            if self.at[e] - self.at[s] < self.wide:
                return s, e
            b = s + 1
        return None

    def grown(self, bits: list[int], ks: range, inside: int, step: int, limit: int) -> tuple[int, bool]:
        """The last of ks (`inside` of them are taken as they are) that adds a word in order, over steps of up to `step`
        words and less than limit words in all; and whether the template is complete."""
        row, last = (1 << self.n) - 1, ks[inside - 1]
        for i, k in enumerate(ks):
            if i >= inside and (not row or abs(self.at[k] - self.at[last]) > step or abs(self.at[k] - self.at[ks[0]]) >= limit):
                break
            before, row = row, self._more(row, bits[k])
            if i >= inside and row.bit_count() < before.bit_count():
                last = k
        return last, not row

    def complete(self, s: int, e: int) -> int:
        """e, or where the stretch s..e goes on in small steps to the template's last missing word, that place."""
        last, done = self.grown(self.ahead, range(s, len(self.at)), e - s + 1, max(3, self.n // 16), self.wide)
        return last if done else e

    def wider(self, tight: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """Each stretch with the words around it that add to it. None takes from the others: from the last to the first they
        grow up to the next one, leave what they need not at their front, and grow there up to what goes on right after the one before."""
        out: list[tuple[int, int]] = []
        end = len(self.at)
        for i in range(len(tight) - 1, -1, -1):
            s, e = tight[i]
            e, _ = self.grown(self.ahead, range(s, end), e - s + 1, self.n, self.wide)
            s, _ = self.grown(self.back, range(e, s - 1, -1), 1, self.wide, self.wide)
            lo = 0
            if i:
                a, z = tight[i - 1]
                lo = 1 + self.grown(self.ahead, range(a, s), z - a + 1, max(3, self.n // 16), self.wide)[0]
            s, _ = self.grown(self.back, range(e, lo - 1, -1), e - s + 1, self.n, self.wide)
            out.append((s, e))
            end = s
        return out[::-1]


def _regions(words: list[bytes], x: Bounds, wide: int) -> list[tuple[int, int]]:
    """Parts of the text outside of which no stretch of `wide` words has `need` different telling words."""
    spots = [i for i, w in enumerate(words) if w in x.telling]
    held: Counter[bytes] = Counter()
    out: list[tuple[int, int]] = []
    z = 0
    for i in spots:
        while z < len(spots) and spots[z] < i + wide:
            held[words[spots[z]]] += 1
            z += 1
        if len(held) >= x.need:
            a, b = max(i - wide, 0), i + wide
            if out and a <= out[-1][1]:
                a = out.pop()[0]
            out.append((a, b))
        held[words[i]] -= 1
        if not held[words[i]]:
            del held[words[i]]
    return out


def matches(words: list[bytes], t: Template, coverage: float = COVERAGE, stretch: int = STRETCH) -> list[tuple[float, int, int]]:
    """Copies of t in the text, from left to right, none over another: coverage, from, to (exclusive).

    A copy is a stretch of at most `stretch` times the template's words whose alignment covers `coverage` of them, whatever
    was altered, left out or put in. The copy that ends first is taken, again and again, which gives the most copies; then
    all are widened.
    """
    n, x = len(t.words), _bounds(tuple(t.words), t.telling, coverage)
    found = []
    for lo, hi in _regions(words, x, stretch * n):
        at = [i for i in range(lo, min(hi, len(words))) if words[i] in x.ahead]
        within, b = _Stretches(at, words, n, x, stretch * n), 0

        def aligned(s: int, e: int) -> tuple[float, int, int] | None:
            pairs = align(words[at[s] : at[e] + 1], t.words)
            return (len(pairs) / n, at[s] + pairs[0][0], at[s] + pairs[-1][0] + 1) if len(pairs) >= coverage * n - 1e-9 else None

        tight = []
        while (one := within.first(b)) is not None:
            one = one[0], within.complete(*one)
            if not aligned(*one):  # words around it may be anchors that it lacks
                following = within.first(one[1] + 1)
                end = len(at) if following is None else following[0]
                e, _ = within.grown(within.ahead, range(one[0], end), one[1] - one[0] + 1, n, stretch * n)
                s, _ = within.grown(within.back, range(e, b - 1, -1), e - one[0] + 1, n, stretch * n)
                if not aligned(s, e):
                    b = one[0] + 1
                    continue
                one = s, e
            tight.append(one)
            b = one[1] + 1
        found += [aligned(*wide) or aligned(*one) for wide, one in zip(within.wider(tight), tight)]
    return found


def best_match(words: list[bytes], t: Template, coverage: float = COVERAGE) -> tuple[float, int, int] | None:
    """The copy of t with the highest coverage, ties to the first; None where no copy reaches `coverage`."""
    return max(matches(words, t, coverage), key=lambda m: (m[0], -m[1]), default=None)


class Scanner:
    """All copies of all templates in a text. Templates are looked up by the telling words that the text has."""

    def __init__(self, templates: list[Template], coverage: float = COVERAGE):
        self.templates, self.coverage = templates, coverage
        self.bounds = [_bounds(tuple(t.words), t.telling, coverage) for t in templates]
        self.of: dict[bytes, list[int]] = {}
        for i, x in enumerate(self.bounds):
            for w in x.telling:
                self.of.setdefault(w, []).append(i)
        self.known = frozenset(self.of)

    def scan(self, words: list[bytes]) -> list[tuple[str, float, int, int]]:
        """name, coverage, from, to, by name and place. Of copies that overlap by over half of the shorter one only that with the most words stays (ties: higher coverage, then name)."""
        held = Counter(i for w in self.known.intersection(words) for i in self.of[w])
        found = [
            (self.templates[i].name, *m, round(m[0] * len(self.templates[i].words)))
            for i in sorted(held) if held[i] >= self.bounds[i].need for m in matches(words, self.templates[i], self.coverage)
        ]
        kept: list[tuple] = []
        at: dict[int, list[tuple]] = {}  # kept copies by the stretches of 512 words that they touch
        for f in sorted(found, key=lambda f: (-f[4], -f[1], f[0], f[2])):
            stretches = range(f[2] // 512, (f[3] - 1) // 512 + 1)
            if all(2 * (min(f[3], g[3]) - max(f[2], g[2])) <= min(f[3] - f[2], g[3] - g[2]) for s in stretches for g in at.get(s, ())):
                kept.append(f)
                for s in stretches:
                    at.setdefault(s, []).append(f)
        return sorted((f[:4] for f in kept), key=lambda f: (f[0], f[2]))


def scan(words: list[bytes], templates: list[Template], coverage: float = COVERAGE) -> list[tuple[str, float, int, int]]:
    return Scanner(templates, coverage).scan(words)


def scan_licenses(docs: DataFrame, texts: dict[str, str] | None = None, coverage: float = COVERAGE) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_words, licenses: array of (license, coverage, begin, end), by name and place; words count from 0.

    Whole texts are searched and every copy is listed that covers `coverage` of its license's words and more within a stretch
    of STRETCH times its length; of copies of different licenses in one place only the one with the most words. Null and empty texts have no licenses; repeated rows have a row each; an
    empty table gives an empty result.
    """
    templates = templates_of(TEMPLATES if texts is None else texts)
    kind = pa.list_(pa.struct([("license", pa.string()), ("coverage", pa.float64()), ("begin", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, coverage)
        for b in batches:
            n, found = [], []
            for t in b.column(1).to_pylist():
                words = words_of(t or b"")
                n.append(len(words))
                found.append([dict(zip(("license", "coverage", "begin", "end"), x)) for x in scanner.scan(words)])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(found, kind)], ["doc_id", "n_words", "licenses"])

    of = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(
        run, f"doc_id {of}, n_words long, licenses array<struct<license:string,coverage:double,begin:long,end:long>>"
    )


def op4_licenses(spark, sf_dir: str) -> DataFrame:
    found = scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return found.select(
        "doc_id", "n_words", F.size("licenses").cast("long").alias("n_licenses"),
        F.array_join(F.transform("licenses", lambda x: F.concat_ws(":", x["license"], F.round(x["coverage"], 4).cast("string"), x["begin"].cast("string"), x["end"].cast("string"))), ",").alias("licenses"),
    )
