"""License scans by patience alignment.

A template and a stretch of text are aligned on the words that are unique in both: of these the longest increasing
subsequence are anchors, and the gaps between anchors are aligned in the same way, with equal words at either end of
a gap taken first. Coverage is the share of the template's words that are aligned.

A license may stand anywhere in a long text, more than once. So the stretches to align are found first: in windows
of one and a half template lengths, the number of words in common, repeats included, bounds the coverage from above.
A window begins at each template word of the text; of neighbouring windows whose bound reaches the threshold those of
highest bound are aligned first, until no other can cover more. Of a template of 200 words or more, each hundredth
part of its length is a place where a window begins, and so is the place of highest bound.

Short notices must align whole, and longer templates in the words that tell them from their siblings. Of stretches
that lie over each other by more than half, the one with the most aligned words stays.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import Counter
from pkgutil import get_data

from pyspark.sql import DataFrame

from .common import map_texts

def _whole(name: str) -> str:
    return get_data(__package__, f"license_texts/{name}.txt").decode()


_AS_IS = (
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE "
    "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS "
)
_BSD_HEAD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
    "the following conditions are met: Redistributions of source code must retain the above copyright notice, this "
    "list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above "
    "copyright notice, this list of conditions and the following disclaimer in the documentation and/or other "
    "materials provided with the distribution. "
)
_BSD_THIRD = (
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
    "products derived from this software without specific prior written permission. "
)
_BSD_TAIL = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, "
    "INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE "
    "DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
    "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR "
    "SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, "
    "WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE "
    "OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)


def _gnu(kind: str, version: str, later: bool) -> str:
    either = f"either version {version} of the License, or (at your option) any later version." if later else f"version {version} of the License."
    return (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
        f"{kind} Public License as published by the Free Software Foundation, {either}"
    )


_GNU = {"GPL": "General", "LGPL": "Lesser General", "AGPL": "Affero General"}
_GNU_VERSIONS = [("GPL", "2.0"), ("GPL", "3.0"), ("LGPL", "2.1"), ("LGPL", "3.0"), ("AGPL", "3.0")]
_CC = {
    "BY": "Attribution",
    "BY-SA": "Attribution-ShareAlike",
    "BY-ND": "Attribution-NoDerivatives",
    "BY-NC": "Attribution-NonCommercial",
    "BY-NC-SA": "Attribution-NonCommercial-ShareAlike",
    "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives",
}

#: License notices and texts by SPDX identifier; several wordings are told apart after a slash.
TEMPLATES = {
    "MIT/notice": "Released under the MIT License.",
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without "
        "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
        "Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
        "conditions: The above copyright notice and this permission notice shall be included in all copies or "
        f"substantial portions of the Software. {_AS_IS}OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
        "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE "
        "SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "ISC/notice": "Released under the ISC License.",
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE "
        "IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED "
        "WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, "
        "INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER "
        "IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR "
        "PERFORMANCE OF THIS SOFTWARE."
    ),
    "BSD-2-Clause": _BSD_HEAD + _BSD_TAIL,
    "BSD-3-Clause": _BSD_HEAD + _BSD_THIRD + _BSD_TAIL,
    "Apache-2.0/notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance "
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless "
        "required by applicable law or agreed to in writing, software distributed under the License is distributed on "
        "an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for "
        "the specific language governing permissions and limitations under the License."
    ),
    "Apache-2.0/text": _whole("Apache-2.0"),
    "MPL-2.0/notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "MPL-2.0": _whole("MPL-2.0"),
    **{
        f"{k}-{v}/notice": f"This work is licensed under the GNU {_GNU[k]} Public License, version {v.removesuffix('.0')}."
        for k, v in _GNU_VERSIONS
    },
    **{
        f"{k}-{v}-{'or-later' if later else 'only'}": _gnu(_GNU[k], v.removesuffix(".0"), later)
        for k, v in _GNU_VERSIONS
        for later in (True, False)
    },
    "GPL-2.0": _whole("GPL-2"),
    "GPL-3.0": _whole("GPL-3"),
    "LGPL-2.1": _whole("LGPL-2.1"),
    "LGPL-3.0": _whole("LGPL-3"),
    **{f"CC-{k}-4.0/notice": f"Licensed under CC {k} 4.0." for k in _CC},
    **{f"CC-{k}-4.0": f"This work is licensed under a Creative Commons {name} 4.0 International License." for k, name in _CC.items()},
    "Unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, "
        "publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for "
        "any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the "
        "author or authors of this software dedicate any and all copyright interest in the software to the public domain. "
        "We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. "
        "We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to "
        f"this software under copyright law. {_AS_IS}BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN "
        "ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER "
        "DEALINGS IN THE SOFTWARE."
    ),
}
#: Phrases that must align in one piece, as they tell a license from its siblings. Templates of up to ``SHORT`` words must
#: align whole.
TELLING = {
    "BSD-3-Clause": ["endorse or promote"],
    "Apache-2.0/notice": ["Apache License, Version 2.0"],
    "Apache-2.0": ["Apache License, Version 2.0"],
    "Apache-2.0/text": ["Apache License Version 2.0"],
    "MPL-2.0": ["Mozilla Public License Version 2.0"],
    **{f"{k}-{v}/notice": [f"GNU {_GNU[k]} Public License", f"version {v.removesuffix('.0')}"] for k, v in _GNU_VERSIONS},
    **{f"{k}-{v}-only": [f"GNU {_GNU[k]} Public License", f"version {v.removesuffix('.0')} of the License"] for k, v in _GNU_VERSIONS},
    **{
        f"{k}-{v}-or-later": [f"GNU {_GNU[k]} Public License", f"version {v.removesuffix('.0')} of the License", "any later version"]
        for k, v in _GNU_VERSIONS
    },
    "GPL-2.0": ["GNU GENERAL PUBLIC LICENSE Version 2"],
    "GPL-3.0": ["GNU GENERAL PUBLIC LICENSE Version 3"],
    "LGPL-2.1": ["GNU LESSER GENERAL PUBLIC LICENSE Version 2.1"],
    "LGPL-3.0": ["GNU LESSER GENERAL PUBLIC LICENSE Version 3"],
    **{f"CC-{k}-4.0/notice": [f"CC {k} 4.0"] for k in _CC},
    **{f"CC-{k}-4.0": [f"{name} 4.0 International"] for k, name in _CC.items()},
}
SHORT = 20
THRESHOLD = 0.8
#: Bytes that separate words: ASCII other than letters and digits. Letters are lower-cased.
_TABLE = bytes((b | 0x20 if 65 <= b <= 90 else b) if b > 127 or chr(b).isalnum() else 0x20 for b in range(256))


def words_in(text: str) -> list[bytes]:
    return text.encode().translate(_TABLE).split()


def increasing(values: list[int]) -> list[int]:
    """Indices of a longest strictly increasing subsequence, by patience sorting."""
    tops, piles, back = [], [], []
    for i, v in enumerate(values):
        pile = bisect_left(tops, v)
        back.append(piles[pile - 1] if pile else None)
        if pile == len(tops):
            tops.append(v)
            piles.append(i)
        else:
            tops[pile], piles[pile] = v, i
    out, i = [], piles[-1] if piles else None
    while i is not None:
        out.append(i)
        i = back[i]
    return out[::-1]


def align(text: list[bytes], template: list[bytes]) -> list[tuple[int, int]]:
    """Pairs of aligned positions (in the text, in the template), in order of both."""
    pairs, gaps = [], [(0, len(text), 0, len(template))]
    while gaps:
        a, b, c, d = gaps.pop()
        while a < b and c < d and text[a] == template[c]:
            pairs.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and text[b - 1] == template[d - 1]:
            b, d = b - 1, d - 1
            pairs.append((b, d))
        here, there = Counter(text[a:b]), Counter(template[c:d])
        at = {w: i for i, w in enumerate(template[c:d], c) if there[w] == 1}
        unique = [(i, at[w]) for i, w in enumerate(text[a:b], a) if here[w] == 1 and w in at]
        anchors = [unique[i] for i in increasing([j for _, j in unique])]
        if anchors:
            pairs += anchors
            inner = [(a - 1, c - 1), *anchors, (b, d)]
            gaps += [(i + 1, k, j + 1, m) for (i, j), (k, m) in zip(inner, inner[1:], strict=False) if i + 1 < k and j + 1 < m]
    return sorted(pairs)


class Scanner:
    """Finds the templates in texts."""

    def __init__(self, templates: dict[str, str], threshold: float = THRESHOLD):
        self.templates = {name: words_in(text) for name, text in templates.items()}
        self.threshold = threshold
        self.wanted = {name: Counter(words) for name, words in self.templates.items()}
        self.need = {name: len(words) if len(words) <= SHORT else threshold * len(words) for name, words in self.templates.items()}
        self.telling = {name: self._places(name) for name in self.templates}

    def _places(self, name: str) -> list[tuple[int, int]]:
        """First occurrence in a template of each of its telling phrases, and their lengths."""
        words, phrases = self.templates[name], [words_in(p) for p in TELLING.get(name, [])]
        starts = [next((i for i in range(len(words)) if words[i : i + len(p)] == p), None) for p in phrases]
        return [(i, len(p)) for i, p in zip(starts, phrases, strict=True) if i is not None]

    def _tells(self, name: str, pairs: list[tuple[int, int]]) -> bool:
        """Whether all telling phrases are aligned, each in one piece."""
        at = {j: i for i, j in pairs}
        return all(c in at and all(at.get(c + i) == at[c] + i for i in range(n)) for c, n in self.telling[name])

    def scan(self, text: str) -> list[tuple[str, float, int, int]]:
        """(template, coverage, first word, last word) of each stretch that covers a template best, in text order."""
        words, found = words_in(text), []
        held = Counter(words)
        for name, wanted in self.wanted.items():
            if len(words) < self.need[name]:
                continue
            common = sum(min(n, held[word]) for word, n in wanted.items() if word in held)
            if common and common >= self.need[name]:
                at = [i for i, word in enumerate(words) if word in wanted]
                found += [(name, *x) for x in self._stretches(words, at, name)]
        taken, best = bytearray(len(words)), []
        for x in sorted(found, key=lambda x: (-round(x[1] * len(self.templates[x[0]])), -x[1], x[2], x[0])):
            first, last = x[2], x[3] + 1
            if 2 * sum(taken[first:last]) <= last - first:
                best.append(x)
                taken[first:last] = b"\1" * (last - first)
        return sorted(best, key=lambda x: (x[2], -x[3], -x[1], x[0]))

    def _bounds(self, words: list[bytes], at: list[int], low: int, high: int, name: str) -> list[int]:
        """For the window that begins at each of the template words low to high: its words in common, repeats included."""
        wanted, reach = self.wanted[name], len(self.templates[name]) * 3 // 2 + 1
        held, common, right, out = Counter(), 0, low, []
        for left in range(low, high):
            while right < high and at[right] < at[left] + reach:
                word = words[at[right]]
                held[word] += 1
                common += held[word] <= wanted[word]
                right += 1
            out.append(common)
            word = words[at[left]]
            common -= held[word] <= wanted[word]
            held[word] -= 1
        return out

    def _best(self, words: list[bytes], starts: list[tuple[int, int]], end: int, name: str) -> list[tuple[int, int]]:
        """The alignment of most words from one of ``starts`` (less its bound, place in the text) on; empty if none will do."""
        template, best = self.templates[name], []
        for bound, start in sorted(starts):
            if -bound <= len(best):
                break
            pairs = align(words[start : min(end, start + len(template) * 3 // 2 + 1)], template)
            if len(pairs) >= self.need[name] and len(pairs) > len(best) and self._tells(name, pairs):
                best = [(start + i, j) for i, j in pairs]
        return best

    def _stretches(self, words: list[bytes], at: list[int], name: str) -> list[tuple[float, int, int]]:
        """Coverage, first and last word of the best alignments, none over another. ``at``: places of template words."""
        size, need, found, todo = len(self.templates[name]), self.need[name], [], [(0, len(at))]
        if not all(self._occurs(words, at, self.templates[name][c : c + n]) for c, n in self.telling[name]):
            return []
        while todo:
            low, high = todo.pop()
            bounds, i = self._bounds(words, at, low, high, name), low
            while i < high:
                if bounds[i - low] < need:
                    i += 1
                    continue
                after = bisect_right(at, at[i] + size * 3 // 2 + 1, i, high)
                near = [(-bounds[j - low], at[j]) for j in range(i, after) if bounds[j - low] >= need]
                best = self._best(words, [*near[:: max(1, size // 100)], min(near)], at[high - 1] + 1, name)
                if not best:
                    i = after
                    continue
                found.append((len(best) / size, best[0][0], best[-1][0]))
                first = bisect_left(at, best[0][0])
                if first - i >= need:  # room for another one before it
                    todo.append((i, first))
                i = bisect_right(at, best[-1][0])
        return found

    def _occurs(self, words: list[bytes], at: list[int], phrase: list[bytes]) -> bool:
        return any(words[i] == phrase[0] and words[i : i + len(phrase)] == phrase for i in at)


def scan_licenses(
    docs: DataFrame, templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD, text: str = "text"
) -> DataFrame:
    """Per document: ``n_licenses``, ``licenses``, ``best``, ``coverage``, ``start_word``, ``end_word``, ``spans``.

    ``spans`` has (license, coverage, start_word, end_word) of every stretch in which ``threshold`` of a template's
    words align, all in short notices, and no other template aligns more; of two that align alike, the one of higher
    coverage, then the first in the text, then the first name. ``licenses`` has the sorted distinct identifiers without
    wording, comma-joined; ``best`` the template of highest coverage, then of more words, then the first in the text,
    with its figures. Without a license, and for null and empty texts, ``n_licenses`` is 0, ``licenses`` empty and the
    others null. One row comes out for each row, null and repeated ids included; other columns are ignored. Words are
    runs of ASCII letters and digits, lower-cased, and other characters.
    """

    def score(texts: list[str]) -> list[list]:
        rows = []
        for t in texts:
            spans = scanner.scan(t)
            names = sorted({name.split("/")[0] for name, *_ in spans})
            best = max(spans, key=lambda s: (s[1], len(scanner.templates[s[0]]), -s[2]), default=(None,) * 4)
            listed = [dict(zip(("license", "coverage", "start_word", "end_word"), s, strict=True)) for s in spans]
            rows.append((len(spans), ",".join(names), *best, listed))
        return [list(column) for column in zip(*rows, strict=True)]

    scanner = Scanner(templates, threshold)
    kinds = "license:string,coverage:double,start_word:int,end_word:int"
    return map_texts(
        docs,
        score,
        ["n_licenses int", "licenses string", "best string", "coverage double", "start_word int", "end_word int", f"spans array<struct<{kinds}>>"],
        text=text,
    )
