"""License scans by patience alignment against license texts and notices.

Trigrams of the long templates find places of a document where a template may lie; hits on neighbouring diagonals make a
candidate window of bounded length. Short templates (up to ``SHORT`` tokens), of which few changes break every trigram, are
found by tokens that no accepted window can lack: a deciding word, a number, or one more of the longest tokens than may be
missing; all windows around such a token are tried. Template and window are aligned: tokens that occur once in either are anchors, the
longest increasing subsequence of their positions is kept, and the gaps between anchors are aligned in the same way.
Coverage is the share of the template's tokens that are aligned. A window whose coverage reaches ``LEAST_COVERAGE`` is a
finding unless a deciding word speaks against it: words that tell one license from another (names, version numbers, ND, SA,
NC, Lesser, Affero and the like) must be aligned where the template has them, and none may stand in the aligned stretch,
or right beside its ends, that the template lacks. Of findings that overlap, the one with the most aligned tokens stays
(ties: the higher coverage, then the earlier name).

Templates are parameters (name -> text); the table below holds short notices and the bodies of common licenses. Of the
long licenses (GPL, LGPL, AGPL, MPL, Apache) it holds the notices that files carry, not the whole texts.

Cases: null and empty texts have no findings. Short templates (below three tokens) are not sought. Repeated rows get equal
answers; a license that occurs twice is listed twice among the findings and once among the names. Only the id and text
are read, so ids of any type and extra columns of any name do no harm. The whole text is scanned, in one pass without a
shuffle; memory is bounded by the longest text, and a window by its template's length, whatever a text repeats.
"""

from __future__ import annotations

import bisect
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from broadsheet.llm.decontaminate import _tokens
from broadsheet.llm.shared import chunks, small_batches
from broadsheet.llm.words import U64

LEAST_COVERAGE = 0.8
_GRAM = 3
#: Tokens up to which a template is sought by single tokens.
SHORT = 30
_FILTER_BITS = 20

#: Words that tell a license from its neighbours, besides numbers.
DECIDING = "mit bsd apache gnu mozilla cc creative lesser library affero nd nc sa noderivatives noderivs noncommercial sharealike".split()

#: Public license texts and usual notices.
TEMPLATES = {
    "MIT notice": "Released under the MIT License.",
    "MIT notice, licensed": "Licensed under the MIT License.",
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0 notice": "Licensed under the GNU General Public License, version 3.",
    "GPL-2.0 notice": "Licensed under the GNU General Public License, version 2.",
    "LGPL-3.0 notice": "Licensed under the GNU Lesser General Public License, version 3.",
    "LGPL-2.1 notice": "Licensed under the GNU Lesser General Public License, version 2.1.",
    "AGPL-3.0 notice": "Licensed under the GNU Affero General Public License, version 3.",
    "LGPL notice": "Licensed under the GNU Lesser General Public License.",
    "AGPL notice": "Licensed under the GNU Affero General Public License.",
    "BSD notice": "Licensed under the BSD License.",
    "MPL-2.0 notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "CC-BY-4.0 notice": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0 notice": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0 notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-ND-4.0 notice": "Licensed under CC BY-ND 4.0.",
    "CC-BY-NC-SA-4.0 notice": "Licensed under CC BY-NC-SA 4.0.",
    "CC-BY-NC-ND-4.0 notice": "Licensed under CC BY-NC-ND 4.0.",
    "CC-BY-4.0 long notice": "Licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0 long notice": "Licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-NC-4.0 long notice": "Licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "CC-BY-ND-4.0 long notice": "Licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    "CC-BY-NC-SA-4.0 long notice": "Licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
    "CC-BY-NC-ND-4.0 long notice": "Licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.",
    "All rights reserved": "All rights reserved.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "GPL-3.0-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
}


def patience(a: list, b: list) -> list[tuple[int, int]]:
    """Aligned positions of two token sequences, increasing in both."""
    out: list[tuple[int, int]] = []
    stack = [(0, len(a), 0, len(b))]
    while stack:
        a0, a1, b0, b1 = stack.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        ca, cb = Counter(a[a0:a1]), Counter(b[b0:b1])
        at = {t: j for j, t in enumerate(b[b0:b1], b0) if cb[t] == 1}
        pairs = [(i, at[t]) for i, t in enumerate(a[a0:a1], a0) if ca[t] == 1 and t in at]
        chain = _increasing(pairs)
        if not chain:
            continue
        before = (a0 - 1, b0 - 1)
        for i, j in chain:
            stack.append((before[0] + 1, i, before[1] + 1, j))
            out.append((i, j))
            before = (i, j)
        stack.append((before[0] + 1, a1, before[1] + 1, b1))
    return sorted(out)


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest subsequence of pairs (ascending in the first place) that ascends in the second, by patience piles."""
    tops: list[int] = []
    last: list[int] = []
    back = [-1] * len(pairs)
    for k, (_, j) in enumerate(pairs):
        p = bisect.bisect_left(tops, j)
        if p == len(tops):
            tops.append(j), last.append(k)
        else:
            tops[p], last[p] = j, k
        back[k] = last[p - 1] if p else -1
    out, k = [], last[-1] if last else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def _plain(text: str) -> list[str]:
    """The tokens of a text as strings, parted as :func:`_tokens` parts them."""
    return re.findall(r"[^\x00-\x2f:-@\[-^`{-~\x7f]+|[0-9A-Za-z_]+", text)


def _needed(n: int) -> int:
    """Least number of aligned tokens of a template of ``n``."""
    return next(k for k in range(n + 1) if k >= LEAST_COVERAGE * n)


def _beside(tokens: np.ndarray, a: int, b: int) -> tuple[int | None, int | None]:
    """The tokens right before and after a window."""
    return (int(tokens[a - 1]) if a > 0 else None), (int(tokens[b]) if b < len(tokens) else None)


class Scanner:
    """Trigrams of long templates and single tokens of short ones in hash tables, with bit tables before them."""

    def __init__(self, templates: dict[str, str]):
        self.names = list(templates)
        words = _tokens(pa.array([templates[n] for n in self.names], pa.string()))
        self.tokens = [words.hash[words.bounds[i] : words.bounds[i + 1]].tolist() for i in range(len(self.names))]
        named = _tokens(pa.array([" ".join(DECIDING)], pa.string())).hash.tolist()
        self.deciding = set(named)
        digits = [[any(c.isdigit() for c in t) for t in _plain(templates[n])] for n in self.names]
        #: Positions of each template that must be aligned.
        self.must = [{p for p, t in enumerate(tokens) if d[p] or t in self.deciding} for tokens, d in zip(self.tokens, digits)]
        self.grams: dict[int, list[tuple[int, int]]] = defaultdict(list)
        self.singles: dict[int, list[tuple[int, int]]] = defaultdict(list)
        rank = {w: k for k, w in enumerate(named)}
        for t, tokens in enumerate(self.tokens):
            if _GRAM <= len(tokens) <= SHORT:
                texts = _plain(templates[self.names[t]])
                if self.must[t]:
                    chosen = {tokens[min(self.must[t], key=lambda p: (rank.get(tokens[p], len(rank)), p))]}
                    places = [p for p in range(len(tokens)) if tokens[p] in chosen]
                else:
                    missing = len(tokens) - _needed(len(tokens))
                    places = sorted(range(len(tokens)), key=lambda p: (-len(texts[p]), p))[: missing + 1]
                for p in places:
                    self.singles[tokens[p]].append((t, p))
        self.token_bits = np.zeros(1 << _FILTER_BITS, bool)
        self.token_bits[np.array(list(self.singles), U64) & U64((1 << _FILTER_BITS) - 1)] = True
        h, bounds, _ = words.windows(_GRAM)
        for t in range(len(self.names)):
            if len(self.tokens[t]) <= SHORT:
                continue
            for p, g in enumerate(h[bounds[t] : bounds[t + 1]].tolist()):
                self.grams[g].append((t, p))
        self.bits = np.zeros(1 << _FILTER_BITS, bool)
        self.bits[np.array(list(self.grams), U64) & U64((1 << _FILTER_BITS) - 1)] = True

    def _fits(self, t: int, window: list[int], before: int | None = None, after: int | None = None) -> tuple[int, int, int] | None:
        """Aligned tokens, and first and end position in the window, if the window holds template ``t``; ``before`` and
        ``after`` are the tokens beside the window."""
        template = self.tokens[t]
        pairs = patience(template, window)
        if not pairs or len(pairs) < _needed(len(template)):
            return None
        if not self.must[t] <= {i for i, _ in pairs}:
            return None
        first, end = pairs[0][1], pairs[-1][1] + 1
        if (first == 0 and before in self.deciding) or (end == len(window) and after in self.deciding):
            return None
        aligned = {j for _, j in pairs}
        if any(w in self.deciding and j not in aligned for j, w in enumerate(window[max(0, first - 1) : end + 1], max(0, first - 1))):
            return None
        return len(pairs), first, end

    def _near_singles(self, words) -> Iterator[tuple[int, int, int]]:
        """(text, template, where it would begin) for each place of a short template's token."""
        near = np.flatnonzero(self.token_bits[words.hash & U64((1 << _FILTER_BITS) - 1)])
        owner = np.searchsorted(words.bounds, near, "right") - 1
        for k, d, h in zip(near.tolist(), owner.tolist(), words.hash[near].tolist()):
            for t, p in self.singles.get(h, ()):
                yield d, t, k - int(words.bounds[d]) - p

    def scan(self, texts: pa.Array) -> list[list[tuple[str, float, int, int]]]:
        """(name, coverage, first token, end token) of each text's findings, in order of place."""
        words = _tokens(texts)
        h, bounds, _ = words.windows(_GRAM)
        near = np.flatnonzero(self.bits[h & U64((1 << _FILTER_BITS) - 1)])
        owner = np.searchsorted(bounds, near, "right") - 1
        hits: dict[tuple[int, int], list[int]] = defaultdict(list)
        for k, d, g in zip(near.tolist(), owner.tolist(), h[near].tolist()):
            for t, p in self.grams.get(g, ()):
                hits[d, t].append(k - int(bounds[d]) - p)
        found: dict[int, list] = defaultdict(list)
        for (d, t), diagonals in hits.items():
            template = self.tokens[t]
            slack = max(2, len(template) // 5)
            tokens = None
            diagonals.sort()
            start = 0
            for k in range(1, len(diagonals) + 1):
                end = k == len(diagonals) or diagonals[k] - diagonals[k - 1] > slack
                if end or diagonals[k] - diagonals[start] > 4 * slack:
                    if tokens is None:
                        tokens = words.hash[words.bounds[d] : words.bounds[d + 1]]
                    low, high = max(0, diagonals[start] - slack), min(len(tokens), diagonals[k - 1] + len(template) + slack)
                    got = self._fits(t, tokens[low:high].tolist(), *_beside(tokens, low, high))
                    if got is not None:
                        found[d].append((got[0], got[0] / len(template), self.names[t], low + got[1], low + got[2]))
                    # A long chain is cut into windows that overlap by two slacks.
                    start = k if end else bisect.bisect_left(diagonals, diagonals[k] - 2 * slack, start + 1, k)
        for d, t, at in self._near_singles(words):
            own, template = words.hash[words.bounds[d] : words.bounds[d + 1]], self.tokens[t]
            slack = max(2, len(template) // 5)
            low, high = max(0, at - slack), min(len(own), at + len(template) + slack)
            around = own[low:high].tolist()
            held = set(around)
            if sum(w in held for w in template) < _needed(len(template)):
                continue
            best = None
            for a in range(low, min(high, at + slack) + 1):
                for b in range(max(a, at + len(template) - slack), high + 1):
                    if best is not None and best[0] == len(template):
                        break
                    got = self._fits(t, around[a - low : b - low], *_beside(own, a, b))
                    if got is not None and (best is None or got[0] > best[0]):
                        best = got[0], a + got[1], a + got[2]
            if best is not None:
                found[d].append((best[0], best[0] / len(template), self.names[t], best[1], best[2]))
        out = []
        for d in range(len(texts)):
            kept: list = []
            for n, c, name, a, b in sorted(found.get(d, ()), key=lambda f: (-f[0], -f[1], f[2], f[3])):
                if all(b <= x[2] or a >= x[3] for x in kept):
                    kept.append((name, c, a, b))
            out.append(sorted(kept, key=lambda f: f[2]))
        return out


_FINDINGS = pa.list_(pa.struct([("license", pa.string()), ("coverage", pa.float64()), ("start", pa.int32()), ("end", pa.int32())]))


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_findings, licenses, coverage, findings) of every row; coverage is the best one, 0 without findings."""
    small_batches(docs.sparkSession)
    scanner = Scanner(templates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            got = scanner.scan(batch.column(1))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(f) for f in got], pa.int64()),
                    pa.array([sorted({x[0] for x in f}) for f in got], pa.list_(pa.string())),
                    pa.array([max((x[1] for x in f), default=0.0) for f in got]),
                    pa.array([[dict(zip(("license", "coverage", "start", "end"), x)) for x in f] for f in got], _FINDINGS),
                ],
                names=["id", "n_findings", "licenses", "coverage", "findings"],
            )

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("body"))
    kind = dict(source.dtypes)["id"]
    return source.mapInArrow(run, f"id {kind}, n_findings long, licenses array<string>, coverage double, findings array<struct<license:string,coverage:double,start:int,end:int>>")
