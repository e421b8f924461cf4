"""Licence scans by patience alignment.

A text and a template are sequences of words (letters and digits, lower case).  Words that are unique in both are
anchors; of the anchors the longest increasing subsequence stays; the gaps between them are aligned in the same way, after
equal words at their ends.  Coverage is the share of the template's words that are aligned.

Words that the template hasn't can't be aligned; they are left out of the text first, so that gaps of foreign words may be of any
length.  What is left of the text is aligned in windows: at each of its words one as long as the template and one twice
as long; from four times the template's length on, windows of doubling length that overlap by half, and last the whole text.  So a
licence is found however many words stand between its own.  A line (a template of fewer than LINE words) is looked for only in windows of the
text's own words that are as long as the line or twice as long: a few common words stand in order in any long text.
Every window that can reach the threshold is aligned; it can't align more words than it shares with the template, counted with
repeats (an exact bound), nor can a text without enough of the template's distinct words.  The best coverage of all windows counts.

Defined cases: null, empty or wordless texts have no licence; equal coverages: the first template by name is the best, and
of a template's windows the first one, the shorter of two; repeated rows are scanned each; an empty table gives an empty result;
further columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import kernels
from .session import arrow_map

THRESHOLD = 0.8
#: Words of a template that is more than a line.
LINE = 12
STEP_BYTES = 4 << 20
#: Licence notices and texts (fixed values).
TEMPLATES = {
    "Apache-2.0 notice": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "Apache-2.0 line": "Licensed under the Apache License, Version 2.0.",
    "BSD-2-Clause": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "CC-BY-4.0 line": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0 line": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0 line": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0 notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/.",
    "ISC": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "LGPL-2.1 notice": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
    "MIT": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "MIT line": "Released under the MIT License.",
    "MPL-2.0 notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
}
BSD_CLAUSE = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE"
TEMPLATES["BSD-3-Clause"] = TEMPLATES["BSD-2-Clause"].replace("THIS SOFTWARE", BSD_CLAUSE, 1)


def rising(values: list[int]) -> list[int]:
    """Places of a longest increasing subsequence."""
    tails: list[int] = []
    ends: list[int] = []
    before = [-1] * len(values)
    for i, v in enumerate(values):
        k = bisect_left(tails, v)
        before[i] = ends[k - 1] if k else -1
        if k == len(tails):
            tails.append(v)
            ends.append(i)
        else:
            tails[k], ends[k] = v, i
    out = []
    i = ends[-1] if ends else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def align(a: list, b: list) -> list[tuple[int, int]]:
    """Aligned places (in a, in b), rising in both."""
    out = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, j, k, m = todo.pop()
        while i < j and k < m and a[i] == b[k]:
            out.append((i, k))
            i, k = i + 1, k + 1
        while i < j and k < m and a[j - 1] == b[m - 1]:
            j, m = j - 1, m - 1
            out.append((j, m))
        if i >= j or k >= m:
            continue
        seen_a: dict = {}
        seen_b: dict = {}
        for p in range(i, j):
            seen_a[a[p]] = p if a[p] not in seen_a else -1
        for p in range(k, m):
            seen_b[b[p]] = p if b[p] not in seen_b else -1
        anchors = [(p, seen_b[w]) for w, p in seen_a.items() if p >= 0 and seen_b.get(w, -1) >= 0]
        kept = [anchors[x] for x in rising([q for _, q in anchors])]
        if not kept:
            continue
        out += kept
        edges = [(i - 1, k - 1), *kept, (j, m)]
        todo += [(p + 1, r, q + 1, s) for (p, q), (r, s) in zip(edges, edges[1:], strict=False)]
    return sorted(out)


class Template:
    def __init__(self, name: str, text: str, threshold: float):
        raw = text.encode()
        _, _, h, _ = kernels.words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), kernels.ALNUM)
        self.name, self.words = name, h.tolist()
        self.distinct, self.times = np.unique(h, return_counts=True)
        #: Distinct words that a text needs at least to reach the threshold.
        self.least = len(self.distinct) - int((1 - threshold) * len(h) + 1e-9)


def shared(place: np.ndarray, code: np.ndarray, times: np.ndarray, wide: int) -> np.ndarray:
    """For each window of ``wide`` words that starts at one of the ascending places: the words it shares with a template, counted with repeats.  ``code`` numbers the words at the places, ``times`` is how often the template has each."""
    n = len(place)
    order = np.argsort(code, kind="stable")
    back = np.arange(n) - times[code[order]]
    same = (back >= 0) & (code[order[np.maximum(back, 0)]] == code[order])
    # an occurrence counts in the windows that hold it, but not the one of the same word that many times before
    after = np.zeros(n, np.int64)
    after[order[same]] = order[back[same]] + 1
    change = np.bincount(np.maximum(after, np.searchsorted(place, place - wide, "right")), minlength=n + 1)
    change[1:] -= 1
    return np.cumsum(change[:-1])


def doubled(wide: int, most: int) -> list[int]:
    """Lengths of windows: wide, doubled until one holds all."""
    out = [wide]
    while out[-1] < most:
        out.append(2 * out[-1])
    return out if wide // 2 < most else []


def scan(docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = THRESHOLD, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_words, n_licenses, licenses (names, comma-joined), best_license, best_coverage, span_start and span_end (bytes of the best one's first and last aligned word).  One pass, no shuffle."""
    templates = TEMPLATES if templates is None else templates
    src = docs.select(key, text)
    kind = dict(src.dtypes)[key]

    def work(batches):
        use = [Template(n, t, threshold) for n, t in sorted(templates.items())]
        every = np.unique(np.concatenate([t.distinct for t in use])) if use else np.empty(0, np.uint64)
        quick = np.zeros(1 << 20, bool)
        quick[(every >> np.uint64(44)).astype(np.int64)] = True
        member = [np.isin(every, t.distinct) for t in use]
        times = [np.zeros(len(every), np.int64) for _ in use]
        for t, m, c in zip(use, member, times, strict=True):
            c[m] = t.times

        def rows(raw, at):
            start, end, h, first = kernels.words(raw, at, kernels.ALNUM)
            code = np.full(len(h), -1)
            may = np.flatnonzero(quick[(h >> np.uint64(44)).astype(np.int64)])
            place = np.minimum(np.searchsorted(every, h[may]), max(0, len(every) - 1))
            code[may] = np.where(every[place] == h[may], place, -1) if len(every) else -1
            hits = np.flatnonzero(code >= 0)
            edge = np.searchsorted(hits, first)
            for r in range(len(at) - 1):
                n = int(first[r + 1] - first[r])
                own = hits[edge[r] : edge[r + 1]]
                found = []
                if len(own):
                    present = np.zeros(len(every), bool)
                    present[code[own]] = True
                    for t, m, c in zip(use, member, times, strict=True):
                        if (present & m).sum() >= max(1, t.least):
                            found += best(t, own[m[code[own]]], c, code, h)
                yield n, found, start, end, int(at[r])

        def best(t, mine, c, code, h):
            n, own = len(t.words), h[mine].tolist()
            codes = code[mine]
            # places of the template's words: in the text, or counted without foreign words
            place = mine if n < LINE else np.arange(len(mine))
            start = np.repeat(np.arange(len(mine)), 2)
            stop = np.stack([np.searchsorted(place, place + wide) for wide in (n, 2 * n)], axis=1).reshape(-1)
            most = np.stack([shared(place, codes, c, wide) for wide in (n, 2 * n)], axis=1).reshape(-1)
            if n >= LINE:
                far = [(a, min(a + wide, len(mine))) for wide in doubled(4 * n, len(mine)) for a in range(0, len(mine), wide // 2) if a == 0 or a + wide // 2 < len(mine)]
                if far:
                    reach = [np.minimum(np.bincount(codes[a:b], minlength=len(c)), c).sum() for a, b in far]
                    start, stop, most = (np.concatenate(x) for x in ((start, [a for a, _ in far]), (stop, [b for _, b in far]), (most, reach)))
            able = np.flatnonzero(most / n >= threshold)
            top, at, out = 0, None, None
            for w in able[np.lexsort((stop[able], start[able], -most[able]))].tolist():
                if most[w] < top:
                    break
                here = (int(start[w]), int(stop[w]))
                if most[w] == top and here > at:
                    continue
                pairs = align(t.words, own[here[0] : here[1]])
                if len(pairs) / n >= threshold and (len(pairs) > top or (len(pairs) == top and here < at)):
                    top, at = len(pairs), here
                    out = (t.name, top / n, int(mine[here[0] + pairs[0][1]]), int(mine[here[0] + pairs[-1][1]]))
            return [out] if out else []

        for batch in batches:
            raw, at = kernels.flat(batch.column(1))
            i = 0
            while i < batch.num_rows:
                j = max(i + 1, int(np.searchsorted(at, at[i] + STEP_BYTES, "right")) - 1)
                cols: list[list] = [[] for _ in range(7)]
                for n, found, start, end, base in rows(raw[at[i] : at[j]], at[i : j + 1] - at[i]):
                    top = min(found, key=lambda f: (-f[1], f[0])) if found else None
                    row = (n, len(found), ",".join(f[0] for f in found), *((top[0], top[1], int(start[top[2]]) - base, int(end[top[3]]) - base) if top else (None, 0.0, None, None)))
                    for c, v in zip(cols, row, strict=True):
                        c.append(v)
                types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *[pa.array(c, t) for c, t in zip(cols, types, strict=True)]], [key, "n_words", "n_licenses", "licenses", "best_license", "best_coverage", "span_start", "span_end"])
                i = j

    return arrow_map(src, work, f"`{key}` {kind}, n_words bigint, n_licenses bigint, licenses string, best_license string, best_coverage double, span_start bigint, span_end bigint")
