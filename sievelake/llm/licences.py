"""Licence scan: generalised suffix automaton of licence templates, matching statistics over streamed texts, chains of long matches.

The templates' words make one suffix automaton. A text's words are fed to it
one by one; at each word the automaton's length is the longest suffix that
occurs in some template (the matching statistics). Matches of MIN words at
least that can't be made longer are chained, template by template, in the order
of both text and template with gaps of at most GAP words; a chain that covers
COVER of its template's words, or LONG words, is a licence span. Of chains that
overlap, of one template or of several, the one that covers most words is taken,
then the one that covers most of its template; those equal in both all count.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievelake.llm import arrays as A

MIN, GAP, COVER, LONG = 4, 16, 0.6, 24
#: Fixed: phrases whose place alone names a licence.
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
_AS_IS = "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."
_BSD_2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_3 = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ISC_END = """THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""


def _gnu(name: str, version: str) -> str:
    """The notice that programs under a licence of this family carry."""
    return f"""This program is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details.
You should have received a copy of the GNU {name} along with this program. If not, see https://www.gnu.org/licenses/"""


#: Fixed: public licences, whole where they are short, else the notice that files carry; and short forms. (label, words)
TEMPLATES = (
    ("mit", "released under the MIT License"),
    ("mit", f"""Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
{_AS_IS} IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("apache-2", "licensed under the Apache License, Version 2.0"),
    ("apache-2", """Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""),
    ("bsd-2", f"{_BSD_2}\n{_BSD_END}"),
    ("bsd-3", f"{_BSD_2}\n{_BSD_3}\n{_BSD_END}"),
    ("isc", f"Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n{_ISC_END}"),
    ("0bsd", f"Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n{_ISC_END}"),
    ("zlib", """This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""),
    ("bsl-1", """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the Software) to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:
The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor."""),
    ("unlicense", f"""This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.
{_AS_IS} IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE. For more information, please refer to https://unlicense.org"""),
    ("wtfpl", "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE. Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed. TERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION 0. You just DO WHAT THE FUCK YOU WANT TO."),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("epl-2", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("gpl-2", _gnu("General Public License", "2")),
    ("gpl-3", _gnu("General Public License", "3")),
    ("lgpl-2", _gnu("Lesser General Public License", "2.1")),
    ("lgpl-3", _gnu("Lesser General Public License", "3")),
    ("agpl-3", _gnu("Affero General Public License", "3")),
    ("gpl-2", "this work is licensed under the GNU General Public License, version 2"),
    ("gpl-3", "this work is licensed under the GNU General Public License, version 3"),
    ("cc-by-nc", "licensed under CC BY-NC 4.0"),
    ("cc-by", "licensed under CC BY 4.0"),
    ("cc-by-sa", "licensed under CC BY-SA 4.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-nd", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License"),
    ("cc-by-nc-sa", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"),
    ("cc-by-nc-nd", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("cc0", "dedicated to the public domain under the CC0 1.0 Universal Public Domain Dedication"),
)
_GAP = np.zeros(256, bool)
_GAP[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True


def word_hashes(text: str) -> np.ndarray:
    b = A.LOWER[np.frombuffer(text.encode(), np.uint8)]
    ws, we, _ = A.words(b, np.array([0]), np.array([len(b)]), _GAP)
    return A.word_hashes(b, ws, we)


class Automaton:
    """Suffix automaton of several word sequences; each state knows where its words end in each of them."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[set[tuple[int, int]]] = [set()]
        for t, seq in enumerate(sequences):
            last = 0
            for i, w in enumerate(seq):
                last = self._extend(last, w)
                self.ends[last].add((t, i))
        for s in sorted(range(1, len(self.next)), key=lambda s: -self.length[s]):
            if self.link[s] > 0:
                self.ends[self.link[s]] |= self.ends[s]

    def _new(self, length: int, like: int | None = None) -> int:
        self.next.append(dict(self.next[like]) if like is not None else {})
        self.link.append(self.link[like] if like is not None else -1)
        self.length.append(length)
        self.ends.append(set())
        return len(self.next) - 1

    def _split(self, p: int, w: int, q: int) -> int:
        """The state for p's words and w: q itself, or a copy of it that is as short."""
        if self.length[q] == self.length[p] + 1:
            return q
        clone = self._new(self.length[p] + 1, q)
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = clone
            p = self.link[p]
        self.link[q] = clone
        return clone

    def _extend(self, last: int, w: int) -> int:
        if w in self.next[last]:
            return self._split(last, w, self.next[last][w])
        cur = self._new(self.length[last] + 1)
        p = last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = cur
            p = self.link[p]
        self.link[cur] = 0 if p < 0 else self._split(p, w, self.next[p][w])
        return cur

    def matches(self, seq, least: int) -> Iterator[tuple[int, int, int]]:
        """(end, length, state) of each match of `least` words or more that can't be made longer on either side."""
        s = n = 0
        for i, w in enumerate(seq):
            if w not in self.next[s]:
                if n >= least:
                    yield i, n, s
                while s and w not in self.next[s]:
                    s = self.link[s]
                    n = self.length[s]
            if w in self.next[s]:
                s, n = self.next[s][w], n + 1
        if n >= least:
            yield len(seq), n, s


class Scanner:
    def __init__(self, templates=TEMPLATES, phrases=PHRASES):
        hashes = [word_hashes(t) for _, t in templates]
        self.vocab = np.unique(np.concatenate(hashes))
        seqs = [np.searchsorted(self.vocab, h).tolist() for h in hashes]
        self.labels, self.sizes = [x for x, _ in templates], [len(s) for s in seqs]
        self.auto = Automaton(seqs)
        self.phrases = [(word_hashes(p), label) for p, label in phrases]

    def spans(self, ids, offset: int) -> list[tuple[str, int, int, float]]:
        """(label, first word, end word, share of the template covered) of the chains in one stretch of words that are licence spans and don't overlap, but for those equally good."""
        by: dict[int, list[tuple[int, int, int]]] = {}
        for end, n, s in self.auto.matches(ids, MIN):
            for t, e in self.auto.ends[s]:
                by.setdefault(t, []).append((end, e + 1, n))
        found = [(c[3], c[3] / self.sizes[t], c[0], c[1], self.labels[t]) for t, x in by.items() for c in self._apart(sorted(x), self.sizes[t])]
        taken: list[tuple[int, int, int, float]] = []
        out = []
        for n, share, a, b, label in sorted(found, key=lambda c: (-c[0], -c[1], c[2], c[4])):
            i = bisect.bisect_left(taken, (a, b))
            free = (i == 0 or taken[i - 1][1] <= a) and (i == len(taken) or b <= taken[i][0])
            if free:
                taken.insert(i, (a, b, n, share))
            if free or i < len(taken) and taken[i] == (a, b, n, share):
                out.append((label, a + offset, b + offset, min(1.0, share)))
        return out

    @staticmethod
    def _enough(words: int, size: int) -> bool:
        return words >= COVER * size or words >= LONG

    def _apart(self, found: list[tuple[int, int, int]], size: int) -> list[tuple[int, int, int, int]]:
        """Chains that cover enough of a template of that size and don't overlap, best first; what is left between them is chained again."""
        out, todo = [], [found]
        while todo:
            part = todo.pop()
            taken: list[tuple[int, int]] = []
            for c in sorted(self._chains(part), key=lambda c: (-c[3], c[0])):
                if not self._enough(c[3], size):
                    break
                i = bisect.bisect_left(taken, c[:2])
                if (i == 0 or taken[i - 1][1] <= c[0]) and (i == len(taken) or c[1] <= taken[i][0]):
                    taken.insert(i, c[:2])
                    out.append(c)
            if not taken:
                continue
            for lo, hi in zip([-1, *(b for _, b in taken)], [*(a for a, _ in taken), part[-1][0]], strict=True):
                if self._enough(hi - lo, size):
                    near = part[bisect.bisect_right(part, lo, key=lambda x: x[0]) : bisect.bisect_right(part, hi + size, key=lambda x: x[0])]
                    # Matches that reach beyond the gap are cut to it.
                    fit = [(min(end, hi), e - max(0, end - hi), min(end, hi) - max(end - n, lo)) for end, e, n in near]
                    if fit := sorted(x for x in fit if x[2] >= MIN):
                        todo.append(fit)
        return out

    def _chains(self, found: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int]]:
        """The best chain that ends with each match: start, end, template end, words covered."""
        chains: list[tuple[int, int, int, int]] = []
        for end, e, n in found:
            best = (end - n, end, e, n)
            for c in reversed(chains):
                if end - n - c[1] > GAP:
                    if end - n - c[1] > GAP + max(self.sizes):
                        break
                    continue
                new = min(n, end - c[1], e - c[2])
                if c[1] < end and c[2] < e and new > 0 and e - n - c[2] <= GAP and c[3] + new > best[3]:
                    best = (c[0], end, e, c[3] + new)
            chains.append(best)
        return chains


@lru_cache(4)
def scanner(templates=TEMPLATES, phrases=PHRASES) -> Scanner:
    return Scanner(templates, phrases)


def scan(docs: DataFrame, templates=TEMPLATES, phrases=PHRASES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans) of every row of docs.

    Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after lower-casing A-Z.
    n_base counts the places of all phrases, first_word and last_word are the
    smallest and largest start (null without a place). labels adds those of
    licence spans; score is 1 with a phrase, else the
    best span's share of its template. spans lists label:first:end of such
    spans. Null text is empty: no words, no labels, score 0. Rows repeated each
    come back; an empty table gives no rows. Other columns play no part, whatever their names.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sc = scanner(templates, phrases)
        for batch in batches:
            for at, to, buf, starts, ends in A.texts(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, to - at), *_scan(sc, A.LOWER[buf], starts, ends)], names)

    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
    A.tune(docs.sparkSession)
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(A.rested(run), f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans string")


def _scan(sc: Scanner, low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[pa.Array]:
    m = len(starts)
    ws, we, at = A.words(low, starts, ends, _GAP)
    n = np.diff(at)
    rows = np.repeat(np.arange(m), n)
    h = A.word_hashes(low, ws, we)
    base: list[list[tuple[int, str]]] = [[] for _ in range(m)]
    for phrase, label in sc.phrases:
        k = len(phrase)
        if len(h) < k:
            continue
        hit = h[: len(h) - k + 1] == phrase[0]
        for j in range(1, k):
            hit &= h[j : len(h) - k + 1 + j] == phrase[j]
        for i in np.flatnonzero(hit):
            if rows[i] == rows[i + k - 1]:
                base[rows[i]].append((int(i - at[rows[i]]), label))
    spans: list[list[tuple[str, int, int, float]]] = [[] for _ in range(m)]
    ids = np.minimum(np.searchsorted(sc.vocab, h), len(sc.vocab) - 1)
    known = sc.vocab[ids] == h
    edge = np.ones(len(h) + 1, bool)
    edge[1:-1] = (known[1:] != known[:-1]) | (rows[1:] != rows[:-1])
    cut = np.flatnonzero(edge)
    # A word outside the templates takes the automaton back to its root, so stretches of known words can go one by one; those nearby are chained together.
    long = (np.diff(cut) >= MIN) & known[cut[:-1]] if len(h) else np.zeros(0, bool)
    group: list[tuple[int, int]] = []
    for s, e in zip(cut[:-1][long].tolist(), cut[1:][long].tolist(), strict=True):
        if group and rows[group[-1][0]] == rows[s] and s - group[-1][1] <= GAP:
            group[-1] = (group[-1][0], e)
        else:
            group.append((s, e))
    for s, e in group:
        seq = np.where(known[s:e], ids[s:e], -1).tolist()
        spans[rows[s]] += sc.spans(seq, int(s - at[rows[s]]))
    first = [min(p for p, _ in b) if b else None for b in base]
    last = [max(p for p, _ in b) if b else None for b in base]
    named = [",".join(sorted({x for _, x in b})) for b in base]
    full = [",".join(sorted({x for _, x in b} | {x[0] for x in s})) for b, s in zip(base, spans, strict=True)]
    score = [1.0 if b else max([x[3] for x in s], default=0.0) for b, s in zip(base, spans, strict=True)]
    said = [",".join(f"{x}:{a}:{b}" for x, a, b, _ in sorted(set(s), key=lambda y: (y[1], y[2], y[0]))) for s in spans]
    ints = lambda x: pa.array(x, pa.int64())
    return [ints(n), ints([len(b) for b in base]), ints(first), ints(last), pa.array(named), pa.array(full), pa.array(score, pa.float64()), pa.array(said)]
