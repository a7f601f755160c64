"""License scans: winnowed fingerprints of templates in an inverted index pick candidates, banded alignment measures them.

Words are runs of letters and digits, lower-cased (A-Z). Hashes of GRAM words are winnowed: of every WINDOW neighbours the
least is kept, so a template that shares WINDOW + GRAM - 1 words in a row with a text shares a fingerprint. A template of
SHORT words or fewer has each pair of neighbouring words as a fingerprint, and is a candidate where these cover half of it.
Every document's hashes are looked up; hits of one template on diagonals less than its length apart are a candidate, so a
template with words put into it is one, and the words around it are aligned to the template within a band around those
diagonals. A match is reported from MIN_COVERAGE of the template's words on, in at most twice as many words of the text.

Null and empty texts match nothing; repeated rows are scanned alike; a template that stands twice in a text is reported twice;
of templates matching at the same place all are reported, the best first in `rank`: more of the template, then more words,
then the earlier place, then the name. Very long texts are aligned only around their candidates. Other columns are ignored.
`read_templates` takes full texts from a folder.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formlake.llm.kernels import WordTable, chunks

GRAM, WINDOW, SHORT = 3, 3, 12
BAND, MIN_COVERAGE = 8, 0.7

#: Notices of public licenses.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "MIT": "Released under the MIT License.",
    "MIT-text": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "BSD-2-Clause": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.',
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "BSD-3-Clause-text": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "MIT-disclaimer": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "ISC": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "MPL-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "GPL-2.0-header": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "LGPL-2.1-header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "AGPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
}

_WORDLESS = np.ones(256, bool)
_WORDLESS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_FILTER_BITS = 20


def winnow(h: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Places of the fingerprints: the rightmost least hash of every `window` neighbours; of fewer hashes, the least."""
    if not len(h):
        return np.zeros(0, np.int64)
    if len(h) <= window:
        return np.array([len(h) - 1 - int(h[::-1].argmin())])
    views = np.lib.stride_tricks.sliding_window_view(h, window)[:, ::-1]
    return np.unique(np.arange(len(views)) + window - 1 - views.argmin(axis=1))


class Templates:
    """Templates' word hashes and the inverted index of their fingerprints."""

    def __init__(self, templates: dict[str, str]):
        self.names = sorted(templates)
        table = WordTable([templates[n].encode() for n in self.names], lower=True, separator=_WORDLESS)
        self.words = [table.hashes[table.first[i] : table.first[i + 1]] for i in range(len(self.names))]
        h, at = table.grams(GRAM, short=True)
        owner = table.doc_of()[at]
        self.index: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for i in range(len(self.names)):
            own, place = h[owner == i], at[owner == i] - table.first[i]
            if len(self.words[i]) <= SHORT:
                continue
            for k in winnow(own).tolist():
                self.index[int(own[k])].append((i, int(place[k])))
        # Short templates: every pair of neighbouring words.
        h, at = table.grams(2, short=True)
        for x, place in zip(h.tolist(), at.tolist(), strict=True):
            i = int(np.searchsorted(table.first, place, "right")) - 1
            if len(self.words[i]) <= SHORT:
                self.index[x].append((i, place - int(table.first[i])))
        self.filter = np.zeros(1 << _FILTER_BITS, bool)
        self.known = np.array(sorted(self.index), np.uint64)
        self.filter[(self.known >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True

    def hits(self, h: np.ndarray) -> np.ndarray:
        may = np.flatnonzero(self.filter[(h >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)])
        return may[np.isin(h[may], self.known)]


#: A cell of an alignment in one number: words matched, first matched place + 1, places left after the last; more is better.
_PLACE = 21
_FIRST, _LAST = np.int64(((1 << _PLACE) - 1) << _PLACE), np.int64((1 << _PLACE) - 1)
_ONE = np.int64(1) << np.int64(2 * _PLACE)


def align(template: np.ndarray, text: np.ndarray, low: int, high: int) -> tuple[int, int, int]:
    """The most template words matched, in order, by text words whose place minus the template's lies in [low, high], and the first and last matched place in the text. Of equal alignments the shortest span, then the first, counts."""
    # Of as many matched, the later first place can only end in a shorter span. A row of the band takes one template word.
    wide = high - low + 1
    row = np.zeros(wide + 1, np.int64)
    padded = np.zeros(wide + len(template) - 1, text.dtype)
    there = np.zeros(len(padded), bool)
    a, b = max(0, low), min(len(text), low + len(padded))
    if b > a:
        padded[a - low : b - low], there[a - low : b - low] = text[a:b], True
    for i, word in enumerate(template.tolist()):
        d = np.flatnonzero((padded[i : i + wide] == word) & there[i : i + wide])
        if not len(d):
            # Only the template's word is skipped: the text's place moves against the band.
            row[:-1] = row[1:]
            continue
        j = i + low + d
        was = row[d]
        hit = np.where(was > 0, (was & ~_LAST) + _ONE, _ONE | (j + 1) << _PLACE) | (_LAST - j)
        row[:-1] = row[1:]
        row[-1] = 0
        np.maximum.at(row, d, hit)
        row[:-1] = np.maximum.accumulate(row[:-1])
        row[-1] = 0
    best = row[row >> np.int64(2 * _PLACE) == int(row.max()) >> 2 * _PLACE]
    first, last = ((best & _FIRST) >> _PLACE) - 1, _LAST - (best & _LAST)
    k = int(np.lexsort((first, last - first))[0])
    n = int(best[k]) >> 2 * _PLACE
    return (n, int(first[k]), int(last[k])) if n else (0, 0, 0)


def scan_words(words: np.ndarray, hit: list[tuple[int, int]], templates: Templates) -> list[tuple[int, int, int, int]]:
    """(template, matched words, first and last matched word) of every candidate of one text that is covered enough. hit: (first word, hash) of the fingerprints found."""
    diagonals: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for k, x in hit:
        for i, place in templates.index[x]:
            diagonals[i].append((k - place, place))
    out = []
    for i, found in diagonals.items():
        size = len(templates.words[i])
        near: list[list] = []
        for d, place in sorted(found):
            # Diagonals more than a template's length apart are different places.
            if near and d - near[-1][1] <= max(BAND, size):
                near[-1][1] = d
            else:
                near.append([d, d, set()])
            near[-1][2] |= {place, place + 1}
        for low, high, covered in near:
            if size <= SHORT and 2 * len(covered) < size:
                continue
            # A band that grows beyond a template's length, as in repeated text, is cut into bands of bounded width that overlap by one band.
            cut = high - low > size + BAND
            for start in range(low - BAND, high + BAND + 1, size + BAND) if cut else (low - BAND,):
                end = min(high + BAND, start + size + 3 * BAND) if cut else high + BAND
                # What stands before and after a match may hold the template again.
                open_ = [(max(0, start), min(len(words), end + size))]
                while open_:
                    x, y = open_.pop()
                    if y - x < MIN_COVERAGE * size:
                        continue
                    matched, a, b = align(templates.words[i], words[x:y], start - x, end - x)
                    # Words scattered over more than twice the template's length are no match of it.
                    if matched >= MIN_COVERAGE * size and b - a < 2 * size:
                        out.append((i, matched, x + a, x + b))
                        open_ += [(x, x + a), (x + b + 1, y)]
    return sorted(set(out), key=lambda x: (x[2], -x[1], x[0]))


def read_templates(spark: SparkSession, folder: str) -> dict[str, str]:
    """Templates from the text files of a folder, named by the files (without their endings): a few hundred license texts, gathered for the index."""
    rows = spark.read.text(folder, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.[A-Za-z]+)?$", 1).alias("name"), "value").collect()
    return {r.name: r.value for r in rows}


def scan(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """doc_id, license, coverage (share of the template's words), first_word, last_word, first_byte, last_byte (of the UTF-8 text, end exclusive), rank."""
    named = dict(TEMPLATES if templates is None else templates)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _templates(tuple(sorted(named.items())))
        for ids, texts in chunks(batches):
            table = WordTable(texts, lower=True, separator=_WORDLESS)
            rows = []
            for n in (2, GRAM):
                h, at = table.grams(n, short=True)
                hit = known.hits(h)
                rows.append((at[hit], h[hit]))
            place, keys = (np.concatenate(x) for x in zip(*rows, strict=True))
            order = np.argsort(place, kind="stable")
            place, keys = place[order], keys[order]
            ends = np.searchsorted(place, table.first)
            out: list[tuple] = []
            for k in np.flatnonzero(np.diff(ends)).tolist():
                a, b = int(table.first[k]), int(table.first[k + 1])
                mine = slice(ends[k], ends[k + 1])
                found = scan_words(table.hashes[a:b], list(zip((place[mine] - a).tolist(), keys[mine].tolist(), strict=True)), known)
                best = sorted(range(len(found)), key=lambda j: (-found[j][1] / len(known.words[found[j][0]]), -found[j][1], j))
                for r, j in enumerate(best):
                    i, n, x, y = found[j]
                    out.append((ids[k], known.names[i], n / len(known.words[i]), x, y, int(table.starts[a + x] - table.offsets[k]), int(table.ends[a + y] - table.offsets[k]), r + 1))
            columns = list(zip(*out, strict=True)) or [()] * 8
            kinds = (pa.int64(), pa.string(), pa.float64(), *[pa.int64()] * 5)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["doc_id", "license", "coverage", "first_word", "last_word", "first_byte", "last_byte", "rank"])

    schema = "doc_id long, license string, coverage double, first_word long, last_word long, first_byte long, last_byte long, rank long"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


@lru_cache(2)
def _templates(named: tuple[tuple[str, str], ...]) -> Templates:
    return Templates(dict(named))
