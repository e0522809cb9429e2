"""License scans: winnowed fingerprints find candidate places, alignment confirms them.

Texts and templates are reduced to ASCII letters and digits; the least of every ``SPAN``
neighbouring k-gram hashes is a fingerprint, so any common stretch of ``GRAM + SPAN - 1``
characters shares one. Template fingerprints form an inverted index. Hits that agree on
where a template would begin, within a bounded distance, are one candidate; a banded alignment of the words there
with the template's words gives the matched share of the template and the matched spans.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from rankframe.llm.common import SYMBOLS_FOLDED, SubstringHash, as_bytes, slices, tune

GRAM, SPAN = 9, 6
#: A match is reported from this share of the template's words, and this many words.
MIN_COVERAGE, MIN_WORDS = 0.75, 3
#: Characters of templates in one index sent to tasks; more templates are scanned in blocks.
BLOCK_CHARS = 4_000_000

SCHEMA = "doc_id long, template_id string, coverage double, matched_words long, start long, end long, spans string, best boolean"

#: Common license notices.
TEMPLATES: list[tuple[str, str]] = [
    ("Apache-2.0-line", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("MIT-line", "Released under the MIT License."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.'),
    ("GPL-3.0-line", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
    ("CC-BY-NC-4.0-line", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Unlicense-terms", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("MIT-disclaimer", 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("BSD-3-Clause-names", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD-disclaimer", 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.'),
    ("BSD-style-line", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("GPL-2.0-line", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-warranty", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GFDL-1.3", "Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License, Version 1.3 or any later version published by the Free Software Foundation"),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("CDDL", 'The contents of this file are subject to the terms of the Common Development and Distribution License (the "License"). You may not use this file except in compliance with the License.'),
    ("BSL-1.0", 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so'),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"),
    ("PostgreSQL", "Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted, provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies."),
    ("Artistic-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the Artistic License 2.0."),
    ("EUPL-1.2", 'Licensed under the EUPL, Version 1.2 or - as soon they will be approved by the European Commission - subsequent versions of the EUPL (the "Licence"); You may not use this work except in compliance with the Licence.'),
    ("OFL-1.1", "This Font Software is licensed under the SIL Open Font License, Version 1.1."),
    ("ODbL-1.0", "is made available under the Open Database License: http://opendatacommons.org/licenses/odbl/1.0/."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-ND-4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    ("CC-BY-NC-SA-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    ("CC-BY-NC-ND-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."),
    ("CC-BY-SA-line", "Text is available under the Creative Commons Attribution-ShareAlike License"),
    ("SPDX-MIT", "SPDX-License-Identifier: MIT"),
    ("SPDX-Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("SPDX-GPL-2.0-only", "SPDX-License-Identifier: GPL-2.0-only"),
    ("SPDX-GPL-3.0-or-later", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("SPDX-BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
]

_KEPT = np.zeros(256, bool)
_KEPT[48:58] = _KEPT[65:91] = _KEPT[97:123] = True
_WORD = re.compile(rb"[A-Za-z0-9]+")


def winnow(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Fingerprints of a slice: hash, row, place among the row's kept characters, and the
    byte of every kept character."""
    byte = np.flatnonzero(_KEPT[data])
    text = data[byte]
    cut = np.searchsorted(byte, offsets)  # rows among kept characters
    m = len(text) - GRAM + 1
    z = np.zeros(0, np.int64)
    if m <= 0:
        return z.view(np.uint64), z, z, byte
    place = np.arange(m)
    row = np.searchsorted(cut, place, "right") - 1
    h = SubstringHash(text, SYMBOLS_FOLDED).of(place, place + GRAM)
    ok = place + GRAM <= cut[row + 1]
    h = np.where(ok, h, np.uint64(0xFFFFFFFFFFFFFFFF))
    n = max(1, m - SPAN + 1)
    least, where = h[:n].copy(), place[:n].copy()
    for j in range(1, min(SPAN, m)):
        nearer = h[j : j + n] < least
        least[nearer], where[nearer] = h[j : j + n][nearer], place[j : j + n][nearer]
    where = np.unique(where)
    where = where[ok[where]]
    return h[where], row[where], where - cut[row[where]], byte


class Index:
    """Inverted index of a block of templates."""

    def __init__(self, templates: list[tuple[str, str]]):
        raw = [t.encode() for _, t in templates]
        offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
        h, row, place, byte = winnow(np.frombuffer(b"".join(raw), np.uint8), offsets)
        order = np.argsort(h, kind="stable")
        self.hash, self.template, self.place = h[order], row[order], place[order]
        self.names = [n for n, _ in templates]
        self.words = [[w.lower() for w in _WORD.findall(r)] for r in raw]
        self.joined = [b" %b " % b" ".join(w) for w in self.words]
        self.chars = np.diff(np.searchsorted(byte, offsets))


def align(template: list[bytes], words: list[bytes], band: int) -> list[tuple[int, int]]:
    """Matched (template word, text word) pairs of the best alignment within ``band`` of
    the diagonal; text words before and after it are free."""
    m, n = len(template), len(words)
    width = 2 * band + 1
    low = -(10**6)
    score = [[low] * width for _ in range(m + 1)]  # column j - i + band
    move = [[0] * width for _ in range(m + 1)]  # 1 match, 2 mismatch, 3 skip template word, 4 skip text word
    for d in range(width):
        if 0 <= d - band <= n:
            score[0][d] = 0
    for i in range(1, m + 1):
        for d in range(width):
            j = i + d - band
            if not 0 <= j <= n:
                continue
            best, way = (score[i - 1][d + 1] - 1, 3) if d + 1 < width else (low, 0)
            if j:
                same = template[i - 1] == words[j - 1]
                diagonal = score[i - 1][d] + (2 if same else -1)
                if diagonal >= best:
                    best, way = diagonal, 1 if same else 2
                if d and score[i][d - 1] - 1 > best:
                    best, way = score[i][d - 1] - 1, 4
            score[i][d], move[i][d] = best, way
    i, d = m, max(range(width), key=lambda d: score[m][d])
    pairs = []
    while i and move[i][d]:
        way, j = move[i][d], i + d - band
        if way == 1:
            pairs.append((i - 1, j - 1))
        if way in (1, 2):
            i -= 1
        elif way == 3:
            i, d = i - 1, d + 1
        else:
            d -= 1
    return pairs[::-1]


def _matches(text: bytes, byte: np.ndarray, begin: int, index: Index, template: int) -> tuple | None:
    """Align a template with the words around the place where it would begin."""
    words = index.words[template]
    band = 4 + len(words) // 8
    a = int(byte[max(0, min(begin, len(byte) - 1))])
    lead = [m for m in _WORD.finditer(text[max(0, a - 16 * band) : a])][-band:]
    base = max(0, a - 16 * band)
    found = [(base + m.start(), base + m.end(), m[0].lower()) for m in lead]
    reach = len(words) + 2 * band
    for m in _WORD.finditer(text, a):
        found.append((m.start(), m.end(), m[0].lower()))
        if len(found) >= reach + len(lead):
            break
    # no alignment matches more words than the two have in common
    if (Counter(words) & Counter(w for _, _, w in found)).total() < max(min(MIN_WORDS, len(words)), MIN_COVERAGE * len(words)):
        return None
    place = (b" %b " % b" ".join([w for _, _, w in found])).find(index.joined[template])
    if place >= 0:  # word for word
        first = bisect_left(list(accumulate((len(w) + 1 for _, _, w in found), initial=0)), place)
        pairs = [(i, first + i) for i in range(len(words))]
    else:
        pairs = align(words, [w for _, _, w in found], band + len(lead))
    if len(pairs) < min(MIN_WORDS, len(words)) or len(pairs) < MIN_COVERAGE * len(words):
        return None
    spans: list[list[int]] = []
    last = -2
    for _, j in pairs:
        if j == last + 1:
            spans[-1][1] = found[j][1]
        else:
            spans.append([found[j][0], found[j][1]])
        last = j
    return len(pairs) / len(words), len(pairs), spans


def _clusters(row: np.ndarray, template: np.ndarray, begin: np.ndarray, slack: np.ndarray) -> np.ndarray:
    """Marks the first hit of each cluster of sorted hits: a cluster holds hits of a row and
    a template whose begins lie within ``slack`` of its first begin, however many follow."""
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (template[1:] != template[:-1]) | (begin[1:] - begin[:-1] > slack[1:])
    edge = np.append(np.flatnonzero(new), len(row))
    for a, b in zip(edge.tolist(), edge[1:].tolist()):
        while a < b and begin[b - 1] - begin[a] > slack[a]:
            a += int(np.searchsorted(begin[a:b], begin[a] + slack[a], "right"))
            new[a] = True
    return new


def _scan(batches: Iterator[pa.RecordBatch], index: Index) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = batch.column(0).to_pylist()
        data, offsets = as_bytes(batch.column(1))
        out: list[tuple] = []
        for a, b in slices(offsets):
            part, at = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
            h, row, place, byte = winnow(part, at)
            lo, hi = np.searchsorted(index.hash, h, "left"), np.searchsorted(index.hash, h, "right")
            hit = np.flatnonzero(hi > lo)
            if not len(hit):
                continue
            many = hi[hit] - lo[hit]
            entry = np.repeat(lo[hit], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            row, begin, template = np.repeat(row[hit], many), np.repeat(place[hit], many) - index.place[entry], index.template[entry]
            order = np.lexsort((begin, template, row))
            row, begin, template = row[order], begin[order], template[order]
            slack = np.maximum(12, index.chars[template] // 8)
            new = _clusters(row, template, begin, slack)
            cut = np.searchsorted(byte, at)
            matches: dict[int, list[tuple]] = {}
            texts: dict[int, tuple[bytes, np.ndarray]] = {}
            for k in np.flatnonzero(new).tolist():
                r, t = int(row[k]), int(template[k])
                if r not in texts:
                    texts[r] = part[at[r] : at[r + 1]].tobytes(), byte[cut[r] : cut[r + 1]] - at[r]
                got = _matches(*texts[r], int(begin[k]), index, t)
                if got:
                    matches.setdefault(r, []).append((t, *got))
            for r, many in matches.items():
                raw = np.frombuffer(texts[r][0], np.uint8)
                chars = np.concatenate([np.zeros(1, np.int64), np.cumsum((raw & 0xC0) != 0x80)])
                taken, leaders = [Taken() for _ in index.names], Taken()
                for t, coverage, n, where in sorted(many, key=lambda g: (-g[1], -g[2])):
                    lo, hi = where[0][0], where[-1][1]
                    if not taken[t].add(lo, hi):  # of places of a template that overlap the best one stays
                        continue
                    spans = [(int(chars[s]), int(chars[e])) for s, e in where]
                    out.append((keys[a + r], index.names[t], coverage, n, spans[0][0], spans[-1][1], ",".join(f"{s}:{e}" for s, e in spans), leaders.add(lo, hi)))
        kinds = [pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_()]
        columns = list(zip(*out)) if out else [()] * len(kinds)
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], ["doc_id", "template_id", "coverage", "matched_words", "start", "end", "spans", "best"])


class Taken:
    """Ranges that don't overlap."""

    def __init__(self) -> None:
        self.starts: list[int] = []
        self.ends: list[int] = []

    def add(self, lo: int, hi: int) -> bool:
        """Adds a range unless it overlaps one that is there."""
        k = bisect_left(self.starts, hi)
        if k and self.ends[k - 1] > lo:
            return False
        self.starts.insert(k, lo)
        self.ends.insert(k, hi)
        return True


def scan_licenses(docs: DataFrame, templates: list[tuple[str, str]] | None = None) -> DataFrame:
    """One row per match in ``docs(doc_id, text)``: ``doc_id, template_id, coverage,
    matched_words, start, end, spans`` (code points, ends exclusive) and ``best``, true
    where no better match of another template overlaps (in blocks of templates: of its block).

    Null and empty texts match nothing; a template that a text repeats gives a row per
    place; repeated rows give repeated matches; an empty table or list gives no rows;
    templates without words are passed over.
    """
    spark = docs.sparkSession
    tune(spark)
    templates = [t for t in (TEMPLATES if templates is None else templates) if _WORD.search(t[1].encode())]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    blocks: list[list[tuple[str, str]]] = [[]]
    size = 0
    for t in templates:
        if size and size + len(t[1]) > BLOCK_CHARS:
            blocks.append([])
            size = 0
        blocks[-1].append(t)
        size += len(t[1])
    out = None
    for block in blocks:
        sent = spark.sparkContext.broadcast(Index(block))  # at most BLOCK_CHARS characters
        part = rows.mapInArrow(lambda it, sent=sent: _scan(it, sent.value), SCHEMA)
        out = part if out is None else out.union(part)
    return out
