"""License scans by patience alignment of whole texts with license templates.

A text is compared as lower-cased words. Templates whose distinct words the text
holds too few of can't reach the coverage asked for and are passed over. Where a
template may stand, as its once-only words say, a window of the text is aligned
with it: words unique to both sides are anchors, the longest increasing run of
anchors is kept, and the gaps between are aligned in the same way, their equal
ends first. Coverage is the aligned part of the template's words. A template is
found at ``MIN_COVERAGE`` or more with all its key words aligned and few words
between, and without the words that tell its relatives from it, so that one
license isn't taken for another of like wording.

Defined cases: a null or empty text, or one without a license, has license null
and coverage 0; of equal coverage the template of more aligned words and then the
first by name is named, and a license that overlaps a better one isn't found; a
license that stands in a text twice counts once;
repeated rows get equal results; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latentspark.llm import license_texts as full
from latentspark.llm.common import bound_batches

MIN_COVERAGE = 0.8
#: Aligned words per word of the text that they span; less are words that only happen to follow each other.
MIN_DENSITY = 2 / 3

# Notices and texts of public licenses, as (license, key words, text).
TEMPLATES = (
    ("Apache-2.0", "apache 2", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "apache 2", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("BSD-2-Clause", "redistribution", 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.'),
    ("BSD-3-Clause", "bsd 3", "Licensed under the BSD 3-Clause License."),
    ("CC-BY-4.0", "cc by 4", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "cc nc 4", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "cc sa 4", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-4.0", "creative attribution 4", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC0-1.0", "cc0", "Released into the public domain under CC0 1.0."),
    ("GPL-2.0", "gnu general 2", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "gnu general 3", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "gnu general 3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("LGPL-3.0", "gnu lesser 3", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("ISC", "permission purpose fee", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MIT", "mit", "Released under the MIT License."),
    ("MIT", "mit", "Licensed under the MIT License."),
    ("MIT", "permission charge deal", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.'),
    ("MPL-2.0", "mozilla 2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("Unlicense", "unencumbered domain", "This is free and unencumbered software released into the public domain."),
    ("BSD-3-Clause", "redistribution neither endorse", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD-4-Clause", "redistribution advertising neither endorse", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. All advertising materials mentioning features or use of this software must display the following acknowledgement: This product includes software developed by the organization. 4. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("GPL-2.0", "gnu general 2", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("AGPL-3.0", "gnu affero 3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details."),
    ("AGPL-3.0", "gnu affero 3", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("LGPL-2.0", "gnu library 2", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Library General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Library General Public License for more details."),
    ("LGPL-2.1", "gnu lesser 2 1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details."),
    ("LGPL-3.0", "gnu lesser 3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details."),
    ("Apache-2.0", "contributor derivative contribution", full.APACHE_2),
    ("GPL-2.0", "recipients derivative whole", full.GPL_2),
    ("GPL-3.0", "propagate conveying affero", full.GPL_3),
    ("AGPL-3.0", "propagate conveying affero remotely", full.AGPL_3),
    ("LGPL-2.0", "library linking", full.LGPL_2),
    ("LGPL-2.1", "lesser library linking", full.LGPL_2_1),
    ("LGPL-3.0", "lesser library combined", full.LGPL_3),
    ("MPL-2.0", "mozilla contributor secondary", full.MPL_2),
    ("CC0-1.0", "cc0 affirmer waiver", full.CC0_1),
)

#: Words that a license's relatives have and its own templates lack, and how many words behind the match they may stand: a further clause isn't inside it.
RELATIVES = {
    "BSD-2-Clause": ("endorse advertising", 60),
    "BSD-3-Clause": ("advertising", 0),
    "GPL-2.0": ("affero lesser", 0),
    "GPL-3.0": ("affero lesser remotely", 0),
    "LGPL-2.0": ("lesser", 0),
}

_WORD = re.compile(r"[^\W_]+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def _longest_rise(values: list[int]) -> list[int]:
    """Places of a longest increasing subsequence."""
    tails: list[int] = []
    at: list[int] = []
    before = [-1] * len(values)
    for i, v in enumerate(values):
        k = bisect_left(tails, v)
        if k == len(tails):
            tails.append(v)
            at.append(i)
        else:
            tails[k], at[k] = v, i
        before[i] = at[k - 1] if k else -1
    chain, i = [], at[-1] if at else -1
    while i >= 0:
        chain.append(i)
        i = before[i]
    return chain[::-1]


def patience(text: list[str], template: list[str]) -> list[tuple[int, int]]:
    """Aligned (text place, template place) pairs, ascending."""
    found: list[tuple[int, int]] = []
    open_gaps = [(0, len(text), 0, len(template))]
    while open_gaps:
        a, b, c, d = open_gaps.pop()
        while a < b and c < d and text[a] == template[c]:
            found.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and text[b - 1] == template[d - 1]:
            b, d = b - 1, d - 1
            found.append((b, d))
        if a == b or c == d:
            continue
        n_text, n_template = Counter(text[a:b]), Counter(template[c:d])
        place = {w: c + k for k, w in enumerate(template[c:d]) if n_template[w] == 1 and n_text[w] == 1}
        anchors = [(a + k, place[w]) for k, w in enumerate(text[a:b]) if w in place]
        kept = [anchors[k] for k in _longest_rise([j for _, j in anchors])]
        if not kept:
            continue
        found += kept
        edges = [(a - 1, c - 1), *kept, (b, d)]
        open_gaps += [(i + 1, k, j + 1, m) for (i, j), (k, m) in zip(edges, edges[1:], strict=False)]
    return sorted(found)


class Match(NamedTuple):
    coverage: float
    aligned: int
    license: str
    start: int
    end: int


class _Template:
    def __init__(self, name: str, keys: str, text: str) -> None:
        self.name, self.words = name, words_of(text)
        self.distinct, self.keys = frozenset(self.words), frozenset(keys.split())
        self.counts = n = Counter(self.words)
        self.once = {w: k for k, w in enumerate(self.words) if n[w] == 1}
        others, self.behind = RELATIVES.get(name, ("", 0))
        self.others = frozenset(others.split()) - self.distinct
        #: Each absent word leaves the template's words that equal it unaligned.
        self.may_lack = int((1 - MIN_COVERAGE) * len(self.words) + 1e-9)

    def reachable(self, present: frozenset[str]) -> bool:
        return self.keys <= present and sum(self.counts[w] for w in self.distinct - present) <= self.may_lack

    def windows(self, words: list[str]) -> Iterator[tuple[int, int]]:
        """Parts of the text where enough of the once-only words say that the template begins alike."""
        n = len(self.words)
        step = n // 2 + 2
        begins: dict[int, set[str]] = defaultdict(set)
        for place, w in enumerate(words):
            if w in self.once:
                cell = (place - self.once[w]) // step
                begins[cell].add(w)
                begins[cell + 1].add(w)
        for cell, seen in sorted(begins.items()):
            # A window spans two cells, so that words moved by under a cell still meet in one.
            if len(seen) >= len(self.once) - self.may_lack:
                yield max(0, (cell - 1) * step), min(len(words), (cell + 1) * step + n)

    def best(self, words: list[str]) -> Match | None:
        best = None
        for low, high in self.windows(words):
            pairs = patience(words[low:high], self.words)
            if not pairs or not self.keys <= {self.words[j] for _, j in pairs}:
                continue
            match = Match(len(pairs) / len(self.words), len(pairs), self.name, low + pairs[0][0], low + pairs[-1][0] + 1)
            if not self.others.isdisjoint(words[match.start : match.end + self.behind]):
                continue
            dense = match.aligned >= MIN_DENSITY * (match.end - match.start)
            if dense and match.coverage >= MIN_COVERAGE and (best is None or match.coverage > best.coverage):
                best = match
        return best


_TEMPLATES = [_Template(*t) for t in TEMPLATES]
_VOCABULARY = frozenset().union(*(t.distinct for t in _TEMPLATES))


def scan(text: str | None) -> list[Match]:
    """The best match of each license in a text, best first."""
    words = words_of(text)
    present = _VOCABULARY.intersection(words)
    found: dict[str, Match] = {}
    for t in _TEMPLATES:
        if t.reachable(present) and (m := t.best(words)):
            if t.name not in found or m[:2] > found[t.name][:2]:
                found[t.name] = m
    ordered = sorted(found.values(), key=lambda m: (-m.coverage, -m.aligned, m.license))
    # Words that a better match has taken don't make a second license.
    return [m for k, m in enumerate(ordered) if all(m.end <= o.start or o.end <= m.start for o in ordered[:k])]


def _scan_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for found in map(scan, batch.column("text").to_pylist()):
            m = found[0] if found else Match(0.0, 0, None, None, None)
            rows.append((m.license, m.coverage, m.aligned, m.start, m.end, [x.license for x in found]))
        types = [pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string())]
        columns = list(zip(*rows, strict=True)) or [()] * len(types)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], ["doc_id", "license", "coverage", "aligned_words", "start_word", "end_word", "licenses"])


def license_scan(docs: DataFrame) -> DataFrame:
    """``(doc_id, license, coverage, aligned_words, start_word, end_word, licenses)`` of every row of docs."""
    bound_batches(docs.sparkSession)
    schema = "doc_id long, license string, coverage double, aligned_words long, start_word long, end_word long, licenses array<string>"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_scan_batches, schema)
