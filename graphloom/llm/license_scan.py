"""License scans by patience alignment.

Text and template are compared as words.  Words that occur once in both ranges are anchors; the
longest increasing subsequence of their places is kept, and the gaps between kept anchors are
aligned in the same way (where a gap has no such word, the first occurrences of words that the
template's range holds once stand in).  Coverage is the share of the template's words matched.

A template is tried only in regions that can reach the coverage: sliding counts of its words
over a window of SLACK times its length.  Each region may hold several copies; after a match
the rest is aligned again.  Of matches that overlap, the one that covers most stays.

Defined results: null and empty texts match nothing; equal rows get equal matches; null ids
keep their rows.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from graphloom.llm.common import bytes_of, needed, tune

COVERAGE = 0.8
SLACK = 1.5
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")

# Wording of public licences and of their usual notices.
TEMPLATES = {
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), "
    "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
    "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and "
    "this permission notice shall be included in all copies or substantial portions of the Software.",
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of "
    "the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is "
    "distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must "
    "reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice "
    "and this permission notice appear in all copies.",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software "
    "Foundation, either version 3 of the License, or (at your option) any later version.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "CC-BY-4.0-notice": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0-notice": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, "
    "either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "GPL-2.0": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software "
    "Foundation; either version 2 of the License, or (at your option) any later version.",
    "LGPL-2.1": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software "
    "Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "LGPL-3.0": "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software "
    "Foundation, either version 3 of the License, or (at your option) any later version.",
    "AGPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software "
    "Foundation, either version 3 of the License, or (at your option) any later version.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must "
    "reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this "
    "software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the "
    "following restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an "
    "acknowledgment in the product documentation would be appreciated but is not required. Altered source versions must be plainly marked as such, and must not be misrepresented as "
    "being the original software. This notice may not be removed or altered from any source distribution.",
    "BSL-1.0": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "
    "Software) to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the "
    "Software is furnished to do so, all subject to the following:",
    "BSL-1.0-notice": "Distributed under the Boost Software License, Version 1.0.",
    "CC0-1.0": "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This "
    "software is distributed without any warranty.",
}


def words_of(text: bytes) -> list[bytes]:
    return _WORD.findall(text.lower())


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest subsequence of (a, b), sorted by a, whose b increase: patience sorting with back links."""
    tops: list[int] = []
    piles: list[int] = []
    back = [-1] * len(pairs)
    for i, (_, b) in enumerate(pairs):
        at = bisect_left(tops, b)
        back[i] = piles[at - 1] if at else -1
        if at == len(tops):
            tops.append(b)
            piles.append(i)
        else:
            tops[at], piles[at] = b, i
    out, i = [], piles[-1] if piles else -1
    while i >= 0:
        out.append(pairs[i])
        i = back[i]
    return out[::-1]


def align(text: list[bytes], template: list[bytes]) -> list[tuple[int, int]]:
    """Matched places (in text, in template), both increasing."""
    matched: list[tuple[int, int]] = []
    todo = [(0, len(text), 0, len(template))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and text[a0] == template[b0]:
            matched.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and text[a1 - 1] == template[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            matched.append((a1, b1))
        if a0 >= a1 or b0 >= b1:
            continue
        in_template = Counter(template[b0:b1])
        in_text = Counter(w for w in text[a0:a1] if w in in_template)
        once = {w for w, n in in_template.items() if n == 1 and in_text.get(w) == 1}
        if not once:
            once = {w for w, n in in_template.items() if n == 1 and w in in_text}
        if not once:
            once = in_text.keys()
        first_a: dict[bytes, int] = {}
        first_b: dict[bytes, int] = {}
        for i in range(a0, a1):
            if text[i] in once:
                first_a.setdefault(text[i], i)
        for j in range(b0, b1):
            if template[j] in once:
                first_b.setdefault(template[j], j)
        anchors = _increasing(sorted((first_a[w], first_b[w]) for w in first_a))
        if not anchors:
            continue
        matched += anchors
        edges = [(a0 - 1, b0 - 1), *anchors, (a1, b1)]
        todo += [(p + 1, q, r + 1, s) for (p, r), (q, s) in zip(edges, edges[1:], strict=False)]
    return sorted(matched)


class Scanner:
    def __init__(self, templates: dict[str, str], coverage: float = COVERAGE):
        self.coverage = coverage
        self.templates = [(name, w, frozenset(w)) for name, t in templates.items() if (w := words_of(t.encode()))]

    def scan(self, text: bytes) -> list[tuple[str, int, int, int, int]]:
        """(template, first word, end word, words matched, template's words), not overlapping, by place."""
        words = words_of(text)
        present = set(words)
        found = []
        for name, template, vocabulary in self.templates:
            n = len(template)
            spare = n - self._least(n)
            if len(vocabulary & present) < len(vocabulary) - spare:
                continue
            for lo, hi in self._regions(words, vocabulary, n):
                while hi - lo >= self._least(n):
                    pairs = align(words[lo:hi], template)
                    if len(pairs) < self._least(n):
                        break
                    a, b = self._densest([p for p, _ in pairs], n)
                    # again inside the stretch only: words before it no longer take the anchors
                    start, stop = max(0, a - n // 4), b + 1 + n // 4
                    pairs = [(p + start, q) for p, q in align(words[lo + start : min(hi, lo + stop)], template)]
                    a, b = self._densest([p for p, _ in pairs], n)
                    got = sum(a <= p <= b for p, _ in pairs)
                    if got >= self._least(n):
                        found.append((name, lo + a, lo + b + 1, got, n))
                    lo += b + 1
        found.sort(key=lambda m: (-m[3] / m[4], -m[3], m[1], m[0]))
        kept: list[tuple[str, int, int, int, int]] = []
        for m in found:
            # a longer text that includes a notice speaks for both
            if not any(m[1] < k[2] and k[1] < m[2] for k in kept):
                kept.append(m)
        return sorted(kept, key=lambda m: m[1])

    def _least(self, n: int) -> int:
        return int(-(-self.coverage * n // 1))

    def _regions(self, words, vocabulary, n):
        """Ranges in which some window of SLACK n words has enough of the template's words."""
        window = max(n, int(SLACK * n))
        hit = np.fromiter((w in vocabulary for w in words), np.int64, len(words))
        sums = np.concatenate([[0], np.cumsum(hit)])
        ends = np.minimum(np.arange(len(words)) + window, len(words))
        good = np.flatnonzero(sums[ends] - sums[:-1] >= self._least(n))
        out: list[list[int]] = []
        for i in good.tolist():
            if out and i <= out[-1][1]:
                out[-1][1] = min(i + window, len(words))
            else:
                out.append([i, min(i + window, len(words))])
        return out

    @staticmethod
    def _densest(places: list[int], n: int) -> tuple[int, int]:
        """The stretch of at most SLACK n words with most matches, the first of equals."""
        best, lo = (0, 0, 0), 0
        for hi, p in enumerate(places):
            while p - places[lo] >= max(n, SLACK * n):
                lo += 1
            if hi - lo + 1 > best[0]:
                best = (hi - lo + 1, places[lo], p)
        return best[1], best[2]


def license_matches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None, coverage: float = COVERAGE) -> DataFrame:
    """doc_id, license, first_word, end_word, matched, template_words, coverage: a row per match."""
    tune(docs.sparkSession)
    docs = needed(docs, doc_id=id_col, text=text_col)
    kind = dict(docs.dtypes)["doc_id"]
    chosen = dict(TEMPLATES if templates is None else templates)

    def run(batches):
        scanner = Scanner(chosen, coverage)
        for batch in batches:
            rows = [(i, *m, m[3] / m[4]) for i, raw in enumerate(bytes_of(batch.column(1))) for m in scanner.scan(raw)]
            at, *rest = zip(*rows, strict=True) if rows else ((),) * 7
            types = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *[pa.array(c, t) for c, t in zip(rest, types, strict=True)]], ["doc_id", "license", "first_word", "end_word", "matched", "template_words", "coverage"])

    return docs.mapInArrow(run, f"doc_id {kind}, license string, first_word long, end_word long, matched long, template_words long, coverage double")
