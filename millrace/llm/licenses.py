"""License scans by patience alignment.

Words are runs of bytes other than white space and ASCII punctuation, A-Z lower-cased. Regions of a document are sought from left to
right, each after the one before: a window of n / threshold words from a pair of neighbouring words of a template, and the few words
before it that a region may begin with, so that copies next to each other are apart. In each the template is aligned with the text:
anchors are the words that occur once in both; the longest increasing subsequence of the anchors is kept; and the gaps between
kept anchors are aligned in the same way, where words that were not unique before may be. Where a gap has no unique common word,
equal words at its two ends are taken. Coverage is the number of aligned words by those of the template, counted where most of
them lie within n / threshold words of text (n: words of the template), so that strange words between them count against it.

A region whose pairs of words cannot reach the threshold is not aligned. At the threshold m of the n words may be missing, each
of which breaks two pairs, and n / threshold - (n - m) strange words may stand between the others, each of which breaks one; what
these cannot break of a template's distinct pairs must be there. (Below a threshold of some 0.77 they can break all pairs; a region
that holds no pair is not seen.)

Defined results: a null or empty text holds nothing; a license is reported once a document, at its best and then first region,
with the number of regions at or over the threshold; repeated rows are each reported; null ids stay null; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import bisect
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import textkernel as tk

#: Public license notices.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0",
    "apache-2.0-header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
        'writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, '
        "either express or implied. See the License for the specific language governing permissions and limitations under the License."
    ),
    "mit": "Released under the MIT License",
    "mit-text": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), '
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, '
        "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
        "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS "
        "IN THE SOFTWARE."
    ),
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3",
    "gpl-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free "
        "Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be "
        "useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General "
        "Public License for more details."
    ),
    "isc-text": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
        "copyright notice and this permission notice appear in all copies."
    ),
    "bsd-clauses": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
        "and/or other materials provided with the distribution."
    ),
    "cc-by-4.0": "Licensed under CC BY 4.0",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0",
}


def longest_increasing(values: Sequence[int]) -> list[int]:
    """Positions of a longest strictly increasing subsequence."""
    tails: list[int] = []
    ends: list[int] = []
    back = [-1] * len(values)
    for i, v in enumerate(values):
        k = bisect.bisect_left(tails, v)
        if k == len(tails):
            tails.append(v)
            ends.append(i)
        else:
            tails[k], ends[k] = v, i
        back[i] = ends[k - 1] if k else -1
    out = []
    i = ends[-1] if ends else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def patience(a: Sequence, b: Sequence) -> list[tuple[int, int]]:
    """Aligned positions of two sequences, in order."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, j, k, m = todo.pop()
        while i < j and k < m and a[i] == b[k]:
            out.append((i, k))
            i, k = i + 1, k + 1
        while i < j and k < m and a[j - 1] == b[m - 1]:
            j, m = j - 1, m - 1
            out.append((j, m))
        if i == j or k == m:
            continue
        in_a, in_b = Counter(a[i:j]), Counter(b[k:m])
        place = {w: p for p, w in enumerate(b[k:m], k) if in_b[w] == 1}
        anchors = [(p, place[w]) for p, w in enumerate(a[i:j], i) if in_a[w] == 1 and w in place]
        kept = [anchors[x] for x in longest_increasing([q for _, q in anchors])]
        out += kept
        edges = [(i - 1, k - 1), *kept, (j, m)]
        if kept:
            todo += [(p + 1, r, q + 1, s) for (p, q), (r, s) in zip(edges[:-1], edges[1:], strict=True)]
    return sorted(out)


def _densest(places: list[int], n: int, most: int) -> tuple[float, int, int]:
    """Coverage, first place and width of the run of aligned places that holds most within that many words."""
    best, i = (0.0, 0, 0), 0
    for j, q in enumerate(places):
        while q - places[i] + 1 > most:
            i += 1
        best = max(best, ((j - i + 1) / n, -places[i], q - places[i] + 1))
    return best[0], -best[1], best[2]


def _broken(n: int, threshold: float) -> int:
    """Most pairs of neighbours among a template's n words that a text of sufficient coverage can lack."""
    missing = max(m for m in range(n + 1) if m == 0 or (n - m) / n >= threshold)
    return 3 * missing + int(n / threshold) - n


def _aligned(w, words: list, a: int, b: int, most: int) -> tuple[float, int, int]:
    """Coverage, first word and width of the template's best place among the words from a to b."""
    coverage, at, span = _densest([q for _, q in patience(words, w.text(a, b))], len(words), most)
    return coverage, a + at, span


class Templates:
    """Words of the templates, and the hashes of their pairs."""

    def __init__(self, templates: dict[str, str]):
        self.names = list(templates)
        w = tk.words(pa.array(list(templates.values()), pa.string()), tk.WHITE_AND_MARKS)
        self.words = [w.text(a, b) for a, b in zip(w.first[:-1], w.first[1:], strict=True)]
        pairs = tk._combine([w.hash[:-1], w.hash[1:]])
        self.pairs = [np.unique(pairs[a : max(a, b - 1)]) for a, b in zip(w.first[:-1], w.first[1:], strict=True)]
        self.all_pairs = np.unique(np.concatenate(self.pairs))


def scan(texts: pa.Array, templates: Templates, threshold: float) -> Iterator[tuple[int, str, float, int, int, int]]:
    """(text, license, coverage, first word, words, regions)."""
    w = tk.words(texts, tk.WHITE_AND_MARKS)
    if len(w.hash) < 2:
        return
    pairs = tk._combine([w.hash[:-1], w.hash[1:]])
    place = np.minimum(np.searchsorted(templates.all_pairs, pairs), len(templates.all_pairs) - 1)
    hit = np.flatnonzero(templates.all_pairs[place] == pairs)
    text_of = np.searchsorted(w.first, hit, "right") - 1
    inside = hit + 1 < w.first[text_of + 1]
    hit, text_of = hit[inside], text_of[inside]
    for spots in np.split(hit, np.flatnonzero(np.diff(text_of)) + 1) if len(hit) else []:
        text = int(np.searchsorted(w.first, spots[0], "right") - 1)
        begin, end = int(w.first[text]), int(w.first[text + 1])
        for name, words, own in zip(templates.names, templates.words, templates.pairs, strict=True):
            n = len(words)
            most, broken = int(n / threshold), _broken(n, threshold)
            need = max(1, len(own) - broken)
            # Words of a region, at most, that begin none of its pairs.
            loose = most - max(1, n - 1 - broken)
            mine = spots[np.isin(pairs[spots], own)]
            if len(mine) < need:
                continue
            # All pairs of a region lie within its length from the first of them.
            ends = np.searchsorted(mine, mine + most, "left")
            free, best, regions = begin, None, 0
            for i in np.flatnonzero(ends - np.arange(len(mine)) >= need):
                first = int(mine[i])
                if first < free or len(np.unique(pairs[mine[i : ends[i]]])) < need:
                    continue
                found = _aligned(w, words, max(free, first - loose), min(end, first + most), most)
                if found[0] < threshold:
                    # Other words are unique in a wider window.
                    found = _aligned(w, words, max(free, first - n), min(end, first + most + n), most)
                if found[0] < threshold:
                    continue
                # The window may begin before the region or end within it; or the last words were found in the next copy.
                if found[0] < 1:
                    found = max(found, _aligned(w, words, found[1], min(end, found[1] + most + loose), most), key=lambda x: x[0])
                if found[2] > n:
                    found = max(found, _aligned(w, words, found[1], min(end, found[1] + n), most), key=lambda x: (x[0], -x[2]))
                regions += 1
                free = found[1] + found[2]
                if best is None or found[0] > best[0]:
                    best = found[0], found[1] - begin, found[2]
            if best:
                yield text, name, *best, regions


def license_scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, threshold: float = 0.9, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document and license found in it: id, license, coverage, start_word, n_words, regions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Templates(templates)
        for batch in batches:
            for part in tk.slices(batch, 1):
                ids = part.column(0).to_pylist()
                found = list(zip(*((ids[t], *rest) for t, *rest in scan(part.column(1), known, threshold)), strict=True)) or [[]] * 6
                types = (pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(found, types, strict=True)], [id_col, "license", "coverage", "start_word", "n_words", "regions"])

    schema = f"{id_col} long, license string, coverage double, start_word long, n_words long, regions long"
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)
