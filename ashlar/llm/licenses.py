"""License scans by patience alignment with the whole text.

``align`` pairs the words of a text with those of a template: words that occur once in both are anchors, the longest increasing
subsequence of their places is kept, and the gaps between are aligned in the same way; equal words at a gap's ends are
matched first.  In a gap without such words those that occur equally often in both stand in, the first for the first and so on, and where there
are none, those that occur least.  Coverage is the share of the template's words that are matched; gaps may have any length, so inserted names, years
or clauses count the same wherever they lie.

The whole text is aligned, and so is each stretch of it that may hold the notice (three times as many shared words as the template has, one
template's length apart), in which words are unique that other parts of the text repeat; the fullest alignment counts.  Before any of this, texts and
stretches are dismissed that could not reach the coverage wanted even if every word they share with the template matched in order; this dismisses
nothing that an alignment would find.

Each task works on its own Arrow batches: nothing is shuffled, and memory is a small multiple of a batch, however many templates there are.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import _common as C
from . import _text as X

MIN_COVERAGE = 0.9

#: Public license notices (fixed values), by SPDX identifier.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. '
        "See the License for the specific language governing permissions and limitations under the License."
    ),
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, "
        "but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies."
    ),
    "MIT": "Released under the MIT License.",
    "MIT-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
        "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
    ),
}


def align(text: Sequence[int], template: Sequence[int]) -> list[tuple[int, int]]:
    """Pairs of places (in text, in template) matched, both increasing.  Gaps wait on a stack, so depth is no limit."""
    matched: list[tuple[int, int]] = []
    gaps = [(0, len(text), 0, len(template))]
    while gaps:
        a, b, c, d = gaps.pop()
        while a < b and c < d and text[a] == template[c]:
            matched.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and text[b - 1] == template[d - 1]:
            b, d = b - 1, d - 1
            matched.append((b, d))
        if a == b or c == d:
            continue
        anchors = _increasing(_common_words(text, template, a, b, c, d))
        for (i, j), (k, m) in zip([(a - 1, c - 1), *anchors], [*anchors, (b, d)], strict=True):
            if anchors and k - i > 1 and m - j > 1:
                gaps.append((i + 1, k, j + 1, m))
        matched += anchors
    return sorted(matched)


def _common_words(text: Sequence[int], template: Sequence[int], a: int, b: int, c: int, d: int) -> list[tuple[int, int]]:
    """(place in text, place in template), in the template's order, of the words that anchor a gap."""
    here, there = {}, {}
    for j in range(c, d):
        there.setdefault(template[j], []).append(j)
    for i in range(a, b):
        if text[i] in there:
            here.setdefault(text[i], []).append(i)
    ways = (lambda x, y: x == y == 1, lambda x, y: x == y, lambda x, y: max(x, y) == least)
    least = min((max(len(i), len(there[w])) for w, i in here.items()), default=0)
    for way in ways:
        pairs = [(i, j) for w, own in here.items() if way(len(own), len(there[w])) for i, j in zip(own, there[w], strict=False)]
        if pairs:
            return sorted(pairs, key=lambda p: p[1])
    return []


def _rows(text: Sequence[int], template: Sequence[int]) -> Iterator[int]:
    """After each word of the text: the template's places that do not lengthen the longest common subsequence of what lies before, as bits."""
    bits: dict[int, int] = {}
    for j, w in enumerate(template):
        bits[w] = bits.get(w, 0) | 1 << j
    whole = rest = (1 << len(template)) - 1
    for w in text:
        taken = rest & bits.get(w, 0)
        rest = (rest + taken | rest - taken) & whole
        yield rest


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest subsequence that increases in the first place, by patience sorting; pairs come in order of the second."""
    tops: list[int] = []
    piles: list[int] = []
    before: list[int] = []
    for n, (i, _) in enumerate(pairs):
        pile = bisect_left(tops, i)
        before.append(piles[pile - 1] if pile else -1)
        if pile == len(tops):
            tops.append(i)
            piles.append(n)
        else:
            tops[pile], piles[pile] = i, n
    found, n = [], piles[-1] if piles else -1
    while n >= 0:
        found.append(pairs[n])
        n = before[n]
    return found[::-1]


def _most(text: Sequence[int], template: Sequence[int]) -> int:
    """How many words any alignment can match at most."""
    rest = (1 << len(template)) - 1
    for rest in _rows(text, template):  # noqa: B007
        pass
    return len(template) - rest.bit_count()


def _closer(pairs: list[tuple[int, int]], text: Sequence[int]) -> tuple[int, int]:
    """First and last place of an alignment once its words stand as close to a middle one as the text allows."""
    where: dict[int, list[int]] = {}
    for i, w in enumerate(text):
        where.setdefault(w, []).append(i)
    best = None
    for n in sorted({round(k * (len(pairs) - 1) / 8) for k in range(9)}):
        first = last = pairs[n][0]
        for i, _ in reversed(pairs[:n]):
            own = where[text[i]]
            first = own[bisect_left(own, first) - 1]
        for i, _ in pairs[n + 1 :]:
            own = where[text[i]]
            last = own[bisect_left(own, last + 1)]
        if best is None or last - first < best[1] - best[0]:
            best = (first, last)
    return best


def best_match(text: Sequence[int], template: Sequence[int], wanted: int) -> tuple[int, int, int] | None:
    """(words matched, first, last place in the text) of the fullest alignment, if it has ``wanted`` words or more.

    Of alignments as full the shortest counts, and of these the first.
    """
    known, size = set(template), len(template)
    places = [i for i, w in enumerate(text) if w in known]  # no other word can match
    own = [text[i] for i in places]
    wanted = max(wanted, 1)
    if _most(own, template) < wanted:
        return None
    stretches = [(0, len(own))] + [(at, at + 3 * size) for at in range(-2 * size, len(own), size) if len(own) > 3 * size]
    weight, best = Counter(template), None
    for first, last in stretches:
        first, part = max(first, 0), own[max(first, 0) : last]
        held = Counter(part)
        if sum(min(n, held[w]) for w, n in weight.items()) < wanted or (len(part) < len(own) and _most(part, template) < wanted):
            continue
        pairs = align(part, template)
        if len(pairs) >= wanted:
            a, b = (places[first + i] for i in _closer(pairs, part))
            best = min([(-len(pairs), b - a, a), *([best] if best else [])])
    return best and (-best[0], best[2], best[2] + best[1])


class Templates:
    """Templates as word hashes, with an exact way to dismiss: a text that reaches a template's coverage lacks few of its
    words, so it holds one at least of any set of words that weighs more than may be missing.  The hooks are such a set,
    made of the words that fewest templates share; only (text, template) pairs met at a hook are counted in full."""

    def __init__(self, named: list[tuple[str, str]], min_coverage: float):
        hashes, counts = X.word_hashes(pa.array([body for _, body in named], pa.string()), X.PUNCTUATION)
        self.names = [name for name, _ in named]
        self.bodies = [x.tolist() for x in np.split(hashes, np.cumsum(counts)[:-1])]
        self.wanted = np.ceil(counts * min_coverage - 1e-9).astype(np.int64)
        self.vocabulary = np.unique(hashes)
        self.words, self.weights = [], []
        for body in self.bodies:
            words, weights = np.unique(np.array(body, dtype=np.uint64), return_counts=True)
            self.words.append(np.searchsorted(self.vocabulary, words))
            self.weights.append(weights)
        shared = np.bincount(np.concatenate([*self.words, np.zeros(0, np.int64)]), minlength=len(self.vocabulary))
        hooks = []
        for k, (words, weights) in enumerate(zip(self.words, self.weights, strict=True)):
            order = np.lexsort((words, shared[words]))
            missing = len(self.bodies[k]) - max(int(self.wanted[k]), 1)
            upto = int(np.searchsorted(np.cumsum(weights[order]), missing, side="right")) + 1
            hooks += [(int(w), k) for w in words[order[:upto]]]
        hooks.sort()
        self.hook_template = np.array([k for _, k in hooks], dtype=np.int64)
        self.hook_start = np.searchsorted(np.array([w for w, _ in hooks], dtype=np.int64), np.arange(len(self.vocabulary) + 1))
        self.mask = np.zeros(1 << 16, dtype=bool)
        self.mask[(self.vocabulary >> np.uint64(48)).astype(np.int64)] = True

    def possible(self, words: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
        """(row, template) pairs whose shared words, in the template's numbers, reach the coverage wanted."""
        hit = np.flatnonzero(self.mask[(words >> np.uint64(48)).astype(np.int64)])
        if not len(hit):
            return []
        which = np.minimum(np.searchsorted(self.vocabulary, words[hit]), len(self.vocabulary) - 1)
        sure = self.vocabulary[which] == words[hit]
        size = len(self.vocabulary)
        held = np.unique(np.searchsorted(ends, hit[sure], side="right") * size + which[sure])  # (row, word), each once
        row, word = held // size, held % size
        n = self.hook_start[word + 1] - self.hook_start[word]
        place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        met = np.unique(np.repeat(row, n) * len(self.bodies) + self.hook_template[np.repeat(self.hook_start[word], n) + place])
        found = []
        row, template = met // len(self.bodies), met % len(self.bodies)
        for k in np.unique(template).tolist():
            rows = row[template == k]
            total = np.zeros(len(rows), dtype=np.int64)
            for w, weight in zip(self.words[k].tolist(), self.weights[k].tolist(), strict=True):
                key = rows * size + w
                total += weight * (held[np.minimum(np.searchsorted(held, key), len(held) - 1)] == key)
            found += [(r, k) for r in rows[total >= max(int(self.wanted[k]), 1)].tolist()]
        return sorted(found)


def scan(df: DataFrame, text: str = "text", templates: dict[str, str] | None = None, min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """Every row of ``df`` with ``licenses`` added: array of (license, coverage, first_word, last_word) by
    license name, one entry for each template whose alignment covers ``min_coverage`` of its words or more.

    Words are runs of ASCII letters, digits and non-ASCII characters, A-Z lower-cased, counted from 0.  A null or empty text has
    no license; rows are independent of each other; an empty table gives an empty table; if the name is taken, a number follows.
    """
    known = Templates(sorted((templates or TEMPLATES).items()), min_coverage)
    name, at = C.free_name(df.columns, "licenses"), df.columns.index(text)
    entry = T.StructType([T.StructField("license", T.StringType()), T.StructField("coverage", T.DoubleType()), T.StructField("first_word", T.LongType()), T.StructField("last_word", T.LongType())])
    names = [f"c{i}" for i in range(len(df.columns) + 1)]
    kind = pa.list_(pa.struct([("license", pa.string()), ("coverage", pa.float64()), ("first_word", pa.int64()), ("last_word", pa.int64())]))

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in X.batches(stream, names[at]):
            words, n = X.word_hashes(batch.column(at), X.PUNCTUATION)
            ends = np.cumsum(n)
            found: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            for row, k in known.possible(words, ends):
                best = best_match(words[ends[row] - n[row] : ends[row]].tolist(), known.bodies[k], int(known.wanted[k]))
                if best:
                    found[row].append({"license": known.names[k], "coverage": best[0] / len(known.bodies[k]), "first_word": best[1], "last_word": best[2]})
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, kind)], names=names)

    schema = T.StructType([*[T.StructField(c, f.dataType) for c, f in zip(names, df.schema.fields, strict=False)], T.StructField(names[-1], T.ArrayType(entry))])
    return df.toDF(*names[:-1]).mapInArrow(run, schema).toDF(*df.columns, name)
