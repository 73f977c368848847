"""License scan: a generalised suffix automaton of licence words, matching statistics, chained template spans.

1. The words of all templates and phrases form one suffix automaton (a new text starts at the root, so no string runs
   over a text's end).  It is built once per task from the templates, a bounded parameter.
2. A document's words are hashed in whole batches.  Only stretches in which every pair of neighbours is a pair of some
   template are streamed through the automaton: every match of two words and more lies inside one.
3. Streaming gives the matching statistics: at every word the longest template string that ends there.  Phrases are read from
   the states on the way (a phrase ends where the state or one above it by suffix links is the phrase's); a match that
   cannot grow and has ``MIN_MATCH`` words is placed at each of its occurrences in the templates.
4. For every template, matches in the same order in document and template are chained while no more than ``MAX_GAP`` words
   lie between them (a holder's name, a changed word); overlaps count once.  A chain that covers ``MIN_COVERAGE`` of the
   template's words is a span with the template's label.

``score`` is the largest covered share over phrases (1 when found) and spans.

Defined results: null and empty texts have no word, no place and score 0; texts are taken whole whatever their length;
chains of one template do not share matches, of equal ones the first stays; repeated rows are scanned each; an
empty table gives no row; all columns are carried through, those with a result's name are replaced.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ranqa.llm.common import BASE, INVERSE, append_columns, binary_views, mix64, powers, table

MIN_MATCH, MAX_GAP, MIN_COVERAGE = 4, 12, 0.8
#: words that templates and phrases may hold together
MAX_TEMPLATE_WORDS = 200_000

# Phrases of the base reading and their labels.
PHRASES = [("cc-by", "cc by"), ("gpl", "general public license"), ("reserved", "all rights reserved")]

# Public licence notices (label, text).
TEMPLATES = [
    ("mit", "Released under the MIT License"),
    ("mit", "Licensed under the MIT License"),
    ("mit", "This project is licensed under the terms of the MIT license"),
    ("mit", "SPDX-License-Identifier: MIT"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files (the \"Software\"), to deal in the Software without restriction, including without "
            "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
            "Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
            "The above copyright notice and this permission notice shall be included in all copies or substantial portions of "
            "the Software."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
            "granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("isc", "SPDX-License-Identifier: ISC"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
                   "compliance with the License. You may obtain a copy of the License at "
                   "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
                   "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR "
                   "CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing "
                   "permissions and limitations under the License."),
    ("apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
            "following conditions are met:"),
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following "
            "disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions "
            "and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
                "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
                "option) any later version."),
    ("gpl-3.0", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("gpl-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General "
                "Public License as published by the Free Software Foundation; either version 2 of the License, or (at your "
                "option) any later version."),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser "
             "General Public License as published by the Free Software Foundation"),
    ("agpl-3.0", "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as "
                 "published by the Free Software Foundation, either version 3 of the License"),
    ("no-warranty", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even "
                    "the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    ("cc-by-4.0", "Licensed under CC BY 4.0"),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to "
                "this work."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
]

Notices = list[tuple[str, str]]

SPAN = T.StructType([T.StructField("label", T.StringType()), T.StructField("first_word", T.LongType()),
                     T.StructField("end_word", T.LongType()), T.StructField("coverage", T.DoubleType())])
FOUND = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("n_base", T.LongType()), T.StructField("first_word", T.LongType()),
    T.StructField("last_word", T.LongType()), T.StructField("base_labels", T.ArrayType(T.StringType())),
    T.StructField("spans", T.ArrayType(SPAN)), T.StructField("labels", T.ArrayType(T.StringType())),
    T.StructField("score", T.DoubleType())])

# bytes of words after A-Z were lowered: digits, a-z and every byte of a character beyond ASCII
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WORD = np.zeros(256, bool)
_IS_WORD[48:58] = _IS_WORD[97:123] = _IS_WORD[128:] = True


def word_hashes(texts: pa.Array) -> list[np.ndarray]:
    """64-bit hashes of the words of every text, words ending at a text's end; null texts have none."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    data, off = binary_views(pc.fill_null(texts, ""))
    out: list[np.ndarray] = []
    first = 0
    while first < len(off) - 1:  # texts in groups of about a megabyte
        last = max(first + 1, int(np.searchsorted(off, off[first] + (1 << 20), "right")) - 1)
        out += _hashes(data[off[first]:off[last]], off[first:last + 1] - off[first])
        first = last
    return out


def _hashes(raw: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
    b = _LOWER[raw]
    inside = np.zeros(len(b) + 2, bool)
    inside[1:-1] = _IS_WORD[b]
    starts = inside[1:-1] & ~inside[:-2]
    ends = inside[1:-1] & ~inside[2:]  # at the last byte of a word
    edge = off[(off > 0) & (off < len(b))]
    starts[edge] |= inside[1:-1][edge]
    ends[edge - 1] |= inside[1:-1][edge - 1]
    s, e = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    sums = np.zeros(len(b) + 1, np.uint64)
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * powers(BASE, len(b)), out=sums[1:])
    h = mix64((sums[e] - sums[s]) * powers(INVERSE, len(b) + 1)[s])
    at = np.searchsorted(s, off)
    return [h[i:j] for i, j in zip(at[:-1], at[1:])]


class Automaton:
    """Suffix automaton of several texts of word numbers."""

    def __init__(self, texts: Iterable[list[int]]):
        self.step: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.own: list[list[tuple[int, int]]] = [[]]  # (text, words up to the end) of prefixes
        for t, words in enumerate(texts):
            last = 0
            for k, w in enumerate(words):
                last = self._add(last, w)
                self.own[last].append((t, k + 1))
        self.below: list[list[int]] = [[] for _ in self.link]
        for s, up in enumerate(self.link[1:], 1):
            self.below[up].append(s)

    def _state(self, length: int, step: dict[int, int], link: int) -> int:
        self.step.append(step)
        self.length.append(length)
        self.link.append(link)
        self.own.append([])
        return len(self.link) - 1

    def _split(self, p: int, w: int, q: int) -> int:
        """The state of the longest string that ``p`` reaches by ``w``, cut out of ``q`` where that holds longer ones."""
        if self.length[q] == self.length[p] + 1:
            return q
        c = self._state(self.length[p] + 1, dict(self.step[q]), self.link[q])
        self.link[q] = c
        while p >= 0 and self.step[p].get(w) == q:
            self.step[p][w] = c
            p = self.link[p]
        return c

    def _add(self, last: int, w: int) -> int:
        if w in self.step[last]:
            return self._split(last, w, self.step[last][w])
        new, p = self._state(self.length[last] + 1, {}, 0), last
        while p >= 0 and w not in self.step[p]:
            self.step[p][w] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, w, self.step[p][w])
        return new

    def places(self, state: int) -> list[tuple[int, int]]:
        """(text, words up to the end) of every occurrence of the state's strings."""
        out, todo = [], [state]
        while todo:
            s = todo.pop()
            out += self.own[s]
            todo += self.below[s]
        return sorted(out)


def chain(matches: list[tuple[int, int, int]], max_gap: int) -> list[tuple[int, int, int]]:
    """(covered words, first document word, word after the last) of chains over (document start, template start, words),
    ordered by document start; each match is in one chain at most, better chains first."""
    best: list[int] = []
    before: list[int] = []
    start = 0  # matches before this one end too early for the current one
    reach: list[int] = []  # largest document end of matches up to each one
    for j, (d, t, n) in enumerate(matches):
        reach.append(max(d + n, reach[-1] if reach else 0))
        while start < j and reach[start] < d - max_gap:
            start += 1
        top, prev = n, -1
        for i in range(start, j):
            di, ti, ni = matches[i]
            if d - (di + ni) > max_gap or t <= ti or t - (ti + ni) > max_gap or d <= di:
                continue
            gain = min(n, d + n - (di + ni), t + n - (ti + ni))
            if gain > 0 and best[i] + gain > n and best[i] + gain >= top:  # of equal ones the nearest
                top, prev = best[i] + gain, i
        best.append(top)
        before.append(prev)
    out, used = [], [False] * len(matches)
    for j in sorted(range(len(matches)), key=lambda j: (-best[j], j)):
        at, members = j, []
        while at >= 0 and not used[at]:
            members.append(at)
            at = before[at]
        if at >= 0 or not members:  # runs into a better chain
            continue
        for m in members:
            used[m] = True
        out.append((best[j], matches[members[-1]][0], max(matches[m][0] + matches[m][2] for m in members)))
    return out


class Scanner:
    """Phrases and templates ready to be found in documents."""

    def __init__(self, phrases: Notices, templates: Notices, min_match: int = MIN_MATCH, max_gap: int = MAX_GAP,
                 min_coverage: float = MIN_COVERAGE):
        self.min_match, self.max_gap, self.min_coverage = min_match, max_gap, min_coverage
        hashes = word_hashes(pa.array([t for _, t in [*phrases, *templates]], pa.string()))
        if sum(map(len, hashes)) > MAX_TEMPLATE_WORDS:
            raise ValueError(f"templates hold more than {MAX_TEMPLATE_WORDS} words")
        self.labels = [label for label, _ in [*phrases, *templates]]
        self.vocabulary = np.unique(np.concatenate([*hashes, np.zeros(0, np.uint64)]))
        texts = [np.searchsorted(self.vocabulary, h).tolist() for h in hashes]
        self.texts, self.n_phrases = texts, len(phrases)
        self.automaton = Automaton(texts)
        pairs = lambda ts: np.unique(np.array([a * len(self.vocabulary) + b
                                               for t in ts for a, b in zip(t, t[1:])], np.int64))
        self.pairs, self.phrase_pairs = pairs(texts), pairs(texts[:len(phrases)])
        self.single: dict[int, list[int]] = {}
        for k, t in enumerate(texts[:len(phrases)]):
            if len(t) == 1:
                self.single.setdefault(t[0], []).append(k)
        self.low = np.uint64((1 << max(12, (16 * len(self.vocabulary)).bit_length())) - 1)
        self.maybe = np.zeros(int(self.low) + 1, bool)
        self.maybe[(self.vocabulary & self.low).view(np.int64)] = True
        # phrases that end with a state: its own and those of the states above it
        a = self.automaton
        own: dict[int, list[int]] = {}
        for k, t in enumerate(texts[:len(phrases)]):
            state = 0
            for w in t:
                state = a.step[state][w]
            if t:
                own.setdefault(state, []).append(k)
        self.ending: list[list[int]] = [[] for _ in a.link]
        for s in sorted(range(1, len(a.link)), key=a.length.__getitem__):
            self.ending[s] = own.get(s, []) + self.ending[a.link[s]]
        self._places: dict[int, list[tuple[int, int]]] = {}

    def _numbers(self, h: np.ndarray) -> np.ndarray:
        """Vocabulary number of every word, -1 for others."""
        out = np.full(len(h), -1, np.int64)
        near = np.flatnonzero(self.maybe[(h & self.low).view(np.int64)])
        if len(near) and len(self.vocabulary):
            at = np.minimum(np.searchsorted(self.vocabulary, h[near]), len(self.vocabulary) - 1)
            same = self.vocabulary[at] == h[near]
            out[near[same]] = at[same]
        return out

    def stretches(self, words: np.ndarray) -> list[tuple[int, int]]:
        """(first word, word after the last) of stretches of template pairs that may hold a phrase or a long match."""
        both = (words[:-1] >= 0) & (words[1:] >= 0)
        at = np.flatnonzero(both)
        key = words[at] * len(self.vocabulary) + words[at + 1]
        known = lambda ps: (ps[np.minimum(np.searchsorted(ps, key), len(ps) - 1)] == key) if len(ps) else np.zeros(len(key), bool)
        ok, phrase = known(self.pairs), known(self.phrase_pairs)
        at, phrase = at[ok], phrase[ok]
        if not len(at):
            return []
        first = np.flatnonzero(np.append(True, np.diff(at) != 1))
        last = np.append(first[1:], len(at))
        holds = np.add.reduceat(phrase, first) > 0
        keep = holds | (last - first + 1 >= self.min_match)
        return [(int(at[i]), int(at[j - 1]) + 2) for i, j in zip(first[keep], last[keep])]

    def statistics(self, words: list[int]) -> list[tuple[int, int]]:
        """(state, length) of the longest template string that ends at each word of a stretch."""
        step, link, length = self.automaton.step, self.automaton.link, self.automaton.length
        state = n = 0
        out = []
        for w in words:
            while state and w not in step[state]:
                state = link[state]
                n = length[state]
            if w in step[state]:
                state, n = step[state][w], n + 1
            out.append((state, n))
        return out

    def scan(self, h: np.ndarray) -> tuple[list[tuple[int, int]], list[tuple[int, int, int, float]]]:
        """((first word, phrase) of every place, (template, first word, word after, coverage) of every span)."""
        words = self._numbers(h)
        places: list[tuple[int, int]] = []
        if self.single:
            for at in np.flatnonzero(np.isin(words, list(self.single))):
                places += [(int(at), k) for k in self.single[int(words[at])]]
        found: dict[int, list[tuple[int, int, int]]] = {}
        for lo, hi in self.stretches(words) if len(words) > 1 else []:
            stats = self.statistics(words[lo:hi].tolist())
            for i, (state, n) in enumerate(stats):
                for k in self.ending[state]:
                    m = len(self.texts[k])
                    if 1 < m <= n:
                        places.append((lo + i + 1 - m, k))
                if n >= self.min_match and (i + 1 == len(stats) or stats[i + 1][1] <= n):
                    if state not in self._places:
                        self._places[state] = self.automaton.places(state)
                    for t, end in self._places[state]:
                        if t >= self.n_phrases:
                            found.setdefault(t, []).append((lo + i + 1 - n, end - n, n))
        spans = []
        for t, matches in found.items():
            size = len(self.texts[t])
            spans += [(t, d, e, covered / size) for covered, d, e in chain(sorted(matches), self.max_gap)
                      if covered >= self.min_coverage * size]
        return sorted(places), sorted(spans, key=lambda s: (s[1], s[2], s[0]))

    def columns(self, texts: pa.Array) -> list[pa.Array]:
        """The result columns of a batch of texts."""
        rows = []
        for h in word_hashes(texts):
            places, spans = self.scan(h)
            base = sorted({self.labels[k] for _, k in places})
            rows.append((len(h), len(places), places[0][0] if places else None, places[-1][0] if places else None, base,
                         [{"label": self.labels[t], "first_word": d, "end_word": e, "coverage": min(c, 1.0)} for t, d, e, c in spans],
                         sorted({*base, *(self.labels[t] for t, *_ in spans)}),
                         1.0 if places else min(1.0, max((s[3] for s in spans), default=0.0))))
        span = pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("end_word", pa.int64()), ("coverage", pa.float64())])
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(span), pa.list_(pa.string()),
                 pa.float64()]
        return [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]


def scan_licenses(docs: DataFrame, text: str = "text", phrases: Notices = PHRASES, templates: Notices = TEMPLATES,
                  min_match: int = MIN_MATCH, max_gap: int = MAX_GAP, min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """``docs`` plus ``n_words, n_base, first_word, last_word, base_labels, spans, labels, score``."""
    phrases, templates = list(phrases), list(templates)  # the closure takes what is given now

    def make() -> Callable[[pa.Array], list[pa.Array]]:
        return Scanner(phrases, templates, min_match, max_gap, min_coverage).columns

    return append_columns(docs, [text], FOUND, make)


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its licence phrases, labels and score."""
    out = scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word",
                      F.array_join("base_labels", ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), "score",
                      F.size("spans").cast("long").alias("n_spans"))
