"""License scans by patience alignment.

Words that are unique to both a stretch of text and a template are anchors; the longest
increasing run of anchors is kept, and the gaps between them are aligned in the same way.
The share of the template's words that are matched is its coverage. Stretches are found by
the words of the templates that are not everyday words: for every template, `COVERAGE`
cannot be reached on everyday words alone, so nothing is lost.

Copies that stand close together share a stretch, in which none of their words is unique.
So windows of about one template are aligned first, one beginning where each telling word
puts the template's begin; then wider windows, and last the whole rest, for copies with
insertions.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from dossier.llm.arrow_text import ALNUM, Members, hash_text, numbered, pieces, text_buffer, words_of

COVERAGE = 0.75
#: So many template lengths on either side of an everyday-free word belong to its stretch.
REACH = 2
#: Template lengths of the windows; after them comes what is left of the stretch as a whole.
WINDOWS = (1, 2, 4)

# Everyday words, and the notices and license texts to look for.
EVERYDAY = frozenset("a all an and any are as at be by for from if in is it may no not of on or that the this to under version with without you your work".split())
TEMPLATES = {
    "all-rights-reserved": "All rights reserved.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "mit-notice": "Released under the MIT License.",
    "apache-2.0-header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.'
    ),
    "mit": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), '
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies."
    ),
    "bsd-2-clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
        "and/or other materials provided with the distribution."
    ),
}


def plain_words(text: str) -> list[int]:
    """Hashes of the words of a text, as the scan sees them."""
    data = np.frombuffer(text.encode(), dtype=np.uint8)
    return words_of(data, np.array([0, len(data)]), ALNUM).hash.tolist()


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of pairs, ordered by their first part, whose second part increases (patience sorting)."""
    tops: list[int] = []
    piles: list[int] = []
    before: list[int] = []
    for k, (_, y) in enumerate(pairs):
        at = bisect_left(tops, y)
        before.append(piles[at - 1] if at else -1)
        if at == len(tops):
            tops.append(y), piles.append(k)
        else:
            tops[at], piles[at] = y, k
    out, k = [], piles[-1] if piles else -1
    while k >= 0:
        out.append(pairs[k])
        k = before[k]
    return out[::-1]


def _once(words: list[int], start: int, end: int) -> dict[int, int]:
    seen: dict[int, int] = {}
    for k in range(start, end):
        seen[words[k]] = -1 if words[k] in seen else k
    return {w: k for w, k in seen.items() if k >= 0}


def align(text: list[int], template: list[int]) -> list[tuple[int, int]]:
    """Matched places (text, template), both increasing. Equal ends of a gap are matched first, then its anchors."""
    matched: list[tuple[int, int]] = []
    todo = [(0, len(text), 0, len(template))]
    while todo:
        a, b, c, d = todo.pop()
        while a < b and c < d and text[a] == template[c]:
            matched.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and text[b - 1] == template[d - 1]:
            b, d = b - 1, d - 1
            matched.append((b, d))
        if a >= b or c >= d:
            continue
        mine, theirs = _once(text, a, b), _once(template, c, d)
        anchors = _increasing(sorted((k, theirs[w]) for w, k in mine.items() if w in theirs))
        if not anchors:
            continue
        x, y = a, c
        for p, q in anchors:
            todo.append((x, p, y, q))
            matched.append((p, q))
            x, y = p + 1, q + 1
        todo.append((x, b, y, d))
    return sorted(matched)


class Scanner:
    def __init__(self, templates: dict[str, str] = TEMPLATES, coverage: float = COVERAGE) -> None:
        self.coverage = coverage
        self.templates = {name: plain_words(text) for name, text in templates.items()}
        everyday = {hash_text(w) for w in EVERYDAY}
        self.telling = {name: frozenset(words) - everyday for name, words in self.templates.items()}
        for name, words in self.templates.items():
            if sum(w in everyday for w in words) >= coverage * len(words):
                raise ValueError(f"template {name} could be covered by everyday words")
        self.counts = {name: Counter(words) for name, words in self.templates.items()}
        self.place = {name: {w: k for k, w in reversed(list(enumerate(words)))} for name, words in self.templates.items()}
        self.any = Members(np.array(sorted(set().union(*self.telling.values())), dtype=np.uint64))

    def _match(self, words: list[int], name: str, start: int, end: int) -> tuple[int, int, int] | None:
        """(words matched, first word, end) of the template in a window, or None under the coverage."""
        template, counts = self.templates[name], self.counts[name]
        least = self.coverage * len(template)
        if end - start < least or sum(min(m, counts[w]) for w, m in Counter(words[start:end]).items() if w in counts) < least:
            return None
        matched = align(words[start:end], template)
        return (len(matched), start + matched[0][0], start + matched[-1][0] + 1) if len(matched) >= least else None

    def _copies(self, words: list[int], name: str, own: list[int], start: int, end: int) -> Iterator[tuple[int, int, int]]:
        """Every copy of the template in a stretch, the tightest first; copies do not overlap. `own` are all places of telling words."""
        n, place = len(self.templates[name]), self.place[name]
        gaps = [(start, end)]
        for size in (w * n for w in WINDOWS):
            rest = []
            for a, b in gaps:
                for h in own[bisect_left(own, a) : bisect_left(own, b)]:
                    if h < a:
                        continue
                    low = max(a, h - place[words[h]])
                    if not self._match(words, name, low, min(b, low + size)):
                        continue
                    # What ends after the window belongs to the copy unless more foreign words than its own come with it.
                    wider = [self._match(words, name, low, min(b, low + size * k // 2)) for k in (2, 3, 4)]
                    found = max((x for x in wider if x), key=lambda x: 2 * x[0] - (x[2] - x[1]))
                    yield found
                    rest.append((a, found[1]))
                    a = found[2]
                rest.append((a, b))
            gaps = rest
        while gaps:
            a, b = gaps.pop()
            found = self._match(words, name, a, b)
            if found:
                yield found
                gaps += [(a, found[1]), (found[2], b)]

    def scan(self, words: list[int], hits: list[int]) -> list[tuple[str, int, int, int]]:
        """(name, coverage in ten thousandths, first word, end) for each copy of a template; `hits` are the places of telling words."""
        out = []
        for name, template in self.templates.items():
            reach = REACH * len(template)
            own = [h for h in hits if words[h] in self.telling[name]]
            k = 0
            while k < len(own):
                n = k + 1
                while n < len(own) and own[n] - own[n - 1] <= reach:
                    n += 1
                start, end = max(0, own[k] - reach), min(len(words), own[n - 1] + reach + 1)
                for matched, low, high in self._copies(words, name, own[k:n], start, end):
                    out.append((name, 10_000 * matched // len(template), low, high))
                k = n
        return sorted(out, key=lambda x: (x[2], x[0]))


def scan_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] = TEMPLATES, coverage: float = COVERAGE) -> DataFrame:
    """One row per input row: id, n_found, licenses, best.

    `licenses` lists (name, coverage, first word, end) by place; `best` is the name with
    the largest coverage, ties by name, or null. Null and empty texts have none. Repeated
    rows and null ids give a row each. Templates are few and fixed.
    """
    source = numbered(docs, id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(Scanner(templates, coverage))
    kind = pa.list_(pa.struct([("name", pa.string()), ("coverage", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = shared.value
        for batch in pieces(batches):
            words = words_of(*text_buffer(batch.column(1)), ALNUM)
            hits = np.flatnonzero(scanner.any(words.hash))
            owner = np.searchsorted(words.first, hits, side="right") - 1
            found: list[list] = [[] for _ in range(batch.num_rows)]
            for k in np.unique(owner).tolist():
                place = words.text(k)
                found[k] = scanner.scan(words.hash[place].tolist(), (hits[owner == k] - place.start).tolist())
            best = [min(f, key=lambda x: (-x[1], x[0]))[0] if f else None for f in found]
            rows = [[dict(zip(("name", "coverage", "start", "end"), x)) for x in f] for f in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(f) for f in found], pa.int64()), pa.array(rows, kind), pa.array(best, pa.string())], ["id", "n_found", "licenses", "best"])

    schema = f"id {source.schema['id'].dataType.simpleString()}, n_found long, licenses array<struct<name: string, coverage: int, start: int, end: int>>, best string"
    return source.mapInArrow(run, schema).withColumnRenamed("id", id_col)
