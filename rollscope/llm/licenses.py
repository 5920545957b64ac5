"""License scan: a generalised suffix automaton of licence templates, matching statistics, chained matches.

The words of a file stream through the automaton, which keeps the longest suffix read so far that occurs in
some template. Matches of MIN_MATCH words or more that cannot be carried on are chained per template, at every place that
they have in it, in order and with bounded gaps: each match continues the chain that has the most words with it.
A template's label is reported if its heaviest chain covers COVERED of its words.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import repeat
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from rollscope.llm.common import bounded_batches, with_columns_of

MIN_MATCH = 3
COVERED = 0.75
GAP = 12

# The phrases of the contract and their labels.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

# Licence notices, as published by their authors.
TEMPLATES = (
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("apache-2", "Licensed under the Apache License, Version 2.0."),
    ("apache-2", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
)

_PLAIN = bytes(i + 32 if 65 <= i <= 90 else i if 48 <= i <= 57 or 97 <= i <= 122 or i >= 128 else 32 for i in range(256))


def words(text: bytes) -> list[bytes]:
    """Words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of the text with A-Z lower-cased."""
    return text.translate(_PLAIN).split()


class SuffixAutomaton:
    """Generalised suffix automaton over word numbers; each state knows all its end positions in the templates."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[dict[int, list[int]]] = [{}]
        for number, sequence in enumerate(sequences):
            last = 0
            for at, word in enumerate(sequence):
                last = self._extend(last, word)
                self.ends[last].setdefault(number, []).append(at + 1)
        for state in sorted(range(1, len(self.next)), key=lambda s: -self.length[s]):
            for number, some in self.ends[state].items():
                self.ends[self.link[state]].setdefault(number, []).extend(some)

    def _new(self, length: int) -> int:
        self.next.append({})
        self.link.append(0)
        self.length.append(length)
        self.ends.append({})
        return len(self.next) - 1

    def _split(self, p: int, word: int) -> int:
        """The state of length[p] + 1 that p leads to by a word, parted from a longer one where needed."""
        q = self.next[p][word]
        if self.length[q] == self.length[p] + 1:
            return q
        copy = self._new(self.length[p] + 1)
        self.next[copy], self.link[copy] = dict(self.next[q]), self.link[q]
        self.link[q] = copy
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, word: int) -> int:
        if word in self.next[last]:
            return self._split(last, word)
        state, p = self._new(self.length[last] + 1), last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = state
            p = self.link[p]
        self.link[state] = self._split(p, word) if p >= 0 else 0
        return state

    def statistics(self, sequence: list[int]) -> Iterator[tuple[int, int]]:
        """(state, length) of the longest match that ends at each word."""
        state = n = 0
        for word in sequence:
            while state and word not in self.next[state]:
                state = self.link[state]
                n = self.length[state]
            if word in self.next[state]:
                state, n = self.next[state][word], n + 1
            yield state, n


class Chain(NamedTuple):
    """Matches in order: words covered, first word and end in the file, end in the template."""

    words: int
    start: int
    end: int
    to: int


class Scanner:
    """Templates and phrases as word numbers, with the automaton over the templates."""

    def __init__(self, templates=TEMPLATES, phrases=PHRASES):
        parts = [(label, words(text.encode())) for label, text in templates]
        named = [(label, words(text.encode())) for text, label in phrases.items()]
        every = sorted({w for _, part in parts + named for w in part})
        self.number = {w: i for i, w in enumerate(every)}
        self.labels = [label for label, _ in parts]
        self.sizes = [len(part) for _, part in parts]
        self.phrases = [(label, [self.number[w] for w in part]) for label, part in named]
        self.automaton = SuffixAutomaton([[self.number[w] for w in part] for _, part in parts])

    def base(self, ids: np.ndarray) -> tuple[list[int], set[str]]:
        """Word positions at which phrases start, and their labels."""
        starts, labels = [], set()
        for label, phrase in self.phrases:
            n = max(0, len(ids) - len(phrase) + 1)
            hit = np.ones(n, dtype=bool)
            for i, word in enumerate(phrase):
                hit &= ids[i : i + n] == word
            at = np.flatnonzero(hit).tolist()
            starts += at
            labels |= {label} if at else set()
        return starts, labels

    def matches(self, ids: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(end in the file, length, state) of matches that end because the next word does not carry them on.

        A match has template words only, so runs of under MIN_MATCH of those are passed over.
        """
        edges = np.flatnonzero(np.diff(np.concatenate([[0], (ids >= 0).astype(np.int8), [0]])))
        for begin, end in edges.reshape(-1, 2)[np.diff(edges)[::2] >= MIN_MATCH].tolist():
            before = (0, 0)
            for at, (state, n) in enumerate(self.automaton.statistics(ids[begin:end].tolist()), begin):
                if n != before[1] + 1 and before[1] >= MIN_MATCH:
                    yield at, before[1], before[0]
                before = (state, n)
            if before[1] >= MIN_MATCH:
                yield end, before[1], before[0]

    def covered(self, ids: np.ndarray) -> list[tuple[str, float, int, int]]:
        """(label, covered share of the template, first word, end) of the heaviest chain of each template met."""
        open_: dict[int, list[Chain]] = {}
        best: dict[int, Chain] = {}
        for end, n, state in self.matches(ids):
            for template, places in self.automaton.ends[state].items():
                # Only chains that end within a template and a gap of here can be carried on.
                chains = [c for c in open_.get(template, ()) if c.end >= end - self.sizes[template] - GAP]
                new = []
                for to in places:
                    chain = Chain(n, end - n, end, to)
                    for c in chains:
                        over = max(0, c.end - (end - n), c.to - (to - n))  # words that the chain has covered
                        if over < n and 0 <= end - n + over - c.end <= GAP and c.words + n - over > chain.words:
                            chain = Chain(c.words + n - over, c.start, end, to)
                    new.append(chain)
                open_[template] = chains + new
                best[template] = max([best.get(template, new[0]), *new], key=lambda c: c.words)
        return [(self.labels[t], min(1.0, c.words / self.sizes[t]), c.start, c.end) for t, c in best.items()]

    def scan(self, text: bytes) -> tuple:
        found = words(text)
        ids = np.fromiter(map(self.number.get, found, repeat(-1)), dtype=np.int32, count=len(found))
        starts, base = self.base(ids)
        spans = self.covered(ids)
        labels = base | {label for label, share, _, _ in spans if share >= COVERED}
        score = 1.0 if base else max((share for _, share, _, _ in spans), default=0.0)
        first, last = (min(starts), max(starts)) if starts else (None, None)
        return len(found), len(starts), first, last, ",".join(sorted(base)), ",".join(sorted(labels)), score


@cache
def _scanner() -> Scanner:
    return Scanner()


def _scan(texts: pd.Series) -> pd.DataFrame:
    columns = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    out = pd.DataFrame([_scanner().scan(t) for t in texts], columns=columns)
    return out.astype({"first_word": "Int64", "last_word": "Int64"})


def scan_licenses(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Null and empty texts have no words, no labels and score 0. A text with a base phrase scores 1, any other the
    covered share of its best template. Texts of any length are read whole; of chains of equal weight the first
    counts. Repeated rows give repeated results, null doc_ids are kept, an empty table gives none; other columns are ignored.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.selectExpr("cast(doc_id as long) as doc_id", "cast(coalesce(text, '') as binary) as text")
    kinds = (
        "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    )
    return with_columns_of(rows, _scan, kinds, "text")
