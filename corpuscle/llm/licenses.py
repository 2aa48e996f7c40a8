"""Licence scans by a generalised suffix automaton of licence words.

One automaton holds the word sequences of all templates.  A file's words stream through it:
after each word, the state and length of the longest match that ends there (the matching
statistics).  Maximal matches of some length become segments; per template, segments that
advance in both file and template, with bounded gaps in the file, are chained, and every chain
that covers enough of the template is a span with that template's label; where chains of
relatives lie on the same words, the one that matches most of them is kept.  Three phrases are
also looked for word by word; their labels always stay.

Texts of any length are scanned whole, in one pass.  Null texts have no words and no labels; other columns are left aside; repeated rows are
scanned each.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from corpuscle.llm.support import bounded_batches, id_and_text

#: The phrases and their labels.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
#: Notices and opening passages of public licences, by label.
TEMPLATES = (
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"),
    ("apache-2", "Licensed under the Apache License, Version 2.0."),
    ("apache-2", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("gpl-2", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("cc-by", "Licensed under CC BY 4.0."),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by-nd", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    ("cc-by-nc-sa", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    ("cc-by-nc-nd", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."),
    ("lgpl-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("lgpl-3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("agpl-3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("agpl-3", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("0bsd", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
)

LEAST_MATCH = 3  # words of a segment
LARGEST_GAP = 8  # words between two segments of a chain
COVERED = 0.75  # of a template, for its label

_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words_of(text: str) -> list[bytes]:
    """ASCII letters lower-cased; a word is a run of ASCII letters, digits and all beyond ASCII."""
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split()


class SuffixAutomaton:
    """All substrings of several word sequences; each state knows where it first ends in each."""

    def __init__(self, sequences: list[list[int]]) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[dict[int, set[int]]] = [{}]  # state -> sequence -> ends
        for k, sequence in enumerate(sequences):
            last = 0
            for at, symbol in enumerate(sequence):
                last = self._extend(last, symbol)
                self.ends[last].setdefault(k, set()).add(at)
        for state in sorted(range(1, len(self.link)), key=lambda s: -self.length[s]):
            for k, ends in self.ends[state].items():
                if self.link[state] > 0:
                    self.ends[self.link[state]].setdefault(k, set()).update(ends)

    def _new(self, length: int, link: int, following: dict[int, int]) -> int:
        self.next.append(following)
        self.length.append(length)
        self.link.append(link)
        self.ends.append({})
        return len(self.link) - 1

    def _split(self, state: int, symbol: int, target: int) -> int:
        twin = self._new(self.length[state] + 1, self.link[target], dict(self.next[target]))
        self.link[target] = twin
        while state >= 0 and self.next[state].get(symbol) == target:
            self.next[state][symbol] = twin
            state = self.link[state]
        return twin

    def _extend(self, last: int, symbol: int) -> int:
        known = self.next[last].get(symbol)
        if known is not None:  # this prefix stands in an earlier sequence
            return known if self.length[known] == self.length[last] + 1 else self._split(last, symbol, known)
        state = self._new(self.length[last] + 1, 0, {})
        p = last
        while p >= 0 and symbol not in self.next[p]:
            self.next[p][symbol] = state
            p = self.link[p]
        if p >= 0:
            q = self.next[p][symbol]
            self.link[state] = q if self.length[q] == self.length[p] + 1 else self._split(p, symbol, q)
        return state

    def segments(self, symbols: list[int | None], least: int) -> list[tuple[int, int, int]]:
        """Right-maximal matches of at least ``least`` symbols: (end in the file, length, state)."""
        out, state, length = [], 0, 0
        following, link, lengths = self.next, self.link, self.length
        for at, symbol in enumerate(symbols):
            if symbol is None:
                if length >= least:
                    out.append((at - 1, length, state))
                state = length = 0
                continue
            to = following[state].get(symbol)
            if to is None:
                if length >= least:
                    out.append((at - 1, length, state))
                while state > 0 and to is None:
                    state = link[state]
                    length = lengths[state]
                    to = following[state].get(symbol)
            if to is None:
                state = length = 0
            else:
                state, length = to, length + 1
        if length >= least:
            out.append((len(symbols) - 1, length, state))
        return out


class Chain(NamedTuple):
    """Words ``first`` to ``last`` of a file, of which ``matched`` are the template's: a share ``covered`` of it."""

    label: str
    first: int
    last: int
    matched: int
    covered: float


class Scanner:
    def __init__(self, templates: tuple[tuple[str, str], ...] = TEMPLATES, phrases: dict[str, str] = PHRASES) -> None:
        sequences = [words_of(t) for _, t in templates]
        phrase_words = {tuple(words_of(p)): label for p, label in phrases.items()}
        self.ids = {w: i for i, w in enumerate(sorted({w for s in [*sequences, *phrase_words] for w in s}))}
        self.labels = [label for label, _ in templates]
        self.sizes = [len(s) for s in sequences]
        self.automaton = SuffixAutomaton([[self.ids[w] for w in s] for s in sequences])
        self.phrases = [([self.ids[w] for w in p], label) for p, label in phrase_words.items()]

    def base(self, symbols: list[int | None]) -> list[tuple[int, str]]:
        """Places of the phrases: (first word, label)."""
        found = []
        for phrase, label in self.phrases:
            at = -1
            try:
                while True:
                    at = symbols.index(phrase[0], at + 1)
                    if symbols[at : at + len(phrase)] == phrase:
                        found.append((at, label))
            except ValueError:
                continue
        return found

    def _chains(self, found: list[tuple[int, int, int, int]], size: int) -> list[tuple[int, int, int]]:
        """(words covered, first, last) of the best chain that ends with each segment, in order of the segments' starts."""
        # No segment is longer than the template, so the ones that can go before it start within a bounded stretch.
        best: list[tuple[int, int, int]] = []
        for i, (a, b, c, d) in enumerate(found):
            cover, first = b - a + 1, a
            for j in range(i - 1, -1, -1):
                if found[j][0] < a - LARGEST_GAP - 1 - size:
                    break
                if found[j][1] < a - LARGEST_GAP - 1:
                    continue
                overlap = max(0, found[j][1] - a + 1, found[j][3] - c + 1)
                if found[j][0] < a and found[j][2] < c and overlap < b - a + 1 and best[j][0] + b - a + 1 - overlap > cover:
                    cover, first = best[j][0] + b - a + 1 - overlap, best[j][1]
            best.append((cover, first, b))
        return best

    def chains(self, symbols: list[int | None]) -> list[Chain]:
        """Each template's chains that cover enough of it and don't overlap, the best first; where none does, its best chain."""
        by_template: dict[int, list[tuple[int, int, int, int]]] = {}
        for end, length, state in self.automaton.segments(symbols, LEAST_MATCH):
            for k, ends in self.automaton.ends[state].items():
                for template_end in ends:
                    by_template.setdefault(k, []).append((end - length + 1, end, template_end - length + 1, template_end))
        out = []
        for k, found in by_template.items():
            label, size = self.labels[k], self.sizes[k]
            found.sort()
            best = self._chains(found, size)
            if max(best)[0] < COVERED * size:
                cover, first, last = max(best)
                out.append(Chain(label, first, last, cover, cover / size))
            while enough := sorted((-cover, first, last) for cover, first, last in best if cover >= COVERED * size):
                taken: list[tuple[int, int]] = []  # by place
                for cover, first, last in enough:
                    at = bisect.bisect(taken, (first, last))
                    if (not at or taken[at - 1][1] < first) and (at == len(taken) or last < taken[at][0]):
                        taken.insert(at, (first, last))
                        out.append(Chain(label, first, last, -cover, min(1.0, -cover / size)))
                # What overlaps no chain so far may make others.
                left = [(first, last) for first, last in taken]
                found = [f for f in found if (at := bisect.bisect(left, (f[1], len(symbols)))) == 0 or left[at - 1][1] < f[0]]
                best = self._chains(found, size)
        return out

    def spans(self, chains: list[Chain]) -> list[Chain]:
        """Chains that cover enough; of relatives on the same words, the one that matches most of them."""
        out: list[Chain] = []
        places: list[tuple[int, int, str]] = []  # those kept, by their first word
        longest = 0
        for c in sorted((c for c in chains if c.covered >= COVERED), key=lambda c: (-c.matched, -c.covered, c.first, c.label)):
            longest = max(longest, c.last - c.first + 1)
            low, high = bisect.bisect(places, (c.first - longest,)), bisect.bisect(places, (c.last + 1,))
            if not any(label != c.label and 2 * (min(last, c.last) - max(first, c.first) + 1) > c.last - c.first + 1 for first, last, label in places[low:high]):
                bisect.insort(places, (c.first, c.last, c.label))
                out.append(c)
        return sorted(out, key=lambda c: (c.first, c.last, c.label))


@lru_cache(maxsize=2)
def scanner() -> Scanner:
    return Scanner()


def license_scan(docs: DataFrame) -> DataFrame:
    """Per document: n_words, base places and labels, all labels, score, and the spans found."""
    bounded_batches(docs.sparkSession)
    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,first:long,last:long,covered:double>>"
    span = pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("covered", pa.float64())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = scanner()
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                words = words_of(text)
                symbols = list(map(s.ids.get, words))
                base = s.base(symbols)
                chains = s.chains(symbols)
                spans = s.spans(chains)
                base_labels = {label for _, label in base}
                starts = [at for at, _ in base]
                rows.append((
                    len(words), len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted(base_labels)),
                    ",".join(sorted(base_labels | {x.label for x in spans})), 1.0 if base else max((x.covered for x in spans), default=0.0),
                    [{"label": x.label, "first": x.first, "last": x.last, "covered": x.covered} for x in spans],
                ))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), span)
            columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
            yield pa.record_batch([batch.column(0), *columns], names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"])

    return id_and_text(docs).mapInArrow(scan, schema)
