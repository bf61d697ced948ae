"""Licence scans by a generalised suffix automaton of licence word sequences (operator 5).

Words are runs of [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F] after A-Z are lower-cased. The automaton holds
every template and the base phrases. A text streams through it word by word, which gives
matching statistics: the longest run of words ending here that occurs in any template. Runs
that can't go on and have at least MIN_MATCH words are matches; those of a template
are chained in order (gaps of at most GAP words), and a chain that covers at least COVER of
the template's words is a span with its label. A template that stands whole within a longer match of another
is a span too. Such templates and base phrases are read off the same statistics: they stand
where they are a suffix of the current run.

Words and word pairs of the templates are looked up for whole blocks of texts first: a
run of two or more words consists of template pairs, so only such runs are streamed; that loses nothing.

Null and empty texts have no words and score 0. The score is 1 where a base phrase stands, else the best coverage
of a span. Texts of any length are scanned whole, in time that follows their length. Repeated rows are scanned each, an empty
table gives an empty result, and columns other than doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.llm.tables import id_and_text, tidied
from pairloom.llm.words import WORD, buffers, hash_word, row_blocks, words_of

MIN_MATCH, GAP, COVER = 4, 12, 0.6

# Base phrases and their labels.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Short public licence notices, as the licences' own texts recommend them.
TEMPLATES = (
    ("agpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation"),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc-sa", "licensed under cc by nc sa 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("mit", "released under the mit license"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
)


class SuffixAutomaton:
    """Generalised over word-number sequences; occurrences keep (sequence, end) pairs of every state."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[set[tuple[int, int]]] = [set()]
        for k, seq in enumerate(sequences):
            last = 0
            for end, word in enumerate(seq):
                last = self._extend(last, word)
                self.ends[last].add((k, end))
        for state in sorted(range(1, len(self.next)), key=lambda s: -self.length[s]):
            if self.link[state] > 0:
                self.ends[self.link[state]] |= self.ends[state]

    def _state(self, length: int, moves: dict[int, int], link: int) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.length.append(length)
        self.ends.append(set())
        return len(self.next) - 1

    def _split(self, p: int, word: int, q: int) -> int:
        clone = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, word: int) -> int:
        q = self.next[last].get(word)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, word, q)
        new, p = self._state(self.length[last] + 1, {}, 0), last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][word]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, word, q)
        return new

    def stream(self, words: list[int]) -> Iterator[tuple[int, int]]:
        """Matching statistics: (state, length) after each word."""
        state = size = 0
        for word in words:
            while state and word not in self.next[state]:
                state = self.link[state]
                size = self.length[state]
            if word in self.next[state]:
                state, size = self.next[state][word], size + 1
            else:
                state = size = 0
            yield state, size


class LicenceScanner:
    def __init__(self, templates=TEMPLATES, base=None):
        base = BASE if base is None else base
        self.labels = [label for label, _ in templates]
        self.phrases = list(base.values())
        sequences = [text.split() for _, text in templates] + [p.split() for p in base]
        self.sizes = [len(s) for s in sequences]
        vocabulary = sorted({w for s in sequences for w in s})
        number = {w: i + 1 for i, w in enumerate(vocabulary)}
        hashes = np.array([hash_word(w) for w in vocabulary], np.uint64)
        order = np.argsort(hashes)
        self._hashes, self._numbers = hashes[order], np.arange(1, len(vocabulary) + 1)[order]
        coded = [[number[w] for w in s] for s in sequences]
        self.automaton = SuffixAutomaton(coded)
        self._width = len(vocabulary) + 1
        self._pairs = np.unique([a * self._width + b for s in coded for a, b in zip(s, s[1:])])
        short = [s for s in coded[len(templates) :] if len(s) - 1 < MIN_MATCH - 1]
        self._short = np.unique([a * self._width + b for s in short for a, b in zip(s, s[1:])])
        # For each state: base phrases and whole templates that are suffixes of it, as (phrase or template, words).
        self._suffix: list[list[tuple[int, int]]] = []
        self._whole: list[list[tuple[int, int]]] = []
        for state in range(len(self.automaton.next)):
            here, whole, up = [], [], state
            while up > 0:
                low = self.automaton.length[self.automaton.link[up]]
                for k, end in self.automaton.ends[up]:
                    p = k - len(templates)
                    if end == self.sizes[k] - 1 and low < self.sizes[k] <= self.automaton.length[up]:
                        (here if p >= 0 else whole).append((p if p >= 0 else k, self.sizes[k]))
                up = self.automaton.link[up]
            self._suffix.append(here)
            self._whole.append(whole)

    def scan(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, list[tuple[str, int]], list[tuple[str, int, int, float]]]]:
        """Per text: number of words, base places (label, word), spans (label, first word, end word, coverage)."""
        words = words_of(data, offsets, WORD)
        at = np.minimum(np.searchsorted(self._hashes, words.hashes), len(self._hashes) - 1)
        numbers = np.where(self._hashes[at] == words.hashes, self._numbers[at], 0)
        out: list = [(int(n), [], []) for n in np.diff(words.bounds)]
        if len(numbers) < 2:
            return out
        rows = words.rows
        pair = numbers[:-1] * self._width + numbers[1:]
        good = (numbers[:-1] > 0) & (numbers[1:] > 0) & (rows[:-1] == rows[1:]) & np.isin(pair, self._pairs)
        edges = np.flatnonzero(np.diff(np.concatenate([[0], good.astype(np.int8), [0]])))
        found: dict[int, list[tuple[int, int, int]]] = {}
        whole: dict[int, list[tuple[int, int]]] = {}
        short = np.concatenate([[0], np.cumsum(good & np.isin(pair, self._short))])
        for i, j in zip(edges[::2], edges[1::2]):
            if j - i < MIN_MATCH - 1 and short[j] == short[i]:
                continue
            row, lo = int(rows[i]), int(i - words.bounds[rows[i]])
            stats = list(self.automaton.stream(numbers[i : j + 1].tolist()))
            for k, (state, size) in enumerate(stats):
                for p, n in self._suffix[state]:
                    if n <= size:
                        out[row][1].append((self.phrases[p], lo + k - n + 1))
                whole.setdefault(row, []).extend((t, lo + k - n + 1) for t, n in self._whole[state] if n <= size)
                if size >= MIN_MATCH and (k + 1 == len(stats) or stats[k + 1][1] <= size):
                    found.setdefault(row, []).append((lo + k - size + 1, size, state))
        for row, matches in found.items():
            out[row][2].extend(self._chains(matches, whole[row]))
        return out

    def _chains(self, matches: list[tuple[int, int, int]], whole: list[tuple[int, int]]) -> list[tuple[str, int, int, float]]:
        """Chains matches, in text order, into covered spans of each template, beside those that stand whole."""
        # Matches come by rising start, so a chain that ended more than GAP words before can't go on.
        open_: dict[int, list[list[int]]] = {}
        ended: list[tuple[int, list[int]]] = []
        for start, size, state in matches:
            for k, end in self.automaton.ends[state]:
                if k >= len(self.labels):
                    continue
                first = end - size + 1
                chains = open_.setdefault(k, [])
                past = [c for c in chains if c[1] < start - GAP]
                if past:
                    ended.extend((k, c) for c in past)
                    chains[:] = [c for c in chains if c[1] >= start - GAP]
                for chain in reversed(chains):  # text start, text end, template end, covered
                    if 0 <= start - chain[1] <= GAP and 0 <= first - chain[2] <= GAP:
                        chain[1:] = [start + size, end + 1, chain[3] + size]
                        break
                else:
                    chains.append([start, start + size, end + 1, size])
        best: dict[tuple[str, int], tuple[int, float]] = {(self.labels[k], start): (start + self.sizes[k], 1.0) for k, start in whole}
        ended.extend((k, c) for k, chains in open_.items() for c in chains)
        for k, (start, end, _, covered) in ended:
            share = covered / self.sizes[k]
            if share >= COVER and (share, end) > best.get((self.labels[k], start), (0, 0.0))[::-1]:
                best[self.labels[k], start] = (end, share)
        return sorted((label, start, end, round(share, 6)) for (label, start), (end, share) in best.items())


@lru_cache(maxsize=1)
def _scanner() -> LicenceScanner:
    return LicenceScanner()


def scan_licences(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, base array<struct<label, at>>, spans array<struct<label, start, end, covered>>; places are word numbers."""
    base = pa.list_(pa.struct([("label", pa.string()), ("at", pa.int64())]))
    span = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("covered", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _scanner()
        for batch in batches:
            data, offsets = buffers(batch.column(1))
            for a, b in row_blocks(offsets):
                n, places, spans = zip(*scanner.scan(data, offsets[a : b + 1]))
                places = [[{"label": x, "at": i} for x, i in p] for p in places]
                spans = [[{"label": x, "start": i, "end": j, "covered": c} for x, i, j, c in s] for s in spans]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(n, pa.int64()), pa.array(places, base), pa.array(spans, span)], ["doc_id", "n_words", "base", "spans"])

    return id_and_text(docs).mapInArrow(tidied(run), "doc_id long, n_words long, base array<struct<label:string,at:long>>, spans array<struct<label:string,start:long,end:long,covered:double>>")


def licence_digest(scanned: DataFrame) -> DataFrame:
    """The columns of the query's contract."""
    joined = lambda *parts: F.array_join(F.array_sort(F.array_distinct(F.concat(*parts))), ",")
    covered = F.coalesce(F.array_max("spans.covered"), F.lit(0.0))
    return scanned.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min("base.at").alias("first_word"),
        F.array_max("base.at").alias("last_word"),
        joined(F.col("base.label")).alias("base_labels"),
        joined(F.col("base.label"), F.col("spans.label")).alias("labels"),
        F.when(F.size("base") > 0, 1.0).otherwise(covered).alias("score"),
    )
