"""License scans with a generalised suffix automaton over the words of licence templates.

Files are streamed through the automaton, which keeps the longest suffix of the words read so far
that occurs in any template (matching statistics). Maximal matches of at least ``MIN_MATCH`` words
are laid out on the templates they occur in and chained: matches that go forward in file and
template, with small gaps, add up to one covered span. A template is reported where a chain covers
enough of it, so reflowed, interrupted or slightly edited notices are still found.

Word pairs that occur in no template cannot lie inside a match; they are skipped in bulk, and only
the rest is streamed. Files are independent, so nothing is shuffled.

Defined results: a NULL or empty text has no words; texts are read whole; repeated rows, NULL ids
and ties between templates each keep their rows and labels; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varstrip.llm import text as tx

# Phrases and labels of the contract.
PHRASES = [("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")]
# Licence notices in public use; more can be given as a parameter.
TEMPLATES = [
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-3.0", "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("gpl-2.0", "under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License"),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("agpl-3.0", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0."),
    ("cc-by-4.0", "Licensed under CC BY 4.0."),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
]
MIN_MATCH, MAX_GAP, MIN_COVER = 3, 12, 0.8


def hashes_of(text: str) -> np.ndarray:
    return tx.words(*tx.raw(pa.array([text])), tx.ALNUM, fold=True).hashes


class SuffixAutomaton:
    """All substrings of several word sequences; each state knows where its words end."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.ends = [-1], [0], [set()]
        for number, sequence in enumerate(sequences):
            last = 0
            for place, word in enumerate(sequence):
                last = self._extend(last, word)
                self.ends[last].add((number, place + 1))
        for state in sorted(range(1, len(self.next)), key=lambda s: -self.length[s]):
            if self.link[state] > 0:
                self.ends[self.link[state]] |= self.ends[state]

    def _new(self, length: int, link: int, moves: dict[int, int]) -> int:
        self.next.append(moves)
        self.length.append(length)
        self.link.append(link)
        self.ends.append(set())
        return len(self.next) - 1

    def _split(self, state: int, target: int, word: int) -> int:
        """The state for exactly the words of ``state`` plus ``word``, cut out of ``target``."""
        copy = self._new(self.length[state] + 1, self.link[target], dict(self.next[target]))
        self.link[target] = copy
        while state >= 0 and self.next[state].get(word) == target:
            self.next[state][word] = copy
            state = self.link[state]
        return copy

    def _extend(self, last: int, word: int) -> int:
        target = self.next[last].get(word)
        if target is not None:  # known from an earlier template
            return target if self.length[target] == self.length[last] + 1 else self._split(last, target, word)
        new = self._new(self.length[last] + 1, 0, {})
        state = last
        while state >= 0 and word not in self.next[state]:
            self.next[state][word] = new
            state = self.link[state]
        if state >= 0:
            target = self.next[state][word]
            self.link[new] = target if self.length[target] == self.length[state] + 1 else self._split(state, target, word)
        return new

    def matches(self, words: list[int], least: int) -> list[tuple[int, int, int]]:
        """(start, length, state) of the matches that cannot be extended to the right."""
        out, state, size = [], 0, 0
        for i, word in enumerate(words):
            before, held = state, size
            while state and word not in self.next[state]:
                state = self.link[state]
                size = self.length[state]
            if word in self.next[state]:
                state, size = self.next[state][word], size + 1
            if size <= held and held >= least:  # the match that ended before this word was maximal
                out.append((i - held, held, before))
        if size >= least:
            out.append((len(words) - size, size, state))
        return out


class Library(NamedTuple):
    labels: list[str]
    sizes: list[int]
    vocabulary: np.ndarray
    pairs: np.ndarray
    automaton: SuffixAutomaton
    phrases: list[tuple[np.ndarray, str]]


def library(templates: list[tuple[str, str]]) -> Library:
    """Automaton, vocabulary and word pairs of the templates."""
    sequences = [hashes_of(t) for _, t in templates]
    phrases = [(hashes_of(p), label) for p, label in PHRASES]
    vocabulary = np.unique(np.concatenate([*sequences, *[p for p, _ in phrases]]))
    coded = [np.searchsorted(vocabulary, s) for s in sequences]
    pairs = np.unique(np.concatenate([c[:-1] * len(vocabulary) + c[1:] for c in coded]))
    return Library([label for label, _ in templates], [len(c) for c in coded], vocabulary, pairs, SuffixAutomaton([c.tolist() for c in coded]), [(np.searchsorted(vocabulary, p), label) for p, label in phrases])


def chains(matches: list[tuple[int, int, int]], gap: int) -> list[tuple[int, int, int]]:
    """Chain (file start, template start, length) triples of one template.

    A match follows another if it goes forward in both and leaves at most ``gap`` words of the file
    between them; an overlap with the last match counts once. Returns (covered, first, end) of every
    chain that no match continues; the scan back stops at the gap, so it is linear in the file.
    """
    matches = sorted(matches)
    longest = max((n for _, _, n in matches), default=0)
    best: list[tuple[int, int]] = []
    continued = set()
    for i, (at, t, n) in enumerate(matches):
        covered, first, before = n, at, None
        for j in range(i - 1, -1, -1):
            at2, t2, n2 = matches[j]
            if at2 + longest + gap < at:
                break
            if at2 == at or t2 >= t or at2 + n2 + gap < at:
                continue
            new = n - max(0, at2 + n2 - at, t2 + n2 - t)
            if new > 0 and best[j][0] + new > covered:
                covered, first, before = best[j][0] + new, best[j][1], j
        best.append((covered, first))
        if before is not None:
            continued.add(before)
    return [(c, f, matches[i][0] + matches[i][2]) for i, (c, f) in enumerate(best) if i not in continued]


def scan_codes(codes: np.ndarray, lib: Library) -> list[tuple[str, int, int, float]]:
    """(label, first word, end word, share of the template) of the notices of one file.

    ``codes`` has the place of every word in the vocabulary, or -1.
    """
    if len(codes) < 2:
        return []
    pair = codes[:-1] * len(lib.vocabulary) + codes[1:]
    at = np.minimum(np.searchsorted(lib.pairs, pair), len(lib.pairs) - 1)
    good = (lib.pairs[at] == pair) & (codes[:-1] >= 0) & (codes[1:] >= 0)
    edges = np.flatnonzero(np.diff(np.concatenate([[0], good.view(np.int8), [0]]))).reshape(-1, 2)
    found: dict[int, list] = {}
    for low, high in edges[edges[:, 1] - edges[:, 0] >= MIN_MATCH - 1].tolist():
        for start, size, state in lib.automaton.matches(codes[low : high + 1].tolist(), MIN_MATCH):
            for template, end in lib.automaton.ends[state]:
                found.setdefault(template, []).append((low + start, end - size, size))
    out = []
    for template, matches in found.items():
        for covered, first, end in chains(matches, MAX_GAP):
            out.append((lib.labels[template], first, end, covered / lib.sizes[template]))
    return sorted(out)


_SPAN = pa.struct([("label", pa.string()), ("first", pa.int32()), ("end", pa.int32()), ("share", pa.float64())])
SCANNED = "doc_id long, n_words long, bases array<struct<label:string,word:int>>, spans array<struct<label:string,first:int,end:int,share:double>>"
_TYPES = [pa.int64(), pa.list_(pa.struct([("label", pa.string()), ("word", pa.int32())])), pa.list_(_SPAN)]


def _scan_batches(lib: Library):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for s in tx.slices(batch.column(1)):
                w = tx.words(s.data, s.offsets, tx.ALNUM, fold=True)
                place = np.minimum(np.searchsorted(lib.vocabulary, w.hashes), len(lib.vocabulary) - 1)
                codes = np.where(lib.vocabulary[place] == w.hashes, place, -1).astype(np.int64)
                rows = len(w.first) - 1
                bases: list[list] = [[] for _ in range(rows)]
                for phrase, label in lib.phrases:
                    k = len(phrase)
                    hit = np.ones(max(0, len(codes) - k + 1), bool)
                    for j, word in enumerate(phrase):
                        hit &= codes[j : len(codes) - k + 1 + j] == word
                    for start in np.flatnonzero(hit).tolist():
                        row = int(np.searchsorted(w.first, start, "right")) - 1
                        if start + k <= w.first[row + 1]:
                            bases[row].append({"label": label, "word": start - int(w.first[row])})
                spans = [[dict(zip(("label", "first", "end", "share"), x, strict=True)) for x in scan_codes(codes[w.first[i] : w.first[i + 1]], lib)] for i in range(rows)]
                columns = [pa.array(x, t) for x, t in zip([np.diff(w.first), bases, spans], _TYPES, strict=True)]
                yield pa.RecordBatch.from_arrays([ids[s.rows], *columns], names=["doc_id", "n_words", "bases", "spans"])

    return run


def scan(documents: DataFrame, templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """Words, fixed phrases and template spans of every document.

    ``bases`` lists the places of the fixed phrases, ``spans`` the chained matches with the share of
    their template that they cover, weak ones included.
    """
    rows = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(_scan_batches(library(templates)), SCANNED)


def op9(documents: DataFrame, least: float = MIN_COVER) -> DataFrame:
    """The contract's digest of ``scan``: a template's label counts from a share of ``least``."""
    base = F.array_sort(F.array_distinct(F.col("bases")["label"]))
    words = F.col("bases")["word"]
    strong = F.filter("spans", lambda s: s["share"] >= least)["label"]
    labels = F.array_sort(F.array_distinct(F.concat(base, strong)))
    score = F.least(F.lit(1.0), F.coalesce(F.array_max(F.col("spans")["share"]), F.lit(0.0)))
    return scan(documents).select(
        "doc_id", "n_words", F.size("bases").cast("long").alias("n_base"), F.array_min(words).cast("long").alias("first_word"), F.array_max(words).cast("long").alias("last_word"),
        F.array_join(base, ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), score.alias("score"),
    )
