"""License scans by an exact set-similarity join of text blocks with templates.

A template is the set of words of a licence notice.  A block is a line of a
text, or, as notices are wrapped, a window of words wherever lines end, as long
as the notice with room for foreign words (its words / threshold).  Every pair with |template & block| >= threshold * |template| is found:
the words of the templates are ordered by their frequency in all texts, rarest
first; a block that meets the threshold must hold one of the first
|template| - ceil(threshold * |template|) + 1 words of the template (prefix
filter), must have ceil(threshold * |template|) words at least (length filter),
and after a first common word at place p of the template at most |template| - p
words can be shared (positional filter).  What is left is counted exactly.  Windows
start at every word of a template; those of too few of its words or of none of
the prefix are out, and of windows that overlap only the fullest is given.  The
words of a line that meets the template itself are not looked at again, so a
notice within a line is found once, as that line.  Where templates that are nearly
alike (a licence and its stricter variant) are met at one place, the fullest counts.

Windows are looked for only around the places of prefix words: an inverted index
from those words to templates gives, for each template, the stretches of text that
a window with a prefix word can cover, so templates without a hit cost nothing.

Templates, tags (short ones of which every word must be there, as SPDX identifiers)
and phrases are parameters; they and the frequencies of their words (one count per
word, summed over all rows) are what is broadcast.

Words: A-Z in lower case, maximal runs of 0-9, a-z and characters beyond ASCII.
Defined results: a null text counts as empty; empty texts have no words, no
places and no labels; repeated rows are kept as they come.
"""

from __future__ import annotations

import bisect
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernel import ALPHANUMERIC, LOWER, string_buffers, word_hashes

THRESHOLD = 0.8
#: Of templates with fewer different words than this, all must be there: a few common words say nothing.
SHORT = 6
#: Licence notices by label (fixed values).
TEMPLATES = {
    "mit": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ],
    "apache": ["Licensed under the Apache License, Version 2.0.", "you may not use this file except in compliance with the License"],
    "gpl": ["This work is licensed under the GNU General Public License, version 3.", "it under the terms of the GNU General Public License as published by the Free Software Foundation"],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "cc-by": ["This work is licensed under a Creative Commons Attribution 4.0 International License"],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ],
    "isc": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"],
    "unlicense": ["This is free and unencumbered software released into the public domain."],
}
#: SPDX identifiers by label (fixed values).
SPDX = {
    "mit": ["MIT"],
    "apache": ["Apache-2.0"],
    "gpl": ["GPL-2.0", "GPL-3.0"],
    "lgpl": ["LGPL-2.1", "LGPL-3.0"],
    "agpl": ["AGPL-3.0"],
    "bsd": ["BSD-2-Clause", "BSD-3-Clause"],
    "isc": ["ISC"],
    "mpl": ["MPL-2.0"],
    "epl": ["EPL-2.0"],
    "cc0": ["CC0-1.0"],
    "cc-by": ["CC-BY-4.0"],
    "cc-by-nc": ["CC-BY-NC-4.0"],
    "unlicense": ["Unlicense"],
}
#: Titles of licences by label (fixed values).
TITLES = {
    "lgpl": ["GNU Lesser General Public License"],
    "agpl": ["GNU Affero General Public License"],
    "mpl": ["Mozilla Public License Version 2.0"],
    "epl": ["Eclipse Public License"],
}
#: Tags: every word must be there.
TAGS = {label: [f"SPDX-License-Identifier: {i}" for i in SPDX.get(label, [])] + TITLES.get(label, []) for label in {**SPDX, **TITLES}}
#: Phrases whose places are counted, and their labels (fixed values).
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}


def words_of(text: str) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))


def _hashes_of(words: list[str]) -> np.ndarray:
    raw, offs = string_buffers(pa.array(words, pa.large_string()))
    return word_hashes(raw, offs, ALPHANUMERIC, LOWER)[0]


class TemplateIndex:
    """The templates' words, rarest first, and what the filters need."""

    def __init__(self, counts: dict[str, int] | None = None, templates: dict[str, list[str]] = TEMPLATES, phrases: dict[str, str] = PHRASES, threshold: float = THRESHOLD, tags: dict[str, list[str]] | None = None):
        listed = [(label, n, False) for label, notices in templates.items() for n in notices] + [(label, n, True) for label, notices in (tags or {}).items() for n in notices]
        listed = [x for x in listed if words_of(x[1])]
        self.vocabulary = sorted({w for _, n, _ in listed for w in words_of(n)} | {w for p in phrases for w in words_of(p)})
        hashes = _hashes_of(self.vocabulary)
        by_hash = np.argsort(hashes)
        self.keys, self.ids = hashes[by_hash], by_hash
        number = {w: i for i, w in enumerate(self.vocabulary)}
        counts = counts or {}
        self.templates: list[tuple[str, list[int], int]] = []
        self.widths: list[int] = []
        self.prefixes: dict[int, list[tuple[int, int]]] = {}
        for label, notice, whole in listed:
            order = sorted({number[w] for w in words_of(notice)}, key=lambda i: (counts.get(self.vocabulary[i], 0), self.vocabulary[i]))
            need = len(order) if whole or len(order) < SHORT else math.ceil(threshold * len(order) - 1e-9)
            for place in range(len(order) - need + 1):
                self.prefixes.setdefault(order[place], []).append((len(self.templates), place))
            self.templates.append((label, order, need))
            self.widths.append(math.floor(len(words_of(notice)) / threshold + 1e-9))
        #: Which words each template holds.
        self.holds = np.zeros((len(self.templates), len(self.vocabulary)), bool)
        for t, (_, order, _) in enumerate(self.templates):
            self.holds[t, order] = True
        #: Templates of other labels that share the threshold's part of the smaller one: only one of them is meant.
        both = self.holds.astype(np.float32) @ self.holds.astype(np.float32).T
        sizes = np.diag(both)
        alike = both >= threshold * np.minimum.outer(sizes, sizes)
        self.rivals = [{u for u in np.flatnonzero(row).tolist() if self.templates[u][0] != label} for row, (label, _, _) in zip(alike, self.templates)]
        self.phrases = [([number[w] for w in words_of(p)], label) for p, label in phrases.items() if words_of(p)]
        self.starts_block = np.zeros(len(self.vocabulary), bool)
        self.starts_block[list(self.prefixes)] = True
        #: The templates of each prefix word, one after the other, and where those of a word begin.
        self.posted = np.array([t for w in range(len(self.vocabulary)) for t, _ in self.prefixes.get(w, ())], np.int64)
        self.posted_at = np.concatenate([[0], np.cumsum([len(self.prefixes.get(w, ())) for w in range(len(self.vocabulary))])]).astype(np.int64)

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """The place of each word in the vocabulary, -1 outside it."""
        if not len(self.keys):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        return np.where(self.keys[at] == hashes, self.ids[at], -1)

    def matches(self, block: set[int], size: int) -> list[tuple[int, float]]:
        """(template, containment) of all templates that the block's set of vocabulary words meets; size: of all its different words."""
        out, seen = [], set()
        for word in block:
            for t, place in self.prefixes.get(word, ()):
                label, order, need = self.templates[t]
                if t in seen or size < need:
                    continue
                if any(w in block for w in order[:place]):
                    continue  # this pair is met at its first common word
                if len(order) - place < need:
                    continue
                seen.add(t)
                shared = sum(w in block for w in order)
                if shared >= need:
                    out.append((t, shared / len(order)))
        return out

    def told_apart(self, met: list[tuple[int, int, float]]) -> list[tuple[int, int, float]]:
        """Of matches (first word, template, containment) at one place whose templates are rivals, the fullest, of equally full ones the longest."""
        rank = lambda m: (m[2], len(self.templates[m[1]][1]))
        by: dict[int, list[tuple[int, int, float]]] = {}
        for m in sorted(met):
            by.setdefault(m[1], []).append(m)

        def near(m: tuple[int, int, float], u: int) -> list[tuple[int, int, float]]:
            reach = max(self.widths[m[1]], self.widths[u])
            own = by.get(u, [])
            return own[bisect.bisect_left(own, (m[0] - reach + 1,)) : bisect.bisect_left(own, (m[0] + reach,))]

        return [m for m in met if not any(rank(o) > rank(m) for u in self.rivals[m[1]] & by.keys() for o in near(m, u))]

    def stretches(self, at: np.ndarray, words: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(template, which of the words): for each template with a prefix word, its words that lie within a window's length of one.

        at: places of words of the vocabulary, ascending; words: which they are.
        """
        core = np.flatnonzero(self.starts_block[words])
        each = self.posted_at[words[core] + 1] - self.posted_at[words[core]]
        template = self.posted[_ranges(self.posted_at[words[core]], each)]
        hit = np.repeat(core, each)
        by = np.argsort(template, kind="stable")
        template, hit = template[by], hit[by]
        cuts = np.flatnonzero(np.diff(template, prepend=-1, append=-1)) if len(template) else np.zeros(1, np.int64)
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            t, places = int(template[a]), at[hit[a:b]]
            lo, hi = np.searchsorted(at, places - self.widths[t] + 1), np.searchsorted(at, places + self.widths[t])
            first = np.append(True, lo[1:] > hi[:-1])
            lo, hi = lo[first], hi[np.append(first[1:], True)]
            near = _ranges(lo, hi - lo)
            yield t, near[self.holds[t, words[near]]]

    def wrapped(self, t: int, at: np.ndarray, words: np.ndarray, ends: np.ndarray) -> list[tuple[int, float]]:
        """(first word, containment) of the windows that meet template t, fullest of those that overlap.

        at: places of the template's words, ascending; words: which they are; ends: where the text of each ends.
        """
        _, order, need = self.templates[t]
        if len(at) < need:
            return []
        until = np.searchsorted(at, np.minimum(at + self.widths[t], ends))
        rare = np.concatenate([[0], np.cumsum(np.isin(words, order[: len(order) - need + 1]))])
        first = np.arange(len(at))
        first = first[(until - first >= need) & (rare[until] > rare[:-1])]
        if not len(first):
            return []
        by_word = np.argsort(words, kind="stable")
        before = np.full(len(at), -1)
        again = words[by_word[1:]] == words[by_word[:-1]]
        before[by_word[1:][again]] = by_word[:-1][again]
        shared, core = np.zeros(len(first), np.int64), np.full(len(first), -1)
        for step in range(int((until[first] - first).max())):
            here = np.minimum(first + step, len(at) - 1)
            shared += (first + step < until[first]) & (before[here] < first)
            core[(core < 0) & (shared >= need)] = step
        met = core >= 0
        first, shared, core = first[met], shared[met], (first + core)[met]
        out, last = [], -1
        for i in np.lexsort((-first, core)).tolist():  # by where the threshold is reached: as many as do not overlap
            if first[i] > last:
                last = core[i]
                same = slice(np.searchsorted(first, first[i]), np.searchsorted(first, last, "right"))
                best = same.stop - 1 - int(shared[same][::-1].argmax())
                out.append((int(at[first[best]]), int(shared[best]) / len(order)))
        return out


def _ranges(first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """first, first + 1, ... of each length, one after the other."""
    ends = np.cumsum(length)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(first - ends + length, length)


def _located(index: TemplateIndex, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    raw, offs = string_buffers(column)
    hashes, where, bounds = word_hashes(raw, offs, ALPHANUMERIC, LOWER)
    return index.numbers(hashes), where, bounds, np.flatnonzero(raw == 10)


def word_frequencies(docs: DataFrame, text_col: str, index: TemplateIndex) -> dict[str, int]:
    """How often each word of the vocabulary occurs in all texts; one row per word and task is what moves."""
    vocabulary = index.vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(vocabulary), np.int64)
        for batch in batches:
            numbers = _located(index, batch.column(0))[0]
            total += np.bincount(numbers[numbers >= 0], minlength=len(vocabulary))
        yield pa.RecordBatch.from_arrays([pa.array(range(len(vocabulary)), pa.int32()), pa.array(total)], names=["w", "n"])

    rows = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "w int, n long").groupBy("w").agg(F.sum("n").alias("n"))
    return {vocabulary[r["w"]]: r["n"] for r in rows.collect()}


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, templates: dict[str, list[str]] = TEMPLATES, tags: dict[str, list[str]] = TAGS, phrases: dict[str, str] = PHRASES) -> DataFrame:
    """doc_id, n_words, places (start word of each phrase), place_labels, blocks (first word of the line or window, template label, containment).

    templates: texts of notices by label, of which the threshold's share of words must be there; tags: short ones by
    label, of which all must be; phrases: labels by phrase, whose words must follow each other.  Texts without words
    stand for nothing.
    """
    counts = word_frequencies(docs, text_col, TemplateIndex(None, templates, phrases, threshold, tags))
    index = TemplateIndex(counts, templates, phrases, threshold, tags)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers, where, bounds, newlines = _located(index, batch.column(1))
            n = batch.num_rows
            places: list[list[int]] = [[] for _ in range(n)]
            labels: list[list[str]] = [[] for _ in range(n)]
            met: list[list[tuple[int, int, float]]] = [[] for _ in range(n)]
            lines: dict[int, list[int]] = {}
            for phrase, label in index.phrases:
                hit = np.flatnonzero(numbers == phrase[0])
                hit = hit[hit + len(phrase) <= len(numbers)]
                for k, w in enumerate(phrase[1:], 1):
                    hit = hit[numbers[hit + k] == w]
                text = np.searchsorted(bounds, hit, "right") - 1
                for i, at in zip(text.tolist(), hit.tolist()):
                    if at + len(phrase) <= bounds[i + 1]:
                        places[i].append(at - int(bounds[i]))
                        labels[i].append(label)
            begins = np.flatnonzero(np.isin(numbers, np.flatnonzero(index.starts_block))) if len(numbers) else np.zeros(0, np.int64)
            text = np.searchsorted(bounds, begins, "right") - 1
            line = np.searchsorted(newlines, where[begins])
            for i, at in dict.fromkeys(zip(text.tolist(), line.tolist())):
                lo = int(bounds[i]) if at == 0 else max(int(bounds[i]), int(np.searchsorted(where, newlines[at - 1])))
                hi = int(bounds[i + 1]) if at == len(newlines) else min(int(bounds[i + 1]), int(np.searchsorted(where, newlines[at])))
                own = numbers[lo:hi]
                found = index.matches(set(own[own >= 0].tolist()), hi - lo)
                met[i] += [(lo - int(bounds[i]), t, c) for t, c in found]
                for t, _ in found:
                    lines.setdefault(t, []).append(i + at)
            known = np.flatnonzero(numbers >= 0)
            words = numbers[known]
            text = np.searchsorted(bounds, known, "right") - 1
            line = np.searchsorted(newlines, where[known]) + text  # counts on from text to text
            for t, mine in index.stretches(known, words):
                if t in lines:
                    mine = mine[~np.isin(line[mine], lines[t])]
                for at, c in index.wrapped(t, known[mine], words[mine], bounds[text[mine] + 1]):
                    i = int(np.searchsorted(bounds, at, "right")) - 1
                    met[i].append((at - int(bounds[i]), t, c))
            blocks = [[{"first_word": w, "label": index.templates[t][0], "containment": c} for w, t, c in sorted(index.told_apart(m))] for m in met]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.diff(bounds), pa.int64()), pa.array(places, pa.list_(pa.int64())), pa.array(labels, pa.list_(pa.string())), pa.array(blocks, pa.list_(pa.struct([("first_word", pa.int64()), ("label", pa.string()), ("containment", pa.float64())])))],
                names=["doc_id", "n_words", "places", "place_labels", "blocks"],
            )

    picked = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = picked.schema["doc_id"].dataType.simpleString()
    return picked.mapInArrow(run, f"doc_id {kind}, n_words long, places array<long>, place_labels array<string>, blocks array<struct<first_word: long, label: string, containment: double>>")
