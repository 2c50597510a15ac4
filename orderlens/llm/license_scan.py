"""License scans: MinHash bands over overlapping windows find license texts inside documents.

Words are lower-cased runs of letters and digits, shingles are five words (a shorter template
has one shingle, all its words). A template of s shingles belongs to the level with the
smallest B = 2**k >= s. At each level a document is cut into blocks of B shingle positions, and
two neighbouring blocks are a window, so every occurrence lies whole in a window and their
Jaccard similarity is at least s / 2B > 1/4, or 1/5 with a fifth of the template missing. Each
of ``BANDS`` bands is one MinHash value: a window shares at least one with its template with
probability 1 - (1 - 1/5)**40 = 0.9999. What is retrieved is verified: the share of the
template's shingles that the window holds must be at least ``CONTAINED``.

Defined cases: null and empty texts hold no license; a document that holds a template several
times gives one row, with the best share and its first window; repeated documents give repeated
rows; other columns are ignored; no documents or no templates give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from orderlens.llm.common import in_arrow, text_or_empty
from orderlens.llm.textbytes import ngrams, plain_words, seeds, slices

SHINGLE, BANDS = 5, 40
#: Share of a template's shingles as a fraction.
CONTAINED = (4, 5)
_HASH = seeds(BANDS, 71)

#: Usual license notices.
TEMPLATES = {
    "MIT": "Released under the MIT License.",
    "MIT text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, '
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions"
    ),
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 text": (
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the "
        'License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.'
    ),
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL text": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
        "by the Free Software Foundation"
    ),
    "BSD text": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"
    ),
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "CC0-1.0": "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to the public domain worldwide",
    "reserved": "All rights reserved.",
}


class Index:
    """Templates by shingle length and level, with their MinHash values."""

    def __init__(self, templates: dict[str, str]):
        self.names = list(templates)
        hashes, bounds = plain_words(pa.array(list(templates.values()), pa.string()))
        self.sets: list[np.ndarray] = []
        self.levels: dict[tuple[int, int], list[int]] = {}
        for t in range(len(self.names)):
            own = hashes[bounds[t] : bounds[t + 1]]
            n = min(SHINGLE, len(own))
            self.sets.append(np.unique(ngrams(own, np.array([0, len(own)]), max(n, 1))[0]))
            if n:
                self.levels.setdefault((n, max(len(self.sets[t]) - 1, 0).bit_length()), []).append(t)
        self.low = np.array([[(s * h).min() if len(s) else 0 for h in _HASH] for s in self.sets], np.uint64).reshape(len(self.sets), BANDS)
        # a bit for the upper 16 bits of each value, to pass over most windows quickly
        self.bits = {}
        for level, own in self.levels.items():
            table = np.zeros((BANDS, 1 << 16), bool)
            for t in own:
                table[np.arange(BANDS), (self.low[t] >> np.uint64(48)).astype(np.int64)] = True
            self.bits[level] = table

    def scan(self, hashes: np.ndarray, bounds: np.ndarray) -> list[tuple[int, int, float, int]]:
        """(text, template, share of its shingles, first shingle of the window) of all matches."""
        best: dict[tuple[int, int], tuple[float, int]] = {}
        for n in sorted({n for n, _ in self.levels}):
            # only texts of n words have shingles of n words
            value, at = ngrams(hashes, bounds, n)
            short = np.flatnonzero((np.diff(bounds) < n) & (np.diff(at) > 0))
            value[at[short]] = 0
            for (size, level), own in self.levels.items():
                if size == n and len(value):
                    self._level(value, at, level, own, self.bits[size, level], best)
        return [(d, t, share, first) for (d, t), (share, first) in sorted(best.items())]

    def _level(self, value, at, level, own, bits, best) -> None:
        block = 1 << level
        count = -(-np.diff(at) // block)
        text = np.repeat(np.arange(len(count)), count)
        first = np.cumsum(count) - count
        start = at[text] + (np.arange(len(text)) - first[text]) * block
        stop = np.minimum(start + 2 * block, at[text + 1])
        inner = text[1:] == text[:-1]  # blocks whose window goes on in the next one
        retrieved = set()
        for band in range(BANDS):
            low = value * _HASH[band]
            if block > 1:
                low = np.minimum.reduceat(low, start)
            window = low.copy()
            window[:-1][inner] = np.minimum(low[:-1], low[1:])[inner]
            some = np.flatnonzero(bits[band][(window >> np.uint64(48)).astype(np.int64)])
            for t in own:
                retrieved.update((int(w), t) for w in some[window[some] == self.low[t, band]])
        for w, t in sorted(retrieved):
            held = int(np.isin(self.sets[t], value[start[w] : stop[w]]).sum())
            if CONTAINED[1] * held >= CONTAINED[0] * len(self.sets[t]):
                key = (int(text[w]), t)
                share = held / len(self.sets[t])
                if key not in best or share > best[key][0]:
                    best[key] = (share, int(start[w] - at[text[w]]))


def scan(docs: DataFrame, templates: dict[str, str] | None = None, column: str = "text") -> DataFrame:
    """doc_id, license, share, first_word (of the window) for every license that a document holds."""
    index = Index(TEMPLATES if templates is None else templates)
    chosen = docs.select("doc_id", text_or_empty(column).alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", 1 << 20):
                found = index.scan(*plain_words(batch.column("text")))
                of = pa.array([f[0] for f in found], pa.int64())
                columns = [batch.column("doc_id").take(of), pa.array([index.names[f[1]] for f in found], pa.string())]
                columns += [pa.array([f[2] for f in found], pa.float64()), pa.array([f[3] for f in found], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "license", "share", "first_word"])

    return in_arrow(chosen, work, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, license string, share double, first_word long")
