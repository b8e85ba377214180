"""License notices in documents.

MinHash bands over overlapping text windows retrieve templates; the exact
containment of the template's five-word shingles in the window verifies them.

Windows come in a few lengths.  A template uses the shortest length w whose
stride s leaves w - s + 1 >= n of its n shingles, so that a whole notice always
lies in one window.  The similarity of that window to the template is then at
least c * n / (w + (1 - c) * n) for containment c; the number of bands is chosen
so that such a window is retrieved with the given probability.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from postpulse.llm.decontaminate import tokens
from postpulse.llm.tables import slices, text_bytes
from postpulse.llm.words import Words

# Notices as their licenses word them, by SPDX identifier.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
)


@dataclass(frozen=True)
class Scan:
    shingle: int = 5
    containment: float = 0.8
    probability: float = 0.999
    seed: int = 5


def band_settings(similarity: float, probability: float, most_rows: int = 3, most_hashes: int = 96) -> tuple[int, int]:
    """(rows, bands): the most selective bands that retrieve ``similarity`` with ``probability``."""
    for rows in range(most_rows, 0, -1):
        bands = math.ceil(math.log(1 - probability) / math.log(1 - similarity**rows)) if similarity < 1 else 1
        if rows * bands <= most_hashes or rows == 1:
            return rows, bands
    raise AssertionError


def window_shape(n: int) -> tuple[int, int]:
    """Length and stride, in shingles, of the windows for a template of ``n`` shingles."""
    length, stride = 8, 4
    while length - stride + 1 < n:
        length *= 2
        stride = length // 4
    return length, stride


class Templates:
    """Band tables of the templates, grouped by window shape."""

    def __init__(self, templates=TEMPLATES, rule: Scan | None = None):
        self.rule = rule = rule or Scan()
        self.names = [name for name, _ in templates]
        flat = Words.from_lists([tokens(text) for _, text in templates])
        grams, whole = flat.windows(rule.shingle)
        starts = flat.starts
        self.sets = [np.unique(grams[a:b][whole[a:b]]) for a, b in zip(starts[:-1], starts[1:], strict=True)]
        self.lengths = flat.counts
        if not all(len(s) for s in self.sets):
            raise ValueError(f"a template needs at least {rule.shingle} words")
        shapes: dict[tuple[int, int], list[int]] = {}
        for i, own in enumerate(self.sets):
            shapes.setdefault(window_shape(len(own)), []).append(i)
        self.shapes = {}
        most = 1
        for shape, members in shapes.items():
            least = min(len(self.sets[i]) for i in members)
            c = rule.containment
            rows, bands = band_settings(c * least / (shape[0] + (1 - c) * least), rule.probability)
            self.shapes[shape] = (members, rows, bands)
            most = max(most, rows * bands)
        random = np.random.default_rng(rule.seed)
        self.factors = random.integers(0, 1 << 63, most, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.shifts = random.integers(0, 1 << 63, most, dtype=np.uint64)
        signatures = np.stack([self.hashed(s).min(axis=1) for s in self.sets])
        self.keys = {shape: band_keys(signatures[members][:, : r * b], r) for shape, (members, r, b) in self.shapes.items()}

    def hashed(self, grams: np.ndarray) -> np.ndarray:
        """One row per hash function."""
        return ((grams[None, :] * self.factors[:, None] + self.shifts[:, None]) >> np.uint64(32)).astype(np.uint32)


def band_keys(signatures: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key per band of ``rows`` values."""
    key = np.zeros((signatures.shape[0], signatures.shape[1] // rows), np.uint64)
    for r in range(rows):
        key = key * np.uint64(0x9E3779B97F4A7C15) + signatures[:, r::rows] + np.uint64(1)
    return key


def window_minima(hashed: np.ndarray, starts: np.ndarray, counts: np.ndarray, length: int, stride: int):
    """(document, first shingle, signature) of every window; documents own runs of columns.

    Minima are taken over strides first and then over the strides of a window.
    A document shorter than a window is one window.
    """
    pieces = np.maximum(-(-counts // stride), 0)
    owner = np.repeat(np.arange(len(counts)), pieces)
    index = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    heads = starts[owner] + index * stride
    if not len(heads):
        return owner, heads, np.empty((0, len(hashed)), np.uint32)
    minima = np.minimum.reduceat(hashed, heads, axis=1)
    span = length // stride
    most = np.iinfo(np.uint32).max
    padded = np.concatenate([minima, np.full((len(hashed), span), most, np.uint32)], axis=1)
    owner_padded = np.concatenate([owner, np.full(span, -1)])
    result = minima.copy()
    for k in range(1, span):
        same = owner_padded[k : k + len(owner)] == owner
        np.minimum(result, np.where(same[None, :], padded[:, k : k + len(owner)], most), out=result)
    # windows that reach beyond the end repeat the end of the one before; the first of a document stays
    useful = (index == 0) | (index * stride + length < counts[owner] + stride)
    return owner[useful], heads[useful], result[:, useful].T


def matches(templates: Templates, texts: list[bytes | None]) -> list[tuple[int, str, int, int, float]]:
    """(text, license, first token, tokens, containment) of every verified notice."""
    rule = templates.rule
    flat = Words.from_lists([tokens(t) for t in texts])
    grams, whole = flat.windows(rule.shingle)
    counts = np.maximum(flat.counts - rule.shingle + 1, 0)
    starts = flat.starts[:-1]
    if not counts.any():
        return []
    hashed = templates.hashed(grams)
    hashed[:, ~whole] = np.iinfo(np.uint32).max  # shingles of two documents are nobody's
    found: dict[tuple[int, int], list[tuple[int, int, float]]] = {}
    for (length, stride), (members, rows, bands) in templates.shapes.items():
        owner, head, signature = window_minima(hashed[: rows * bands], starts, counts, length, stride)
        keys = band_keys(signature, rows)
        for m, member in enumerate(members):
            hit = (keys == templates.keys[length, stride][m][None, :]).any(axis=1)
            for w in np.flatnonzero(hit).tolist():
                doc = int(owner[w])
                end = min(head[w] + length, starts[doc] + counts[doc])
                inside = np.isin(grams[head[w] : end], templates.sets[member])
                places = np.flatnonzero(inside)
                part = len(np.unique(grams[head[w] : end][inside])) / len(templates.sets[member])
                if part >= rule.containment:
                    first = int(head[w] - starts[doc] + places[0])
                    found.setdefault((doc, member), []).append((first, int(places[-1] - places[0]) + rule.shingle, part))
    result = []
    for (doc, member), spans in found.items():
        # overlapping windows see one notice several times; the fullest view counts
        taken: list[tuple[int, int, float]] = []
        for first, size, part in sorted(spans, key=lambda s: (-s[2], s[1], s[0])):
            if all(first + size <= f or f + n <= first for f, n, _ in taken):
                taken.append((first, size, part))
        result.extend((doc, templates.names[member], *t) for t in taken)
    return sorted(set(result))


def scan(documents: DataFrame, templates: Templates | None = None) -> DataFrame:
    """(doc_id, license, at, words, containment): license notices in the rows of ``documents``.

    Positions count tokens (letters, digits, underscores) of the whole text.
    Null, empty and very short texts have no notice.  A notice that contains a
    shorter template of the same license is reported for both lengths.  Repeated
    rows repeat their notices; null ids are passed on; other columns are ignored.
    """
    templates = templates or Templates()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 200):
            rows = matches(templates, batch.column("text").to_pylist())
            ids = batch.column("doc_id").to_pylist()
            columns = list(zip(*[(ids[r[0]], *r[1:]) for r in rows], strict=True)) or [()] * 5
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "license", "at", "words", "containment"])

    return text_bytes(documents, ("doc_id", "long")).mapInArrow(run, "doc_id long, license string, at long, words long, containment double")
