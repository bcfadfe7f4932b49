"""License scans: MinHash bands over overlapping text windows retrieve templates.

Text and templates are lower-cased and cut into runs of letters, digits and non-ASCII characters. A
template of T distinct 5-word shingles belongs to the level whose windows have W shingles, W the
smallest of 8, 16, 32, ... with W >= 2 * T, laid every W / 2 shingles: any place of the template lies whole in
a window. Where at least ``SHARE`` of its shingles occur together, the window's similarity to the template
is at least 0.75 * T / (W + 0.25 * T). Bands have one minimum each, ``BANDS`` of them: a match is
retrieved with probability 1 - (1 - s)**BANDS. Levels start at 8, so s is 0.75 / 8.25 at least for T = 1 (in
fact 1 / 8, as its only shingle must occur); ``retrieval_probability`` gives the value of a
template, 0.9998 or more for all but the shortest. To keep that true for a single shingle, which
leaves the least to chance, templates with fewer than ``FEW`` shingles are looked up by each of their
shingles instead of minima: their band is the shingle itself.

What is retrieved is verified: the share of the template's shingles that the window holds, 0.75 or more.

Everything happens in one pass over the documents; nothing is shuffled but the matches. Templates
are a parameter, at most ``MOST_TEMPLATE_BYTES`` of text, which bounds what is sent to the tasks.

Defined results: NULL, empty and wordless texts match nothing; a template with fewer than five words is
one shingle of all its words. A row without ``doc_id`` is reported with NULL. Repeated rows are
reported once each. Of several windows with the same template the best counts, then the first.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from rowrelay.llm.common import WordHashes, map_batches, odd_numbers, slices, window_hashes

SHINGLE = 5
SHARE = (75, 100)
BANDS = 64
FEW = 4
LEAST_WINDOW = 8
MOST_TEMPLATE_BYTES = 4 << 20

# Notices as their licenses word them, by SPDX identifier.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with '
        "the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by "
        "applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ),
    ("MIT", "Released under the MIT License."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without limitation the '
        "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
        "persons to whom the Software is furnished to do so, subject to the following conditions:",
    ),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    (
        "GPL-3.0-or-later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later "
        "version.",
    ),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    (
        "BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met:",
    ),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
)

FACTORS = odd_numbers(BANDS, 21).astype(np.uint32) | np.uint32(1)
SHIFTS = odd_numbers(BANDS, 22).astype(np.uint32)
WORDS = WordHashes()
# Bytes of words stay (upper case as lower case, all bytes of non-ASCII characters), others become spaces.
PLAIN = bytes(ord(chr(i).lower()) if chr(i).isascii() and chr(i).isalnum() else i if i >= 128 else 32 for i in range(256))


def normal_words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(PLAIN).split()


def scrambled(shingles: np.ndarray) -> np.ndarray:
    """One row of BANDS hash values for every shingle."""
    values = shingles.astype(np.uint32)[:, None] * FACTORS
    values += SHIFTS
    values ^= values >> np.uint32(15)
    return values


def minima_by_step(values: np.ndarray, longest: int) -> dict[int, np.ndarray]:
    """step -> minima of every run of ``step`` shingles, for steps of LEAST_WINDOW / 2 and its doubles."""
    step = LEAST_WINDOW // 2
    filled = np.concatenate([values, np.repeat(values[-1:], -len(values) % step)])  # a shingle more than once changes no minimum
    runs = [scrambled(filled[at : at + 128 * step]).reshape(-1, step, BANDS).min(axis=1) for at in range(0, len(filled), 128 * step)]
    out = {step: np.concatenate(runs)}
    while step < longest:
        before = out[step]
        if len(before) % 2:
            before = np.concatenate([before, before[-1:]])
        step *= 2
        out[step] = np.minimum(before[::2], before[1::2])
    return out


@dataclass(frozen=True)
class Template:
    number: int
    license_id: str
    shingles: np.ndarray  # sorted distinct hashes
    n_words: int
    window: int  # shingles of the windows that look for it
    minima: np.ndarray


def prepared(templates: Sequence[tuple[str, str]]) -> list[Template]:
    if sum(len(t.encode("utf-8")) for _, t in templates) > MOST_TEMPLATE_BYTES:
        raise ValueError(f"templates have more than {MOST_TEMPLATE_BYTES} bytes")
    out = []
    for number, (license_id, text) in enumerate(templates):
        words = normal_words(text)
        if not words:
            continue
        shingles = np.unique(window_hashes(WORDS.of(words), min(SHINGLE, len(words))))
        window = max(LEAST_WINDOW, 1 << (2 * len(shingles) - 1).bit_length())
        out.append(Template(number, license_id, shingles, len(words), window, scrambled(shingles).min(axis=0)))
    return out


def retrieval_probability(template: Template) -> float:
    """At least how likely a window with ``SHARE`` of the template's shingles shares a band with it."""
    count = len(template.shingles)
    if count < FEW:
        return 1.0
    needed = -(-SHARE[0] * count // SHARE[1])
    return 1 - (1 - needed / (template.window + count - needed)) ** BANDS


def scan(hashes: dict[int, np.ndarray], templates: list[Template]) -> list[tuple[int, float, int]]:
    """(template number, containment, window start in shingles) of the best window of each template.

    ``hashes`` has the shingle hashes of a document by shingle length.
    """
    found = []
    for size, values in hashes.items():
        group = [t for t in templates if min(SHINGLE, t.n_words) == size]
        if not len(values) or not group:
            continue
        few, banded = [t for t in group if len(t.shingles) < FEW], [t for t in group if len(t.shingles) >= FEW]
        hits: list[tuple[Template, np.ndarray]] = []
        if banded:
            steps = minima_by_step(values, max(t.window for t in banded) // 2)
            windows = {2 * step: half if len(half) == 1 else np.minimum(half[:-1], half[1:]) for step, half in steps.items()}
            hits += [(t, np.flatnonzero((windows[t.window] == t.minima).any(axis=1))) for t in banded]
        if few:
            places = np.flatnonzero(np.isin(values, np.concatenate([t.shingles for t in few])))
            for t in few if len(places) else []:
                at = places[np.isin(values[places], t.shingles)] // (t.window // 2)
                last = max(0, -(-len(values) // (t.window // 2)) - 2)
                hits.append((t, np.unique(np.clip(np.concatenate([at, at - 1]), 0, last))))
        for t, numbers in hits:
            best = (0.0, 0)
            for start in (numbers * (t.window // 2)).tolist():
                held = len(np.intersect1d(values[start : start + t.window], t.shingles))
                if SHARE[1] * held >= SHARE[0] * len(t.shingles) and held / len(t.shingles) > best[0]:
                    best = (held / len(t.shingles), start)
            if best[0]:
                found.append((t.number, *best))
    return found


def matches(docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """(doc_id, template, license_id, containment, window_start): a row for each template that a document holds."""
    ready = prepared(templates)
    sizes = sorted({min(SHINGLE, t.n_words) for t in ready})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            rows = []
            for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                words = WORDS.of(normal_words(text))
                hashes = {size: window_hashes(words, size) for size in sizes}
                rows += [(doc_id, n, ready_by_number[n].license_id, share, start) for n, share, start in scan(hashes, ready)]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
            kinds = [pa.int64(), pa.int32(), pa.string(), pa.float64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "template", "license_id", "containment", "window_start"])

    ready_by_number = {t.number: t for t in ready}
    schema = "doc_id bigint, template int, license_id string, containment double, window_start bigint"
    return map_batches(docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")), run, schema)
