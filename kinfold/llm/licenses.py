"""License scans: MinHash bands over overlapping windows, then exact shingle containment.

A text is cut into overlapping windows, for each size of template windows of a fitting size: the
smallest power of two that is twice the template or more, half of it apart, so every copy of the
template lies whole in one of them. A window that holds the template has at least a fifth of its
shingles in common with it; with one row a band, each of ``BANDS`` bands then collides with that
chance, and all fail with a chance of about one in a million. What collides is verified by exact
containment of the template's shingles.

Windows without any shingle of any template cannot collide and are not hashed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from kinfold.llm.shingles import groups, mix, rolled_hashes, word_hashes

SHINGLE_WORDS = 2
BANDS = 64
LEAST_CONTAINMENT = 0.8
# Templates that one broadcast holds; more are an error, to be scanned in several passes.
MOST_TEMPLATES = 10_000

# Wordings of well-known licences.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)

# Words are runs of ASCII letters and digits: punctuation and line breaks do not matter.
_LETTERS = np.zeros(256, bool)
_LETTERS[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
_SEEDS = mix(np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def window_words(template_words: int) -> int:
    """Words of the windows in which a template is looked for."""
    return 1 << (2 * template_words - 1).bit_length()


def signature(shingles: np.ndarray) -> np.ndarray:
    """The smallest hash of the shingles under each band's function."""
    return mix(shingles[:, None] ^ _SEEDS[None, :]).min(0)


class Library:
    """Hashed templates: by window size, their shingle sets and signatures."""

    def __init__(self, templates: tuple[tuple[str, str], ...]):
        if len(templates) > MOST_TEMPLATES:
            raise ValueError(f"at most {MOST_TEMPLATES} templates a pass")
        self.sizes: dict[int, list[tuple[str, np.ndarray]]] = {}
        for name, text in templates:
            words, _ = word_hashes([text], _LETTERS)
            if len(words) < SHINGLE_WORDS:
                raise ValueError(f"template {name} has fewer than {SHINGLE_WORDS} words")
            shingles = np.unique(rolled_hashes(words, SHINGLE_WORDS))
            self.sizes.setdefault(window_words(len(words)), []).append((name, shingles))
        self.signatures = {w: np.array([signature(s) for _, s in found]) for w, found in self.sizes.items()}
        self.every = np.unique(np.concatenate([s for found in self.sizes.values() for _, s in found] or [np.zeros(0, np.uint64)]))

    def scan(self, texts: list[str | None]) -> Iterator[tuple[int, str, float, int]]:
        """(text, license, containment, first word of the window) of every verified window."""
        words, bounds = word_hashes(texts, _LETTERS)
        shingles = rolled_hashes(words, SHINGLE_WORDS)
        if not len(self.every) or not len(shingles):
            return
        at = np.searchsorted(self.every, shingles).clip(max=len(self.every) - 1)
        hits = np.flatnonzero(self.every[at] == shingles)
        text = np.searchsorted(bounds, hits, "right") - 1
        inside = hits + SHINGLE_WORDS <= bounds[text + 1]
        hits, text = hits[inside], text[inside]
        for size, found in self.sizes.items():
            number = (hits - bounds[text]) // (size // 2)
            spots = np.unique(np.stack([np.tile(text, 2), np.concatenate([number, number - 1])]), axis=1)
            for owner, window in spots[:, spots[1] >= 0].T.tolist():
                begin = bounds[owner] + window * (size // 2)
                end = min(begin + size, bounds[owner + 1]) - SHINGLE_WORDS + 1
                held = np.unique(shingles[begin:end])
                if not len(held):
                    continue
                collides = (self.signatures[size] == signature(held)[None, :]).any(1)
                for k in np.flatnonzero(collides):
                    name, wanted = found[k]
                    share = len(np.intersect1d(held, wanted, assume_unique=True)) / len(wanted)
                    if share >= LEAST_CONTAINMENT:
                        yield owner, name, share, window * (size // 2)


def scan_licenses(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", templates: tuple[tuple[str, str], ...] = TEMPLATES
) -> DataFrame:
    """(doc_id, license, containment, first_word): a row for each license found in a row of ``docs``.

    ``containment`` is the best share of a template's two-word shingles held by one window,
    ``first_word`` the start of the first window that verifies. Null, empty and other texts without
    a license give no row; repeated rows give a row each; whole texts are scanned. Templates are
    few by contract (``MOST_TEMPLATES``) and go to every task; documents are neither moved nor
    joined.
    """
    id_type = docs.schema[doc_id].dataType.simpleString()
    templates = tuple(templates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = Library(templates)
        for batch in batches:
            found: dict[tuple[int, str], tuple[float, int]] = {}
            base = 0
            for group in groups(v.as_py() for v in batch.column(1)):
                for row, name, share, first in library.scan(group):
                    best, start = found.get((base + row, name), (0.0, first))
                    found[base + row, name] = max(best, share), min(start, first)
                base += len(group)
            rows = [row for row, _ in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), pa.array([n for _, n in found], pa.string()),
                 pa.array([s for s, _ in found.values()], pa.float64()), pa.array([f for _, f in found.values()], pa.int64())],
                ["doc_id", "license", "containment", "first_word"],
            )

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        run, f"doc_id {id_type}, license string, containment double, first_word long"
    )
