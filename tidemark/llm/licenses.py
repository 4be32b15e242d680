"""License scans: MinHash bands retrieve templates, exact containment verifies.

Texts and templates become word shingles. Templates are sorted by their number of
shingles into classes; for each class a text is cut into blocks of the class's
size, and every two neighbouring blocks make a window, so that an occurrence of a
template lies whole in one of the overlapping windows. A window retrieves a
template if they agree in one band of their MinHash signatures. Bands have one
row; their number follows from the least likeness a window with enough of the
template can have, so that the chance to miss it is below `MISS`. What is
retrieved is verified with the shingles themselves: the window must contain
`CONTAINMENT` of the template's.

Words are letters and digits, lower-case, digits read as one sign, so versions and
years don't matter. Null texts and texts shorter than a shingle have no matches.
Matches of one template that overlap count once, the best first.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import xxhash
from pyspark.sql import DataFrame

from tidemark.llm.common import row_map

SHINGLE, CONTAINMENT, MISS = 5, 0.8, 1e-3
#: Shingles of a text handled at once; a multiple of every block.
PART, NONE = 8_192, np.uint64(0xFFFFFFFFFFFFFFFF)
MEMO = 400_000
#: Opening notices and key paragraphs of public licenses.
TEMPLATES = {
    "MIT": "Released under the MIT License.",
    "MIT licensed": "This project is licensed under the MIT License.",
    "MIT grant": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in
the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software""",
    "MIT warranty": """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A
PARTICULAR PURPOSE AND NONINFRINGEMENT.""",
    "Apache": "Licensed under the Apache License, Version 2.0.",
    "Apache header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the
License at""",
    "Apache warranty": """Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR
CONDITIONS OF ANY KIND, either express or implied.""",
    "GPL": "This work is licensed under the GNU General Public License, version 3.",
    "GPL header": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software
Foundation, either version 3 of the License, or (at your option) any later version.""",
    "LGPL": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License",
    "AGPL": "under the terms of the GNU Affero General Public License",
    "BSD": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met""",
    "BSD licensed": "Use of this source code is governed by a BSD-style license",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "MPL": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "CC BY-NC": "Licensed under CC BY-NC 4.0.",
    "CC BY-SA": "Licensed under CC BY-SA 4.0.",
    "CC BY-ND": "Licensed under CC BY-ND 4.0.",
    "CC BY": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}
_SPLIT, _DIGITS = re.compile(r"[^\w]+|_"), re.compile(r"\d+")
_MULTIPLY = (np.random.default_rng(5).integers(1, 1 << 62, 256, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_ADD = np.random.default_rng(6).integers(0, 1 << 62, 256, dtype=np.uint64)


def parts_of(token: str) -> list[str]:
    """Words of a blank-separated token."""
    return [_DIGITS.sub("0", w) for w in _SPLIT.split(token.lower()) if w]


def shingle_hashes(words: np.ndarray) -> np.ndarray:
    """Hashes of all shingles, from the hashes of the words."""
    n = len(words) - SHINGLE + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(SHINGLE):
        out = out * np.uint64(0x9E3779B97F4A7C15) + words[k:k + n]
        out ^= out >> np.uint64(29)
    return out


def word_hash(word: str) -> int:
    return xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"), 9)


def bands_for(least: float) -> int:
    """Number of one-row bands so that windows this alike collide with probability 1 - MISS."""
    return math.ceil(math.log(MISS) / math.log(1 - least)) if least < 1 else 1


@dataclass
class _Class:
    block: int
    bands: int
    names: list[str]
    signatures: np.ndarray  # template x band
    sieve: np.ndarray  # band x 65536: some template has a signature with these low bits


class Scanner:
    def __init__(self, templates: dict[str, str]) -> None:
        self.words = {name: [w for t in text.split() for w in parts_of(t)] for name, text in templates.items()}
        self.shingles = {name: {tuple(w[i:i + SHINGLE]) for i in range(len(w) - SHINGLE + 1)} for name, w in self.words.items()}
        self.memo: dict[str, bytes] = {}
        by_block: dict[int, list[str]] = {}
        for name, shingles in self.shingles.items():
            if shingles:
                by_block.setdefault(1 << (len(shingles) - 1).bit_length(), []).append(name)
        self.classes = []
        for block, names in sorted(by_block.items()):
            # The least likeness of a window of two blocks that contains enough of the smallest template.
            size = min(len(self.shingles[n]) for n in names)
            shared = math.ceil(CONTAINMENT * size)
            bands = bands_for(shared / (2 * block + size - shared))
            hashes = [shingle_hashes(np.array([word_hash(w) for w in self.words[n]], np.uint64)) for n in names]
            signatures = np.array([self.permuted(h, bands).min(0) for h in hashes], np.uint64)
            sieve = np.zeros((bands, 1 << 16), bool)
            for k in range(bands):
                sieve[k, (signatures[:, k] & np.uint64(0xFFFF)).astype(np.int64)] = True
            self.classes.append(_Class(block, bands, names, signatures, sieve))
        self.bands = max((c.bands for c in self.classes), default=0)

    @staticmethod
    def permuted(hashes: np.ndarray, bands: int) -> np.ndarray:
        """The hashes under each band's permutation: shingle x band."""
        return (hashes[:, None] * _MULTIPLY[:bands] + _ADD[:bands]) >> np.uint64(16)

    def _token(self, token: str) -> bytes:
        """Hashes of the words of a blank-separated token."""
        made = np.array([word_hash(w) for w in parts_of(token)], np.uint64).tobytes()
        if len(self.memo) < MEMO and len(token) < 64:
            self.memo[token] = made
        return made

    def scan(self, text: str | None) -> list[tuple[str, int, int, float]]:
        """(template, first word, end word, containment) of each verified match."""
        tokens = (text or "").split()
        packed = list(map(self.memo.get, tokens))
        if None in packed:
            packed = [self._token(t) if x is None else x for t, x in zip(tokens, packed)]
        hashes = shingle_hashes(np.frombuffer(b"".join(packed), np.uint64))
        found: dict[tuple[str, int], tuple[int, int, float]] = {}
        words: list[str] = []
        for name, first, size in self._candidates(hashes):
            if (name, first) not in found:
                words = words or [w for t in tokens for w in parts_of(t)]
                found[name, first] = self._verify(name, words, first, size)
        matches = sorted(((name, *span) for (name, _), span in found.items() if span[2] >= CONTAINMENT), key=lambda m: (-m[3], m[1], m[0]))
        kept: list[tuple[str, int, int, float]] = []
        for m in matches:
            if not any(m[0] == k[0] and m[1] < k[2] and k[1] < m[2] for k in kept):
                kept.append(m)
        return sorted(kept, key=lambda m: (m[1], m[0]))

    def _candidates(self, hashes: np.ndarray) -> Iterator[tuple[str, int, int]]:
        """Templates retrieved by the windows: (name, first shingle, shingles). Long texts go in overlapping parts."""
        largest = self.classes[-1].block if self.classes else 1
        for at in range(0, len(hashes), PART):
            part = hashes[at:at + PART + 2 * largest]
            least = self.permuted(part, self.bands)
            block = 1
            for c in self.classes:
                while block < c.block:  # blocks of twice the size from pairs of blocks
                    if len(least) % 2:
                        least = np.vstack([least, np.full((1, self.bands), NONE)])
                    least = np.minimum(least[0::2], least[1::2])
                    block *= 2
                own = least[:, :c.bands]
                window = np.minimum(own[:-1], own[1:]) if len(own) > 1 else own
                hits = c.sieve.ravel()[(window & np.uint64(0xFFFF)).astype(np.int64) + np.arange(c.bands) * 65536]
                if hits.any():
                    for w, band in zip(*np.nonzero(hits)):
                        for t in np.flatnonzero(c.signatures[:, band] == window[w, band]):
                            yield c.names[t], at + int(w) * c.block, 2 * c.block

    def _verify(self, name: str, words: list[str], first: int, size: int) -> tuple[int, int, float]:
        """Exact share of the template's shingles inside the window, and the words they span."""
        words = words[first:first + size + SHINGLE - 1]
        own = self.shingles[name]
        hits = [(i, s) for i in range(len(words) - SHINGLE + 1) if (s := tuple(words[i:i + SHINGLE])) in own]
        if not hits:
            return first, first, 0.0
        return first + hits[0][0], first + hits[-1][0] + SHINGLE, len({s for _, s in hits}) / len(own)


def scan(documents: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """(doc_id, license, first_word, end_word, containment): one row per match."""
    given = dict(TEMPLATES if templates is None else templates)
    state: dict = {}

    def run(columns):
        if not state:
            state["scanner"] = Scanner(given)
        rows = [(doc, *m) for doc, text in zip(columns["doc_id"], columns["text"]) for m in state["scanner"].scan(text)]
        names = ("doc_id", "license", "first_word", "end_word", "containment")
        return {n: [r[i] for r in rows] for i, n in enumerate(names)}

    kind = documents.schema["doc_id"].dataType.simpleString()
    return row_map(documents.select("doc_id", "text"), run, f"doc_id {kind}, license string, first_word bigint, end_word bigint, containment double")
