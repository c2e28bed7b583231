"""License scan: MinHash bands over overlapping word windows, then exact shingle containment."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from showbill.llm.common import batch_of, text_blocks
from showbill.llm.words import SHINGLE, _WORD, mixed, span_hashes

#: Minima per signature: BANDS of ROWS.
BANDS, ROWS = 32, 2
#: Share of a template's shingles that a window must hold.
CONTAINED = 0.8

#: Notices and opening words of public licenses.
TEMPLATES = {
    "MIT notice": "Released under the MIT License.",
    "MIT text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the "
        "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 text": (
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software "
        "distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND"),
    "GPL-3.0 notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL text": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation"),
    "CC-BY-NC-4.0 notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0 text": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "BSD text": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met"),
    "MPL-2.0 text": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at"),
    "ISC text": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies."),
    "Rights reserved": "All rights reserved.",
}

_U = np.uint64
_RNG = np.random.default_rng(41)
_A = _RNG.integers(0, 2**64, BANDS * ROWS, dtype=_U) | _U(1)
_B = _RNG.integers(0, 2**64, BANDS * ROWS, dtype=_U)
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def word_hashes(texts: list[bytes]):
    """(hash, text index, start, end) of all words; a word is a run of letters and digits."""
    joined = b" ".join(texts).translate(_TABLE)
    data = np.frombuffer(joined, np.uint8)
    edges = np.flatnonzero(np.diff(np.concatenate(([True], data == 32, [True])).view(np.int8)))
    starts, ends = edges[0::2], edges[1::2]
    first = np.cumsum([0, *(len(t) + 1 for t in texts)])[:-1]
    of = np.searchsorted(first, starts, "right") - 1
    return (span_hashes(data, starts, ends) if len(starts) else np.zeros(0, _U)), of, starts - first[of], ends - first[of]


def grams(hashes: np.ndarray, of: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first word) of all runs of ``size`` words within a text."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, _U), np.zeros(0, np.int64)
    at = np.flatnonzero(of[:n] == of[size - 1:])
    out = np.full(len(at), size, _U)
    for j in range(size):
        out += hashes[at + j] * _WORD[j]
    return mixed(out), at


class Template:
    """A license text as a shingle set with its bands.

    Windows of ``width`` words begin every ``step`` words, so a copy lies whole in one of
    them. The window then holds at most step + 0.2 m shingles besides the 0.8 m of the
    template's m that make a match, which bounds the similarity below.
    """

    def __init__(self, name: str, text: str):
        hashes, of, _, _ = word_hashes([text.encode()])
        self.name, self.size = name, min(SHINGLE, len(hashes))
        self.shingles = np.unique(grams(hashes, of, self.size)[0])
        self.step = max(1, len(hashes) // 4)
        self.width = len(hashes) + self.step - 1
        self.bands = bands(self.shingles)

    def miss_chance(self) -> float:
        """Greatest chance that a window that holds CONTAINED of the template shares no band."""
        m = len(self.shingles)
        hit = int(np.ceil(CONTAINED * m))
        similarity = hit / (m + self.width - self.size + 1 - hit)
        return (1 - similarity**ROWS) ** BANDS


def bands(shingles: np.ndarray) -> np.ndarray:
    least = (shingles[:, None] * _A + _B).min(axis=0)
    return mixed(least.reshape(BANDS, ROWS) @ np.array([3, 5], _U))


def found(texts: list[bytes], templates: list[Template]):
    """(text index, template name, start, end, containment) of every copy; places are byte offsets."""
    hashes, of, starts, ends = word_hashes(texts)
    if not len(hashes):
        return
    all_grams = {size: grams(hashes, of, size) for size in {t.size for t in templates}}
    for size, (codes, at) in all_grams.items():
        own = [t for t in templates if t.size == size]
        known = np.unique(np.concatenate([t.shingles for t in own]))
        place = np.minimum(np.searchsorted(known, codes), len(known) - 1)
        shared = np.flatnonzero(known[place] == codes)  # no other window can have a template's minimum
        if not len(shared):
            continue
        for t in own:
            hits = shared[np.isin(codes[shared], t.shingles)]
            if not len(hits):
                continue
            first = np.searchsorted(of, of[at[hits]])
            last = (at[hits] - first) // t.step
            # every window that holds the shingle
            reach = (t.width - size) // t.step + 1
            windows = np.unique(np.stack((np.repeat(first, reach), np.maximum(np.repeat(last, reach) - np.tile(np.arange(reach), len(hits)), 0)), axis=1), axis=0)
            spans = []
            for base, k in windows.tolist():
                begin = base + k * t.step
                a, b = np.searchsorted(at, (begin, begin + t.width - size + 1))
                b = a + int(np.searchsorted(of[at[a:b]], of[base], "right"))
                inside = np.unique(codes[a:b])
                if not len(inside) or not (bands(inside) == t.bands).any():
                    continue
                contained = len(np.intersect1d(inside, t.shingles, assume_unique=True)) / len(t.shingles)
                if contained >= CONTAINED:
                    held = at[a:b][np.isin(codes[a:b], t.shingles)]
                    spans.append((int(of[base]), int(held[0]), int(held[-1]) + size - 1, contained))
            merged: list[list] = []
            for i, a, b, contained in sorted(spans):
                if merged and merged[-1][0] == i and a <= merged[-1][2]:
                    merged[-1][2], merged[-1][3] = max(merged[-1][2], b), max(merged[-1][3], contained)
                else:
                    merged.append([i, a, b, contained])
            for i, a, b, contained in merged:
                yield i, t.name, int(starts[a]), int(ends[b]), contained


_FOUND = pa.schema([("doc_id", pa.int64()), ("license", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("containment", pa.float64())])


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """(doc_id, license, start, end, containment) of every copy of a template in a document.

    Words are runs of letters and digits, A-Z lower-cased; shingles have five words, or all
    words of a shorter template. A copy is a stretch with at least 0.8 of the template's
    shingles in a window little longer than the template; overlapping windows are one copy.
    start and end are byte offsets in the text. Windows that share no shingle with a template
    cannot share a minimum with it and get no signature. Null and empty texts have no copies;
    a null doc_id stays null, and repeated rows give repeated results. An empty table gives
    no rows; columns other than doc_id and text are not read. Nothing is shuffled.
    """
    known = [Template(n, t) for n, t in (TEMPLATES if templates is None else templates).items()]

    def run(batches):
        for rows, texts in text_blocks(batches):
            ids = rows.column(0).to_pylist()
            out = [(ids[i], *rest) for i, *rest in found(texts, known)]
            yield batch_of(_FOUND, list(zip(*out, strict=True)) if out else [[]] * len(_FOUND))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id long, license string, start long, end long, containment double")
