"""License scans: MinHash over overlapping windows retrieves templates, exact shingle containment verifies them.

Texts and templates are read as shingles of ``SHINGLE`` words (white space and ASCII punctuation part words, A-Z lowered). For a
template of t shingles, windows have the smallest power of two of shingles that holds t and one stride, the stride being a
quarter of the window; some window then holds a whole occurrence. A window retrieves a template if any of ``BANDS`` MinHash values
(bands of one row) agrees. A window that holds a share c of a template's t shingles among W has similarity s of at least
c t / (W + (1 - c) t), and is retrieved with probability 1 - (1 - s)**BANDS: with c = 0.75 and the largest W / t (8 / 3 for t = 12,
13, ...) that is over 0.9999.

A document with a retrieved window is searched whole for that template: a match is a stretch of 1.25 t shingles that holds at
least ``threshold`` of the template's distinct shingles; matches of a template do not overlap. Each document is scanned in its own task against
a fixed list of templates, so nothing is shuffled.

Null and empty texts match nothing; a template of fewer than ``SHINGLE`` words is never found; repeated rows repeat their matches;
columns other than doc_id and text are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from dyadspark.llm.hashing import PUNCTUATION, mix, span_hashes, text_slices, windows, words

SHINGLE = 5
BANDS = 40

# The wording of public licence notices, (license, template, text).
TEMPLATES = [
    ("MIT", "mit-line", "Released under the MIT License."),
    ("Apache-2.0", "apache-line", "Licensed under the Apache License, Version 2.0."),
    ("CC-BY-NC-4.0", "cc-by-nc-line", "Licensed under CC BY-NC 4.0."),
    ("GPL-3.0", "gpl-line", "This work is licensed under the GNU General Public License, version 3."),
    ("MIT", "mit-grant", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
     "associated documentation files (the \"Software\"), to deal in the Software without restriction, including without "
     "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, "
     "and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("Apache-2.0", "apache-header", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file "
     "except in compliance with the License. You may obtain a copy of the License at"),
    ("GPL-3.0", "gpl-header", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
     "General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
     "option) any later version."),
    ("BSD", "bsd-conditions", "Redistribution and use in source and binary forms, with or without modification, are permitted "
     "provided that the following conditions are met:"),
    ("ISC", "isc-grant", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
     "hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MPL-2.0", "mpl-header", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of "
     "the MPL was not distributed with this file, You can obtain one at"),
]


class Shingles:
    """Shingles of a slice: hash, row, and the byte span of each."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        starts, ends, rows = words(data, offsets, PUNCTUATION)
        n = max(0, len(rows) - SHINGLE + 1)
        inside = rows[:n] == rows[SHINGLE - 1 :] if n else np.zeros(0, dtype=bool)
        hashes = windows(span_hashes(data, starts, ends), SHINGLE) if n else np.zeros(0, dtype=np.uint64)
        self.hash, self.row = hashes[inside], rows[:n][inside]
        self.start, self.end = starts[:n][inside], ends[SHINGLE - 1 :][inside] if n else ends[:0]


def minhash(hashes: np.ndarray, band: int) -> np.ndarray:
    """The band's hash of each shingle."""
    return (mix(hashes ^ mix(np.array([band + 1], dtype=np.uint64))) >> np.uint64(32)).astype(np.uint32)


class Template:
    def __init__(self, license_: str, name: str, text: str):
        raw = np.frombuffer(text.encode("utf-8"), dtype=np.uint8)
        self.license, self.name = license_, name
        self.shingles = np.unique(Shingles(raw, np.array([0, len(raw)])).hash)
        t = len(self.shingles)
        self.window = 1
        while self.window < t + max(1, self.window // 4) - (self.window < 4):
            self.window *= 2
        self.bands = [int(minhash(self.shingles, b).min()) if t else -1 for b in range(BANDS)]


def retrieved(s: Shingles, templates: list[Template]) -> set[tuple[int, int]]:
    """(row, template) pairs with a window that agrees in some band."""
    found: set[tuple[int, int]] = set()
    n = len(s.hash)
    by_window: dict[int, list[int]] = {}
    for i, t in enumerate(templates):
        if len(t.shingles):
            by_window.setdefault(t.window, []).append(i)
    if not n or not by_window:
        return found
    for band in range(BANDS):
        low, width = minhash(s.hash, band), 1
        while True:
            for i in by_window.get(width, ()):
                step = max(1, width // 4)
                for at in (np.flatnonzero(low[::step] == templates[i].bands[band]) * step).tolist():
                    # the window may reach over rows: each of them is searched
                    found.update((int(r), i) for r in range(s.row[at], s.row[min(at + width, n) - 1] + 1))
            if width >= max(by_window):
                break
            if width < n:
                low = np.concatenate([np.minimum(low[: n - width], low[width:]), low[n - width :]])
            width *= 2
    return found


def occurrences(hashes: np.ndarray, template: np.ndarray, threshold: float) -> list[tuple[int, int, float]]:
    """(first, last, containment) of the template's matches in one document's shingles, from left to right."""
    which = np.minimum(np.searchsorted(template, hashes), len(template) - 1)
    at = np.flatnonzero(template[which] == hashes)
    which, at = which[at].tolist(), at.tolist()
    reach, need = len(template) + len(template) // 4, threshold * len(template)
    out, i = [], 0
    while i < len(at):
        seen, j, last = set(), i, i
        while j < len(at) and at[j] < at[i] + reach:
            if which[j] not in seen:
                seen.add(which[j])
                last = j
            j += 1
        if len(seen) >= need:
            out.append((at[i], at[last], len(seen) / len(template)))
            i = last
        i += 1
    return out


def scan(docs: DataFrame, templates: list[tuple[str, str, str]] = TEMPLATES, threshold: float = 0.75) -> DataFrame:
    """doc_id, license, template, containment, start, end (code points) of all matches in ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [Template(*t) for t in templates]
        for batch in batches:
            for first, data, offsets in text_slices(batch.column("text")):
                s = Shingles(data, offsets)
                pairs = sorted(retrieved(s, own))
                if not pairs:
                    continue
                edges = np.searchsorted(s.row, np.arange(len(offsets)))
                rows = []
                for r, i in pairs:
                    t, a = own[i], edges[r]
                    for left, right, share in occurrences(s.hash[a : edges[r + 1]], t.shingles, threshold):
                        row = data[offsets[r] : offsets[r + 1]]
                        chars = np.concatenate([[0], np.cumsum((row & 0xC0) != 0x80)])
                        span = [int(chars[x - offsets[r]]) for x in (s.start[a + left], s.end[a + right])]
                        rows.append((first + r, t.license, t.name, share, *span))
                if rows:
                    at, license_, name, share, start, end = zip(*rows)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("doc_id").take(pa.array(at)), pa.array(license_), pa.array(name), pa.array(share),
                         pa.array(start, pa.int32()), pa.array(end, pa.int32())],
                        names=["doc_id", "license", "template", "containment", "start", "end"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, license string, template string, containment double, start int, end int")
