"""Plain Python versions of the operators, for small data."""

from __future__ import annotations

import re

import numpy as np

from dyadspark.llm import hashing

WORD = re.compile("[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def shingle_set(text, size=5):
    words = WORD.findall(lower(text))
    if not words:
        return frozenset()
    if len(words) < size:
        return frozenset([tuple(words)])
    return frozenset(tuple(words[i : i + size]) for i in range(len(words) - size + 1))


def jaccard_components(rows):
    """rows: (doc_id, text) with distinct ids -> {doc_id: (n_shingles, component_id)}, all pairs compared that share a shingle."""
    sets = {d: shingle_set(t) for d, t in rows}
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    holders = {}
    for d, s in sets.items():
        for g in s:
            holders.setdefault(g, []).append(d)
    shared = {}
    for ds in holders.values():
        for i, x in enumerate(ds):
            for y in ds[:i]:
                shared[x, y] = shared.get((x, y), 0) + 1
    for (x, y), both in shared.items():
        if 100 * both >= 75 * (len(sets[x]) + len(sets[y]) - both):
            a, b = sorted((find(x), find(y)))
            parent[b] = a
    return {d: (len(sets[d]), find(d)) for d in sets}


def units(text):
    """(normalised unit, start, end) in code points; a unit ends with its line or with a word that ends a sentence."""
    out, words, start = [], [], 0
    last_end = 0
    for m in re.finditer("[^\x20\x09-\x0D]+", text or ""):
        if words and ("\n" in text[last_end : m.start()] or words[-1][-1] in ".!?"):
            out.append((tuple(map(lower, words)), start, last_end))
            words = []
        if not words:
            start = m.start()
        words.append(m[0])
        last_end = m.end()
    if words:
        out.append((tuple(map(lower, words)), start, last_end))
    return out


def text_parts(text):
    """Words with their places, and the (first, last, key) spans compared of a text: units, whole lines, chains.

    An anchor is a word whose hash neither neighbour's is below; a chain goes from one to the first that gives it 25 words.
    """
    found = list(WORD.finditer(text or ""))
    words = [lower(m[0]) for m in found]
    breaks = [i + 1 == len(found) or "\n" in text[m.end() : found[i + 1].start()] for i, m in enumerate(found)]
    ends = [b or m[0][-1] in ".!?" for b, m in zip(breaks, found)]

    def spans(closes):
        first, out = 0, []
        for i, end in enumerate(closes):
            if end:
                out.append((first, i))
                first = i + 1
        return out

    keyed = [("unit", a, b, ("unit", *words[a : b + 1])) for a, b in spans(ends)]
    keyed += [("line", a, b, ("line", *words[a : b + 1])) for a, b in spans(breaks)]
    data = np.frombuffer((text or "").encode(), dtype=np.uint8)
    starts, stops, _ = hashing.words(data, np.array([0, len(data)]))
    hashes = hashing.span_hashes(data, starts, stops).tolist() if len(starts) else []
    anchors = [
        i for i, h in enumerate(hashes) if (not i or h <= hashes[i - 1]) and (i + 1 == len(hashes) or h <= hashes[i + 1])]
    for a in anchors:
        b = next((x for x in anchors if x >= a + 24), None)
        if b is not None:
            keyed.append(("chain", a, b, ("chain", *words[a : b + 1])))
    return found, spans(ends), keyed


def dedup_units(rows, min_words=10, edge=4):
    """rows: (doc_id, text) with distinct ids -> {doc_id: (text, removed spans)}: the rule of ``unit_dedup`` in plain Python."""
    parts = {d: text_parts(t) for d, t in rows}
    holder = {}
    for d in sorted(parts):
        for _, _, _, key in parts[d][2]:
            holder.setdefault(key, d)
    result = {}
    for d, text in rows:
        found, units, keyed = parts[d]
        covered, whole, inside, here = set(), set(), set(), set()
        for kind, a, b, key in keyed:
            short = kind == "line" and b - a + 1 < min_words
            repeated = holder[key] < d or (kind != "chain" and key in here)
            here.add(key)
            if repeated and (kind != "line" or short):
                {"unit": covered, "line": whole, "chain": inside}[kind].update(range(a, b + 1))
        gone = set(whole)
        for a, b in _stretches(covered, lambda i: 0):
            if b - a >= min_words:
                gone.update(range(a, b))
        of = {i: u for u, (a, b) in enumerate(units) for i in range(a, b + 1)}
        for a, b in _stretches(inside, of.get):
            if b - a >= edge or b - a == units[of[a]][1] - units[of[a]][0] + 1:
                gone.update(range(a, b))
        spans, kept, at = [], [], 0
        for a, b in _stretches(gone, lambda i: 0):
            start, end = found[a].start(), found[b].start() if b < len(found) else len(text)
            spans.append((start, end))
            kept.append(text[at:start])
            at = end
        result[d] = (None if text is None else "".join([*kept, text[at:]]), spans)
    return result


def _stretches(marked, group):
    """(first, after the last) of runs of consecutive marked numbers of one group."""
    out = []
    for i in sorted(marked):
        if out and out[-1][1] == i and group(i) == group(i - 1):
            out[-1][1] = i + 1
        else:
            out.append([i, i + 1])
    return out


def smith_waterman(a, b, match=2, mismatch=-1, gap=-1):
    best, row = 0, [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(max(0, row[j] + (match if x == y else mismatch), row[j + 1] + gap, new[j] + gap))
        row = new
        best = max(best, max(row))
    return best


def bench_words(text):
    return re.findall("[0-9A-Za-z\x80-\U0010ffff]+|[\x00-\x08\x0e-\x1f\x7f]+", lower(text))


def winnow(text, hashes, window):
    """(hash, position) pairs: of each window the smallest hash, of equal ones the rightmost."""
    out = []
    for i in range(max(1, len(hashes) - window + 1)) if len(hashes) else ():
        part = hashes[i : i + window]
        least = min(part)
        at = i + max(j for j, h in enumerate(part) if h == least)
        if not out or out[-1][1] != at:
            out.append((least, at))
    return out
