"""License scans by patience alignment.

Words are lower-cased runs of letters and digits. A template may be stretched by foreign words to `stretch` times its
length; a region of that many words is aligned wherever one of the words that a covered template can begin with is followed
in it by enough of the others (a lossless bound). In the alignment words unique in both texts are anchors, the longest
increasing subsequence of their places is kept, and the gaps between anchors are aligned in the same way; equal words at the
ends of a gap are taken first, and a gap without anchors is aligned by its longest common subsequence. Coverage is the share
of a template's words that are aligned. Of the places of one template the first that ends is taken, at its latest beginning;
the next begins after it. Where places of several templates share a word, the one with the most aligned words stays (ties:
higher coverage, earlier place, name), so a notice that contains another's words counts as itself alone.

Defined cases: null and blank texts and empty tables match nothing; a template without words is ignored; equal rows give equal
rows; other columns are not read, whatever their names; very long texts are searched as a whole, region by region.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm.words import BREAK, binary_list, chunks, words_of

#: Short forms of widely used public license notices.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "MIT": "Released under the MIT License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
    "MIT-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the software without restriction.",
    "All-rights-reserved": "All rights reserved. No part of this publication may be reproduced without prior written permission.",
}


def _common(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Places of a longest common subsequence."""
    length = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        own, below = length[i], length[i + 1]
        for k in range(len(b) - 1, -1, -1):
            own[k] = below[k + 1] + 1 if a[i] == b[k] else max(below[k], own[k + 1])
    i, k, out = 0, 0, []
    while i < len(a) and k < len(b):
        if a[i] == b[k]:
            out.append((i, k))
            i, k = i + 1, k + 1
        elif length[i + 1][k] >= length[i][k + 1]:
            i += 1
        else:
            k += 1
    return out


def aligned(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Places (in a, in b) of the words of `a` aligned in order with equal words of `b`."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        i, j, k, m = todo.pop()
        while i < j and k < m and a[i] == b[k]:
            out.append((i, k))
            i, k = i + 1, k + 1
        while i < j and k < m and a[j - 1] == b[m - 1]:
            j, m = j - 1, m - 1
            out.append((j, m))
        if i >= j or k >= m:
            continue
        once: dict[int, list[int]] = {}
        for side, text, lo, hi in ((0, a, i, j), (1, b, k, m)):
            for x in range(lo, hi):
                own = once.setdefault(text[x], [0, 0, -1, -1])
                own[side] += 1
                own[2 + side] = x
        anchors = sorted((x, y) for n, p, x, y in once.values() if n == p == 1)
        if not anchors:
            if any(n and p for n, p, _, _ in once.values()):
                out += [(i + x, k + y) for x, y in _common(a[i:j], b[k:m])]
            continue
        tails: list[int] = []
        back: list[int] = []
        at: list[int] = []
        for q, (_, y) in enumerate(anchors):
            p = bisect_left(tails, y)
            if p == len(tails):
                tails.append(y)
                at.append(q)
            else:
                tails[p], at[p] = y, q
            back.append(at[p - 1] if p else -1)
        q = at[-1]
        while q >= 0:  # from the end
            x, y = anchors[q]
            out.append((x, y))
            todo.append((x + 1, j, y + 1, m))
            j, m, q = x, y, back[q]
        todo.append((i, j, k, m))
    return sorted(out)


def patience(a: list[int], b: list[int]) -> int:
    """Number of words of `a` aligned in order with equal words of `b`."""
    return len(aligned(a, b))


def _starts(hash_: np.ndarray, limit: np.ndarray, own: np.ndarray, need: int, width: int) -> np.ndarray:
    """Words from which `width` words (before the place `limit` of each) can hold `need` words of a template in order."""
    start = np.flatnonzero(np.isin(hash_, own[: len(own) - need + 1]))
    if not len(start):
        return start
    end = np.minimum(start + width, limit[start])
    word, times = np.unique(own, return_counts=True)
    held = np.zeros(len(start), np.int64)
    for w, n in zip(word, times.tolist(), strict=True):
        place = np.flatnonzero(hash_ == w)
        held += np.minimum(np.searchsorted(place, end) - np.searchsorted(place, start), n)
    return start[held >= need]


def _places(hash_: np.ndarray, limit: np.ndarray, own: np.ndarray, least: float, stretch: int):
    """(first word, last word, aligned words) of a template's places, which share no word."""
    need, width, words = int(np.ceil(least * len(own) - 1e-9)), stretch * len(own), own.tolist()
    start = _starts(hash_, limit, own, max(need, 1), width)
    free = 0
    for n, s in enumerate(start.tolist()):
        if s < free:
            continue
        pairs = aligned(words, hash_[s:min(s + width, int(limit[s]))].tolist())
        if len(pairs) < max(need, 1):
            continue
        first, free = s + pairs[0][1], s + pairs[-1][1] + 1
        for later in start[n + 1:np.searchsorted(start, free)].tolist():
            closer = aligned(words, hash_[later:free].tolist())
            if len(closer) >= len(pairs):
                pairs, first = closer, later + closer[0][1]
        yield first, free - 1, len(pairs)


def _scan(templates: dict[str, str], least: float, stretch: int):
    names = sorted(templates)
    words = [words_of([templates[n].encode()], lower=True, space=BREAK).hash for n in names]
    vocabulary = np.unique(np.concatenate([np.zeros(0, np.uint64), *words]))

    def run(batches):
        for batch in batches:
            texts = binary_list(batch.column(1))
            row, name, coverage, first, last = [], [], [], [], []
            for lo, hi in chunks(texts):
                found = words_of(texts[lo:hi], lower=True, space=BREAK)
                limit = found.first[1:][found.doc]
                by_doc: dict[int, list[tuple]] = {}
                present = vocabulary[np.isin(vocabulary, found.hash)]
                for t, own in zip(names, words, strict=True):
                    if np.isin(own, present).sum() < max(1, np.ceil(least * len(own) - 1e-9)):
                        continue
                    for s, e, n in _places(found.hash, limit, own, least, stretch):
                        by_doc.setdefault(int(found.doc[s]), []).append((-n, -n / len(own), s, e, t))
                for d, places in sorted(by_doc.items()):
                    kept: list[tuple] = []
                    for place in sorted(places):
                        at = bisect_left(kept, place[2], key=lambda x: x[3])  # the first kept place that ends here or later
                        if at == len(kept) or kept[at][2] > place[3]:
                            kept.insert(at, place)
                    for _, share, s, e, t in kept:
                        row.append(lo + d)
                        name.append(t)
                        coverage.append(-share)
                        first.append(s - int(found.first[d]))
                        last.append(e - int(found.first[d]))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), pa.array(name, pa.string()), pa.array(coverage, pa.float64()),
                                              pa.array(first, pa.int64()), pa.array(last, pa.int64())], names=["id", "license", "coverage", "first_word", "last_word"])

    return run


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None, least: float = 0.9,
         stretch: int = 4) -> DataFrame:
    """(id, license, coverage, first_word, last_word) for every place where a template is covered by at least `least`."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(_scan(templates or TEMPLATES, least, stretch), f"id {kind}, license string, coverage double, first_word bigint, last_word bigint")
