"""License scans: winnowed template fingerprints, an inverted index and banded alignment.

Templates are fingerprinted by winnowing: of the hashes of their ``GRAM``-word
sequences, each window of ``WINDOW`` keeps its smallest.  Every sequence of a
document is looked up in the inverted index (a bit table first, then a sorted
array); hits of one template that lie near one diagonal form a candidate, and a
banded edit alignment of the template with the words around the hits gives the
matched share of the template and the matched span.  Numbers and the words of
``TELLING`` tell versions and kin apart: those in the span must be the template's, in
order, so that no text is reported under another version's name.  Words are runs of
ASCII letters and digits and bytes beyond ASCII, ASCII letters lower-cased, so marks
between words don't matter.
"""

from __future__ import annotations

import bisect
from dataclasses import dataclass
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel

GRAM, WINDOW, BAND, COVERAGE = 3, 3, 12, 0.7
#: A long template must have a fingerprint on the diagonal for every HITS_OF words.
HITS_OF = 100
#: From so many words on a template is long: a whole text, of which cut-off and edited copies lack some telling words.
LONG = 200

_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True

# Short notices and opening grants of well-known public licenses.
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at',
    ],
    "AGPL-3.0": ["GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"],
    "Artistic-1.0": ['The "Artistic License" Preamble The intent of this document is to state the conditions under which a Package may be copied, such that the Copyright Holder maintains some semblance of artistic control over the development of the package'],
    "BSD-3-Clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Released under the BSD 3-Clause License.",
    ],
    "CC-BY-4.0": ["This work is licensed under a Creative Commons Attribution 4.0 International License.", "Licensed under CC BY 4.0."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC0-1.0": [
        "Creative Commons Legal Code CC0 1.0 Universal",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    ],
    "GFDL-1.2": ["GNU Free Documentation License Version 1.2, November 2002"],
    "GFDL-1.3": ["GNU Free Documentation License Version 1.3, 3 November 2008"],
    "GPL-1.0": [
        "GNU GENERAL PUBLIC LICENSE Version 1, February 1989",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 1, or (at your option) any later version.",
    ],
    "GPL-2.0": [
        "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ],
    "GPL-3.0": [
        "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "LGPL-2.0": [
        "GNU LIBRARY GENERAL PUBLIC LICENSE Version 2, June 1991",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Library General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ],
    "LGPL-2.1": [
        "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    ],
    "LGPL-3.0": ["GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007", "This library is licensed under the GNU Lesser General Public License, version 3."],
    "MIT": [
        "Released under the MIT License.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software',
    ],
    "MPL-1.1": ["MOZILLA PUBLIC LICENSE Version 1.1", 'The contents of this file are subject to the Mozilla Public License Version 1.1 (the "License"); you may not use this file except in compliance with the License.'],
    "MPL-2.0": ["Mozilla Public License Version 2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
}


# Words, beside numbers, that tell licenses of one family apart.
TELLING = ("affero", "documentation", "lesser", "nc", "nd", "noderivatives", "noncommercial", "sa", "sharealike")


def full_texts(folder: str, names: dict[str, str]) -> dict[str, list[str]]:
    """Whole license texts of a folder as templates: file name -> license name."""
    return {name: [Path(folder, file).read_text(encoding="utf-8", errors="replace")] for file, name in names.items()}


def _telling(low: np.ndarray, words: kernel.Words, hashes: np.ndarray) -> np.ndarray:
    """Which words hold a digit or are in TELLING."""
    digits = np.concatenate([[0], np.cumsum((low >= 48) & (low <= 57))])
    return (digits[words.end] > digits[words.start]) | np.isin(hashes, _TOLD)


def _words(text: bytes) -> tuple[np.ndarray, kernel.Words]:
    buf = kernel.lower_ascii(np.frombuffer(text, np.uint8))
    words = kernel.split_words(buf, np.array([0, len(buf)]), _WORD)
    return kernel.word_hashes(buf, words), words


_TOLD = np.array([_words(w.encode())[0][0] for w in TELLING])


@dataclass
class Index:
    names: list[str]  # of each template
    words: list[np.ndarray]
    told: list[np.ndarray]  # those that tell versions apart
    keys: np.ndarray  # sorted fingerprints, with where they stand
    template: np.ndarray
    place: np.ndarray
    bits: np.ndarray


def build(templates: dict[str, list[str]] | None = None) -> Index:
    """Index of the templates; those of fewer than GRAM words are left out."""
    names, words, told, found = [], [], [], []
    for name, texts in (TEMPLATES if templates is None else templates).items():
        for text in texts:
            low = kernel.lower_ascii(np.frombuffer(text.encode(), np.uint8))
            h, w = _words(text.encode())
            if len(h) < GRAM:
                continue
            at = np.arange(len(h) - GRAM + 1)
            g = kernel.Grams(h).between(at, at + GRAM)
            # the first and last stay, so that cut-off copies are found as well
            keep = {0, len(g) - 1} | {int(i + g[i : i + WINDOW].argmin()) for i in range(max(1, len(g) - WINDOW + 1))}
            found += [(g[i], len(names), i) for i in sorted(keep)]
            names.append(name)
            words.append(h)
            told.append(h[_telling(low, w, h)])
    keys = np.array([k for k, _, _ in found], np.uint64)
    order = np.argsort(keys, kind="stable")
    bits = np.zeros(1 << 16, bool)
    bits[(keys & np.uint64(0xFFFF)).astype(np.int64)] = True
    return Index(names, words, told, keys[order], np.array([t for _, t, _ in found], np.int64)[order], np.array([p for _, _, p in found], np.int64)[order], bits)


def align(template: np.ndarray, words: np.ndarray, lo: int, hi: int, shift: int) -> tuple[int, int]:
    """Banded alignment of all of the template with part of words[lo:hi]: first matched word and last + 1, or -1, -1.

    Column j of row i is word shift + i + j - BAND; ends of the document part are free.
    """
    size = 2 * BAND + 1
    least = -1 << 30
    prev = [(0, -1, -1)] * size  # score, first match, end of last match
    for i in range(len(template)):
        row = []
        for j in range(size):
            w = shift + i + j - BAND
            up = prev[j + 1] if j + 1 < size else (least, -1, -1)
            best = (up[0] - 1, up[1], up[2])
            diagonal = prev[j]
            if lo <= w < hi and words[w] == template[i]:
                got = (diagonal[0] + 2, diagonal[1] if diagonal[1] >= 0 else w, w + 1)
            else:
                got = (diagonal[0] - 1, diagonal[1], diagonal[2])
            best = max(best, got)
            if row:
                left = row[-1]
                best = max(best, (left[0] - (1 if left[1] >= 0 else 0), left[1], left[2]))
            row.append(best)
        prev = row
    return max(prev)[1:]


def coverage(template: np.ndarray, words: np.ndarray, first: int, end: int) -> float:
    """Share of the template's words that stand in words[first:end] in the same order."""
    known: dict[int, int] = {}
    for i, h in enumerate(template.tolist()):
        known[h] = known.get(h, 0) | 1 << i
    full = (1 << len(template)) - 1
    v = full
    for h in words[first:end].tolist():  # bit-parallel longest common subsequence
        u = v & known.get(h, 0)
        v = ((v + u) | (v - u)) & full
    return (len(template) - v.bit_count()) / len(template)


def _tells(mine: np.ndarray, told: np.ndarray, words: int) -> bool:
    """Whether the telling words of a span are those of a template of so many words, in order and none beside; a long one may lack half."""
    if len(mine) < (len(told) if words < LONG else len(told) / 2):
        return False
    rest = iter(told.tolist())
    return all(w in rest for w in mine.tolist())


def find(index: Index, buf: np.ndarray, offs: np.ndarray, least: float = COVERAGE) -> list[tuple[int, str, int, int, float]]:
    """(document, license, first character, end, coverage) of the matches in a block.

    Of overlapping matches the one of most matched words stays.
    """
    low = kernel.lower_ascii(buf)
    words = kernel.split_words(low, offs, _WORD)
    h = kernel.word_hashes(low, words)
    at, _ = kernel.gram_starts(words.first, GRAM)
    if not len(at) or not len(index.keys):
        return []
    g = kernel.Grams(h).between(at, at + GRAM)
    hit = np.flatnonzero(index.bits[(g & np.uint64(0xFFFF)).astype(np.int64)])
    lo, hi = np.searchsorted(index.keys, g[hit], "left"), np.searchsorted(index.keys, g[hit], "right")
    hit, lo, hi = hit[hi > lo], lo[hi > lo], hi[hi > lo]
    if not len(hit):
        return []
    n = hi - lo
    e = np.arange(n.sum()) + np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n)
    w = at[np.repeat(hit, n)]
    doc = np.searchsorted(words.first, w, "right") - 1
    shift = w - index.place[e]
    order = np.lexsort((shift, index.template[e], doc))
    candidates, last = [], None
    for k in order:
        key = (int(doc[k]), int(index.template[e[k]]))
        if last and last[0] == key and shift[k] - last[1] <= BAND // 2:
            candidates[-1][3] += 1
            continue
        last = (key, int(shift[k]))
        candidates.append([*key, int(shift[k]), 1])
    told = _telling(low, words, h)
    chars, found = kernel.char_offsets(buf), {}
    for d, t, s, hits in candidates:
        if hits < len(index.words[t]) // HITS_OF:
            continue
        first, end = align(index.words[t], h, int(words.first[d]), int(words.first[d + 1]), s)
        if first < 0:
            continue
        if not _tells(h[first:end][told[first:end]], index.told[t], len(index.words[t])):
            continue
        c = coverage(index.words[t], h, first, end)
        if c >= least:
            found.setdefault(d, []).append((round(c * len(index.words[t])), c, first, end, index.names[t]))
    out = []
    for d, spans in sorted(found.items()):
        taken: list[tuple[int, int]] = []
        for _, c, first, end, name in sorted(spans, key=lambda x: (-x[0], -x[1], x[2], x[4])):
            k = bisect.bisect(taken, (first, end))
            if (not k or taken[k - 1][1] <= first) and (k == len(taken) or taken[k][0] >= end):
                taken.insert(k, (first, end))
                base = chars[offs[d]]
                out.append((d, name, int(chars[words.start[first]] - base), int(chars[words.end[end - 1]] - base), round(c, 4)))
    return sorted(out)


def scan(docs: DataFrame, templates: dict[str, list[str]] | None = None, least: float = COVERAGE) -> DataFrame:
    """One row per license text in a document: doc_id, license, span_start, span_end (code points), coverage.

    Null and empty texts have no rows, nor have texts without a match.  Repeated
    rows give repeated results, a null doc_id is passed through, other columns are
    ignored; no templates, no rows.
    """
    index = build(templates)  # ties of matched words go to the greater coverage, then the earlier span, then by name; an empty table has no rows

    def run(batches):
        import pyarrow as pa

        schema = pa.schema([("doc_id", pa.int64()), ("license", pa.string()), ("span_start", pa.int64()), ("span_end", pa.int64()), ("coverage", pa.float64())])
        for batch in batches:
            ids = batch.column("doc_id")
            for b in kernel.blocks(batch.column("text")):
                rows = [(ids[b.lo + d].as_py(), *x) for d, *x in find(index, b.buf, b.offs, least)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, license string, span_start long, span_end long, coverage double")
