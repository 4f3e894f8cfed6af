"""License scans: MinHash bands over overlapping text windows find templates, exact containment decides.

Texts and templates are words in lower case without marks, in shingles of five words. For every class of
template lengths a text is read through windows a quarter longer than the class's longest template, in
steps of a quarter of the shortest, so that a whole copy lies in some window whose Jaccard similarity to
it is above 0.5 when it matches in four of five shingles. With 2 rows in each of 24 bands such a window
meets its template in some band with probability 1 - (1 - 0.25) ** 24 > 0.998, at 0.7 above 1 - 1e-6.
A window without any template shingle has similarity 0 and needs no signature. A template is found
where a retrieved window holds at least ``CONTAINMENT`` of its shingles, counted exactly.

Templates are a parameter, a short list that is broadcast; those of fewer than five words are one
shingle. Null, empty and unmatched texts give no rows; repeated rows give repeated results; an empty
table gives no rows; other columns are ignored. Ties between windows go to the first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cadastre.llm.text import frugal, in_chunks, plain_words, shingles_of, whole_text, word_hashes

SHINGLE = 5
CONTAINMENT = 0.8
BANDS, ROWS = 24, 2
#: lengths of templates in one class differ at most by this factor
CLASS = 1.3
#: bits of the table that tells shingles of templates
BITS = 1 << 20

# fixed values: wording of public license notices
TEMPLATES = {
    "GPL-3.0 notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0 notice": "Licensed under CC BY-NC 4.0.",
    "MIT notice": "Released under the MIT License.",
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 header": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "MIT permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so",
    "ISC permission": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "BSD conditions": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "GPL header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "MPL-2.0 header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}

_ODD = np.random.default_rng(7).integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)


def signature(shingles: np.ndarray) -> np.ndarray:
    """One hash for each band of ``ROWS`` minima."""
    with np.errstate(over="ignore"):
        mixed = shingles[None, :] * _ODD[:, None]
        mixed ^= mixed >> np.uint64(32)
        least = (mixed * _ODD[:, None]).min(axis=1).reshape(BANDS, ROWS)
        return least[:, 0] * _ODD[0] + least[:, 1] * _ODD[1]


class Scanner:
    """Templates with their classes, band tables and the table of their shingles."""

    def __init__(self, templates: dict[str, str]):
        parsed = [(name, shingles_of(word_hashes(w), SHINGLE), len(w)) for name, t in templates.items() if (w := plain_words(t.encode()))]
        self.names = [p[0] for p in parsed]
        self.sets = [np.unique(p[1]) for p in parsed]
        self.mark = np.zeros(BITS, bool)
        self.classes: list[tuple[int, int, int, dict]] = []
        order = sorted(range(len(parsed)), key=lambda k: parsed[k][2])
        while order:
            shortest = parsed[order[0]][2]
            reach = shortest * CLASS if shortest >= SHINGLE else shortest  # shorter ones have shingles of their own length
            own = [k for k in order if parsed[k][2] <= reach]
            order = order[len(own) :]
            longest = max(parsed[k][2] for k in own)
            step = max(1, shortest // 4)
            bands: dict[tuple[int, int], list[int]] = {}
            for k in own:
                self.mark[(self.sets[k] & np.uint64(BITS - 1)).astype(np.int64)] = True
                for b, h in enumerate(signature(self.sets[k]).tolist()):
                    bands.setdefault((b, h), []).append(k)
            span = min(SHINGLE, shortest)  # a text is cut into shingles of the same length as the class
            self.classes.append((longest + step - 1, step, span, bands))

    def scan(self, text: bytes) -> list[tuple[str, float, int]]:
        """(template, containment, first word of the window) of the templates found, the best window of each."""
        h = word_hashes(plain_words(text))
        best: dict[int, tuple[float, int]] = {}
        for length, step, span, bands in self.classes:
            if len(h) < span:
                continue
            s = shingles_of(h, span)
            held = self.mark[(s & np.uint64(BITS - 1)).astype(np.int64)]
            if not held.any():
                continue
            width = length - span + 1
            upto = np.concatenate(([0], np.cumsum(held)))
            starts = np.arange(0, max(1, len(s) - width + step), step)
            ends = np.minimum(starts + width, len(s))
            for a, e in zip(starts[upto[ends] > upto[starts]].tolist(), ends[upto[ends] > upto[starts]].tolist()):
                own = np.unique(s[a:e])
                met = {k for b, g in enumerate(signature(own).tolist()) for k in bands.get((b, g), ())}
                for k in met:
                    part = len(np.intersect1d(own, self.sets[k], True)) / len(self.sets[k])
                    if part >= CONTAINMENT and part > best.get(k, (0.0, 0))[0]:
                        best[k] = part, a
        return [(self.names[k], *best[k]) for k in sorted(best)]


def scan(docs: DataFrame, *, templates: dict[str, str] = TEMPLATES, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(id, license, containment, at_word) for every template found in a document."""
    shared = docs.sparkSession.sparkContext.broadcast(Scanner(templates))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = shared.value
        for batch in batches:
            for first, texts in in_chunks(batch.column(1)):
                rows = [(first + k, *found) for k, t in enumerate(texts) for found in scanner.scan(t)]
                if rows:
                    at, name, part, word = zip(*rows)
                    yield pa.record_batch([batch.column(0).take(pa.array(at)), pa.array(name), pa.array(part), pa.array(word, pa.int64())], ["id", "license", "containment", "at_word"])

    rows = docs.select(F.col(key).alias("id"), whole_text(text).cast("binary").alias("t"))
    kind = docs.schema[key].dataType.simpleString()
    return rows.mapInArrow(frugal(run), f"id {kind}, license string, containment double, at_word long").withColumnRenamed("id", key)
