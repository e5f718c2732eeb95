"""Licence scans by a trained paragraph classifier.

A paragraph becomes a sparse vector of its distinct word 1-, 2- and 3-grams, known by 64-bit hashes; multinomial logistic regression, trained in
numpy, gives a probability for each licence family, for `unknown` (licences of no family) and for `none` (no
licence).  It learns from variants of short templates, of notices of other licences, and of prose.  What it has not
learned from calibrates it: a temperature, the share `sure` of a family (which tells its wordings from other
licences) and the share `some` of all licences together (well over that of any prose).  A paragraph
* is of a family if that leads, has at least `sure`, and one of its templates confirms it: the paragraph holds at
  least half of the template's 2-grams,
* else is `unknown` if all licences together have at least `some`,
* else is no licence.

Paragraphs are single lines, three lines in a row, blocks between empty lines, and windows of 25 to 400 words that
slide over longer blocks; line breaks and comment marks count as spaces, so wrapped notices are read whole.  Every line
and every 16 words of a block (each piece half over the one before) is looked at; the paragraphs round it are classified
if its own share of licences reaches what the best piece of each variant reaches at least.

A document's licence is that of its surest confirmed paragraph, else `unknown` if it has such a paragraph,
else `none`.  Null, empty and wordless texts have `none`.  Repeated rows give repeated results.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .store import release, small_batches

NONE, UNKNOWN = "none", "unknown"

#: Customary notices of each family.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "agpl": ("This work is licensed under the GNU Affero General Public License, version 3.", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3", "SPDX-License-Identifier: AGPL-3.0-or-later", "You can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    "apache-2.0": ("Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.", "SPDX-License-Identifier: Apache-2.0", "This file is released under the Apache License 2.0"),
    "bsd": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.", "Released under the BSD License.", "SPDX-License-Identifier: BSD-3-Clause"),
    "cc-by": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "Text is available under the Creative Commons Attribution License"),
    "cc-by-nc": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "Licensed under CC BY-NC-SA 4.0."),
    "cc-by-sa": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "Text is available under the Creative Commons Attribution-ShareAlike License"),
    "cc0": ("Released under CC0 1.0.", "To the extent possible under law, the author has waived all copyright and related rights to this work under CC0 1.0 Universal.", "This work is dedicated to the public domain under CC0."),
    "gpl": ("This work is licensed under the GNU General Public License, version 3.", "This work is licensed under the GNU General Public License, version 2.", "You can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", "SPDX-License-Identifier: GPL-3.0-or-later", "Licensed under the GPL version 2 or later."),
    "isc": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "Released under the ISC License.", "SPDX-License-Identifier: ISC"),
    "lgpl": ("This library is licensed under the GNU Lesser General Public License, version 2.1.", "You can redistribute it and/or modify it under the terms of the GNU Lesser General Public License", "SPDX-License-Identifier: LGPL-2.1-or-later"),
    "mit": ("Released under the MIT License.", "Licensed under the MIT license.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "SPDX-License-Identifier: MIT"),
    "mpl": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License, version 2.0.", "SPDX-License-Identifier: MPL-2.0"),
    "unlicense": ("This is free and unencumbered software released into the public domain.", "Released under the Unlicense."),
}
#: Notices of licences that belong to no family above.
OTHERS = (
    "Licensed under the Eclipse Public License, version 2.0.",
    "This program is distributed under the Artistic License 2.0.",
    "Distributed under the Boost Software License, Version 1.0.",
    "Licensed under the European Union Public Licence, version 1.2.",
    "This software is provided 'as-is', without any express or implied warranty, under the zlib license.",
    "Do what you want to under the terms of the WTFPL license.",
    "Copyright 2019 the authors. All rights reserved. No part may be copied without permission.",
    "Use of this software is subject to the terms of the End User License Agreement.",
    "This product is licensed, not sold, under a proprietary license of the company.",
    "Permission to use this material is granted for personal, non-commercial purposes only under our license terms.",
    "Released under the Open Font License, version 1.1.",
    "Licensed under the Academic Free License version 3.0.",
    "This data is made available under the Open Database License.",
    "The content is licensed under the terms of the publisher; redistribution is prohibited.",
    "SPDX-License-Identifier: Zlib",
    "SPDX-License-Identifier: LicenseRef-Internal",
    "All use is subject to the license of the owner of the work.",
    "This code is covered by the Microsoft Public License.",
    "You may use these files under the Python Software Foundation License.",
    "Licensed under the PostgreSQL License, a liberal open source license.",
    "The images may be used under the terms of the agency's standard license.",
    "Copying and distribution of this file, with or without modification, are permitted in any medium without royalty.",
    "This document is licensed under the terms of the GNU Free Documentation License.",
    "This software may be used under a commercial license from the vendor.",
)
#: Paragraphs that are no licence, some of them about licences or with their words.
PROSE = (
    "The driver showed his license to the officer and was free to go.",
    "She lost her driving licence last year and had to walk.",
    "A fishing licence costs ten pounds and is valid for a year.",
    "The minister said that licensing laws would be reviewed in May.",
    "She has a general interest in public works and common law.",
    "The software was released in version 2 after a long delay.",
    "All members of the public may use the library free of charge.",
    "He asked for permission to copy the file under the desk.",
    "The Mozilla browser and the Apache helicopter have little in common.",
    "A creative person with many attributes, he shared them alike.",
    "The foundation published a notice about the terms of the contract.",
    "This work is done and the other is not, said the author of the book.",
    "It was the best of times and the worst of times in the city.",
    "In the year that followed, the source of the river was found at last.",
    "Prices rose by 4.0 percent and fell by 2.0 percent later.",
    "You can find the form at the office, or modify it as you see fit.",
    "The museum is open to the public from nine to five without charge.",
    "They were permitted to use the source of water under certain conditions.",
    "The version of the story that he told was not the one in the file.",
    "An open source of heat must not be used in this building.",
    "der die das und ist nicht von mit sich des auf im zu eine als auch an",
    "le la les de des est une que dans pour qui sur pas plus par avec au",
    "el la los de que no una por con para es del se las su como más",
    "the of and to in is that for it was on are as with at be this have from or one had by not but what all were we when your can said there use an each which she do how their if will up other about out many then them these so some her would make like him into time has look two more write go see number no way could people my than first been call who its now find long down day did get come made may part",
)
#: Short names, which the carriers below turn into notices of any family.
NAMES: dict[str, tuple[str, ...]] = {
    "agpl": ("the GNU Affero General Public License, version 3", "the AGPL v3"),
    "apache-2.0": ("the Apache License, Version 2.0", "the Apache 2.0 license"),
    "bsd": ("the 3-clause BSD license", "the BSD License"),
    "cc-by": ("the Creative Commons Attribution 4.0 International License", "CC BY 4.0"),
    "cc-by-nc": ("the Creative Commons Attribution-NonCommercial 4.0 International License", "CC BY-NC 4.0"),
    "cc-by-sa": ("the Creative Commons Attribution-ShareAlike 4.0 International License", "CC BY-SA 4.0"),
    "cc0": ("CC0 1.0 Universal", "CC0 1.0"),
    "gpl": ("the GNU General Public License, version 3", "the GPL version 2 or later"),
    "isc": ("the ISC License",),
    "lgpl": ("the GNU Lesser General Public License, version 2.1", "the LGPL version 3"),
    "mit": ("the MIT License", "the MIT license (MIT)"),
    "mpl": ("the Mozilla Public License, version 2.0", "the MPL 2.0"),
    "unlicense": ("the Unlicense",),
    UNKNOWN: ("the Eclipse Public License 2.0", "the Artistic License", "the Boost Software License", "the zlib license", "a proprietary license", "the license agreement of the company", "the Open Database License", "the Fair License", "the license of the author", "the Reciprocal Public License", "the Community License 1.0", "the Sleepycat license"),
}
CARRIERS = ("This project is distributed under the terms of {}.", "Licensed under {}.", "Released under {}.", "This software is made available under {}.", "You may use this file under {}.", "The code is covered by {}; see the file for details.")

FAMILIES = (NONE, UNKNOWN, *sorted(TEMPLATES))
KNOWN = 2  # families from here on
#: Words of the windows that slide over blocks; a block of up to the widest is read whole as well.
WINDOWS = (25, 50, 100, 200, 400)
LOOK = 16  # words of a piece of a block whose likeness to licences is looked at first


class Model:
    """keys: ascending hashes of the n-grams that were learned from; weights: a row for each."""

    def __init__(self, keys: np.ndarray, weights: np.ndarray, bias: np.ndarray, temperature: float = 1.0, sure: float = 0.5, some: float = 0.5):
        self.keys, self.weights, self.bias, self.temperature, self.sure, self.some = keys, weights, bias, temperature, sure, some
        self.templates = []
        for k, name in enumerate(FAMILIES):
            for t in TEMPLATES.get(name, ()):
                self.templates.append((k, np.unique(tx.word_ngrams(_words(t), np.zeros(len(_words(t)), np.int8), 2)[0])))
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(keys & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        self.least = 0.0

    def known(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of grams that were learned from, and their rows in weights."""
        at = np.flatnonzero(self.maybe[(grams & np.uint64((1 << 20) - 1)).astype(np.int64)])
        i = np.minimum(np.searchsorted(self.keys, grams[at]), len(self.keys) - 1)
        right = self.keys[i] == grams[at]
        return at[right], i[right]

    def probabilities(self, words: np.ndarray) -> np.ndarray:
        """By family, of one paragraph's word hashes; features are weighted by 1 / sqrt(distinct words)."""
        grams = np.unique(_grams(words))
        z = (self.weights[self.known(grams)[1]].sum(0) / np.sqrt(len(np.unique(words))) + self.bias) / self.temperature
        z = np.exp(z - z.max())
        return z / z.sum()

    def licence_shares(self, words: np.ndarray, line: np.ndarray, n: int) -> np.ndarray:
        """1 - p(none) of each of n lines, at once; line: the line of each word, ascending."""
        pairs = []
        for k in (1, 2, 3):
            gram, spot = tx.word_ngrams(words, line, k)
            on, key = self.known(gram)
            pairs.append(line[spot[on]] * len(self.keys) + key)
        own, key = np.divmod(np.unique(np.concatenate(pairs)), len(self.keys))
        scale = np.sqrt(np.maximum(1, np.bincount(line, minlength=n)))
        z = np.stack([np.bincount(own, self.weights[key, k], n) / scale for k in range(len(FAMILIES))], 1)
        return 1 - _soft((z + self.bias) / self.temperature)[:, 0]

    def judged(self, words: np.ndarray, confirm: float) -> tuple[int, float]:
        """(family, its share) of a paragraph: a confirmed one, UNKNOWN with the share of all licences, or NONE."""
        p = self.probabilities(words)
        k = KNOWN + int(p[KNOWN:].argmax())
        if p[k] >= self.sure and p[k] > p[0]:
            pairs = tx.word_ngrams(words, np.zeros(len(words), np.int8), 2)[0]
            if max(float(np.isin(t, pairs).mean()) for of, t in self.templates if of == k) >= confirm:
                return k, float(p[k])
        return (1, float(1 - p[0])) if 1 - p[0] >= self.some else (0, float(p[0]))


def _words(text: str) -> np.ndarray:
    data, offs = tx.buffers(pa.array([text]))
    s, e, _ = tx.words(data, offs, tx.PUNCT)
    return tx.span_hash(data, s, e)


def _grams(words: np.ndarray) -> np.ndarray:
    """All 1-, 2- and 3-grams of one paragraph's word hashes."""
    return np.concatenate([tx.word_ngrams(words, np.zeros(len(words), np.int8), n)[0] for n in (1, 2, 3)])


def _variants(rng: np.random.Generator) -> tuple[list[list[str]], list[int], np.ndarray]:
    """Word lists of templates, other notices and prose: whole, cut, with words lost, among other words; labels; which ones calibrate.

    Of other notices every fourth calibrates only, as does a quarter of all variants.
    """
    prose = [w for p in PROSE for w in p.split()]
    made_up = lambda: "".join("aeioubdgklmnrst"[i] for i in rng.integers(0, 15, int(rng.integers(2, 9))))
    filler = lambda n: [prose[j] if rng.random() < 0.5 else made_up() for j in rng.integers(0, len(prose), n)]
    texts, labels, spared = [], [], []
    for k, name in enumerate(FAMILIES):
        carried = [CARRIERS[(at + i) % len(CARRIERS)].format(n) for at, n in enumerate(NAMES.get(name, ())) for i in range(3)]
        for at, t in enumerate([*TEMPLATES.get(name, PROSE if k == 0 else OTHERS), *carried]):
            words = t.split()
            for i in range(24 if k == 0 else 8):
                own = [w for w in words if rng.random() > 0.08 * (i % 3)] or words
                if k == 0 and i % 3 == 0:
                    own = filler(len(words))
                pad = filler(int(rng.integers(0, 10))) if i % 2 else []
                texts.append(pad + own if i % 4 < 2 else own + pad)
                labels.append(k)
                spared.append(at % 4 == 3 if k == 1 else rng.random() < 0.25)
    return texts, labels, np.array(spared)


def _soft(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(1, keepdims=True))
    return z / z.sum(1, keepdims=True)


@lru_cache(1)
def train(steps: int = 80, l2: float = 1e-4, seed: int = 3) -> Model:
    rng = np.random.default_rng(seed)
    texts, labels, test = _variants(rng)
    y, m = np.array(labels), len(FAMILIES)
    words = [_words(" ".join(t)) for t in texts]
    features = [np.unique(_grams(w)) for w in words]
    spots, col = np.unique(np.concatenate(features), return_inverse=True)
    owner = np.repeat(np.arange(len(y)), [len(f) for f in features])
    x = np.zeros((len(y), len(spots)), np.float32)
    x[owner, col] = (1 / np.sqrt([max(1, len(np.unique(w))) for w in words]))[owner]
    weight = (1 / np.bincount(y[~test], minlength=m))[y]  # classes count alike
    w, b = np.zeros((len(spots), m), np.float32), np.zeros(m, np.float32)
    first, second = [np.zeros_like(w), np.zeros_like(b)], [np.zeros_like(w), np.zeros_like(b)]
    gold = np.eye(m, dtype=np.float32)[y]
    for step in range(1, steps + 1):
        gap = ((_soft(x[~test] @ w + b) - gold[~test]) * (weight[~test] / weight[~test].sum())[:, None]).astype(np.float32)
        for i, (p, g) in enumerate(((w, x[~test].T @ gap + l2 * w), (b, gap.sum(0)))):
            first[i] += 0.1 * (g - first[i])
            second[i] += 0.01 * (g * g - second[i])
            p -= 0.1 * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.99**step)) + 1e-8)
    z, own = x[test] @ w + b, y[test]
    heat = float(min(np.geomspace(0.1, 8, 40), key=lambda t: -np.log(np.maximum(_soft(z / t)[np.arange(len(z)), own], 1e-9)).mean()))
    p = _soft(z / heat)
    cut = lambda good, bad: float(max(np.unique(np.concatenate([good, bad])), key=lambda c: (good >= c).mean() + (bad < c).mean()))
    sure = cut(p[own >= KNOWN, KNOWN:].max(1), p[own < KNOWN, KNOWN:].max(1))
    some = float(1 + (1 - p[own == 0, 0]).max()) / 2  # halfway from the likeliest piece of prose to certainty
    model = Model(spots, w, b, heat, sure, some)
    # what a piece of a text must have to be looked round: what the best piece of each licence variant has at least
    best = [float(model.licence_shares(t, np.arange(len(t)) // LOOK, -(-len(t) // LOOK)).max()) for t, k in zip(words, labels) if k]
    model.least = min(best)
    return model


Found = tuple[str, float, bool, int]


def pieces(starts: np.ndarray, ends: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Word ranges of `words` words in every block (starts, ends: its words), each half over the one before; shorter blocks whole."""
    step = max(1, words // 2)
    n = np.maximum(1, -(-(ends - starts - words) // step) + 1)
    own = np.repeat(np.arange(len(starts)), n)
    lo = starts[own] + (np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)) * step
    return lo, np.minimum(lo + words, ends[own])


def paragraphs(first: np.ndarray, end: np.ndarray, lines: tuple[int, int], lo: int, hi: int) -> set[tuple[int, int]]:
    """Word ranges of the paragraphs round the words lo to hi of a block (lines: its first and last line).

    The lines they stand in, those with a line more on each side, the whole block if the widest window holds it, and of
    every width the windows, in steps of half of it, that have the middle of lo and hi in their middle half.
    """
    begin, over, mid = int(first[lines[0]]), int(end[lines[1]]), (lo + hi) // 2
    a, b = int(np.searchsorted(end, lo, "right")), int(np.searchsorted(end, hi - 1, "right"))
    found = {(int(first[max(lines[0], a - k)]), int(end[min(lines[1], b + k)])) for k in (0, 1)}
    found = {x for x in found if x[1] - x[0] <= WINDOWS[-1]}
    for w in WINDOWS:
        if over - begin <= w:
            found.add((begin, over))
            break
        at = begin + max(0, (mid - begin - w // 4) // (w // 2)) * (w // 2)
        at = min(at, over - w)
        found.add((at, at + w))
    return found


def scan(model: Model, column: pa.Array, confirm: float) -> list[Found]:
    """(licence, its share, confirmed by a template, licence paragraphs) of each text."""
    out: list[Found] = [(NONE, 0.0, False, 0)] * len(column)
    data, offs = tx.buffers(column)
    for lo, _, part, at in tx.slices(data, offs):
        s, e, row = tx.words(part, at, tx.PUNCT)
        if not len(s):
            continue
        h = tx.span_hash(part, s, e)
        breaks = np.cumsum(part == 10)[s]
        first = np.flatnonzero(np.concatenate([[True], (breaks[1:] != breaks[:-1]) | (row[1:] != row[:-1])]))
        end = np.append(first[1:], len(h))
        block = np.cumsum(np.concatenate([[True], (np.diff(breaks[first]) > 1) | (np.diff(row[first]) != 0)]))
        opens = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))  # first line of each block
        closes = np.append(opens[1:], len(first)) - 1
        where = block - 1  # of each line
        looked = [(first, end, where), (*(p := pieces(first[opens], end[closes], LOOK)), np.searchsorted(first[opens], p[0], "right") - 1)]
        found: list[tuple[int, float, int, int]] = []
        judged: dict[tuple[int, int], tuple[int, float]] = {}
        for lows, highs, of in looked:  # every line, and every piece of a block whatever its lines
            spots = np.arange(int((highs - lows).sum())) + np.repeat(lows - (np.cumsum(highs - lows) - (highs - lows)), highs - lows)
            shares = model.licence_shares(h[spots], np.repeat(np.arange(len(lows)), highs - lows), len(lows))
            for i in np.flatnonzero(shares >= model.least).tolist():
                k = int(of[i])
                for r in sorted(paragraphs(first, end, (int(opens[k]), int(closes[k])), int(lows[i]), int(highs[i]))):
                    if r not in judged:
                        judged[r] = model.judged(h[r[0] : r[1]], confirm)
                        if judged[r][0]:
                            found.append((*judged[r], *r))
        taken = np.zeros(len(h), bool)  # a word counts for one paragraph: the surest confirmed ones first
        for k, share, a, b in sorted(found, key=lambda x: (x[0] < KNOWN, -x[1], x[2], x[3])):
            if not taken[a:b].any():
                taken[a:b] = True
                r = lo + int(row[a])
                best = max((FAMILIES[k], share, k >= KNOWN), out[r][:3], key=lambda x: (x[2], x[1]))
                out[r] = (*best, out[r][3] + 1)
    return out


def scan_licenses(docs: DataFrame, text: str = "text", confirm: float = 0.5) -> DataFrame:
    """docs with license (a family, `unknown` or `none`), license_score, license_confirmed and n_license_paragraphs;
    columns of these names are replaced."""
    small_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(train())  # of fixed size

    @F.pandas_udf("struct<license:string,license_score:double,license_confirmed:boolean,n_license_paragraphs:long>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame(scan(model.value, pa.array(batch, pa.large_string(), from_pandas=True), confirm), columns=["license", "license_score", "license_confirmed", "n_license_paragraphs"])
        release()

    out = docs.withColumn("__license", run(F.col(text)))
    names = ("license", "license_score", "license_confirmed", "n_license_paragraphs")
    return out.withColumns({n: F.col(f"__license.{n}") for n in names}).drop("__license")
