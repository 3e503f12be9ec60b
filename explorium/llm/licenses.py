"""Licence scan: a trained paragraph classifier, confirmed by comparison with templates.

A paragraph is a sentence of a line, or two neighbouring ones, or words of neighbouring lines without a blank one
between, as many as a template has and a few more. Its features are the word unigrams and bigrams that
occur in the templates; a paragraph without any is unknown at once, which is what the classifier says of it too. A
sparse multinomial logistic regression over licence families and the class ``unknown`` is trained on the templates,
cut and varied by a seeded generator, against shuffled template words and ``NEGATIVE`` whole paragraphs of the documents
(those of least hash, but for the ones with a licence word). A temperature fitted on templates kept apart calibrates
the probabilities. A text without any of the words that every template leaves a trace of is passed over. A prediction holds if the family's probability reaches ``SURE`` and the paragraph contains one of
the family's phrases: enough of the phrase's word bigrams, and the words that tell the family from its neighbours. There,
any version is like any other.

A document's result is its families in order of first mention. Null and empty texts have none. Whole texts are read.
Rows that repeat an id are separate. Empty tables give empty results; extra columns are not read.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: How licences of each family announce themselves in common notices.
TEMPLATES = {
    "apache": ["Licensed under the Apache License, Version 2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "SPDX-License-Identifier: Apache-2.0", "Apache License 2.0"],
    "mit": ["Released under the MIT License", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "SPDX-License-Identifier: MIT", "Licensed under the MIT license"],
    "bsd": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "Use of this source code is governed by a BSD-style license", "Licensed under the BSD License", "SPDX-License-Identifier: BSD-3-Clause", "BSD 3-Clause License"],
    "gpl": ["This work is licensed under the GNU General Public License, version 3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", "SPDX-License-Identifier: GPL-3.0-or-later", "licensed under the GPL", "under GPL v3"],
    "lgpl": ["This library is licensed under the GNU Lesser General Public License, version 2.1", "modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", "SPDX-License-Identifier: LGPL-2.1-or-later"],
    "agpl": ["This program is licensed under the GNU Affero General Public License, version 3", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation", "SPDX-License-Identifier: AGPL-3.0-only"],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "Licensed under the Mozilla Public License, version 2.0", "SPDX-License-Identifier: MPL-2.0", "under MPL 2.0"],
    "cc-by": ["Licensed under CC BY 4.0", "CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0", "CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0", "CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "cc-by-nd": ["Licensed under CC BY-ND 4.0", "CC BY-ND 4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License"],
    "cc0": ["Released under CC0 1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work", "CC0 1.0 Universal Public Domain Dedication"],
    "unlicense": ["This is free and unencumbered software released into the public domain", "Released under the Unlicense"],
    "isc": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "Released under the ISC License"],
    "epl": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License v2.0", "Licensed under the Eclipse Public License", "SPDX-License-Identifier: EPL-2.0"],
    "proprietary": ["All rights reserved", "Unauthorized copying of this file, via any medium, is strictly prohibited", "Proprietary and confidential"],
}
#: A word that must be there for the family, where bigrams are mostly shared with others.
TELLING = {"apache": {"apache", "compliance"}, "lgpl": {"lesser", "lgpl"}, "agpl": {"affero", "agpl"}, "mpl": {"mozilla", "mpl"}, "cc-by-sa": {"sa", "sharealike"}, "cc-by-nc": {"nc", "noncommercial"}, "cc-by-nd": {"nd", "noderivatives"}, "epl": {"eclipse", "epl"}, "isc": {"isc", "purpose"}, "mit": {"mit", "granted"}, "bsd": {"bsd", "redistribution"}, "unlicense": {"unencumbered", "unlicense"}, "cc0": {"cc0", "waived"}}
#: Words that tell a paragraph isn't of the family.
OTHERS = {"gpl": {"lesser", "affero", "lgpl", "agpl"}, "cc-by": {"sa", "nc", "nd", "sharealike", "noncommercial", "noderivatives"}, "cc-by-sa": {"nc", "noncommercial"}}
UNKNOWN, NEGATIVE, VARIANTS, SURE, CONTAINED = "unknown", 2000, 60, 0.5, 0.7

_WORD = re.compile(r"[a-z0-9]+")
_SENTENCE = re.compile(r"(?<=[.;:!?])\s+(?=[A-Z\"(])")


def paragraphs(text: str) -> Iterator[str]:
    """Sentences of each line and, where a line has several, neighbours together."""
    for line in text.split("\n"):
        parts = _SENTENCE.split(line)
        yield from parts
        for a, b in zip(parts, parts[1:], strict=False):
            yield f"{a} {b}"


_MARKS = " \t\r\x0b\x0c*#/;%-=<!>{}"
_NUMBER, _JOINED = re.compile(r"v?[0-9]+"), re.compile(r"([al]?gpl|mpl|epl|apache)v?[0-9]+")
#: Words that a wrapped notice may have beyond its template's.
SLACK = 4


def plain_words(words: list[str]) -> list[tuple[str, int]]:
    """Words for comparison with the place of each: a version is one "0", with the v before and the only, or later after it; GNU GPL is GPL."""
    out: list[tuple[str, int]] = []
    for i, w in enumerate(words):
        if m := _JOINED.fullmatch(w):  # gplv2
            out += [(m[1], i), ("0", i)]
            continue
        after = words[i + 1] if i + 1 < len(words) else ""
        if w == "v" and _NUMBER.fullmatch(after) or w == "gnu" and after in ("gpl", "lgpl", "agpl"):
            continue
        if out and out[-1][0] == "0" and (_NUMBER.fullmatch(w) or w == "only" or (w == "or" and after in ("later", "newer")) or (w in ("later", "newer") and words[i - 1] == "or")):
            continue
        out.append(("0" if _NUMBER.fullmatch(w) else w, i))
    return out


def _pairs(text: str) -> list[tuple[str, str]]:
    words = [w for w, _ in plain_words(_WORD.findall(text.lower()))]
    return list(zip(words, words[1:], strict=False))


def _templates() -> tuple[list[tuple[set, int]], dict]:
    """Of each template its bigrams and length; the templates of each bigram."""
    every = [(set(two), len(two) + 1) for texts in TEMPLATES.values() for t in texts if (two := _pairs(t))]
    return every, {two: [k for k, (own, _) in enumerate(every) if two in own] for own, _ in every for two in own}


_EVERY, _HOLDERS = _templates()


#: Words of templates that other texts are full of.
_COMMON = frozenset("the of and to in or for this with is are be by from that on a any may not all use work under at you it as free without".split())


def _keys() -> re.Pattern:
    """Words of which one at least stands in every text that holds a template, as far as ``CONTAINED`` asks for: few rare ones that take part in so many of a template's bigrams that the rest don't suffice."""
    keys: set[str] = set()
    for own, _ in _EVERY:
        words = sorted({w for two in own for w in two if w != "0"}, key=lambda w: (w in _COMMON, -len(w), w))
        while len([two for two in own if not keys & set(two)]) >= CONTAINED * len(own):
            keys.add(next(w for w in words if w not in keys))
    return re.compile(f"(?:{'|'.join(sorted(keys))})(?![a-z0-9])")


_KEYS = _keys()


def wrapped(lines: list[list[str]]) -> Iterator[tuple[int, int, str]]:
    """First and last line, and the words, of what holds most of a template across lines. lines: the words of neighbouring lines."""
    words, line = [w for x in lines for w in x], [k for k, x in enumerate(lines) for _ in x]
    told = plain_words(words)
    places: dict[int, list[int]] = {}
    for i in range(len(told) - 1):
        for k in _HOLDERS.get((told[i][0], told[i + 1][0]), ()):
            places.setdefault(k, []).append(i)
    found = set()
    for k, at in places.items():
        own, length = _EVERY[k]
        if len(at) < CONTAINED * len(own):
            continue
        end, a = -1, 0
        while a < len(at):
            if at[a] <= end:
                a += 1
                continue
            inside = [i for i in at[a:a + 2 * length] if i + 1 < at[a] + length + SLACK]
            if len({(told[i][0], told[i + 1][0]) for i in inside}) >= CONTAINED * len(own):
                end = inside[-1]
                first, last = told[at[a]][1], told[min(end + 1, len(told) - 1)][1]
                if line[first] != line[last]:
                    found.add((first, last))
            a += 1
    for first, last in sorted(found):
        yield line[first], line[last], " ".join(words[first : last + 1])


def grams(text: str) -> list[str]:
    """Words, all versions being one, and pairs of neighbours."""
    words = [w for w, _ in plain_words(_WORD.findall(text.lower()))]
    return words + [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]


@dataclass
class LicenseModel:
    families: list[str]
    vocabulary: dict[str, int]
    weights: np.ndarray  # features and bias by class
    temperature: float = 1.0
    words: set[str] = field(default_factory=set)

    def vector(self, paragraph: str) -> list[int]:
        return sorted({self.vocabulary[g] for g in grams(paragraph) if g in self.vocabulary})

    def scores(self, vectors: list[list[int]]) -> np.ndarray:
        x = np.stack([self.weights[v].sum(axis=0) / max(1.0, len(v)) ** 0.5 if v else np.zeros(self.weights.shape[1]) for v in vectors]) + self.weights[-1]
        e = np.exp((x - x.max(axis=1, keepdims=True)) / self.temperature)
        return e / e.sum(axis=1, keepdims=True)

    def ruled_out(self, family: str, paragraph: str) -> bool:
        words = {w for w, _ in plain_words(_WORD.findall(paragraph.lower()))}
        return bool(family in TELLING and not TELLING[family] & words or OTHERS.get(family, set()) & words)

    def confirmed(self, family: str, paragraph: str) -> bool:
        """Whether the paragraph contains most bigrams of a template of the family and what tells it from others."""
        if self.ruled_out(family, paragraph):
            return False
        own = set(_pairs(paragraph))
        for t in TEMPLATES[family]:
            two = set(_pairs(t))
            if two and len(two & own) >= CONTAINED * len(two):
                return True
        return False

    def tell(self, paragraph: str) -> tuple[str, float]:
        v = self.vector(paragraph)
        if not v:
            return UNKNOWN, 1.0
        first = p = self.scores([v])[0]
        if self.families[int(p.argmax())] != UNKNOWN and self.ruled_out(self.families[int(p.argmax())], paragraph):
            # what the words rule out leaves its probability to the others
            p = np.where([f != UNKNOWN and self.ruled_out(f, paragraph) for f in self.families], 0, p)
            p = p / p.sum()
        best = int(p.argmax())
        if self.families[best] != UNKNOWN and p[best] >= SURE and self.confirmed(self.families[best], paragraph):
            return self.families[best], float(p[best])
        return UNKNOWN, float(first[self.families.index(UNKNOWN)])


def _examples(model: LicenseModel, templates: dict[str, list[str]], negatives: list[str], rng: random.Random) -> list[tuple[str, int]]:
    """Templates whole, and cut and set among other words; and what is no licence."""
    every = [w for texts in templates.values() for t in texts for w in _WORD.findall(t.lower())]
    other = [w for t in negatives for w in _WORD.findall(t.lower())] or ["word"]
    none = model.families.index(UNKNOWN)
    examples: list[tuple[str, int]] = []
    for family, texts in templates.items():
        k = model.families.index(family)
        for t in texts:
            words = t.split()
            examples += [(t, k)] * 5
            for _ in range(VARIANTS):
                kept = [w for w in words if rng.random() > 0.08] or words
                around = [rng.choice(other) for _ in range(rng.randrange(0, 12))]
                cut = rng.randrange(len(around) + 1)
                examples.append((" ".join(around[:cut] + kept + around[cut:]), k))
    for _ in range(VARIANTS * 20):  # licence words out of order are no licence
        examples.append((" ".join(rng.choice(every if rng.random() < 0.5 else other) for _ in range(rng.randrange(2, 14))), none))
    return examples + [(t, none) for t in negatives]


def _arrays(model: LicenseModel, examples: list[tuple[str, int]]) -> tuple[list[list[int]], np.ndarray]:
    return [model.vector(t) for t, _ in examples], np.array([k for _, k in examples])


def _weights(model: LicenseModel, examples: list[tuple[str, int]]) -> np.ndarray:
    """Of a multinomial logistic regression by accelerated gradient steps; classes weigh the same."""
    vectors, y = _arrays(model, examples)
    x = np.zeros((len(vectors), len(model.vocabulary) + 1), np.float32)
    for i, v in enumerate(vectors):
        x[i, v] = 1 / max(1.0, len(v)) ** 0.5
        x[i, -1] = 1
    weight = (1 / np.maximum(np.bincount(y, minlength=len(model.families)), 1))[y]
    weight /= weight.sum()
    w = ahead = np.zeros((x.shape[1], len(model.families)))
    t, rate, want = 1.0, 1.0, np.eye(len(model.families))[y]
    for _ in range(300):
        z = x @ ahead
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        new = ahead - rate * (x.T @ ((p - want) * weight[:, None]) + 1e-5 * ahead)
        s = (1 + (1 + 4 * t * t) ** 0.5) / 2
        ahead, w, t = new + (t - 1) / s * (new - w), new, s
    return np.where(np.abs(w) < 1e-3, 0, w)  # sparse


def train(negatives: list[str], seed: int = 11) -> LicenseModel:
    """The temperature comes from a model that has not seen the first template of any family of three or more, nor every fifth negative: it is fitted on these."""
    rng = random.Random(seed)
    vocabulary: dict[str, int] = {}
    for texts in TEMPLATES.values():
        for t in texts:
            for g in grams(t):
                vocabulary.setdefault(g, len(vocabulary))
    families = [*TEMPLATES, UNKNOWN]
    model = LicenseModel(families, vocabulary, np.zeros((len(vocabulary) + 1, len(families))))
    apart = {f: texts[:1] for f, texts in TEMPLATES.items() if len(texts) > 2}
    model.weights = _weights(model, _examples(model, {f: texts[1:] if f in apart else texts for f, texts in TEMPLATES.items()}, [t for k, t in enumerate(negatives) if k % 5], rng))
    vectors, y = _arrays(model, _examples(model, apart, negatives[::5], rng))

    def loss(temperature: float) -> float:
        model.temperature = temperature
        p = model.scores(vectors)
        return -float(np.log(p[np.arange(len(p)), y] + 1e-12).mean())

    temperature = min((k / 10 for k in range(2, 31)), key=loss)
    return LicenseModel(families, vocabulary, _weights(model, _examples(model, TEMPLATES, negatives, rng)), temperature)


def fit(docs: DataFrame, negative: int = NEGATIVE, id_col: str = "doc_id", text_col: str = "text") -> LicenseModel:
    """Negatives: the first paragraphs, whole, of the documents of least hash; the bound is ``negative``. Those with a licence word are left out."""
    first = F.substring_index(F.col(text_col), "\n", 1).alias("t")
    texts = docs.where(F.col(text_col).isNotNull())
    chosen = texts.select(F.col(id_col).alias("__id")).distinct().orderBy(F.xxhash64("__id"), "__id").limit(negative)
    # a bounded table of ids
    got = sorted(texts.join(F.broadcast(chosen), F.col(id_col) == F.col("__id")).select(first).collect())
    return train([r.t for r in got if not re.search(r"licen|copyright|rights|permission|public|terms", r.t, re.I)])


def scan(docs: DataFrame, model: LicenseModel | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, license (the first family or null), licenses (all, in order), score (of the first), n_paragraphs (that carry a licence)."""
    shared = docs.sparkSession.sparkContext.broadcast(model or fit(docs, id_col=id_col, text_col=text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            for at in range(0, b.num_rows, 256):
                rows = []
                for t in b.column(1).slice(at, 256):
                    text = t.as_py() or ""
                    if not _KEYS.search(text.lower()):  # holds no template
                        rows.append((None, [], None, 0))
                        continue
                    found: list[tuple[str, float]] = []
                    run_of: list[list[str]] = []
                    own: list[tuple[int, str, float]] = []
                    for line in [*text.split("\n"), ""]:
                        words = _WORD.findall(line.lower())
                        if not words and line.strip(_MARKS):
                            words = [""]  # a line of other signs or letters is no blank one
                        if not words:  # a run of lines has ended
                            if len(run_of) > 1:
                                for a, z, notice in wrapped(run_of):
                                    name, p = m.tell(notice)
                                    if name != UNKNOWN and not any(a <= k <= z and name == n for k, n, _ in own):
                                        own.append((a, name, p))
                            found += [(n, p) for _, n, p in sorted(own, key=lambda x: x[0])]
                            run_of, own = [], []
                            continue
                        run_of.append(words)
                        if _KEYS.search(line.lower()):
                            own += [(len(run_of) - 1, *f) for p in paragraphs(line) if (f := m.tell(p))[0] != UNKNOWN]
                    names = list(dict.fromkeys(f[0] for f in found))
                    rows.append((names[0] if names else None, names, max(f[1] for f in found if f[0] == names[0]) if names else None, len(found)))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, 256), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.string(), pa.list_(pa.string()), pa.float64(), pa.int64()), strict=True))], ["id", "license", "licenses", "score", "n_paragraphs"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, license string, licenses array<string>, score double, n_paragraphs long").withColumnRenamed("id", id_col)
