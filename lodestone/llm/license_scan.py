"""License scans: a paragraph classifier over word n-grams, confirmed against templates. DataFrame functions only."""

from __future__ import annotations

import math
import random
import re
from dataclasses import dataclass

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNKNOWN = "unknown"
#: A family is reported if its calibrated probability is above this.
REPORT = 0.5
#: Share of a template's n-grams that a paragraph has to have for the template to confirm the family.
CONFIRM = 0.7
NO_WORD = r"[^0-9A-Za-z\x80-\x{10FFFF}]+"
WORD = r"[0-9A-Za-z\x80-\x{10FFFF}]"
#: Notices by which licence families are declared.
NOTICES = {
    "MIT": [
        "Released under the MIT License",
        "This project is licensed under the terms of the MIT license",
        "Permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License Version 2.0",
        "you may not use this file except in compliance with the License You may obtain a copy of the License at",
        "Apache License Version 2.0 January 2004",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License version 3",
        "under the terms of the GNU General Public License as published by the Free Software Foundation either version 3 of the License",
        "GNU General Public License v3.0",
    ],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License version 2",
        "under the terms of the GNU General Public License as published by the Free Software Foundation either version 2 of the License",
        "GNU General Public License v2.0",
    ],
    "BSD": [
        "Redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
        "Use of this source code is governed by a BSD style license",
        "Released under the BSD 3 Clause License",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License v 2.0",
        "Licensed under the Mozilla Public License Version 2.0",
    ],
    "CC-BY-NC": ["Licensed under CC BY NC 4.0", "This work is licensed under a Creative Commons Attribution NonCommercial 4.0 International License"],
    "CC-BY": ["Licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"],
    "Proprietary": ["All rights reserved Unauthorized copying of this file via any medium is strictly prohibited", "This software is proprietary and confidential"],
}
#: Prose about licences and other matters that declares none.
OTHER = [
    "the driver must hold a valid license to drive this vehicle on public roads",
    "he was granted permission to use the general version of the work",
    "under the terms of the treaty the conditions were met by both sides",
    "the committee released the report under version 3 of the plan",
    "Apache helicopters and the Mozilla mascot were seen at the public fair",
    "students at the institute MIT obtained a copy of the documentation",
    "this file was last modified in January and is subject to review",
    "the software foundation published a general statement for the public",
    "all rights of the person are protected by the law of the source country",
    "fishing licenses are sold free of charge at the office",
    "creative people in common rooms gave attribution to the international press",
    "the source code of the program is in binary form with modification dates",
]


def grams(text: str) -> list[str]:
    w = [x for x in re.split(r"[^0-9A-Za-z\x80-\U0010ffff]+", text.lower()) if x]
    return list(dict.fromkeys(w + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]))


def _hash(gram: str) -> int:
    """The hash that the n-gram has in Spark: of one word, or of two one after the other."""
    seed = 42
    for w in gram.split(" "):
        seed = xxhash.xxh64_intdigest(w.encode(), seed)
    return seed - 2**64 if seed >= 2**63 else seed


def labelled_paragraphs(n: int = 1500, seed: int = 5) -> list[tuple[str, str]]:
    """(paragraph, family) to train on where the caller has none: notices and other prose in varied surroundings."""
    r = random.Random(seed)
    syllables = "th he in er an re on en at ed ha to or it is es ng te se st".split()
    noise = lambda k: " ".join("".join(r.choice(syllables) for _ in range(r.randint(1, 4))) for _ in range(k))
    glue = "the of and is in for a this that with to be by on under version license work public general".split()
    out = []
    for i in range(n):
        if i % 5 < 3:
            family = r.choice(list(NOTICES))
            text = r.choice(NOTICES[family])
            text = f"{r.choice(['', 'Copyright (c) 2021 ' + noise(2) + '. ', noise(3) + ' '])}{text}{r.choice(['.', '. ' + noise(4), ''])}"
        else:
            family = UNKNOWN
            text = r.choice([noise(r.randint(1, 40)), r.choice(OTHER), " ".join(r.choice([noise(1), r.choice(glue)]) for _ in range(r.randint(3, 30)))])
        out.append((text, family))
    return out


@dataclass
class Model:
    """Softmax regression over the presence of ``features``; ``weights`` has a row for each and the bias last."""

    families: list[str]
    features: list[str]
    weights: np.ndarray
    temperature: float

    def probabilities(self, text: str) -> dict[str, float]:
        found = set(grams(text))
        z = (np.array([g in found for g in self.features] + [True], float) @ self.weights) / self.temperature
        p = np.exp(z - z.max())
        return dict(zip(self.families, p / p.sum(), strict=True))

    def least_features(self, report: float) -> int:
        """How many features a paragraph has at least if a family has a probability above ``report``: with fewer, even the
        strongest of each family don't outweigh the unknown class."""
        against = (self.weights - self.weights[:, :1]) / self.temperature
        needed = -math.inf if report <= 0 else math.inf if report >= 1 else math.log(report / (1 - report))
        most = len(self.features)
        for k in range(1, len(self.families)):
            z, n = against[-1, k], 0
            for gain in np.sort(against[:-1, k])[::-1]:
                if z > needed - 1e-9 or gain <= 0:
                    break
                z, n = z + gain, n + 1
            most = min(most, n)
        return most


def fit(paragraphs: list[tuple[str, str]], l1: float = 4e-4, rounds: int = 600) -> Model:
    """Proximal gradient descent with an L1 penalty, so that few n-grams count; the temperature is set on a held-out
    fifth, which makes the probability of the unknown class a calibrated one."""
    families = [UNKNOWN, *sorted({f for _, f in paragraphs if f != UNKNOWN})]
    seen: dict[str, dict[str, int]] = {}
    for text, family in paragraphs:
        for g in grams(text):
            seen.setdefault(g, {}).setdefault(family, 0)
            seen[g][family] += 1
    # n-grams of declared families, the purest and most frequent first
    pure = {g: max((v for f, v in c.items() if f != UNKNOWN), default=0) - c.get(UNKNOWN, 0) for g, c in seen.items()}
    features = sorted((g for g, v in pure.items() if v >= 3), key=lambda g: (-pure[g], g))
    at = {g: i for i, g in enumerate(features)}
    x, y = np.zeros((len(paragraphs), len(features) + 1)), np.zeros((len(paragraphs), len(families)))
    for i, (text, family) in enumerate(paragraphs):
        x[i, -1] = y[i, families.index(family)] = 1
        x[i, [at[g] for g in grams(text) if g in at]] = 1
    held = np.arange(len(x)) % 5 == 4
    w = np.zeros((x.shape[1], len(families)))
    step = 4.0 / max(1.0, (x[~held] ** 2).sum(1).mean())
    for _ in range(rounds):
        z = x[~held] @ w
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        w -= step * (x[~held].T @ (p - y[~held])) / (~held).sum()
        w[:-1] = np.sign(w[:-1]) * np.maximum(np.abs(w[:-1]) - step * l1, 0)
    z = x[held] @ w

    def loss(t: float) -> float:
        s = z / t
        s = s - s.max(1, keepdims=True)
        return float(-(y[held] * (s - np.log(np.exp(s).sum(1, keepdims=True)))).sum())

    used = np.abs(w[:-1]).sum(1) > 0
    return Model(families, [g for g, u in zip(features, used, strict=True) if u], w[np.r_[used, True]], min((0.1 * k for k in range(2, 31)), key=loss))


_own: list[Model] = []


def own_model() -> Model:
    if not _own:
        _own.append(fit(labelled_paragraphs()))
    return _own[0]


def _longs(values: list[int]) -> str:
    """SQL of a constant array."""
    return "array(" + ", ".join(f"{v}L" if v > -(2**63) else "-9223372036854775807L - 1L" for v in values) + ")" if values else "cast(array() as array<bigint>)"


def _doubles(values: list[float]) -> str:
    return "array(" + ", ".join(f"{v!r}D" for v in map(float, values)) + ")"


def _grams(w: str) -> str:
    """SQL of the hashes of the n-grams of an array of words."""
    return f"concat(transform({w}, x -> xxhash64(x)), if(size({w}) > 1, transform(sequence(1, greatest(size({w}) - 1, 1)), i -> xxhash64(get({w}, i - 1), get({w}, i))), cast(array() as array<bigint>)))"


def _units(docs: DataFrame) -> DataFrame:
    """(doc_id, paragraph_no, n_lines, p): each line, then each run of two lines or more between lines without words."""
    rows = docs.select("doc_id", F.split(F.translate("text", "\x01\x02", "  "), "\n", -1).alias("l"))
    rows = rows.select("doc_id", "l", F.transform("l", lambda x: x.rlike(WORD)).alias("full"))
    starts = lambda i: (i == 0) | ~F.get("full", i - 1)
    marked = F.transform("l", lambda x, i: F.when(~F.get("full", i), "").when(starts(i), F.concat(F.lit("\x01"), i.cast("string"), F.lit("\x02"), x)).otherwise(x))
    runs = F.filter(F.transform(F.split(F.array_join(marked, "\n"), "\x01", -1), lambda x: F.rtrim(x, F.lit("\n"))), lambda x: F.contains(x, F.lit("\n")))
    unit = lambda no, n, p: F.struct(no.cast("int").alias("paragraph_no"), n.cast("int").alias("n_lines"), p.alias("p"))
    whole = F.transform(runs, lambda x: unit(F.substring_index(x, "\x02", 1), F.char_length(x) - F.char_length(F.replace(x, F.lit("\n"), F.lit(""))) + 1, F.substring_index(x, "\x02", -1)))
    return rows.select("doc_id", F.explode(F.concat(F.transform("l", lambda x, i: unit(i, F.lit(1), x)), whole)).alias("u")).select("doc_id", "u.*")


def scan(docs: DataFrame, model: Model | None = None, notices: dict[str, list[str]] | None = None, report: float = REPORT) -> DataFrame:
    """(doc_id, paragraph_no, n_lines, family, probability, template_share, confirmed) for lines and for paragraphs of
    whole texts whose most likely class is a licence family with a probability above ``report``.

    A paragraph is a run of ``n_lines`` lines, two or more, between lines without words, so that wrapped notices are
    seen whole; paragraph_no is the number of its first line. Lines that confirm a template by themselves are findings
    of their own, and the paragraph is scored without them. template_share is the largest share of the n-grams of a
    template of that family that the line or paragraph has; confirmed means CONFIRM of them. Null and blank texts have
    no paragraphs; rows that repeat are all scanned; extra columns are ignored. Everything is computed where the row
    lies: there is no shuffle.
    """
    m, notices = model or own_model(), NOTICES if notices is None else notices
    features = _longs([_hash(g) for g in m.features])
    # for each family the n-grams of its templates
    templates = "array(" + ", ".join("array(" + ", ".join(_longs([_hash(g) for g in grams(t)]) for t in notices.get(f) or [""]) + ")" for f in m.families) + ")"
    key = ["doc_id", "paragraph_no", "n_lines"]
    rows = _units(docs).select(*key, "p", F.array_remove(F.split(F.lower("p"), NO_WORD), "").alias("w"))
    rows = rows.select(*key, "p", F.expr(_grams("w")).alias("grams"))
    # what follows filters inside of generators: a predicate that moves below them would be computed many times over
    hits = f"filter(array(struct({{0}} as grams, array_intersect({{0}}, {features}) as hits)), f -> size(f.hits) >= {max(1, m.least_features(report))})"
    rows = rows.select(*key, "p", F.explode(F.expr(hits.format("grams"))).alias("f"))
    alone = f"size(array_intersect(s.g, {features})) > 0 and exists(flatten({templates}), t -> size(t) > 0 and size(array_intersect(s.g, t)) / size(t) >= {CONFIRM}D)"
    each = f"transform(transform(split(p, '\\n', -1), l -> array_remove(split(lower(l), '{NO_WORD.replace(chr(92), chr(92) * 2)}'), '')), w -> struct(w, {_grams('w')} as g))"
    rest = f"transform(array(transform(filter({each}, s -> not ({alone})), s -> s.w)), ws -> struct(size(ws) as n, flatten(ws) as w))[0]"
    rows = rows.select(*key, "f", F.expr(f"if(n_lines > 1, {rest}, null)").alias("rest"))
    again = f"if(n_lines = 1 or rest.n = n_lines, array(f), if(rest.n > 1, {hits.format('g')}, filter(array(f), x -> false)))"
    rows = rows.select(*key, "f", "rest", F.expr(f"if(n_lines > 1 and rest.n between 2 and n_lines - 1, {_grams('rest.w')}, null)").alias("g"))
    rows = rows.select(*key, F.explode(F.expr(again)).alias("f")).select(*key, "f.grams", F.expr(f"concat(transform(f.hits, h -> int(array_position({features}, h) - 1)), array({len(m.features)}))").alias("at"))
    weights = "array(" + ", ".join(_doubles(m.weights[:, k] / m.temperature) for k in range(len(m.families))) + ")"
    rows = rows.select(*key, "grams", F.expr(f"transform({weights}, row -> aggregate(at, 0D, (a, i) -> a + get(row, i)))").alias("z"))
    found = "named_struct('best', int(array_position(z, array_max(z)) - 1), 'probability', round(1D / aggregate(z, 0D, (a, v) -> a + exp(v - array_max(z))), 6))"
    named = F.explode(F.expr(f"filter(array({found}), f -> f.best > 0 and f.probability > {float(report)!r}D)")).alias("f")
    rows = rows.select(*key, "grams", named)
    share = f"array_max(transform(get({templates}, f.best), t -> size(array_intersect(grams, t)) / greatest(size(t), 1)))"
    names = "array(" + ", ".join(f"'{f}'" for f in m.families) + ")"
    out = rows.select("doc_id", F.col("paragraph_no").cast("long").alias("paragraph_no"), "n_lines", F.expr(f"get({names}, f.best)").alias("family"), "f.probability", F.round(F.expr(share), 6).alias("template_share"))
    return out.withColumn("confirmed", F.col("template_share") >= CONFIRM)
