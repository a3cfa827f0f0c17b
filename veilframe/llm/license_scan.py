"""Licence scans: a trained paragraph classifier with template comparison.

A sparse multinomial logistic regression over word n-grams says which licence family a
paragraph names, or ``unknown``.  It is fitted on the driver, in numpy, on variants of the
templates below and on a bounded sample of corpus paragraphs; its probabilities are
calibrated by a temperature on variants that the fit has not seen.  A prediction is
confirmed if the paragraph holds half of the word pairs of one of the family's templates.
Scanning is one projection of Catalyst expressions over whole texts, without a shuffle.
"""

from __future__ import annotations

import json
import random
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.llm.common import bounded_sample

TOKEN = r"[a-z0-9]+(?:[.-][a-z0-9]+)*+"  # possessive: Java backs up on its stack otherwise
# Between paragraphs: lines without a letter or digit, such as a comment sign alone.
BLANK = r"\n(?:[^\p{L}\p{N}\n]*+\n)++"
# A licence expression of several names, such as ``SPDX-License-Identifier: (MIT OR Apache-2.0)``.
CHOICE = r"(?i)((?:spdx-license-identifier|licen[sc]e)s?:)([^\n]*\s(?:or|and)\s[^\n]*)"
JOINED = r"(?i)\s+(?:or|and)\s+|[()]"
UNKNOWN = "unknown"
SAMPLE = 400  # documents whose paragraphs may serve as examples of no licence
PARAGRAPHS = 3000  # paragraphs of that sample, at most
VARIANTS = 60
SHORT_VARIANTS = 60  # of templates of up to three words
CONFIRM = 0.5

# Short notices and opening sentences by licence family.
TEMPLATES = {
    "MIT": (
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and"
        " associated documentation files, to deal in the Software without restriction",
    ),
    "Apache": (
        "Licensed under the Apache License, Version 2.0.",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    ),
    "BSD": (
        "Use of this source code is governed by a BSD-style license.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided"
        " that the following conditions are met",
    ),
    "GPL": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General"
        " Public License as published by the Free Software Foundation",
    ),
    "LGPL": ("Licensed under the GNU Lesser General Public License, version 2.1.",),
    "AGPL": ("Licensed under the GNU Affero General Public License, version 3.",),
    "MPL": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Released under the Mozilla Public License 2.0.",
    ),
    "CC-BY": ("Licensed under CC BY 4.0.", "Licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-SA": (
        "Licensed under CC BY-SA 4.0.", "Licensed under a Creative Commons Attribution-ShareAlike 4.0 License."),
    "CC-BY-NC": (
        "Licensed under CC BY-NC 4.0.", "Licensed under a Creative Commons Attribution-NonCommercial 4.0 License."),
    "CC0": ("Released under CC0 1.0.", "Dedicated to the public domain under the Creative Commons CC0 1.0 dedication."),
    "Proprietary": (
        "All rights reserved.", "Copyright. All rights reserved.",
        "All rights reserved. No part of this work may be reproduced without written permission.",
        "Confidential and proprietary. Unauthorized copying is strictly prohibited.",
    ),
}
# SPDX names by family; ``SPDX-License-Identifier: <name>`` and ``License: <name>`` are templates too.
SPDX = {
    "MIT": ("MIT", "MIT-0"),
    "Apache": ("Apache-2.0",),
    "BSD": ("BSD-2-Clause", "BSD-3-Clause", "0BSD"),
    "GPL": tuple(f"GPL-{v}{end}" for v in ("2.0", "3.0") for end in ("", "-only", "-or-later")),
    "LGPL": tuple(f"LGPL-{v}{end}" for v in ("2.1", "3.0") for end in ("", "-only", "-or-later")),
    "AGPL": tuple(f"AGPL-3.0{end}" for end in ("", "-only", "-or-later")),
    "MPL": ("MPL-2.0",),
    "CC-BY": ("CC-BY-3.0", "CC-BY-4.0"),
    "CC-BY-SA": ("CC-BY-SA-3.0", "CC-BY-SA-4.0"),
    "CC-BY-NC": ("CC-BY-NC-3.0", "CC-BY-NC-4.0"),
    "CC0": ("CC0-1.0",),
}
SHORT = {
    "MIT": ("MIT License",), "Apache": ("Apache License 2.0",), "BSD": ("BSD 3-Clause License", "BSD License"),
    "GPL": ("GNU GPLv3 License", "GNU GPLv2 License"), "LGPL": ("GNU LGPLv3 License",), "AGPL": ("GNU AGPLv3 License",),
}
for _family, _names in SPDX.items():
    _forms = [f"{_head}: {_name}" for _name in _names for _head in ("SPDX-License-Identifier", "License")]
    TEMPLATES[_family] += (*_forms, *SHORT.get(_family, ()))
# Words that only licences have; paragraphs with one are no examples of no licence.  (Names such
# as MIT are words of languages too and only count with one of these.)
NAMED = re.compile(
    r"\b(?:licen[sc](?:e[sd]?|ing)|spdx|copyright|[al]?gpl(?:v?[0-9.]+)?|mpl|bsd|cc0|cc[ -]by|"
    + "|".join(re.escape(n.lower()) for names in SPDX.values() for n in names if "-" in n) + r")\b")
OPENINGS = (
    "licensed under", "released under", "distributed under", "available under", "this work is licensed under",
    "this project is released under", "the code is made available under", "published under the terms of",
)
VERSIONS = ("1", "1.0", "1.1", "2", "2.0", "2.1", "2.5", "3", "3.0", "4.0")
# Sentences with licence words that name no licence.
OTHER = (
    "he lost his driver license and the plate number", "a licensed professional engineer signed the report",
    "the general public was invited to the meeting", "the apache helicopter landed near the village",
    "she studied at mit and released a new album", "the version 2.0 of the product was released in may",
    "poetic license is common in the arts", "permission to land was granted by the tower",
    "the software was free of charge for a month", "the source of the river is in the hills",
    "all rights of way are reserved for pedestrians", "the foundation published a free guide",
    "copyright law is taught in the second year", "the terms of the contract were not met",
    "public domain was the title of the show", "the commons debated the attribution of the work",
    "use of this door is prohibited at night", "modify the recipe and redistribute the flour",
)


def tokens_of(text: str) -> list[str]:
    return re.findall(TOKEN, text.lower())


def grams_of(words: list[str]) -> set[str]:
    return {" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)}


@dataclass
class LicenseModel:
    families: list[str]
    anchors: list[str]
    weights: dict[str, list[float]]
    bias: list[float]
    temperature: float
    threshold: float


def variants(template: str, fillers: list[str], rng: random.Random, n: int) -> list[list[str]]:
    """Word lists made from a template: words lost, ends cut, other version numbers,
    other words around it."""
    words = tokens_of(template)
    out = [words]
    for _ in range(n - 1):
        kept = [w for w in words if rng.random() > 0.08] or words
        kept = [rng.choice(VERSIONS) if w[0].isdigit() and rng.random() < 0.7 else w for w in kept]
        if len(kept) > 12 and rng.random() < 0.5:
            at = rng.randint(0, len(kept) // 3)
            kept = kept[at : at + max(10, int(len(kept) * 0.7))]
        head = rng.choice(OPENINGS).split()
        if len(words) <= 12 and rng.random() < 0.5:
            short = [w for w in kept if w not in ("licensed", "released", "under", "this", "work", "is")]
            kept = [*head, *short]
        before = [rng.choice(fillers) for _ in range(rng.choice((0, 0, 3, 12)))]
        after = [rng.choice(fillers) for _ in range(rng.choice((0, 0, 3, 12)))]
        out.append([*before, *kept, *after])
    return out


def fit(paragraphs: list[str], seed: int = 3) -> LicenseModel:
    """Fit, calibrate and thin out the model; ``paragraphs`` are examples of corpus text."""
    rng = random.Random(seed)
    pairs = [set(zip(w, w[1:])) for texts in TEMPLATES.values() for t in texts for w in [tokens_of(t)]]
    triples = {t for texts in TEMPLATES.values() for x in texts for w in [tokens_of(x)] for t in zip(w, w[1:], w[2:])}
    plain = []
    for p in paragraphs[:PARAGRAPHS]:
        words = tokens_of(p)
        own = set(zip(words, words[1:]))
        if NAMED.search(p.lower()):
            continue
        fragment = len(triples.intersection(zip(words, words[1:], words[2:]))) > 1
        if not fragment and not any(len(own & t) >= CONFIRM * len(t) for t in pairs):
            plain.append(words)
    fillers = [w for words in plain for w in words[:50]] or tokens_of(" ".join(OTHER))
    families = [*TEMPLATES, UNKNOWN]
    rows: list[tuple[list[str], int]] = []
    for k, texts in enumerate(TEMPLATES.values()):
        rows += [(v, k) for t in texts for v in variants(t, fillers, rng, VARIANTS if len(tokens_of(t)) > 3 else SHORT_VARIANTS)]
    positive = len(rows)
    for sentence in OTHER:
        rows += [(v, len(TEMPLATES)) for v in variants(sentence, fillers, rng, 20)]
    for words, _ in rng.sample(rows[:positive], min(positive, 200)):
        rows.append((rng.sample(words, len(words)), len(TEMPLATES)))
    rows += [(words, len(TEMPLATES)) for words in plain]

    met = Counter(w for words in plain for w in set(words))
    common = {w for w, n in met.items() if n > max(1, 0.004 * len(plain))}
    common |= set("the of and to in is a for by at with or it this that you may not be are".split())
    anchors = {w for texts in TEMPLATES.values() for t in texts for w in tokens_of(t)} - common
    bags = [{g for g in grams_of(words) if anchors & set(g.split())} for words, _ in rows]
    support = Counter(g for bag, (_, k) in zip(bags, rows) if k < len(TEMPLATES) for g in bag)
    vocabulary = sorted(g for g, n in support.items() if n >= 5)
    place = {g: i for i, g in enumerate(vocabulary)}
    x = np.zeros((len(rows), len(vocabulary)), np.float32)
    for i, bag in enumerate(bags):
        x[i, [place[g] for g in bag if g in place]] = 1
    y = np.array([k for _, k in rows])
    test = np.array([rng.random() < 0.25 for _ in rows])
    w, b = _sparse_softmax(x[~test], y[~test], len(families))
    logits = x[test] @ w + b
    temperature = min((_nll(logits / t, y[test]), t) for t in np.linspace(0.3, 3, 28))[1]
    probs = _softmax(logits / temperature)
    best, top = probs.argmax(1), probs.max(1)
    wrong = top[(y[test] == len(TEMPLATES)) & (best != len(TEMPLATES))]
    threshold = float(np.clip(np.quantile(wrong, 0.9), 0.5, 0.9)) if len(wrong) else 0.5
    used = {g: [round(float(v), 5) for v in w[i]] for g, i in place.items() if np.abs(w[i]).max() > 1e-4}
    needed = sorted({a for g in used for a in g.split() if a in anchors})
    return LicenseModel(families, needed, used, [float(v) for v in b], float(temperature), threshold)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _nll(z: np.ndarray, y: np.ndarray) -> float:
    return float(-np.log(_softmax(z)[np.arange(len(y)), y] + 1e-12).mean())


def _sparse_softmax(x: np.ndarray, y: np.ndarray, k: int, l1: float = 2e-4, rounds: int = 250):
    """Accelerated proximal gradient for softmax regression with an L1 penalty."""
    w, b = np.zeros((x.shape[1], k), np.float32), np.zeros(k, np.float32)
    mw, mb, t = w.copy(), b.copy(), 1.0
    target = np.eye(k, dtype=np.float32)[y]
    rate = 4.0 / max(1.0, float((x * x).sum(axis=1).mean()))
    for _ in range(rounds):
        error = (_softmax(x @ mw + mb) - target) / len(x)
        new = mw - rate * 10 * (x.T @ error)
        new = np.sign(new) * np.maximum(np.abs(new) - rate * 10 * l1, 0)
        bias = mb - rate * 10 * error.sum(axis=0)
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        mw, mb = new + (t - 1) / nt * (new - w), bias + (t - 1) / nt * (bias - b)
        w, b, t = new, bias, nt
    return w, b


def pieces_of(text: str) -> list[str]:
    """What a scan of the text looks at: its paragraphs of several lines, and its lines."""
    out = []
    for paragraph in re.split(r"\n(?:[^\w\n]*\n)+", text):
        lines = [line for line in paragraph.split("\n") if line.strip()]
        out += [*lines, paragraph] if len(lines) > 1 else lines
    return out


def train(docs: DataFrame, text_col: str, sample: int = SAMPLE) -> LicenseModel:
    """Fit on pieces of at most ``sample`` texts, chosen by a hash of the text."""
    texts = docs.filter(F.col(text_col).isNotNull()).select(F.lit(0).alias("all"), F.col(text_col).alias("t"))
    rows = bounded_sample(texts, "all", sample, "t")
    return fit([piece for r in rows for piece in pieces_of(r["t"])])


def _fixed(value: object, kind: str) -> Column:
    """A constant of any shape; Spark folds it once."""
    return F.from_json(F.lit(json.dumps({"v": value})), f"struct<v:{kind}>")["v"]


def _tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def _grams(words: Column) -> Column:
    two = F.zip_with(words, F.slice(words, 2, F.greatest(F.size(words), F.lit(1))), lambda a, b: F.concat_ws(" ", a, b))
    three = F.zip_with(two, F.slice(words, 3, F.greatest(F.size(words), F.lit(1))), lambda a, b: F.concat_ws(" ", a, b))
    return F.concat(words, two, three)


FOUND = "struct<paragraph:int,family:string,probability:double,confirmed:boolean,template:string,containment:double>"


def scan_licenses(docs: DataFrame, text_col: str, model: LicenseModel, out: str = "licenses") -> DataFrame:
    """Adds ``out``, an array with one entry per paragraph and licence that it names: the
    paragraph's number, the family, the calibrated probability, and the closest template of
    the family with the share of its word pairs that the paragraph holds.

    Paragraphs end at blank lines.  Each is read line by line, and as a whole across its line
    ends, as notices are often wrapped; a line that joins names by ``OR`` or ``AND`` names each.  The whole counts if a template confirms it or no line
    names a licence; a line that nothing confirms is then a fragment if it holds a word pair
    of that template.  Of several finds of one family the closest to a template stays.

    A text without any word of the model has no licence, and neither has a paragraph without
    one: with no feature, only the constant speaks, for ``unknown``.  Null and empty texts
    give an empty array.  Rows stay as they are; a column of the same name is replaced.
    """
    anchors = _fixed(model.anchors, "array<string>")
    vocabulary = _fixed(sorted(model.weights), "array<string>")
    weights = _fixed(model.weights, "map<string,array<double>>")
    bias = _fixed(model.bias, "array<double>")
    families = _fixed(model.families, "array<string>")
    compared = [
        {"family": f, "id": f"{f}-{i + 1}", "pairs": sorted({" ".join(p) for w in [tokens_of(t)] for p in zip(w, w[1:])})}
        for f, texts in TEMPLATES.items() for i, t in enumerate(texts)
    ]
    templates = _fixed(compared, "array<struct<family:string,id:string,pairs:array<string>>>")
    none = F.array().cast(f"array<{FOUND}>")

    # Each step adds to the struct what the next one reads more than once, so that nothing is
    # computed again inside a lambda.
    def grammed(piece: Column) -> Column:
        return F.struct(piece.at.alias("paragraph"), piece.whole.alias("whole"), F.array_distinct(_grams(piece.words)).alias("grams"))

    def voted(piece: Column) -> Column:
        logits = F.aggregate(
            F.array_intersect(piece.grams, vocabulary), bias,
            lambda acc, g: F.zip_with(acc, F.element_at(weights, g), lambda a, b: a + b))
        return F.struct(piece.paragraph.alias("paragraph"), piece.whole.alias("whole"), piece.grams.alias("grams"), logits.alias("logits"))

    def classify(piece: Column) -> Column:
        top = F.array_max(piece.logits)
        total = F.aggregate(piece.logits, F.lit(0.0), lambda a, v: a + F.exp((v - F.array_max(piece.logits)) / F.lit(model.temperature)))
        family = F.element_at(families, F.array_position(piece.logits, top).cast("int"))
        return F.struct(piece.paragraph.alias("paragraph"), piece.whole.alias("whole"), family.alias("family"),
                        (1 / total).alias("probability"), piece.grams.alias("grams"))

    def held_by(piece: Column) -> Column:
        own = F.filter(templates, lambda t: t.family == piece.family)
        held = F.array_max(F.transform(own, lambda t: F.struct(
            (F.size(F.array_intersect(t.pairs, piece.grams)) / F.size(t.pairs)).alias("share"), t.id.alias("id"), t.pairs.alias("pairs"))))
        return F.struct(piece.alias("piece"), held.alias("held"))

    def compare(x: Column) -> Column:
        # in the order of preference among finds of a family
        return F.struct(x.held.share.alias("containment"), x.piece.probability.alias("probability"),
                        x.held.id.alias("template"), x.piece.whole.alias("whole"), x.piece.paragraph.alias("paragraph"),
                        x.piece.family.alias("family"), x.piece.grams.alias("grams"), x.held.pairs.alias("pairs"))

    def counts(find: Column) -> Column:
        lines = F.exists("_finds", lambda d: (d.paragraph == find.paragraph) & ~d.whole)
        fragment = F.exists("_finds", lambda d: (
            (d.paragraph == find.paragraph) & d.whole & (d.containment >= CONFIRM) & F.arrays_overlap(find.grams, d.pairs)))
        return (find.containment >= CONFIRM) | F.when(find.whole, ~lines).otherwise(~fragment)

    def best(name: Column) -> Column:
        return F.array_max(F.filter("_kept", lambda c: (c.paragraph == name.paragraph) & (c.family == name.family)))

    def piece(text: Column, at: Column, whole: bool) -> Column:
        return F.struct(at.alias("at"), F.lit(whole).alias("whole"), text.alias("text"))

    def named(line: Column) -> Column:
        """A line that joins names by OR or AND is read as one line for each."""
        head, names = F.regexp_extract(line, CHOICE, 1), F.split(F.regexp_extract(line, CHOICE, 2), JOINED)
        one_each = F.transform(names, lambda n: F.concat(head, F.lit(" "), n))
        return F.when(line.rlike(CHOICE), one_each).otherwise(F.array(line))

    def read(p: Column) -> Column:
        told = F.flatten(F.transform(F.split(p.text, "\n"), named))
        lines = F.transform(F.filter(told, lambda t: t.rlike("[a-zA-Z0-9]")), lambda t: piece(t, p.at, False))
        return F.when(F.size(lines) > 1, F.concat(lines, F.array(piece(p.text, p.at, True)))).otherwise(lines)

    def worded(p: Column) -> Column:
        return F.struct(p.at.alias("at"), p.whole.alias("whole"), _tokens(p.text).alias("words"))

    # one projection per step: as one expression, it is nested too deeply for the analyzer
    paragraphs = F.transform(F.split("_text", BLANK), lambda t, i: F.struct(i.alias("at"), t.alias("text")))
    steps = {
        "_likely": F.when(F.arrays_overlap(_tokens(F.col("_text")), anchors),
                          F.filter(paragraphs, lambda p: F.arrays_overlap(_tokens(p.text), anchors))),
        "_pieces": F.transform(F.flatten(F.transform("_likely", read)), worded),
        "_grams": F.transform(F.filter("_pieces", lambda p: F.arrays_overlap(p.words, anchors)), grammed),
        "_votes": F.transform("_grams", voted),
        "_sure": F.filter(F.transform("_votes", classify), lambda c: (c.family != UNKNOWN) & (c.probability >= model.threshold)),
        "_held": F.transform("_sure", held_by),
        "_finds": F.transform("_held", compare),
        "_kept": F.filter("_finds", counts),
        "_names": F.array_distinct(F.transform("_kept", lambda c: F.struct(c.paragraph.alias("paragraph"), c.family.alias("family")))),
        "_best": F.transform("_names", best),
    }
    found = F.transform("_best", lambda c: F.struct(
        c.paragraph.alias("paragraph"), c.family.alias("family"), c.probability.alias("probability"),
        (c.containment >= CONFIRM).alias("confirmed"), c.template.alias("template"), c.containment.alias("containment")))
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"), docs[text_col].alias("_text"))
    for name, step in steps.items():
        rows = rows.select("*", step.alias(name))
    kept = [F.col("_row").getField(c).alias(c) for c in docs.columns if c != out]
    return rows.select(*kept, F.coalesce(found, none).alias(out))


def license_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: how many paragraphs it has and how many name a licence, the families
    in order, and the paragraphs that a template confirms."""
    model = train(docs, text_col)
    found = scan_licenses(docs.select(id_col, text_col), text_col, model, "_found")
    return found.select(
        id_col,
        F.coalesce(F.size(F.split(F.col(text_col), BLANK)), F.lit(0)).cast("long").alias("n_paragraphs"),
        F.size("_found").cast("long").alias("n_licenses"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("_found", lambda c: c.family))), ",").alias("families"),
        F.size(F.filter("_found", lambda c: c.confirmed)).cast("long").alias("n_confirmed"),
        F.round(F.array_min(F.transform("_found", lambda c: c.probability)), 6).alias("least_probability"),
    )
