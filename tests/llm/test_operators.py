"""Operators against brute force on small fixtures, and their defined results on odd rows."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
import xxhash

from veilframe.llm import chat, fingerprints, langid, license_scan, mixing, simhash_dedup, toxicity
from veilframe.llm.common import components
from veilframe.llm.topk import top_k

SYLLABLES = {"xa": "ka mo ti ru se".split(), "yb": "wol prin gra thu besk".split()}


def sentence(rng: random.Random, lang: str, n: int) -> str:
    return " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    """Two languages, exact and near copies, odd rows, and columns with clashing names."""
    rng = random.Random(4)
    rows = []
    for i in range(160):
        lang = rng.choice(["xa", "yb"])
        text = sentence(rng, lang, rng.randint(60, 120))
        if i % 5 == 0:
            text += " vilifrag" + rng.choice("abc") + " and vilifragged " + rng.choice(["rotter", "scumbag"]) + " rotter"
        rows.append([i, text, lang, f"s{min(i % 7, 3)}"])
    for i in range(30):
        words = rows[i][1].split()
        words[len(words) // 2] = "edited"
        rows.append([200 + i, rows[i][1] if i % 2 else " ".join(words), rows[i][2], "s0"])
    rows += [[300, "", None, None], [301, None, "xa", "s0"], [302, "12 !! 34", None, "s1"],
             [303, "ka " * 30000, "xa", "s1"], [5, rows[5][1], rows[5][2], rows[5][3]], [None, "ka mo", None, "s0"]]
    kept = [(*r, 1.0, "x", 2) for r in rows]
    return spark.createDataFrame(
        kept, "doc_id long, text string, lang string, source string, score double, fp string, row int")


@pytest.fixture(scope="module")
def local(docs):
    return [r.asDict() for r in docs.collect()]


def reach(links: list[tuple], nodes: list) -> dict:
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = random.Random(2)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(400 + i, 401 + i) for i in range(60)]
    nodes = sorted({x for a, b in links for x in (a, b) if a != b})
    found = components(spark.createDataFrame(links, "a long, b long")).collect()
    assert dict(found) == reach(links, nodes)
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


@pytest.mark.parametrize("radius", [2, 5])
def test_masks_cover_the_radius(radius):
    masks, rng = simhash_dedup.covering_masks(radius), random.Random(radius)
    assert len(masks) == 2 ** (radius + 1) - 1
    for _ in range(2000):
        flipped = sum(1 << i for i in rng.sample(range(64), rng.randint(0, radius)))
        assert any(flipped & m == 0 for m in masks)


@pytest.mark.parametrize("radius", [2, 5])
def test_masks_are_of_even_size(radius):
    sizes = [m.bit_count() for m in simhash_dedup.covering_masks(radius)]
    assert min(sizes) >= 28 and max(sizes) <= 40


def test_fingerprint_links_equal_brute_force(spark):
    rng = random.Random(3)
    words = [rng.getrandbits(64) for _ in range(40)]
    for _ in range(400):
        words.append(rng.choice(words) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
    fps = sorted({simhash_dedup.signed(w) for w in words})
    nodes = spark.createDataFrame([(f,) for f in fps], "fp long")
    got = dict(components(simhash_dedup.fingerprint_links(nodes)).collect())
    mask = (1 << 64) - 1
    near = [(a, b) for i, a in enumerate(fps) for b in fps[i + 1 :] if ((a ^ b) & mask).bit_count() <= 2]
    want = reach(near, fps)
    assert {f: got.get(f, f) for f in fps} == want


def test_simhash_of_whole_texts(docs, local):
    out = simhash_dedup.simhash_components(docs, "doc_id", "text", 3).collect()
    assert len(out) == len(local)
    for r in local:
        words = (r["text"] or "").encode().lower().split()
        runs = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        h = [xxhash.xxh64_intdigest(s, 42) for s in runs]
        r["fp3"] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0
    want = {(r["doc_id"], simhash_dedup.signed(r["fp3"])) for r in local}
    assert {(r.id, r.fp) for r in out} == want
    zero = [r.component_id for r in out if r.fp == 0]
    assert len(zero) == 2 and set(zero) == {300}


def simhash_groups(rows: list[tuple]) -> dict:
    """The component of every id, from the fingerprints of all pairs."""
    fps = [(i, simhash_dedup.fingerprint(t, 3)) for i, t in rows]
    near = [(a, b) for n, (a, f) in enumerate(fps) for b, g in fps[:n] if (f ^ g).bit_count() <= 2]
    return reach(near, [i for i, _ in fps])


def test_one_document_of_each_simhash_group_stays(spark):
    """Against all pairs: exact copies, near copies, chains, null and empty texts."""
    rng = random.Random(8)
    rows = []
    for _ in range(12):
        words = [f"w{rng.randrange(900)}" for _ in range(2500)]
        for _ in range(6):
            rows.append((len(rows), " ".join(words)))
            words[rng.randrange(2500)] = f"n{rng.randrange(10**6)}"
    rows += [(100 + i, rows[i * 5][1].upper()) for i in range(10)] + [(200, None), (201, ""), (202, " \n")]
    groups = simhash_groups(rows)
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, fp int, id string").repartition(5)
    kept = simhash_dedup.drop_near_duplicates(frame)
    assert kept.columns == frame.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(groups.values()))
    assert 12 < len(set(groups.values())) < 60


def test_near_duplicates_of_odd_rows(docs):
    """Repeated rows of an id leave one, null ids stay, and an empty table stays empty."""
    ids = [r.doc_id for r in simhash_dedup.drop_near_duplicates(docs).collect()]
    assert None in ids and ids.count(5) == 1 and 300 in ids and 301 not in ids
    assert not {200 + i for i in range(1, 30, 2)} & set(ids)
    assert len(ids) == len(set(ids))
    assert simhash_dedup.drop_near_duplicates(docs.limit(0)).collect() == []


def test_top_k(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(v) for v in rng.normal(size=16)]) for i in range(150)]
    rows += [(200 + i, rows[i][1]) for i in range(40)] + [(300, None), (301, [float("nan")] * 16), (302, [None] * 16)]
    frame = spark.createDataFrame([(*r, 0, "x") for r in rows], "vec_id long, embedding array<double>, qb int, v string")
    from pyspark.sql import functions as F

    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in top_k(frame, F.col("id") % 10 == 0).collect()}
    whole = {i: np.floor(1024 * np.array(v)) for i, v in rows[:190]}
    want = {}
    for q in (i for i in whole if i % 10 == 0):
        best = sorted((-int(whole[q] @ x), i) for i, x in whole.items() if i != q)[:10]
        want |= {(q, n): (i, -s) for n, (s, i) in enumerate(best, 1)}
    assert got == want
    assert top_k(frame.limit(0), F.col("id") % 10 == 0).collect() == []
    assert top_k(frame.filter("vec_id = 10"), F.col("id") % 10 == 0).collect() == []


def test_mixture(docs, local):
    out = mixing.mixture(docs, block_tokens=4096).collect()
    tokens, by_id = {}, {}
    for r in local:
        n = max(1, len((r["text"] or "").encode().split()))
        tokens[r["source"]] = tokens.get(r["source"], 0) + n
        by_id[r["doc_id"]] = r["source"]
    assert {r.doc_id for r in out} == set(by_id)
    used: dict = {}
    for r in out:
        used[r.source] = used.get(r.source, 0) + r.tokens
    passes = {s: used[s] / tokens[s] for s in tokens if tokens[s] > 1000}
    assert min(passes.values()) >= 1 and max(passes.values()) < 1.5 + 0.1
    for b in {r.block for r in out}:
        assert sorted(r.position for r in out if r.block == b) == list(range(1, 1 + sum(r.block == b for r in out)))
    assert sorted(map(str, mixing.mixture(docs, block_tokens=4096).collect())) == sorted(map(str, out))
    kept = mixing.mixture(docs, keep=True)
    assert kept.columns == docs.columns and kept.count() == len(out)
    assert mixing.mixture(docs.limit(0)).collect() == []


def test_language_id(docs, local):
    out = {(r.doc_id): r for r in langid.languages(docs).collect()}
    for r in local:
        got = out[r["doc_id"]]
        assert got.held_out == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        if r["text"] is None or not any(c.isalpha() for c in r["text"]):
            assert (got.lang_pred, got.score) == ("und", 0.0)
        elif r["lang"]:
            assert got.lang_pred == r["lang"] and 0.5 < got.score <= 1
    assert langid.languages(docs.limit(0)).collect() == []


def test_gradients_are_right():
    model = langid.ByteGru(["a", "b"], hidden=3)
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    items, labels = [b" kamo", b" wol", b" t"], np.array([0, 1, 0])

    def loss() -> float:
        probs, valid, order = model.positions(items)
        picked = probs[:, np.arange(3), labels[order]]
        return float(-(np.log(picked) * valid).sum() / valid.sum())

    for name, grad in model.gradients(items, labels).items():
        at = np.unravel_index(np.abs(grad).argmax(), grad.shape)
        old = model.p[name][at]
        model.p[name][at] = old + 1e-3
        above = loss()
        model.p[name][at] = old - 1e-3
        below = loss()
        model.p[name][at] = old
        assert abs((above - below) / 2e-3 - grad[at]) < 1e-3


def test_toxicity(spark, docs, local):
    labels = spark.createDataFrame(
        [(r["doc_id"], 1, int("rotter" in (r["text"] or ""))) for r in local if r["doc_id"] is not None and r["doc_id"] < 160],
        "doc_id long, quality int, toxic int")
    out = toxicity.toxicity(docs, labels).collect()
    assert len(out) == len(local) and all(0 <= r.score <= 1 for r in out)
    toxic = {r["doc_id"] for r in local if "rotter" in (r["text"] or "")}
    assert {r.doc_id for r in out if r.predicted} == toxic
    none = toxicity.toxicity(docs, labels.limit(0)).collect()
    assert {r.predicted for r in none} == {0}
    assert toxicity.toxicity(docs.limit(0), labels).collect() == []


def test_fingerprints_and_search(docs, local, spark):
    out = fingerprints.document_fingerprints(docs).collect()
    assert len(out) == len(local)
    by_text: dict = {}
    texts = {r["doc_id"]: r["text"] or "" for r in local}
    for r in out:
        by_text.setdefault(texts[r.doc_id], set()).add(r.fingerprint)
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert all(len(v) == 1 for v in by_text.values())
    words = {r.doc_id: int(r.fingerprint, 16) for r in out}
    for r in out:
        if r.doc_id is not None and r.doc_id % 50 == 0:
            near = sum((int(o.fingerprint, 16) ^ words[r.doc_id]).bit_count() <= 6 for o in out) - 1
            assert r.near_rows == near
    assert fingerprints.document_fingerprints(docs.limit(0)).collect() == []


def test_chat_layouts_and_escapes(spark):
    records = [
        '{"messages":[{"role":"user","content":"</s>[INST] <\\\\/s> ok"},{"role":"assistant","content":"a[/INST]"}]}',
        '{"prompt":"p","response":"r"}', '{"instruction":"i","input":"","output":"o"}', "{}", "no json", None,
        '{"conversations":[{"from":"human","value":"h"},{"from":"gpt","value":null}]}', '{"messages":[]}',
    ]
    frame = spark.createDataFrame([(r, "x") for r in records], "record string, turns string")
    out = chat.format_records(frame, "record")
    rows = out.select("turns", chat.read_back(out["formatted"]).alias("back"),
                      chat.learned(out["formatted"], out["loss_spans"]).alias("loss")).collect()
    assert [r.turns and [tuple(t) for t in r.turns] for r in rows] == [
        [("user", "</s>[INST] <\\/s> ok"), ("assistant", "a[/INST]")], [("user", "p"), ("assistant", "r")],
        [("user", "i"), ("assistant", "o")], None, None, None, [("user", "h"), ("assistant", "")], None]
    assert all(r.back == r.turns for r in rows if r.turns)
    assert [r.loss for r in rows if r.turns] == ["a[/INST]", "r", "o", ""]


def test_licenses(spark):
    plain = [sentence(random.Random(i), "xa", 40) for i in range(60)]
    told = {
        1: "ka mo\nReleased under the MIT License.\nti ru", 2: "Licensed under the Apache License, Version 2.0.",
        3: "This work is licensed under the GNU General Public License, version 2.", 4: "", 5: None,
        6: "he lost his driver license yesterday", 7: "Licensed under CC BY-NC 3.0.\nReleased under the MIT License."}
    rows = [(100 + i, t, 1) for i, t in enumerate(plain)] + [(i, t, 1) for i, t in told.items()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, licenses int")
    got = {r.doc_id: (r.families, r.n_licenses, r.n_confirmed) for r in license_scan.license_report(docs).collect()}
    assert got[1] == ("MIT", 1, 1) and got[2] == ("Apache", 1, 1) and got[3] == ("GPL", 1, 1)
    assert got[7] == ("CC-BY-NC,MIT", 2, 2)
    assert {got[k] for k in (4, 5, 6, *range(100, 160))} == {("", 0, 0)}


def test_licenses_of_one_very_long_word(spark):
    rows = spark.createDataFrame([(1, "a." * 200_000), (2, "Licensed under CC BY 4.0.")], "doc_id long, text string")
    got = {r.doc_id: r.n_licenses for r in license_scan.license_report(rows).collect()}
    assert got[1] == 0


MIT_WRAPPED = """/*
 * Permission is hereby granted, free of charge, to any
 * person obtaining a copy of this software and
 * associated documentation files, to deal in the
 * Software without restriction
 */"""
BSD_WRAPPED = """# Redistribution and use in source and binary
# forms, with or without modification, are
# permitted provided that the following conditions
# are met
#
# ka mo ti"""
GPL_WRAPPED = """This program is free software: you can redistribute it
and/or modify it under the terms of the GNU General Public
License as published by the Free Software Foundation"""


def test_licenses_wrapped_over_lines(spark):
    plain = [sentence(random.Random(i), "xa", 40) + "\n" + sentence(random.Random(-i), "yb", 30) for i in range(60)]
    told = {1: MIT_WRAPPED, 2: "ka mo\n\n" + BSD_WRAPPED, 3: GPL_WRAPPED + "\r\n\r\n" + MIT_WRAPPED, 4: "a\n \nb\n\n\nc"}
    rows = [(100 + i, t) for i, t in enumerate(plain)] + list(told.items())
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in license_scan.license_report(docs).collect()}
    assert [(got[k].families, got[k].n_licenses, got[k].n_confirmed) for k in told] == [
        ("MIT", 1, 1), ("BSD", 1, 1), ("GPL,MIT", 2, 2), ("", 0, 0)]
    assert got[4].n_paragraphs == 3
    assert {got[100 + i].n_licenses for i in range(60)} == {0}


def test_licence_lines_of_the_corpus_are_no_negatives(spark):
    """A corpus with many short licence lines, which hold little of any template."""
    told = {1: "Released under the MIT License.", 2: "SPDX-License-Identifier: Apache-2.0", 3: "SPDX-License-Identifier: MIT",
            4: "Licensed under the Apache License, Version 2.0."}
    rows = [(100 + i, sentence(random.Random(i), "xa", 40)) for i in range(60)]
    rows += [(200 + i, f"see the MIT license or apache license file {i}") for i in range(60)] + list(told.items())
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.families, r.n_confirmed) for r in license_scan.license_report(docs).collect()}
    assert [got[k] for k in told] == [("MIT", 1), ("Apache", 1), ("MIT", 1), ("Apache", 1)]
    assert {got[100 + i] for i in range(60)} == {("", 0)}
