"""Top-k by row and mixing weights against plain models; bounded samples of repeated rows."""

from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilframe.llm import mixing, topk, toxicity
from veilframe.llm.common import bounded_sample


def test_top_k_by_row(spark, monkeypatch):
    """Repeated ids, repeated vectors, ties and several blocks, against all pairs of rows."""
    monkeypatch.setattr(topk, "QUERY_BLOCK", 7)
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", 40)
    rng = np.random.default_rng(2)
    rows = [(i, [float(v) for v in rng.normal(size=20).round(1)]) for i in range(200)]
    rows += [(10, rows[11][1]), (10, rows[10][1]), (20, rows[20][1]), (300, rows[4][1]), (310, [0.0] * 20), (320, [1.0, 2.0]), (330, [2.0, 1.0])]
    frame = spark.createDataFrame([(*r, "x", 5) for r in rows], "vec_id long, embedding array<double>, row string, query_id int")
    whole = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows]
    want = []
    for n, (i, v) in enumerate(whole):
        if i % 10 == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w)), j) for m, (j, w) in enumerate(whole) if m != n and len(w) == len(v))
            want += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scored[:10])]
    got = topk.top_k(frame, F.col("id") % 10 == 0).select("query_id", "rank", "vec_id", "score")
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def test_levels_bound_the_products_and_prune():
    rng = np.random.default_rng(3)
    x = np.floor(1024 * rng.normal(size=(500, 64)) * np.linspace(2, 0.1, 64))
    for s in topk.SEGMENTS:
        level = topk.Level(x, s)
        bounds = level.lower_bounds(level.values[7], level.squares[7], np.arange(500))
        exact = ((x - x[7]) ** 2).sum(1)
        assert (bounds <= exact * (1 + 1e-9) + 1e-6).all()


def entropy_of(shares: list[float], a: float) -> float:
    w = [s**a for s in shares]
    return -sum(x / sum(w) * math.log(x / sum(w)) for x in w)


@pytest.mark.parametrize(
    ("tokens", "entropy", "repeats", "budget"),
    [((900, 60, 30, 10), 0.8, None, None), ((900, 60, 30, 10), 0.95, 3.0, None), ((110, 100, 95, 90), 0.95, None, None),
     ((110, 100, 95, 90), 0.95, 1.5, None), ((300, 200, 100, 50), 0.9, 2.0, 1.5), ((50, 50, 50), 0.9, None, None), ((80, 70), None, 1.1, None)])
def test_exponent_meets_the_target(spark, tokens, entropy, repeats, budget):
    """Either the entropy is the target, or the limit on repeats has stopped the exponent."""
    rows = [(f"s{i}", "w " * n) for i, n in enumerate(tokens)]
    by_source = mixing.shares(spark.createDataFrame([(s, len(t.split())) for s, t in rows], "source string, tokens long"))
    a = mixing.exponent(by_source, entropy, repeats, budget)
    shares = [n / sum(tokens) for n in tokens]
    w = [s**a for s in shares]
    ratio = [x / s for x, s in zip(w, shares)]
    passes = max(ratio) / (min(ratio) if budget is None else sum(w) / budget)
    off = 0 if entropy is None else entropy_of(shares, a) - entropy * math.log(len(tokens))
    if len(set(tokens)) == 1:
        assert a == 1.0
    elif repeats is not None and passes > repeats * 0.99:
        assert passes <= repeats * 1.001
    else:
        assert abs(off) < 0.01, (a, off)
    natural = 0 if entropy is None else entropy_of(shares, 1.0) - entropy * math.log(len(tokens))
    assert a == 1.0 or (a > 1) == (natural > 0)


def test_sharpened_sources_repeat(spark):
    """Sources that are more even than the target: greater ones come more than once."""
    rng = random.Random(9)
    sizes = {"a": 60, "b": 54, "c": 50, "d": 44}
    rows = [(n, " ".join("w" for _ in range(10)), s) for n, s in enumerate(x for x, k in sizes.items() for _ in range(k))]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    used = mixing.mixture(docs, block_tokens=400).collect()
    counts = Counter(r.doc_id for r in used)
    assert set(counts) == {r[0] for r in rows} and set(counts.values()) == {1, 2}
    by_source = Counter(r.source for r in used)
    assert by_source["d"] == sizes["d"] and 1.3 < by_source["a"] / sizes["a"] <= 1.55
    assert by_source["a"] / sizes["a"] > by_source["b"] / sizes["b"] > by_source["c"] / sizes["c"] >= 1
    order = [(r.block, r.position) for r in used]
    assert len(order) == len(set(order))


def test_samples_of_repeated_rows_are_bounded(spark):
    """A text on most rows comes once, and null keys count as one."""
    rows = [("same", "x")] * 3000 + [(None, "x")] * 500 + [(f"t{i}", "xy"[i % 2]) for i in range(400)]
    df = spark.createDataFrame(rows, "t string, g string").repartition(6)
    drawn = bounded_sample(df, "g", 100, "t")
    keys = [(r.g, r.t) for r in drawn]
    assert len(keys) == len(set(keys)) and max(Counter(g for g, _ in keys).values()) <= 100


def test_many_voters_take_part():
    """Each toxic row is met by a voter of its own, of which there are over three hundred."""
    texts = [f"common words vile{i:03d} vile{i:03d}x here" for i in range(320) for _ in range(3)] + [f"common words plain{i} here" for i in range(960)]
    toxic = np.array([1] * 960 + [0] * 960)
    weight = np.ones(len(texts))
    terms = toxicity.select_terms(texts, toxic, weight)
    model = toxicity.ToxicityModel(terms, np.zeros(len(terms) + 4))
    x = np.array([model.row(model.features(t)) for t in texts])
    q = toxicity.label_model(np.column_stack([x[:, : len(terms)], x[:, -3:] >= 0.5]), toxic, weight)
    model.beta = toxicity.logistic(x, q, weight)
    scores = np.array([model.score(t) for t in texts])
    assert scores[:960].min() >= 0.7 > scores[960:].max()
