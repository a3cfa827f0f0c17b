"""Toxicity by weak supervision.

1. Labelled training rows give many voters: words (lexicon voters) and word stems (pattern
   voters) that occur in toxic rows and hardly elsewhere, and voters on how many of them meet.
2. A generative label model, fitted by expectation maximisation, estimates how often each
   voter fires on toxic and on clean rows and how far voters depend on each other; votes of
   correlated voters weigh less.  The given label is one more voter.
3. A linear classifier is trained on the posterior labels and scores every whole text.
"""

from __future__ import annotations

import heapq
import re
from collections import Counter
from collections.abc import Collection, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.llm.common import bounded_sample, held_out

WORD = re.compile(r"\w+")
STEMS = range(3, 8)
SAMPLE = 3000  # labelled rows of each class that training may use
TERMS = 400  # voters that the label model and the classifier know
THRESHOLD = 0.7


def words_of(text: str | None) -> set[str]:
    return set(WORD.findall(text.lower())) if text else set()


def stems_of(words: Iterable[str], n: int) -> Iterator[str]:
    """Stems of ``n`` letters (``stem*``), and those that two words share (``stem**``)."""
    for stem, count in Counter(w[:n] for w in words if len(w) > n).items():
        yield stem + "*"
        if count > 1:
            yield stem + "**"


def known_terms(words: Collection[str], known: Collection[str]) -> set[str]:
    """The words and stems that are among ``known``."""
    found = {w for w in words if w in known}
    for n in STEMS:
        found.update(t for t in stems_of(words, n) if t in known)
    return found


def select_terms(texts: list[str | None], toxic: np.ndarray, weight: np.ndarray, most: int = TERMS) -> list[str]:
    """Terms that tell toxic rows, chosen so that each toxic row is met by several.

    Rare terms are dropped kind by kind, so that only one kind's are held at a time.
    """
    bags = {i: tuple(words_of(texts[i])) for i in np.flatnonzero(toxic)}
    least = max(2, int(0.004 * toxic.sum()))
    hits: dict[str, int] = {}
    for n in (0, *STEMS):
        met = Counter(t for bag in bags.values() for t in (stems_of(bag, n) if n else bag))
        hits.update((t, k) for t, k in met.items() if k >= least)
    misses: Counter = Counter()
    for i in np.flatnonzero(toxic == 0):
        for t in known_terms(words_of(texts[i]), hits):
            misses[t] += weight[i]
    positives, negatives = toxic.sum(), weight[toxic == 0].sum()
    odds = {
        t: np.log((n + 0.5) / (positives + 1)) - np.log((misses[t] + 0.5) / (negatives + 1))
        for t, n in hits.items()
    }
    good = [t for t, o in odds.items() if o > 2.5 and misses[t] <= 0.1 * hits[t]]
    where: dict[str, list[int]] = {t: [] for t in good}
    for i, bag in bags.items():
        for t in known_terms(bag, where):
            where[t].append(i)
    need = np.where(toxic == 1, 4, 0)
    queue = [(-len(where[t]) * min(1.0, odds[t] / 6), len(t), t) for t in good]
    heapq.heapify(queue)
    chosen: list[str] = []
    while queue and len(chosen) < most:
        # gains only shrink, so a best one that is out of date is measured anew
        worth, size, t = heapq.heappop(queue)
        gain = float((need[where[t]] > 0).sum()) * min(1.0, odds[t] / 6)
        if gain < -worth:
            if gain >= 1:
                heapq.heappush(queue, (-gain, size, t))
            continue
        chosen.append(t)
        need[where[t]] -= 1
    return chosen


def label_model(votes: np.ndarray, gold: np.ndarray, weight: np.ndarray, rounds: int = 25) -> np.ndarray:
    """Posterior of class 1 for each row of 0/1 votes, with ``gold`` as one more voter."""
    votes = np.column_stack([votes, gold]).astype(np.float64)
    q = 0.9 * gold + 0.05
    for _ in range(rounds):
        w1, w0 = weight * q, weight * (1 - q)
        fire1 = (w1 @ votes + 0.5) / (w1.sum() + 1)
        fire0 = (w0 @ votes + 0.05) / (w0.sum() + 1)
        fire1[-1], fire0[-1] = np.clip(fire1[-1], 0.5, 0.98), np.clip(fire0[-1], 0.005, 0.5)
        rest = votes - (q[:, None] * fire1 + (1 - q)[:, None] * fire0)
        cov = (rest * weight[:, None]).T @ rest / weight.sum()
        sd = np.sqrt(np.maximum(np.diag(cov), 1e-9))
        corr = np.abs(cov / sd[:, None] / sd[None, :])
        np.fill_diagonal(corr, 0)
        corr[corr < 0.1] = 0
        share = 1 / (1 + corr.sum(axis=1))
        share[-1] = 1.0
        on, off = np.log(fire1 / fire0), np.log((1 - fire1) / (1 - fire0))
        prior = np.log(w1.sum() / w0.sum())
        logit = prior + votes @ (share * on) + (1 - votes) @ (share * off)
        q = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
    return q


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    """Weights (the last is the constant) of a ridge logistic regression on soft labels."""
    x = np.column_stack([x, np.ones(len(x))]).astype(np.float64)
    beta = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-4
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        grad = x.T @ (weight * (p - y)) + penalty * beta
        hess = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(hess, grad)
        beta -= step * min(1.0, 4.0 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-6:
            break
    return beta


class ToxicityModel:
    """Term weights; a text's features are the terms that it holds, and how many."""

    def __init__(self, terms: list[str], beta: np.ndarray) -> None:
        self.place = {t: i for i, t in enumerate(terms)}
        self.stems = {t.rstrip("*") for t in terms if t[-1] == "*"}
        self.beta = beta

    def features(self, text: str | None) -> tuple[list[int], int]:
        """The terms that the text holds, and how many of its words, repeats included, meet one."""
        place, stems = self.place, self.stems
        words = Counter(WORD.findall(text.lower())) if text else Counter()
        found, met, repeats = set(), Counter(), 0
        for w, n in words.items():
            meets = w in place
            if meets:
                found.add(place[w])
            for k in STEMS:
                if w[:k] in stems and len(w) > k:
                    met[w[:k]] += 1
                    meets = True
            repeats += n * meets
        for stem, n in met.items():
            if (at := place.get(stem + "*")) is not None:
                found.add(at)
            if n > 1 and (at := place.get(stem + "**")) is not None:
                found.add(at)
        return sorted(found), repeats

    def row(self, features: tuple[list[int], int]) -> np.ndarray:
        found, repeats = features
        x = np.zeros(len(self.place) + 3)
        x[found] = 1
        x[-3], x[-2], x[-1] = bool(found), bool(found) and repeats > 1, min(len(found), 4) / 4
        return x

    def score(self, text: str | None) -> float:
        logit = float(self.row(self.features(text)) @ self.beta[:-1] + self.beta[-1])
        return float(1 / (1 + np.exp(-np.clip(logit, -30, 30))))


def train(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, sample: int = SAMPLE) -> ToxicityModel:
    """Fit on labelled rows that are not held out (``labels`` has ``doc_id, toxic``).

    At most ``sample`` ids of each class are drawn from the labels; only their texts are
    looked up, by a list of ids that this bounds, and reach the driver.  Of several labels of
    an id the greatest holds.  With no toxic row, every score is 0.
    """
    marked = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out("doc_id", 3, 1))
    marked = marked.groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max("toxic").cast("int").alias("toxic"))
    counts = {r["toxic"]: r["n"] for r in marked.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    drawn = [(r["id"], r["toxic"]) for r in bounded_sample(marked, "toxic", sample, "id")]
    ids = docs.sparkSession.createDataFrame(drawn, "_id long, _toxic int")
    rows = sorted(
        docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
        .join(F.broadcast(ids), F.col("id") == F.col("_id")).select("id", "text", "_toxic").collect(),
        key=lambda r: (r["id"], r["text"] or ""))
    toxic = np.array([r["_toxic"] for r in rows], dtype=np.int64)
    if not len(rows) or not toxic.any():
        return ToxicityModel([], np.array([0.0, 0.0, 0.0, -30.0]))
    found = {c: max(1, int((toxic == c).sum())) for c in (0, 1)}
    weight = np.array([counts[c] / found[c] for c in toxic], dtype=np.float64)
    weight *= len(weight) / weight.sum()
    terms = select_terms([r["text"] for r in rows], toxic, weight)
    model = ToxicityModel(terms, np.zeros(len(terms) + 4))
    x = np.array([model.row(model.features(r["text"])) for r in rows])
    q = label_model(np.column_stack([x[:, : len(terms)], x[:, -3:] >= 0.5]), toxic, weight)
    model.beta = logistic(x, q, weight)
    return model


def toxicity_score(text: Column, model: ToxicityModel) -> Column:
    """The score of a whole text.  Only texts go to the Python worker, in slices."""

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array((model.score(t.as_py()) for t in texts), pa.float64(), size=len(texts))
        pa.default_memory_pool().release_unused()

    return score(text)


def reject_toxic(docs: DataFrame, text_col: str, model: ToxicityModel) -> DataFrame:
    """The rows of ``docs`` below the threshold, with their columns.  A null or empty text has
    the score of a text without any term, and repeated rows stay or go together."""
    return docs.filter(toxicity_score(docs[text_col], model) < THRESHOLD)


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, held_out, score, predicted`` of every row; learns from labelled rows not held
    out, those whose crc32 of the id leaves another rest than 1 by 3.

    Null and empty texts have the score of a text without any term; equal texts score alike, and
    repeated rows stay as they are.  Of several labels of an id the greatest holds, labels other
    than 0 and 1 none.  An empty table gives none; without a toxic label every score is 0.
    """
    model = train(docs, labels, id_col, text_col)
    out = docs.select(docs[id_col].alias(id_col), toxicity_score(docs[text_col], model).alias("score"))
    return out.select(
        id_col, held_out(id_col, 3, 1).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
