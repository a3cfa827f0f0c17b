"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads a text in segments: a space and one word, in UTF-8; runs without white
space are cut every ``SEGMENT`` bytes.  It labels every byte position with a probability per
language from its left and right states, and a document's probabilities are the means over
all its positions.  States start anew with each segment, so equal segments have equal labels
and a task evaluates each distinct one once.  Training is numpy backpropagation through
time on a bounded sample of labelled rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.llm.common import bounded_sample, free_name, held_out

SEGMENT = 32
HIDDEN = 16
STEPS = 400
BATCH = 768
SAMPLE = 400  # labelled rows of each language that training may use
MEMO = 1 << 17  # segments that a task remembers
PART = 2048  # segments evaluated at once
UNKNOWN = "und"
LEAST_SCORE = 0.3  # of a document in a known language


def segments(text: str) -> list[bytes]:
    """The text as segments; together they hold every byte that is not white space."""
    out = []
    for word in text.encode("utf-8").split():
        if len(word) < SEGMENT:
            out.append(b" " + word)
        else:
            step = SEGMENT - 1
            out += [b" " + word[i : i + step] for i in range(0, len(word), step)]
    return out


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def pack(items: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Order by length, longest first; bytes by position from either end; active rows."""
    lengths = np.array([len(s) for s in items])
    order = np.argsort(-lengths, kind="stable")
    longest = int(lengths.max())
    fore = np.zeros((longest, len(items)), np.uint8)
    back = np.zeros((longest, len(items)), np.uint8)
    for at, i in enumerate(order):
        s = np.frombuffer(items[i], np.uint8)
        fore[: len(s), at] = s
        back[: len(s), at] = s[::-1]
    active = (lengths[order][None, :] > np.arange(longest)[:, None]).sum(axis=1)
    return fore, back, order, active


class ByteGru:
    """The two recurrent directions and the label layer."""

    def __init__(self, labels: list[str], hidden: int = HIDDEN, seed: int = 5) -> None:
        rng = np.random.default_rng(seed)
        scale = 1 / np.sqrt(hidden)
        self.labels, self.hidden = labels, hidden
        self.p = {}
        for d in "fb":
            self.p[f"x{d}"] = (rng.normal(size=(256, 3 * hidden)) * 0.3).astype(np.float32)
            self.p[f"h{d}"] = (rng.normal(size=(hidden, 3 * hidden)) * scale).astype(np.float32)
        self.p["o"] = (rng.normal(size=(2 * hidden, len(labels))) * scale).astype(np.float32)
        self.p["c"] = np.zeros(len(labels), np.float32)

    def direction(self, d: str, data: np.ndarray, active: np.ndarray, keep: list | None) -> np.ndarray:
        n, x, w = self.hidden, self.p[f"x{d}"], self.p[f"h{d}"]
        states = np.zeros((*data.shape, n), np.float32)
        h = np.zeros((data.shape[1], n), np.float32)
        for t, k in enumerate(active):
            old, a = h[:k], x[data[t, :k]]
            u = old @ w
            gates = _sigmoid(a[:, : 2 * n] + u[:, : 2 * n])
            z, r = gates[:, :n], gates[:, n:]
            new = np.tanh(a[:, 2 * n :] + r * u[:, 2 * n :])
            h = new + z * (old - new)
            states[t, :k] = h
            if keep is not None:
                keep.append((old, z, r, new, u[:, 2 * n :]))
        return states

    def positions(self, items: list[bytes], keep: dict | None = None):
        """Label probabilities of every position, packed, with what training needs."""
        fore, back, order, active = pack(items)
        lists = ([], []) if keep is not None else (None, None)
        hf = self.direction("f", fore, active, lists[0])
        hb = self.direction("b", back, active, lists[1])
        lengths = (np.arange(len(fore))[:, None] < np.array([len(items[i]) for i in order])[None, :]).sum(0)
        mirror = np.maximum(lengths[None, :] - 1 - np.arange(len(fore))[:, None], 0)
        columns = np.arange(len(items))[None, :]
        both = np.concatenate([hf, hb[mirror, columns]], axis=2)
        logits = both @ self.p["o"] + self.p["c"]
        logits -= logits.max(axis=2, keepdims=True)
        probs = np.exp(logits)
        probs /= probs.sum(axis=2, keepdims=True)
        valid = np.arange(len(fore))[:, None] < lengths[None, :]
        if keep is not None:
            keep.update(fore=fore, back=back, active=active, lists=lists, both=both, mirror=mirror)
        return probs, valid, order

    def pooled(self, items: list[bytes]) -> np.ndarray:
        """For each segment the sum of its positions' probabilities."""
        out = np.zeros((len(items), len(self.labels)), np.float32)
        for at in range(0, len(items), PART):
            probs, valid, order = self.positions(items[at : at + PART])
            out[at + order] = (probs * valid[:, :, None]).sum(axis=0)
        return out

    def gradients(self, items: list[bytes], labels: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross-entropy over all positions."""
        keep: dict = {}
        probs, valid, order = self.positions(items, keep)
        delta = probs
        delta[:, np.arange(len(items)), labels[order]] -= 1
        delta *= valid[:, :, None] / np.float32(valid.sum())
        n, grads = self.hidden, {}
        grads["o"] = np.einsum("tnh,tnl->hl", keep["both"], delta)
        grads["c"] = delta.sum(axis=(0, 1))
        d_both = delta @ self.p["o"].T
        d_back = np.zeros_like(d_both[:, :, n:])
        t, i = np.nonzero(valid)
        d_back[keep["mirror"][t, i], i] = d_both[t, i, n:]
        for d, out, data, saved in (
            ("f", d_both[:, :, :n], keep["fore"], keep["lists"][0]),
            ("b", d_back, keep["back"], keep["lists"][1]),
        ):
            w = self.p[f"h{d}"]
            gx, gw = np.zeros_like(self.p[f"x{d}"]), np.zeros_like(w)
            carry = np.zeros((data.shape[1], n), np.float32)
            for step in range(len(saved) - 1, -1, -1):
                old, z, r, new, un = saved[step]
                k = len(old)
                dh = out[step, :k] + carry[:k]
                dn = dh * (1 - z) * (1 - new * new)
                dz = dh * (old - new) * z * (1 - z)
                dr = dn * un * r * (1 - r)
                da = np.concatenate([dz, dr, dn], axis=1)
                du = np.concatenate([dz, dr, dn * r], axis=1)
                np.add.at(gx, data[step, :k], da)
                gw += old.T @ du
                carry[:k] = dh * z + du @ w.T
            grads[f"x{d}"], grads[f"h{d}"] = gx, gw
        return grads

    def fit(self, by_label: list[list[bytes]], steps: int, batch: int, seed: int = 11) -> None:
        """Adam on batches that hold as many segments of each language."""
        rng = np.random.default_rng(seed)
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        for step in range(1, steps + 1):
            items, labels = [], []
            for label, pool in enumerate(by_label):
                for i in rng.integers(len(pool), size=max(1, batch // len(by_label))):
                    items.append(pool[i])
                    labels.append(label)
            rate = 0.02 * (1 - 0.95 * step / steps)
            for k, g in self.gradients(items, np.array(labels)).items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                m, v = first[k] / (1 - 0.9**step), second[k] / (1 - 0.99**step)
                self.p[k] -= (rate * m / (np.sqrt(v) + 1e-8)).astype(np.float32)


def train(labelled: DataFrame, text_col: str, lang_col: str, id_col: str, sample: int = SAMPLE) -> ByteGru | None:
    """Fit on at most ``sample`` rows of each language; None if no row has both fields."""
    rows = bounded_sample(
        labelled.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
        .select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")),
        "lang", sample, "id",
    )
    pools: dict[str, list[bytes]] = {}
    for r in rows:
        if has_letter(r["text"]):
            pools.setdefault(r["lang"], []).extend(segments(r["text"]))
    pools = {k: v for k, v in sorted(pools.items()) if v}
    if not pools:
        return None
    model = ByteGru(list(pools))
    if len(pools) > 1:
        model.fit(list(pools.values()), STEPS, BATCH)
    return model


class Scorer:
    """Document probabilities, with the segments of this task evaluated once."""

    def __init__(self, model: ByteGru) -> None:
        self.model, self.at = model, {}
        self.sums = np.zeros((1 << 14, len(model.labels)), np.float32)

    def documents(self, texts: list[str]) -> list[tuple[str, float]]:
        cut = [segments(t) if has_letter(t) else [] for t in texts]
        if len(self.at) > MEMO:
            self.at = {}
        fresh = list(dict.fromkeys(s for found in cut for s in found if s not in self.at))
        if fresh:
            start, end = len(self.at), len(self.at) + len(fresh)
            if end > len(self.sums):
                self.sums = np.concatenate([self.sums, np.zeros((end, self.sums.shape[1]), np.float32)])
            self.sums[start:end] = self.model.pooled(fresh)
            self.at.update(zip(fresh, range(start, end)))
        out = []
        for found in cut:
            if not found:
                out.append((UNKNOWN, 0.0))
                continue
            sums = self.sums[np.fromiter(map(self.at.__getitem__, found), np.int64, len(found))].sum(
                axis=0, dtype=np.float64)
            best = int(sums.argmax())
            out.append((self.model.labels[best], float(min(1.0, sums[best] / sums.sum()))))
        return out


def language_of(text: Column, model: ByteGru | None) -> Column:
    """``lang, score`` of a whole text.  One that is null or has no letter is ``und`` with score
    0, as is every text if nothing could be learned.  Only texts go to the Python worker."""

    @F.arrow_udf("lang string, score double")
    def label(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = Scorer(model) if model else None
        for texts in batches:
            found: list[tuple[str, float]] = []
            for at in range(0, len(texts), 256):
                part = [t or "" for t in texts.slice(at, 256).to_pylist()]
                found += scorer.documents(part) if scorer else [(UNKNOWN, 0.0)] * len(part)
            yield pa.StructArray.from_arrays(
                [pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], ["lang", "score"])
        pa.default_memory_pool().release_unused()

    return label(text)


def reject_unknown(docs: DataFrame, text_col: str, model: ByteGru | None) -> DataFrame:
    """The rows of ``docs`` in a known language, with their columns; repeated rows stay or go
    together."""
    found = free_name(docs, "_language")
    labelled = docs.withColumn(found, language_of(docs[text_col], model))
    known = (F.col(found)["lang"] != UNKNOWN) & (F.col(found)["score"] >= LEAST_SCORE)
    return labelled.filter(known).drop(found)


def languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
              sample: int = SAMPLE) -> DataFrame:
    """``id_col, held_out, lang_pred, score`` of every row; learns from rows not held out,
    those whose crc32 of the id leaves another rest than 2 by 4.  Repeated rows stay."""
    test = held_out(id_col, 4, 2)
    model = train(docs.filter(~test), text_col, lang_col, id_col, sample)
    out = docs.select(docs[id_col].alias(id_col), language_of(docs[text_col], model).alias("found"))
    return out.select(
        id_col, held_out(id_col, 4, 2).alias("held_out"), F.col("found.lang").alias("lang_pred"), F.col("found.score").alias("score"))
