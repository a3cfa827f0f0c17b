"""Odd rows of URL lists and chats, and fingerprints against an independent SimHash."""

from __future__ import annotations

import datetime as dt
import hashlib
import math
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from veilframe.llm.chat import formatted_conversations
from veilframe.llm.fingerprints import document_fingerprints
from veilframe.llm.url_lists import evaluate


def day(n: int) -> dt.date:
    return dt.date(2024, 1, 1) + dt.timedelta(days=n)


CAPTURES = [
    (1, "https://a.example.com/x", day(5)), (2, "https://a.example.com/x", day(10)), (2, "https://a.example.com/x", day(10)),
    (3, None, day(5)), (4, "", day(5)), (5, "not a url", day(5)), (6, "ftp://a.example.com", day(5)), (7, "https://a.example.com", None),
    (8, "HTTP://user@A.Example.COM.:80/y", day(20)), (9, "https://b.example.com", day(3)), (10, "https://localhost/", day(30)),
    (11, "https://a.example.com/" + "p" * 300000, day(5)), (None, "https://a.example.com/x", day(5)),
]
ENTRIES = [
    ("example.com", day(4), "block"), ("example.com", day(10), "remove"), ("a.example.com/x", day(5), "allow"),
    ("a.example.com/x", day(5), "block"), ("a.example.com", day(20), "allow"), ("example.com", day(25), "block"),
    (None, day(1), "block"), ("b.example.com", None, "block"), ("localhost", day(30), None), ("localhost", day(29), "block"),
]


def plain_verdict(url: str | None, at: dt.date | None) -> tuple:
    m = re.match(r"(?i)https?://(?:[^/?#@]*@)?([^/?#:@]+)", url or "")
    if not m or at is None:
        return "none", None
    host = m.group(1).lower().rstrip(".")
    labels = host.split(".")
    keys = [".".join(labels[-k:]) for k in range(min(2, len(labels)), len(labels) + 1)]
    seg = re.match(r"(?i)https?://[^/?#]*/([^/?#]+)", url)
    keys += [f"{host}/{seg.group(1)}"] if seg else []
    for key in reversed(keys):
        known = [e for e in ENTRIES if e[0] == key and e[1] and e[2] and e[1] <= at]
        if known and (last := max((e[1], e[2]) for e in known))[1] != "remove":
            return last[1], key
    return "none", None


def test_url_lists_of_odd_rows(spark):
    captures = spark.createDataFrame([(*c, "x", 1) for c in CAPTURES], "id long, url string, day date, key string, row int")
    entries = spark.createDataFrame([(*e, 5) for e in ENTRIES], "key string, day date, action string, id int")
    got = sorted(((r.id, r.url, r.day, r.verdict, r.rule) for r in evaluate(captures, entries).collect()), key=repr)
    assert got == sorted(((*c, *plain_verdict(c[1], c[2])) for c in CAPTURES), key=repr)
    assert evaluate(captures.limit(0), entries).collect() == []
    assert {r.verdict for r in evaluate(captures, entries.limit(0)).collect()} == {"none"}


def test_chats_of_odd_rows(spark):
    rows = [
        (1, 0, "user", None), (1, 1, "assistant", "ok"), (1, 1, "assistant", "ok"), (2, None, None, "x"), (2, 0, "assistant", ""),
        (None, 0, "user", "</s>[INST] \\</s> [/INST]"), (None, 1, "assistant", "[INST]" * 50000), (3, 0, "system", "<<SYS>> only"),
    ]
    schema = "conv_id long, turn long, role string, text string"
    found = {r.conv_id: r for r in formatted_conversations(spark.createDataFrame(rows, schema)).collect()}
    for conv in {r[0] for r in rows}:
        turns = sorted(((r[1] is not None, r[1] or 0, r[2] or "", r[3] or "") for r in rows if r[0] == conv))
        told = "".join(f"{role}\n{text}\n" for _, _, role, text in turns)
        loss = "".join(text for _, _, role, text in turns if role == "assistant")
        r = found[conv]
        assert (r.n_turns, r.turns_sha256) == (len(turns), hashlib.sha256(told.encode()).hexdigest()), conv
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest()), conv
    assert formatted_conversations(spark.createDataFrame([], schema)).collect() == []
    more = spark.createDataFrame([(*r, "x", "y") for r in rows], schema + ", record string, formatted string")
    assert formatted_conversations(more).count() == 4


def plain_simhash(text: str) -> tuple[int, int]:
    """Votes of word pairs, in plain integers; Spark's xxhash64 chains its seeds from 42."""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text)) if w]
    hi, lo, total = [0] * 64, [0] * 64, 0
    for a, b in zip(words, [*words[1:], None]):
        h = xxhash.xxh64_intdigest(a.encode(), 42)
        h = h if b is None else xxhash.xxh64_intdigest(b.encode(), h)
        g = xxhash.xxh64_intdigest((1).to_bytes(4, "little"), xxhash.xxh64_intdigest(h.to_bytes(8, "little"), 42))
        w = min(len(a) + len(b or ""), 24)
        total += w
        for i in range(64):
            hi[i] += w * (h >> i & 1)
            lo[i] += w * (g >> i & 1)
    pack = lambda counts: sum(1 << i for i, c in enumerate(counts) if 2 * c > total)
    return pack(hi), pack(lo)


@pytest.fixture(scope="module")
def texts():
    base = "the quick brown fox jumps over the lazy dog and runs far away from here"
    return [(1, base), (2, base.upper()), (3, base + " today"), (4, ""), (5, None), (6, "word"), (7, "één Äpfel 日本語 𝒳 " * 40), (8, "a  b\ta\nb"), (8, base)]


def test_fingerprints_equal_a_plain_simhash(spark, texts):
    docs = spark.createDataFrame([(*t, "x", 5) for t in texts], "doc_id long, text string, fingerprint string, row int")
    rows = document_fingerprints(docs).collect()
    assert len(rows) == len(texts)
    want = {(i, f"{hi:016x}{lo:016x}") for i, t in texts for hi, lo in [plain_simhash(t or "")]}
    assert {(r.doc_id, r.fingerprint) for r in rows} == want
    by_id = {r.doc_id: r for r in rows}
    order = sorted({i for i, _ in texts}, reverse=True)
    plain = {i: t or "" for i, t in texts}
    for i, j in ((7, 6), (6, 5), (4, 3), (3, 2)):
        assert order[order.index(i) + 1] == j
        bits = sum((a ^ b).bit_count() for a, b in zip(plain_simhash(plain[i]), plain_simhash(plain[j])))
        assert by_id[i].near_next == pytest.approx(max(0.0, math.cos(math.pi * bits / 128)) if bits else 1.0)
        half = len(plain[i]) // 2
        edited = plain[i][: len(plain[i]) - half] + plain[j][:half]
        hi, lo = plain_simhash(edited)
        assert by_id[i].edited_fingerprint == f"{hi:016x}{lo:016x}"
    assert document_fingerprints(docs.limit(0)).collect() == []
    assert document_fingerprints(docs.filter(F.col("doc_id") == 1)).first().near_next == 1.0
