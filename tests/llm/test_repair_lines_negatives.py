"""Conversation repair, line deduplication and hard negatives against brute force."""

from __future__ import annotations

import hashlib
import heapq
import random

import numpy as np
import pytest

from compare import connect, differences
from veilframe.llm import chat_repair, hard_negatives, line_dedup
from veilframe.llm.chat_repair import backward, digests, repair, walks
from pyspark.sql import functions as F

SF_TINY = "/root/testdata/sf0.001"


# conversation repair ------------------------------------------------------------------


def plain_repair(rows: list[tuple[str, str]]) -> tuple[int, str, list[str], dict]:
    """Cheapest edits by a search over (row, state): cost, letters, repaired rows, faults."""
    faults, seen = [], set()
    for role, text in rows:
        bare = text.strip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen
                      else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    queue: list[tuple] = [(0, "", 0, "", ())]
    done: set = set()
    while True:
        cost, letters, i, state, out = heapq.heappop(queue)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == len(rows) and state in ("", "a"):
            counts = {f: faults.count(f) for f in ("blank", "duplicate", "truncated")}
            counts["illegal"] = sum((a[0][:1] + b[0][:1]) not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
            return cost, letters, list(out), counts
        new = "assistant" if state == "u" else "user"
        heapq.heappush(queue, (cost + 2, letters + "I", i, new[0], (*out, f"{new}:")))
        if i < len(rows):
            role, text = rows[i]
            heapq.heappush(queue, (cost + 3, letters + "D", i + 1, state, out))
            if faults[i] in ("", "truncated"):
                cut = faults[i] == "truncated"
                heapq.heappush(queue, (cost + 2 + cut, letters + "R", i + 1, new[0], (*out, f"{new}:{text}")))
                if role[:1] == new[0] or (role[:1] == "s" and state == "" and not out):
                    heapq.heappush(queue, (cost + cut, letters + "K", i + 1, role[0], (*out, f"{role}:{text}")))


def talk(rng: random.Random, n: int) -> list[tuple[int, str, str]]:
    texts = ["Yes.", "No!", "Why?", "cut off", "", " \t", "Right. ", "... so", "é?"]
    return [(t, rng.choice(["user", "assistant", "user", "assistant", "system", "tool", ""]), rng.choice(texts) + ("" if rng.random() < 0.6 else str(t) + "."))
            for t in range(n)]


def results(spark, rows) -> dict:
    schema = "conv_id long, turn long, role string, text string, edit string, start long"
    done = repair(spark.createDataFrame(rows, schema))
    told = digests(done.rows.filter("edit <> 'D'"), "conv", ["start", "place"], F.concat("role", F.lit(":"), "text"), "\n", "sha")
    out = {r["conv"]: r.asDict() for r in done.report.collect()}
    for r in told.collect():
        out[r["conv"]]["sha"] = r["sha"]
    for r in done.blocks.orderBy("start").collect():
        out[r["conv"]]["audit"] = out[r["conv"]].get("audit", "") + r["letters"]
    return out


def test_repair_equals_a_search(spark):
    rng = random.Random(11)
    held = {c: talk(rng, rng.choice([1, 2, 3, 5, 8, 13, 40])) for c in range(60)}
    held[60] = talk(rng, 700)  # blocks of 27 rows
    held[None] = talk(rng, 9)
    rows = [(c, t, r, x, "x", 1) for c, talked in held.items() for t, r, x in talked]
    rng.shuffle(rows)
    found = results(spark, rows)
    assert set(found) == set(held)
    for c, talked in held.items():
        cost, letters, out, counts = plain_repair([(r, x) for _, r, x in talked])
        assert (found[c]["cost"], found[c]["audit"]) == (cost, letters), c
        assert {k: found[c][k] for k in counts} == counts
        assert found[c].get("sha", hashlib.sha256(b"").hexdigest()) == hashlib.sha256("\n".join(out).encode()).hexdigest()


def test_repair_of_odd_rows(spark):
    rows = [
        (1, None, "user", "Hi.", "x", 1), (1, None, None, "Hi.", "x", 1), (1, 5, "assistant", None, "x", 1), (1, 9, "assistant", "Hi.", "x", 1),
        (2, 3, "user", "A.", "x", 1), (2, 3, "user", "A.", "x", 1), (2, 3, "assistant", "B.", "x", 1), (2, 3, "user", "word " * 300000 + ".", "x", 1),
        (3, None, "user", "Hm.", "x", 1),
    ]
    found = results(spark, rows)
    assert {c: (r["gaps"], r["blank"], r["duplicate"], r["truncated"], r["illegal"]) for c, r in found.items()} == {
        1: (3, 1, 0, 0, 2), 2: (0, 0, 1, 0, 2), 3: (0, 0, 0, 0, 0)}
    assert found[3]["audit"] == "KI" and found[3]["cost"] == 2
    assert found[2]["cost"] == plain_repair([("assistant", "B."), ("user", "A."), ("user", "A."), ("user", "w.")])[0]
    empty = repair(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))
    assert empty.rows.collect() == empty.blocks.collect() == empty.report.collect() == []


def test_one_hot_conversation_is_cut(spark):
    """A conversation with most rows, half of them equal, is many blocks and the same result."""
    rng = random.Random(3)
    talked = talk(rng, 1500) + [(2000, "user", "same.")] * 1500
    found = results(spark, [(7, t, r, x, "x", 1) for t, r, x in talked] + [(8, 0, "user", "A.", "x", 1)])
    cost, letters, _, counts = plain_repair([(r, x) for _, r, x in talked])
    assert (found[7]["cost"], found[7]["audit"], found[7]["duplicate"]) == (cost, letters, counts["duplicate"])
    done = repair(spark.createDataFrame([(7, t, r, x) for t, r, x in talked], "conv_id long, turn long, role string, text string"))
    assert done.blocks.count() > 40
    assert done.rows.agg(F.max(F.col("place"))).first()[0] < 200


def test_walk_is_least_of_all_cheapest():
    """In a block, the walk from any state is the first in ASCII of the cheapest."""
    rng = random.Random(5)
    for _ in range(200):
        codes = "".join(rng.choice("suaxSUAX-") for _ in range(rng.randint(0, 6)))
        costs = backward(codes, chat_repair.END)
        letters, _ = walks(codes, chat_repair.END, True)
        rows = [({"-": "z"}.get(c, c.lower()), {"-": "", }.get(c, f"{i} cut" if c.isupper() else f"{i} ok.")) for i, c in enumerate(codes)]
        assert (costs[0][0], letters[0]) == plain_repair(rows)[:2]


# line deduplication -------------------------------------------------------------------


def plain_lines(rows: list[tuple[int | None, str | None]]) -> list[tuple]:
    def key(line: str) -> str:
        stripped = line.strip(" \t\n\x0b\x0c\r")
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in stripped)

    def order(d):
        return (d is None, d or 0)

    held: dict[str, set] = {}
    for d, text in rows:
        for line in (text or "").split("\n"):
            held.setdefault(key(line), set()).add(d)
    out = []
    for d, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 10 or min(held[key(x)], key=order) == d]
        out.append((d, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(12)
    pool = ["This line is shared", "  this LINE is Shared\t", "É this line is shared", "kurz", "nine char", "ten chars!", "zehn Zeiché",
            "once upon a time in doc %d", "", " \r", "ÄÖÜäöüßẞñç", "日本語の行は十文字より長い", "日本語短い"]
    rows = []
    for d in range(150):
        rows.append((d, "\n".join(x % d if "%d" in x else x for x in rng.choices(pool, k=rng.randint(0, 9)))))
    rows += [(200, None), (201, ""), (3, rows[3][1]), (3, "only in rows of document 3\nkurz"), (3, "only in rows of document 3"),
             (None, "null ids hold this line\nten chars!"), (None, "null ids hold this line"), (202, "\n".join(["a line repeated in one text"] * 5)),
             (203, "x" * 400000 + "\nten chars!\n" + "y" * 50), (204, "\r\nTEN CHARS!\r\n")]
    return rows


@pytest.mark.parametrize("bits", [line_dedup.LEAST_BITS, 1 << line_dedup.SEGMENT_BITS])
def test_lines_equal_brute_force(spark, texts, monkeypatch, bits):
    monkeypatch.setattr(line_dedup, "LEAST_BITS", bits)
    monkeypatch.setattr(line_dedup, "MOST_BITS", bits)
    docs = spark.createDataFrame([(*r, "k", [1], 5) for r in texts], "doc_id long, text string, key string, lines array<int>, digest int")
    found = line_dedup.dedup_lines(docs.repartition(5))
    assert sorted((tuple(r) for r in found.collect()), key=repr) == plain_lines(texts)


def test_second_filter_holds_all_shared_lines_and_few_others(spark):
    lines = [(i, f"line number {i} of the corpus\nline number {i % 500} is shared") for i in range(4000)]
    body = spark.createDataFrame(lines, "id long, text string").selectExpr("id", "xxhash64(text) digest", "cast(text as binary) text")
    found = line_dedup.suspects(body.repartition(7), line_dedup.seen_twice(body.repartition(7), 2)).collect()
    met = {r["key"] for r in found}
    assert {f"line number {i} is shared".encode() for i in range(500)} <= met
    assert len(met) < 700


def test_empty_table_of_documents(spark):
    assert line_dedup.dedup_lines(spark.createDataFrame([], "doc_id long, text string")).collect() == []


# hard negatives -----------------------------------------------------------------------


def plain_negatives(rows: list[tuple], every: int, positives=5, negatives=10) -> list[tuple]:
    ok = []
    for n, (i, v, label) in enumerate(rows):
        if i is not None and label is not None and v and all(x is not None and np.isfinite(x) for x in v):
            ok.append((n, i, [int(np.floor(256 * float(x))) for x in v], label))
    out = []
    for n, i, v, label in ok:
        if i % every:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j, m, other) for m, j, w, other in ok if m != n and len(w) == len(v))
        for p, j, m, _ in [s for s in scored if s[3] == label][:positives]:
            band = [s for s in scored if s[3] != label and 30 * -p <= 100 * -s[0] <= 90 * -p][:negatives]
            out += [(i, j, rank + 1, s[1], -p, -s[0]) for rank, s in enumerate(band)]
    return sorted(out)


@pytest.mark.parametrize("size", [1.0, 4e6])
def test_negatives_equal_brute_force(spark, monkeypatch, size):
    """Also with fields of more than eight bytes, and with several blocks of each kind."""
    monkeypatch.setattr(hard_negatives, "CANDIDATE_BLOCK", 64)
    monkeypatch.setattr(hard_negatives, "ANCHOR_BLOCK", 3)
    rng = np.random.default_rng(13)
    rows = [(i, [float(x) for x in rng.normal(0.05, 0.2, 12) * size], "abc"[int(rng.integers(3))]) for i in range(240)]
    rows += [(300, rows[10][1], "a"), (10, rows[11][1], rows[10][2]), (10, rows[10][1], rows[10][2]), (310, None, "a"), (None, rows[5][1], "a"),
             (320, [float("nan")] * 12, "b"), (330, [None] * 12, "b"), (340, rows[1][1], None), (350, [0.5, 0.5], "a"), (360, [0.5, 0.25], "a"),
             (370, [0.25, 0.25], "b"), (380, [], "b"), (390, [float("inf")] * 12, "c"), (400, [0.0] * 12, "c")]
    vectors = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, label string, row int, dim string")
    found = hard_negatives.hard_negatives(vectors, F.col("id") % 10 == 0)
    assert sorted(tuple(r) for r in found.collect()) == plain_negatives(rows, 10)


def test_packed_products_are_exact():
    rng = np.random.default_rng(1)
    for low, high in ((-3, 4), (-200, 150), (-(2**30), 2**30), (0, 2**62), (-(2**63), -(2**62)), (5, 6)):
        v = rng.integers(low, high, (20, 6), dtype=np.int64)
        a = rng.integers(-9, 9, 6).tolist()
        bias = max(0, -min(a))
        packed = hard_negatives.Packed(v, max(a) + bias)
        want = [min(max(sum(x * y for x, y in zip(a, row)), -(2**63)), 2**63 - 1) for row in v.tolist()]
        assert packed.scores([x + bias for x in a], bias).tolist() == want


def test_no_vectors(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert hard_negatives.hard_negatives(none, F.col("id") % 100 == 0).collect() == []
    lone = spark.createDataFrame([(0, [1.0], 1)], "vec_id long, embedding array<float>, label int")
    assert hard_negatives.hard_negatives(lone, F.col("id") % 100 == 0).collect() == []


@pytest.mark.parametrize("name", ["op11_chat_repair", "op12_line_dedup", "op13_hard_negatives"])
def test_query_equals_its_twin(spark, name):
    assert differences(spark, connect(SF_TINY), SF_TINY, name) is None
