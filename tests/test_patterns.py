"""Strings found in texts, keys of any form, and the closure of a vault."""

from __future__ import annotations

import random
from functools import reduce

import numpy as np

from veilframe.operators import patterns
from veilframe.operators.metrics import vault_leak_audit
from veilframe.operators.patterns import asked_pieces, file_strings, occurrences, passes, piece_hashes
from veilframe.operators.rehydrate import rehydrate, rehydrate_literal, vault_closure
from veilframe.sources.stage import stage
from pyspark.sql import functions as F

ALPHABET = "ab[]_1é𝒳"


def fixture(seed: int):
    rng = random.Random(seed)
    strings = {"".join(rng.choices(ALPHABET, k=rng.choice([1, 2, 3, 7, 8, 9, 12, 30]))) for _ in range(120)}
    texts = ["".join(rng.choices(ALPHABET, k=rng.choice([0, 1, 5, 40, 200]))) for _ in range(80)]
    some = sorted(strings)
    texts += ["x".join(rng.sample(some, 5)) for _ in range(40)]
    return some, texts


def test_occurrences_equal_brute_force(spark):
    strings, texts = fixture(1)
    df = spark.createDataFrame([*enumerate(texts), (1000, None)], "id long, text string").repartition(3)
    values = spark.createDataFrame([(s,) for s in [*strings, "", strings[0], None]], "value string")
    got = {(r.id, r.value) for r in occurrences(df, ["id"], "text", values).collect()}
    assert got == {(i, s) for i, t in enumerate(texts) for s in strings if s in t}
    counts = {r.id: r.n_known for r in vault_leak_audit(df, ["id"], "text", values).collect()}
    assert counts == {i: n for i, t in enumerate(texts) if (n := sum(s in t for s in strings))}


def test_only_candidates_leave_the_scan(spark):
    """Twenty texts of many hold a value: the rows that are exchanged grow with those."""
    rng = random.Random(2)
    values = [f"{rng.getrandbits(40):010x}@example.org" for _ in range(300)]
    texts = [" ".join(f"{rng.getrandbits(30):x}" for _ in range(60)) for _ in range(400)]
    for i in range(20):
        texts[i] += values[i]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    filed = stage(file_strings(spark.createDataFrame([(v,) for v in values], "value string")), "filed")
    asked = asked_pieces(df, ["id"], F.col("text"), filed).count()
    assert 20 <= asked <= 40 < sum(len(t) for t in texts) // 100


def test_filter_has_no_false_negatives(spark, monkeypatch):
    monkeypatch.setattr(patterns, "LEAST_BITS", 64)
    monkeypatch.setattr(patterns, "MOST_BITS", 1024)
    strings, texts = fixture(3)
    filed = stage(file_strings(spark.createDataFrame([(s,) for s in strings], "value string")), "filed")
    words = patterns.filter_words(filed)
    assert len(words) == 16
    pieces = np.array([r.piece for r in filed.collect()], np.int64).view(np.uint64)
    assert passes(pieces, words).all()
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    values = spark.createDataFrame([(s,) for s in strings], "value string")
    got = {(r.id, r.value) for r in occurrences(df, ["id"], "text", values).collect()}
    assert got == {(i, s) for i, t in enumerate(texts) for s in strings if s in t}


def test_pieces_are_windows_of_characters():
    t = "añ𝒳\ud800b" * 3
    got = piece_hashes(t, 4)
    assert len(got) == len(t) - 3
    assert [got[i] == got[j] for i in range(9) for j in range(9)] == [t[i : i + 4] == t[j : j + 4] for i in range(9) for j in range(9)]
    assert len(piece_hashes("ab", 3)) == 0


# Keys of any form


def in_turn(text: str, entries: list[tuple[str, str]]) -> str:
    return reduce(lambda acc, e: acc.replace(*e), entries, text)


def literal(spark, texts, entries):
    df = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)], "id long, text string, at int")
    vault = spark.createDataFrame([(n, k, v) for n, (k, v) in enumerate(entries)], "at long, token string, value string")
    return {r.id: r.text for r in rehydrate_literal(df, ["id"], "text", vault, "at").collect()}


def test_keys_without_brackets(spark):
    entries = [("TOKEN_1", "one"), ("TOKEN_12", "twelve"), ("TOKEN_3", "see TOKEN_4"), ("TOKEN_4", "four $1 \\1"),
               ("KEN", "barbie"), ("fourX", "joined"), ("[TOKEN_5]", "five"), ("ee", "EE"), ("", "nothing"), ("gone", None)]
    texts = ["TOKEN_12 and TOKEN_1", "TOKEN_3", "TOKEN_2 [TOKEN_5]", "TOKEN_4X", "four $1 \\1X", "plain", "", None, "it is gone"]
    known = [(k, v or "") for k, v in entries if k]
    want = {i: None if t is None else in_turn(t, known) for i, t in enumerate(texts)}
    assert literal(spark, texts, entries) == want
    assert want[0] == "one2 and one" and want[1] == "sEE four $1 \\1" and want[2] == "TObarbie_2 [TObarbie_5]"


def test_random_keys_equal_replacement_in_turn(spark):
    """Short keys over a small alphabet: values bring later keys, and make some with their neighbours."""
    rng = random.Random(7)
    for _ in range(3):
        keys = list({"".join(rng.choices("abc", k=rng.randint(2, 4))) for _ in range(12)})
        rng.shuffle(keys)
        entries = [(k, "".join(rng.choices("abcX", k=rng.randint(0, 4)))) for k in keys]
        texts = ["".join(rng.choices("abcd", k=rng.randint(0, 25))) for _ in range(40)]
        assert literal(spark, texts, entries) == {i: in_turn(t, entries) for i, t in enumerate(texts)}


# Closure


def tok(c: str) -> str:
    return f"[USER_EMAIL_{c * 6}]"


def test_closure_of_a_vault(spark):
    entries = {
        tok("a"): "plain", tok("b"): f"b({tok('a')})", tok("c"): f"c({tok('b')}{tok('a')})", tok("d"): f"d({tok('c')}) {tok('9')}",
        tok("e"): f"e({tok('f')})", tok("f"): f"f({tok('e')}{tok('a')})", tok("0"): f"self {tok('0')}", tok("1"): f"to cycle {tok('e')}{tok('b')}",
    }
    vault = spark.createDataFrame(list(entries.items()), "token string, value string")
    got = {r.token: r.value for r in vault_closure(vault).collect()}
    assert got == {
        tok("a"): "plain", tok("b"): "b(plain)", tok("c"): "c(b(plain)plain)", tok("d"): f"d(c(b(plain)plain)) {tok('9')}",
        tok("e"): f"e({tok('f')})", tok("f"): f"f({tok('e')}plain)", tok("0"): f"self {tok('0')}", tok("1"): f"to cycle {tok('e')}b(plain)",
    }
    df = spark.createDataFrame([(1, f"x {tok('d')}"), (2, tok("0")), (3, "none")], "id long, text string")
    out = {r.id: r.text for r in rehydrate(df, ["id"], ["text"], vault, fixpoint=True).collect()}
    assert out == {1: f"x d(c(b(plain)plain)) {tok('9')}", 2: f"self {tok('0')}", 3: "none"}
    flat = vault.filter("value = 'plain'")
    assert [tuple(r) for r in vault_closure(flat).collect()] == [(tok("a"), "plain")]


def test_closure_reads_the_corpus_no_more_often_than_one_pass(spark, tmp_path):
    at = str(tmp_path / "corpus")
    spark.createDataFrame([(1, tok("b"))], "id long, text string").write.parquet(at)
    vault = spark.createDataFrame([(tok("a"), "plain"), (tok("b"), tok("a"))], "token string, value string")
    df = spark.read.parquet(at)

    def scans(out):
        return out._jdf.queryExecution().optimizedPlan().toString().count("Relation [id")

    once, deep = rehydrate(df, ["id"], ["text"], vault), rehydrate(df, ["id"], ["text"], vault, fixpoint=True)
    assert scans(deep) == scans(once) and deep.first().text == "plain"
