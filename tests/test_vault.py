"""The vault, rehydration, chunks and event streams."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

import model
from veilframe.functions.ordered import latest_before, preceding_tail
from veilframe.functions.tokens import CUSTOM_TOKEN_PATTERN
from veilframe.operators import chunks as ch
from veilframe.operators import vault as v
from veilframe.operators.redact import explode_findings, redact_text
from veilframe.operators.rehydrate import rehydrate
from veilframe.sources.io import append_vault, read_vault_store, write_corpus, write_vault
from veilframe.streaming import jobs
from veilframe.streaming.sinks import append_to_table, batches_to_table, read_stream

T0 = dt.datetime(2024, 1, 1)
SAVE = "token string, label string, value string, saved_at timestamp, request_id long, ord long"


def at(seconds: float) -> dt.datetime:
    return T0 + dt.timedelta(seconds=seconds)


def saves(spark, *rows):
    return spark.createDataFrame(
        [(t, "L", val, at(s), i, 0) for i, (t, val, s) in enumerate(rows)], SAVE
    )


def vault_of(spark, entries: dict[str, str]):
    return spark.createDataFrame(
        [(t, "L", val, T0) for t, val in entries.items()],
        "token string, label string, value string, saved_at timestamp",
    )


def as_dict(vault):
    return {r.token: (r.value, (r.saved_at - T0).total_seconds()) for r in vault.collect()}


def test_last_write_wins_and_refreshes(spark):
    s = saves(spark, ("[A_1]", "x", 0), ("[A_1]", "y", 5), ("[B_1]", "z", 1))
    assert as_dict(v.vault_upsert(s)) == {"[A_1]": ("y", 5), "[B_1]": ("z", 1)}
    with pytest.raises(Exception, match="token collision"):
        v.vault_upsert(s, on_collision="error").collect()
    assert [r.n_values for r in v.vault_collisions(s).collect()] == [2]
    merged = v.vault_merge(v.vault_upsert(s), saves(spark, ("[B_1]", "new", 1)))
    assert as_dict(merged)["[B_1]"] == ("new", 1)


def test_expiry_happens_on_save(spark):
    s = saves(spark, ("[TOKEN_1]", "a", 0), ("[TOKEN_2]", "b", 0.15))
    assert set(as_dict(v.vault_prune(v.vault_upsert(s), ttl_seconds=0))) == {"[TOKEN_2]"}
    s = saves(spark, ("[TOKEN_1]", "a", 0), ("[TOKEN_2]", "b", 10))
    assert len(as_dict(v.vault_prune(v.vault_upsert(s), ttl_seconds=10))) == 2
    assert len(as_dict(v.vault_prune(v.vault_upsert(s), ttl_seconds=9))) == 1


def test_asof_matches_a_replay(spark):
    rng = random.Random(7)
    rows = [(f"[T_{rng.randrange(4)}]", f"v{i}", rng.randrange(0, 40000) / 2) for i in range(300)]
    looks = [(i, f"[T_{rng.randrange(5)}]", at(rng.randrange(-100, 41000) / 2)) for i in range(200)]
    ttl = 60
    got = {
        r.id: r.value
        for r in v.vault_asof(
            saves(spark, *rows),
            spark.createDataFrame(looks, "id long, token string, at timestamp"),
            "at", ttl_seconds=ttl,
        ).collect()
    }
    order = sorted(range(len(rows)), key=lambda i: (rows[i][2], i))
    for i, token, when in looks:
        held: dict[str, tuple[str, float]] = {}
        for j in order:
            tok, value, s = rows[j]
            if at(s) <= when:
                held[tok] = (value, s)
                held = {k: x for k, x in held.items() if s - x[1] <= ttl}
        assert got[i] == held.get(token, (None,))[0]


def test_latest_before_over_small_blocks(spark):
    rng = random.Random(1)
    rows = [(rng.choice("ab"), i, rng.choice([None, i])) for i in rng.sample(range(500), 200)]
    df = spark.createDataFrame(rows, "k string, pos long, v long")
    out = latest_before(df, ["k"], "pos", F.col("v"), "last", width=3, fanout=4, levels=2)
    for r in out.collect():
        want = [x for k, p, x in rows if k == r.k and p <= r.pos and x is not None]
        assert r.last == max(want, default=None)


def test_preceding_tail_over_small_blocks(spark):
    rng = random.Random(2)
    rows = [(k, i, "xyz"[: rng.randrange(1, 4)] + str(i)) for k in "ab" for i in range(0, 90, 2)]
    df = spark.createDataFrame(rows, "k string, seq long, t string")
    for levels in (0, 1, 2):
        out = preceding_tail(df, ["k"], "seq", F.col("t"), 11, "tail", width=4, levels=levels)
        for r in out.collect():
            assert r.tail == "".join(t for k, i, t in rows if k == r.k and i < r.seq)[-11:]


ENTRIES = {"[USER_EMAIL_aaaaaa]": "a$1@b.io", "[NETWORK_IP_bbbbbb]": 'q"\\n'}


def test_rehydrate_known_and_unknown(spark):
    df = spark.createDataFrame(
        [(1, "x [USER_EMAIL_aaaaaa][NETWORK_IP_bbbbbb] [NETWORK_IP_cccccc]"), (2, "none"),
         (3, None), (4, "[USER_EMAIL_aaaaaa")], "id long, text string"
    )
    rows = rehydrate(df, ["id"], ["text"], vault_of(spark, ENTRIES)).orderBy("id").collect()
    assert [r.text for r in rows] == [
        'x a$1@b.ioq"\\n [NETWORK_IP_cccccc]', "none", None, "[USER_EMAIL_aaaaaa",
    ]
    empty = rehydrate(df, ["id"], ["text"], vault_of(spark, ENTRIES).limit(0)).orderBy("id")
    assert [r.text for r in empty.collect()] == [r.text for r in df.orderBy("id").collect()]


def test_rehydrate_custom_and_nested(spark):
    vault = vault_of(spark, {"[TOKEN_1]": "me@x.org", "[TOKEN_2]": "two"})
    df = spark.sql(
        "SELECT 1 AS id, named_struct('a', array('Hello [TOKEN_1]', '[TOKEN_3]'), 'n', 5,"
        " 'm', map('[TOKEN_1]', '[TOKEN_2]')) AS rec"
    )
    row = rehydrate(df, ["id"], ["rec"], vault, CUSTOM_TOKEN_PATTERN).first()
    assert row.rec.a == ["Hello me@x.org", "[TOKEN_3]"] and row.rec.n == 5
    assert row.rec.m == {"[TOKEN_1]": "two"}


def test_round_trip_and_fixpoint(spark):
    block = "-----BEGIN KEY PRIVATE KEY-----\nmail a@b.io " + "A" * 80
    df = spark.createDataFrame(
        [(1, "a@b.io 10.0.0.1, api_key=abcdefghijklmnopqrst"),
         (2, block + "\n-----END X PRIVATE KEY-----")], "id long, text string"
    )
    red = redact_text(df)
    found = explode_findings(red, ["id"])
    vault = v.vault_upsert(v.vault_build(found, F.lit(T0), "id"))
    texts = red.select("id", F.col("redacted").alias("text"))
    once = {r.id: r.text for r in rehydrate(texts, ["id"], ["text"], vault).collect()}
    full = {
        r.id: r.text for r in rehydrate(texts, ["id"], ["text"], vault, fixpoint=True).collect()
    }
    want = {r.id: r.text for r in df.collect()}
    assert full == want and once[1] == want[1]
    assert once[2] == want[2].replace("a@b.io", model.token("USER_EMAIL", "a@b.io"))


def test_a_token_on_every_row_is_not_broadcast_by_hand(spark):
    df = spark.range(10).select("id", F.lit("[USER_EMAIL_aaaaaa]").alias("text"))
    vault = vault_of(spark, ENTRIES)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = rehydrate(df, ["id"], ["text"], vault)._jdf.queryExecution().executedPlan()
        assert "Broadcast" not in plan.toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def split(text: str, rng: random.Random, longest: int) -> list[str]:
    out = []
    while text:
        n = rng.randrange(0, longest)
        out.append(text[:n])
        text = text[n:]
    return out


TEXT = (
    "a [USER_EMAIL_aaaaaa] b [USER_EMAIL_aaaaab] [[NETWORK_IP_bbbbbb]] [USER_[NETWORK_IP_bbbbbb]"
    " [x] [NETWORK é [USER_EMAIL_aaaaaa"
)


def test_asof_at_one_time_stamp(spark):
    """Saves and lookups of a token that share their time, over many blocks."""
    rng = random.Random(6)
    rows = [(f"[T_{rng.randint(1, 3)}]", "L", f"v{n}", at(10 * rng.randint(0, 2)), n, rng.randint(0, 5)) for n in range(300)]
    asked = [(n, f"[T_{rng.randint(0, 4)}]", at(rng.choice([-1, 0, 5, 10, 20, 45]))) for n in range(300)]
    saved = spark.createDataFrame(rows, SAVE).repartition(5)
    lookups = spark.createDataFrame(asked, "n long, token string, at timestamp").repartition(5)
    got = {r.n: r.value for r in v.vault_asof(saved, lookups, "at", ttl_seconds=10, block=16).collect()}
    for n, token, when in asked:
        before = [r for r in rows if r[3] <= when]
        own = max((r for r in before if r[0] == token), key=lambda r: r[3:], default=None)
        live = own is not None and (max(r[3] for r in before) - own[3]).total_seconds() <= 10
        assert got[n] == (own[2] if live else None), n
    assert v.vault_asof(saved.limit(0), lookups, "at").filter("value is not null").collect() == []


def chunk_rows(seed: int, longest: int, texts: list[str]):
    rng = random.Random(seed)
    return {i: split(t, rng, longest) for i, t in enumerate(texts)}


def as_rows(streams):
    return [(i, n, c) for i, cs in streams.items() for n, c in enumerate(cs)]


RAW_CASES = {
    0: ["My mail is [USER_E", "MAIL_aaaaaa] and more."],
    1: ["Part 1: [US", "ER_EMAIL_aaaaaa] and [", "NETWORK_IP_bbbbbb] done."],
    2: ["Hello World. ", "", "No tokens here.", "[", "USER", "", "_EMAIL_aaaaaa", "]"],
    **{k + 10: c for k, c in chunk_rows(3, 9, [TEXT * 3, TEXT, "[" * 40 + TEXT]).items()},
    **{k + 20: c for k, c in chunk_rows(4, 3, [TEXT, TEXT[5:]]).items()},
    **{k + 30: c for k, c in chunk_rows(5, 300, [TEXT * 20]).items()},
}


def collected(df) -> dict[int, list[str]]:
    out: dict[int, list[str]] = {}
    for r in df.orderBy("stream_id", "seq").collect():
        out.setdefault(r.stream_id, []).append(r.emitted)
    return out


def test_raw_chunks_match_the_model(spark):
    df = spark.createDataFrame(as_rows(RAW_CASES), "stream_id long, seq long, chunk string")
    got = collected(ch.rehydrate_chunks(df, vault_of(spark, ENTRIES)))
    assert got == {i: model.raw_stream(c, ENTRIES) for i, c in RAW_CASES.items()}
    assert got[0] == ["My mail is ", "a$1@b.io and more."]
    flushed = collected(ch.rehydrate_chunks(df, vault_of(spark, ENTRIES), flush_at_end=True))
    for i, c in RAW_CASES.items():
        assert "".join(flushed[i]) == model.rehydrate("".join(c), ENTRIES)


def in_files(spark, rows, folder, schema, parts=3):
    """Rows as several files in order of arrival."""
    size = -(-len(rows) // parts)
    for n in range(parts):
        spark.createDataFrame(rows[n * size : (n + 1) * size], schema).coalesce(1).write.mode(
            "append"
        ).parquet(str(folder))


CHUNKS = "stream_id long, seq long, chunk string"


def test_raw_chunks_across_micro_batches(spark, tmp_path):
    rows = sorted(as_rows(RAW_CASES), key=lambda r: (r[1], r[0]))
    in_files(spark, rows, tmp_path / "in", CHUNKS)
    stream = read_stream(spark, str(tmp_path / "in"), CHUNKS, 1)
    vault = vault_of(spark, ENTRIES)
    jobs.stream_chunks(
        stream, lambda: vault, str(tmp_path / "out"), str(tmp_path / "ck")
    ).awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.select("batch").distinct().count() == 3
    assert collected(out) == {i: model.raw_stream(c, ENTRIES) for i, c in RAW_CASES.items()}


def sse_text(field: str, pieces: list[str]) -> str:
    import json

    events = ["event: start\n", 'data: {"type":"s","note":"[NETWORK_IP_bbbbbb]"}\n\n']
    for n, p in enumerate(pieces):
        delta = {"role": "a", field: p}
        if n % 5 == 4:
            delta["partial_json"] = p
        body = {"delta": delta} if field == "text" else {"choices": [{"index": 0, "delta": delta}]}
        events.append("data: " + json.dumps(body, ensure_ascii=False) + "\n\n")
    return "".join(events) + "data: {broken [USER_EMAIL_aaaaaa]\n: ping\ndata: [DONE]\n\nrest"


def test_event_streams_match_the_model(spark, tmp_path):
    rng = random.Random(11)
    streams = {
        i: split(sse_text(f, split(TEXT * 2, rng, n)), rng, size)
        for i, (f, n, size) in enumerate(
            [("content", 9, 40), ("text", 5, 200), ("reasoning_content", 30, 2000)]
        )
    }
    rows = sorted(as_rows(streams), key=lambda r: (r[1], r[0]))
    in_files(spark, rows, tmp_path / "in", CHUNKS, parts=2)
    stream = read_stream(spark, str(tmp_path / "in"), CHUNKS, 1)
    vault = vault_of(spark, ENTRIES)
    jobs.stream_sse(
        stream, lambda: vault, str(tmp_path / "out"), str(tmp_path / "ck")
    ).awaitTermination()
    got = collected(spark.read.parquet(str(tmp_path / "out")))
    for i, c in streams.items():
        assert got[i] == model.sse_stream(c, ENTRIES)


def test_batch_deltas_match_the_stream(spark):
    rng = random.Random(12)
    pieces = {0: split(TEXT * 2, rng, 9), 1: split(TEXT, rng, 4)}
    rows = []
    for i, ps in pieces.items():
        lines = sse_text(("content", "text")[i], ps).split("\n")
        rows += [(i, n, line) for n, line in enumerate(x for x in lines if x)]
    df = spark.createDataFrame(rows, "stream_id long, seq long, line string")
    out = ch.sse_delta_text(df, vault_of(spark, ENTRIES))
    for i, field in ((0, "content"), (1, "text")):
        got = [r.emitted for r in out.filter(
            (F.col("stream_id") == i) & (F.col("field") == field)).orderBy("seq").collect()]
        whole = model.rehydrate("".join(pieces[i]), ENTRIES)
        assert whole.startswith("".join(got)) and len(got) == len(pieces[i])
    kinds = {r.kind for r in ch.sse_parse(df).collect()}
    assert kinds == {"plain", "event", "delta", "text"}


def test_streaming_redaction_vault_and_counters(spark, tmp_path):
    schema = "request_id long, ts timestamp, text string"
    rows = [(i, at(i * 600), t) for i, t in enumerate(
        ["a@b.io a@b.io", "10.0.0.1", "clean", "a@b.io", "10.0.0.2 c@d.io", None])]
    in_files(spark, rows, tmp_path / "in", schema)
    stream = read_stream(spark, str(tmp_path / "in"), schema, 1)
    append_to_table(
        jobs.stream_redact(stream), str(tmp_path / "r"), str(tmp_path / "ck1")
    ).awaitTermination()
    got = {r.request_id: r.redacted for r in spark.read.parquet(str(tmp_path / "r")).collect()}
    assert got == {i: model.redact(t)[0] for i, _, t in rows}
    jobs.stream_vault(stream, str(tmp_path / "v"), str(tmp_path / "ck2")).awaitTermination()
    vault = as_dict(jobs.read_vault(spark, str(tmp_path / "v")))
    assert vault[model.token("USER_EMAIL", "a@b.io")] == ("a@b.io", 1800.0) and len(vault) == 4
    batches_to_table(
        jobs.stream_counters(stream), str(tmp_path / "c"), str(tmp_path / "ck3"),
        output_mode="update",
    ).awaitTermination()
    counts = {r.type: r.n for r in jobs.read_counters(spark, str(tmp_path / "c")).collect()}
    assert counts == {"EMAIL": 3, "IP": 2}


def test_vault_store(spark, tmp_path):
    path = str(tmp_path / "vault")
    write_vault(vault_of(spark, ENTRIES), path)
    assert read_vault_store(spark, path).count() == 2
    append_vault(saves(spark, ("[USER_EMAIL_aaaaaa]", "newer", 9)), path, str(tmp_path / "next"))
    assert as_dict(read_vault_store(spark, str(tmp_path / "next")))["[USER_EMAIL_aaaaaa]"] == (
        "newer", 9.0,
    )


def test_counter_windows(spark):
    rows = [(i, at(i * 600), "a@b.io") for i in (0, 1, 2, 12)]
    df = spark.createDataFrame(rows, "request_id long, ts timestamp, text string")
    sliding = jobs.stream_counters(df, width="1 hour", slide="30 minutes").collect()
    assert sorted(r.n for r in sliding) == [1, 1, 3, 3]
    sessions = jobs.stream_counters(df, session_gap="15 minutes").collect()
    assert sorted(r.n for r in sessions) == [1, 3]


def test_corpus_goes_to_two_sinks(spark, tmp_path):
    rows = [(i, at(i), "a@b.io", f"10.0.0.{i}") for i in range(3)]
    df = spark.createDataFrame(rows, "id long, ts timestamp, a string, b string")
    table, vault = str(tmp_path / "t"), str(tmp_path / "v")
    write_corpus(df, ["a", "b"], "id", "ts", table, vault)
    got = {r.id: (r.a, r.b) for r in spark.read.parquet(table).collect()}
    assert got == {i: (model.redact(a)[0], model.redact(b)[0]) for i, _, a, b in rows}
    stored = as_dict(read_vault_store(spark, vault))
    assert stored[model.token("USER_EMAIL", "a@b.io")] == ("a@b.io", 2.0) and len(stored) == 4
    assert read_vault_store(spark, vault, ["USER_EMAIL"]).count() == 1
