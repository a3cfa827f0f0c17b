"""Repeated keys and tokens, masks in maps of any type, and blocks with further fields."""

from __future__ import annotations

from conftest import SF_SMALL

from veilframe.operators.events import plugin_after
from veilframe.operators.logs import log_mask
from veilframe.operators.rehydrate import rehydrate


def test_repeated_keys_and_tokens(spark):
    df = spark.createDataFrame(
        [(1, "a [NETWORK_IP_aaaaaa]"), (1, "b [NETWORK_IP_aaaaaa] [NETWORK_IP_bbbbbb]")], "id int, text string"
    )
    vault = spark.createDataFrame(
        [("[NETWORK_IP_aaaaaa]", "y"), ("[NETWORK_IP_aaaaaa]", "x"), ("[NETWORK_IP_bbbbbb]", "z")],
        "token string, value string",
    )
    out = rehydrate(df, ["id"], ["text"], vault)
    assert sorted(r.text for r in out.collect()) == ["a x", "b x z"]


def test_masks_in_maps_of_numbers(spark):
    df = spark.sql("SELECT map('token', 5, 'n', 1) AS m, map('token', 'v') AS s")
    row = log_mask(df).first()
    assert row.m == {"n": 1} and list(row.s) == ["token"] and row.s["token"] != "v"


def test_blocks_keep_their_other_fields(spark):
    df = spark.sql(
        "SELECT 'x' AS output, array(named_struct('id', 7, 'text', 'ip 10.0.0.1', 'type', 'text')) AS content"
    )
    block = plugin_after(df).first().content[0]
    assert block.id == 7 and block.type == "text" and block.text.startswith("ip [NETWORK_IP_")


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_pass_below_a_redaction(spark):
    from veilframe.operators.events import event_responses
    from veilframe.operators.redact import redact_corpus, redact_text

    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    for df in (redact_text(docs), redact_corpus(docs, ["text", "source"])):
        plan = _plan(df.filter("lang = 'en' AND size(findings) > 0"))
        assert "EqualTo(lang,en)" in plan and plan.count("sha2(") <= 6, plan
    raw = docs.selectExpr("doc_id", "text AS raw")
    plan = _plan(event_responses(raw, handlers=("pre_claude",)))
    assert plan.index("Generate") < plan.rindex("pre_claude")


def test_every_rule_has_hits(spark):
    from veilframe.functions.rules import LABELS
    from veilframe.operators.redact import redact_text
    from veilframe.sources import tables as src

    assert set(src.KEYS) == set(LABELS)
    docs = src.documents(spark, SF_SMALL)
    for label in src.KEYS:
        hits = redact_text(src.with_keys(docs, label), labels=[label]).filter("size(findings) > 0")
        assert hits.filter("doc_id % 3 = 0").count() == docs.filter("doc_id % 3 = 0").count(), label


FOREIGN = {"[MASK_EML_1234]": "a@b.io", "[Mail-1]": "m", f"[{'L' * 140}_ab]": "long"}


def _vault(spark, entries):
    return spark.createDataFrame(list(entries.items()), "token string, value string")


def test_streams_know_any_token_of_the_vault(spark, tmp_path):
    import model
    from veilframe.operators.chunks import rehydrate_chunks
    from veilframe.streaming import jobs
    from veilframe.streaming.sinks import read_stream

    longest = max(FOREIGN, key=len)
    streams = {
        0: ["see [MASK_EM", "L_1234] and [Mai", "l-1]."], 1: ["see [NOTE", "] [Mail-2]", " [M"],
        2: [longest[:70], longest[70:141], longest[141:] + "!"], 3: ["a [MASK_", "x", "EML_1234]"],
    }
    rows = [(i, n, c) for i, cs in streams.items() for n, c in enumerate(cs)]
    schema = "stream_id long, seq long, chunk string"
    want = {i: model.raw_stream(c, FOREIGN) for i, c in streams.items()}
    assert want[1] == ["see [NOTE", "] [Mail-2]", " "]

    def shown(df):
        out: dict = {}
        for r in df.orderBy("stream_id", "seq").collect():
            out.setdefault(r.stream_id, []).append(r.emitted)
        return out

    df, vault = spark.createDataFrame(rows, schema), _vault(spark, FOREIGN)
    assert shown(rehydrate_chunks(df, vault)) == want
    for n in range(3):
        df.filter(f"seq = {n}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    for job in (jobs.stream_chunks, jobs.stream_sse):
        at = str(tmp_path / job.__name__)
        stream = read_stream(spark, str(tmp_path / "in"), schema, 1)
        job(stream, lambda: vault, at, at + "-ck").awaitTermination()
        assert shown(spark.read.parquet(at)) == want, job


def test_json_keys_and_spelling_stay(spark):
    from veilframe.streaming.jobs import emit_frames
    from veilframe.streaming.sse import FRAME_SCHEMA, advance

    t = "[USER_EMAIL_aaaaaa]"
    vault = _vault(spark, {t: 'q"@b.io'})
    body = f'{{ "{t}" : 1.50, "v": ["{t}", 1e400], "{t}":"{t}" }}'
    want = f'{{ "{t}" : 1.50, "v": ["q\\"@b.io", 1e400], "{t}":"q\\"@b.io" }}'
    df = spark.createDataFrame([(1, body), (2, "{}")], "id int, body string")
    got = {r.id: r.body for r in rehydrate(df, ["id"], ["body"], vault, json=True).collect()}
    assert got == {1: want, 2: "{}"}
    lines = [f'data: {{"{t}":1.50,"v":"{t}","n":-0}}\n', f'data: {{"n":1.50,"delta":{{"text":"{t}","x":2.0}}}}\n']
    rows = [(1, n, *advance("", "", {}, line, 30)[2]) for n, line in enumerate(lines)]
    out = emit_frames(spark.createDataFrame(rows, FRAME_SCHEMA), vault).orderBy("seq").collect()
    assert [r.emitted for r in out] == [
        f'data: {{"{t}":1.50,"v":"q\\"@b.io","n":-0}}\n',
        'data: {"n":1.50,"delta":{"text":"q\\"@b.io","x":2.0}}\n',
    ]


def test_json_validity(spark):
    from veilframe.operators.nested import is_json_sql

    good = ["{}", "[]", '"x"', " 1 ", "null", '{"a":1,"a":2}', "[" * 1200 + "]" * 1200, '{"[":[{}]}']
    bad = ["", " ", "1,2", "1],[2", '1,"b":2', "{", "{}{}", "1}", '{"a":1} x', "tru", "[" * 1200, '{"a" 1}']
    df = spark.createDataFrame([(x,) for x in good + bad], "j string")
    got = {r.j: r.ok for r in df.selectExpr("j", f"{is_json_sql('j')} AS ok").collect()}
    assert [x for x in good if not got[x]] == [] and [x for x in bad if got[x]] == []


def test_streams_that_start_on_an_empty_vault(spark, tmp_path):
    """Tokens that are saved after the start and cut by the end of a micro-batch."""
    from veilframe.streaming.sinks import read_stream
    from veilframe.streaming import jobs

    token = "[A_LONG_LABEL_" + "0123456789abcdef" * 3 + "]"
    whole, schema = _vault(spark, {token: "Ann"}), "stream_id long, seq long, chunk string"
    halves = [token[:40], token[40:]]
    frames = ['data: {"delta":{"text":"%s"}}\n' % x for x in ("plain", *halves)]
    for job, pieces in ((jobs.stream_chunks, ["plain", *halves]), (jobs.stream_sse, frames)):
        at = str(tmp_path / job.__name__)
        for n, piece in enumerate(pieces):
            spark.createDataFrame([(1, n, piece)], schema).coalesce(1).write.mode("append").parquet(at + "-in")
        reads = iter([whole.limit(0)])
        job(read_stream(spark, at + "-in", schema, 1), lambda: next(reads, whole), at, at + "-ck").awaitTermination()
        shown = "".join(r.emitted for r in spark.read.parquet(at).orderBy("seq").collect())
        assert "Ann" in shown and "[A_" not in shown and "abcdef" not in shown
