"""Metrics, logs, requests, sources and the session helpers."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

import model
from veilframe.operators import logs, metrics
from veilframe.operators import requests as reqs
from veilframe.operators.redact import explode_findings, redact_text
from veilframe.session import ROW_GROUP_BYTES, checkpoint_dir, spread
from veilframe.sources.io import read_chunks, read_logs, read_payloads
from veilframe.sources.stage import stage

T0 = dt.datetime(2024, 1, 1)


def found(spark):
    df = spark.createDataFrame(
        [(1, "s1", "a@b.io a@b.io 10.0.0.1"), (2, "s1", "fe80::1 a@b.io"),
         (3, "s2", "ghp_" + "a1B2" * 9)], "request_id long, source string, text string"
    )
    return explode_findings(redact_text(df), ["request_id", "source"])


def test_counts(spark):
    f = found(spark)
    assert {r.type: r.n for r in metrics.pii_by_type(f).collect()} == {
        "EMAIL": 2, "IP": 2, "PAT": 1,
    }
    assert {r.label: r.n for r in metrics.pii_by_label(f).collect()}["NETWORK_IP_V6"] == 1
    counts = {r.request_id: r.token_count for r in metrics.request_token_count(f).collect()}
    assert counts == {1: 2, 2: 2, 3: 1}
    rolled = {(r.source, r.label): r.n for r in metrics.pii_by_source(f).collect()}
    assert rolled[(None, None)] == 6 and rolled[("s1", "USER_EMAIL")] == 3


def test_latency_keeps_the_last_fifty_positive(spark):
    rows = [(T0 + dt.timedelta(seconds=i), float(i % 7) / 2) for i in range(200)]
    df = spark.createDataFrame(rows, "ts timestamp, ms double")
    got = [r.duration_ms for r in metrics.latency_last(df, ["ts"], "ms").orderBy("ts").collect()]
    want = [int(ms + 0.5) for _, ms in rows if int(ms + 0.5) > 0][-50:]
    assert got == want
    plan = metrics.latency_last(df, ["ts"], "ms")._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


@pytest.mark.parametrize(("n", "percent"), [(0, 0), (4, 0), (5, 1), (500, 50), (2000, 100)])
def test_gauge(spark, n, percent):
    df = spark.createDataFrame([(n,)], "redacted_count long")
    assert metrics.vault_gauge(df).first()[0] == percent


def test_leaks(spark):
    bare = "abcdefghijklmnopqrst"
    df = spark.createDataFrame(
        [(1, "a@b.io"), (2, f"api_key={bare} and {bare}"), (3, "clean"),
         (4, "token=token=token=token=token= abcdefghijklmnopqrst")], "id long, text string"
    )
    got = {r.id: (r.n_rescan, r.n_known) for r in
           metrics.leak_audit(redact_text(df), ["id"]).collect()}
    assert got == {2: (0, 1), 4: (1, 0)}


def test_leaks_of_the_whole_vault(spark):
    vault = spark.createDataFrame(
        [("a@b.io",), (" 555-010-0199",), ("x(y)+\\\\E\n.z",), ("::",), ("secret",)],
        "value string",
    )
    df = spark.createDataFrame(
        [(1, "to a@b.io."), (2, "aa@b.io a@b.iox"), (3, "call 555-010-0199 a@b.io"),
         (4, "q x(y)+\\\\E\n.z"), (5, "::"), (6, "secrets"), (7, None), (8, "secret secret")],
        "id long, text string",
    )
    got = {r.id: r.n_known for r in
           metrics.vault_leak_audit(df, ["id"], "text", vault).collect()}
    assert got == {1: 1, 2: 1, 3: 2, 4: 1, 5: 1, 6: 1, 8: 1}


def test_log_mask_and_severity(spark):
    df = spark.sql(
        "SELECT 5 AS token, 'x' AS apikey, CAST(NULL AS STRING) AS password, 'fatal' AS level,"
        " named_struct('secret', 's', 'Token', 't', 'in', named_struct('secret', 'deep')) AS a,"
        " map('idToken', 'v', 'idtoken', 'w') AS m, array('token') AS l"
    )
    row = logs.log_mask(df).first()
    assert (row.token, row.apikey, row.password) == ("[REDACTED]", "x", None)
    assert row.a.asDict(True) == {"secret": "[REDACTED]", "Token": "t", "in": {"secret": "deep"}}
    assert row.m == {"idToken": "[REDACTED]", "idtoken": "w"} and row.l == ["token"]
    levels = spark.createDataFrame([(x,) for x in ["info", "warn", "x", None]], "level string")
    assert [r[0] for r in levels.select(logs.log_severity()).collect()] == [
        "INFO", "WARNING", "DEFAULT", "DEFAULT",
    ]


GOOGLE = "https://generativelanguage.googleapis.com"
ROUTED = [
    ("POST", "/v1/messages", {"X-Api-Key": "k"}, "anthropic",
     "https://api.anthropic.com/v1/messages", False),
    ("POST", "/v1/messages", {"x-api-key": ""}, "anthropic",
     "https://api.anthropic.com/v1/messages", True),
    ("POST", "/v1/chat/completions", {"x-api-key": "k"}, "openai",
     "https://api.openai.com/v1/chat/completions", True),
    ("POST", "/api/coding/paas/v4/chat/completions", {"authorization": "Bearer x"}, "zhipuai",
     "https://api.z.ai/api/coding/paas/v4/chat/completions", False),
    ("POST", "/v1beta/models/m:run?key=1&x=2", {}, "google",
     GOOGLE + "/v1beta/models/m:run?key=1&x=2", False),
    ("POST", "/v1beta/models/m:run", {}, "google", GOOGLE + "/v1beta/models/m:run", True),
    ("POST", "/v1beta/models/a/b", {}, "google", GOOGLE + "/v1beta/models/a/b", False),
    ("GET", "/v1/messages", {}, "google", GOOGLE + "/v1/messages", False),
    ("GET", "/health", {}, "health", None, False),
    ("DELETE", "/v1/x/123?q", {}, "google", GOOGLE + "/v1/x/123?q", False),
]


def test_routes(spark):
    df = spark.createDataFrame(
        [(i, *r[:3]) for i, r in enumerate(ROUTED)],
        "id long, method string, path string, headers map<string, string>",
    )
    rows = reqs.route_classify(df).withColumn("missing", reqs.missing_auth()).orderBy("id")
    for want, row in zip(ROUTED, rows.collect(), strict=True):
        assert (row.provider, row.target, row.missing) == want[3:]


def test_exchange(spark):
    mail, token = "a@b.io", model.token("USER_EMAIL", "a@b.io")
    sent = [(1, "POST", '{"stream": true, "m": "a@b.io"}'), (2, "GET", '{"m": "c@d.io"}'),
            (3, "PUT", '{"stream": "true"}'), (4, "PATCH", '{"stream": 1}')]
    df = spark.createDataFrame(sent, "request_id long, method string, body string").withColumn(
        "ts", F.lit(T0)
    )
    assert [r[0] for r in df.orderBy("request_id").select(reqs.stream_mode()).collect()] == [
        True, False, True, False,
    ]
    other = model.token("USER_EMAIL", "c@d.io")
    replies = spark.createDataFrame(
        [(1, 200, f'{{"t":"{token}"}}'), (2, 200, f'{{"t":"{token} {other}"}}'),
         (3, 429, f'{{"t":"{token}"}}'), (4, 204, "{}")],
        "request_id long, status long, body string",
    )
    got = {r.request_id: r for r in reqs.exchange_join(df, replies).collect()}
    assert got[1].forwarded == f'{{"stream":true,"m":"{token}"}}' and got[1].has_redacted
    assert got[1].client_body == f'{{"t":"{mail}"}}'
    assert got[2].forwarded is None and got[2].client_body == f'{{"t":"{mail} {other}"}}'
    assert got[3].client_body == f'{{"t":"{token}"}}'


def test_restored_values_are_escaped_inside_json(spark):
    vault = spark.createDataFrame(
        [("[SENSITIVE_SECRET_aaaaaa]", 'q"\\\n')], "token string, value string"
    )
    body = spark.createDataFrame(
        [(1, 200, '{"t":"[SENSITIVE_SECRET_aaaaaa]"}')], "request_id long, status long, body string"
    )
    got = reqs.rehydrate_responses(body, vault).first().body
    assert got == '{"t":"q\\"\\\\\\n"}'


def test_sources(spark, tmp_path):
    (tmp_path / "p.txt").write_text('{"a": 1}\nnot json\n')
    assert [r.raw for r in read_payloads(spark, str(tmp_path / "p.txt")).collect()] == [
        '{"a": 1}', "not json",
    ]
    (tmp_path / "l.json").write_text('{"level": "info", "token": "x"}\n')
    row = logs.log_mask(read_logs(spark, str(tmp_path / "l.json"), "level string, token string"))
    assert row.first().token == "[REDACTED]"
    spark.createDataFrame([(1, 0, "x")], "stream_id long, seq long, chunk string").write.parquet(
        str(tmp_path / "c")
    )
    assert read_chunks(spark, str(tmp_path / "c")).count() == 1


def test_staged_tables_go_to_the_named_folder(spark):
    df = stage(spark.range(5).withColumn("x", F.lit("y")), "t")
    assert df.count() == 5 and checkpoint_dir(spark) in df.inputFiles()[0]


def test_only_small_inputs_are_spread(spark):
    small = spread(spark.range(10).select(F.col("id")))
    assert "Exchange RoundRobin" in small._jdf.queryExecution().executedPlan().toString()
    rows = spark.sparkContext.defaultParallelism * ROW_GROUP_BYTES
    large = spread(spark.range(rows))
    assert "Exchange" not in large._jdf.queryExecution().executedPlan().toString()
