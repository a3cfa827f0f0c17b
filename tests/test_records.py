"""Nested records, JSON, tool events and the access audit."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

import model
from veilframe.operators.access import access_split, sensitive_command, sensitive_path
from veilframe.operators.events import (
    event_responses,
    event_status,
    parse_events,
    plugin_after,
    plugin_before,
)
from veilframe.operators.nested import redact_json, redact_nested
from veilframe.operators.redact import with_flags

ARGS = {
    "email": "user@example.com",
    "ipv4": "192.168.1.1",
    "ipv6": "2001:0db8:85a3:0000:0000:8a2e:0370:7334",
    "config": {
        "apiKey": "sk-1234567890abcdef12345",
        "secretToken": "very-secret-string-of-length-32",
    },
    "message": "Contact me at support@company.org or visit 10.0.0.1",
    "author": "",
    "n": 5,
}


def to_row(value):
    if isinstance(value, dict):
        return Row(**{k: to_row(v) for k, v in value.items()})
    return value


def test_nested_record(spark):
    df = spark.createDataFrame([Row(id=1, args=to_row(ARGS))])
    row = with_flags(redact_nested(df, ["args"])).first()
    found: list = []
    assert row.args.asDict(recursive=True) == model.redact_tree(ARGS, None, found)
    assert [tuple(f) for f in row.findings] == found
    assert row.token_count == 8


def test_arrays_drop_the_key_and_maps_keep_it(spark):
    df = spark.sql(
        "SELECT array('x', 'a@b.io') AS tokens, map('Auth-Id', 'x', 'note', 'a@b.io') AS m,"
        " map('password', array('plain')) AS deep, CAST(NULL AS STRUCT<token: STRING>) AS gone"
    )
    row = redact_nested(df).first()
    mail = model.redact("a@b.io")[0]
    assert row.tokens == ["x", mail]
    assert row.m == {"Auth-Id": model.token("SENSITIVE_SECRET", "x"), "note": mail}
    assert row.deep == {"password": ["plain"]}
    assert row.gone is None


JSON_ROWS = [
    ARGS,
    {"b": [1, 2.5, None, True, {"password": 'p"w\\'}], "a": "l1\nmail a@b.io é \u0001 / \t"},
    ["a@b.io", ["token", {"token": ["a@b.io"], "x": "token=abcdefghijklmnopqrst"}]],
    {"a@b.io": "kept key", "k:": "v", "quo\"te": {"se-cret": "x", "auth": {"y": "z"}}},
    "just a@b.io",
    {},
    [],
    {"text": "x" * 20000 + '"' * 3000 + " a@b.io"},
]


def test_json_of_any_shape(spark):
    df = spark.createDataFrame(
        [(i, json.dumps(v, indent=1)) for i, v in enumerate(JSON_ROWS)], "id long, raw string"
    )
    rows = redact_json(df, "raw").orderBy("id").collect()
    for value, row in zip(JSON_ROWS, rows, strict=True):
        found: list = []
        want = model.redact_tree(value, None, found)
        assert json.loads(row.redacted) == want
        assert list(json.loads(row.redacted)) == list(want)
        assert [tuple(f) for f in row.findings] == found


def test_invalid_json_gives_null(spark):
    df = spark.createDataFrame([("not json",), ("",), (None,), ('{"a": ',)], "raw string")
    assert [r.redacted for r in redact_json(df, "raw").collect()] == [None] * 4


MAIL = "admin@secret.corp"
EVENTS = [
    ({"tool_name": "Bash", "tool_response": {"stdout": f"email: {MAIL}"}},
     "post_builtin", {"decision": "block", "reason": f"email: {MAIL}"}),
    ({"tool_name": "Read", "tool_response": {"file": {"content": MAIL, "filePath": "/x"}}},
     "post_builtin", {"decision": "block", "reason": MAIL}),
    ({"tool_name": "Bash", "tool_response": {"stderr": "to 192.168.1.100 failed"}},
     "post_builtin", {"decision": "block", "reason": "to 192.168.1.100 failed"}),
    ({"tool_name": "Bash", "tool_response": {"stdout": "hello world"}}, "post_builtin", None),
    ({"tool_name": "Bash"}, "post_builtin", None),
    ({"tool_response": {"stdout": f"a {MAIL}", "stderr": "10.0.0.1 down", "output": "x"}},
     "post_builtin", {"decision": "block", "reason": f"a {MAIL}\n10.0.0.1 down\nx"}),
    ({"tool_name": "Grep", "tool_response": {"content": f'mail: "{MAIL}"', "stdout": 5}},
     "post_builtin", {"decision": "block", "reason": f'mail: "{MAIL}"'}),
    ({"hook_event_name": "PreToolUse", "tool_name": "mcp__a__b",
      "tool_input": {"channel": "#general", "text": f"ask {MAIL}"}},
     "pre_claude", {"hookSpecificOutput": {
         "hookEventName": "PreToolUse", "permissionDecision": "allow",
         "updatedInput": {"channel": "#general", "text": f"ask {MAIL}"}}}),
    ({"hook_event_name": "PreToolUse", "tool_input": {"title": "x"}}, "pre_claude", None),
    ({"hook_event_name": "PreToolUse", "tool_input": "a@b.io"}, "pre_claude", None),
    ({"hook_event_name": "PreToolUse",
      "tool_input": {"title": "R", "properties": {"email": MAIL, "ip": "10.20.30.40"}}},
     "pre_claude", {"hookSpecificOutput": {
         "hookEventName": "PreToolUse", "permissionDecision": "allow",
         "updatedInput": {"title": "R", "properties": {"email": MAIL, "ip": "10.20.30.40"}}}}),
    ({"hook_event_name": "BeforeTool", "tool_input": {"text": MAIL}},
     "pre_gemini", {"hookSpecificOutput": {"tool_input": {"text": MAIL}}}),
    ({"hook_event_name": "PostToolUse", "tool_name": "mcp__db__q",
      "tool_response": {"content": [{"type": "text", "text": "Rows:"},
                                    {"type": "x", "note": MAIL}, {"type": "text", "text": "no"}]}},
     "post_mcp", {"updatedMCPToolOutput": {"content": [
         {"type": "text", "text": "Rows:"}, {"type": "x", "note": MAIL},
         {"type": "text", "text": "no"}]}}),
    ({"hook_event_name": "PostToolUse", "tool_name": "mcp__s__p", "tool_response": {"s": MAIL}},
     "post_mcp", None),
    ({"hook_event_name": "PostToolUse", "tool_name": "Bash", "tool_response": {"output": MAIL}},
     "post_builtin", {"decision": "block", "reason": MAIL}),
    ({"hook_event_name": "AfterTool", "tool_name": "mcp__db__q",
      "tool_response": {"content": [{"text": f"1: {MAIL}"}, {"type": "image", "text": 7},
                                    {"text": "2: 192.168.0.1"}]}},
     "after_mcp", {"decision": "deny", "reason": f"1: {MAIL}\n2: 192.168.0.1"}),
    ({"hook_event_name": "AfterTool", "tool_name": "mcp__s__p", "tool_response": None},
     "after_mcp", None),
    ({"hook_event_name": "AfterTool", "tool_name": "sh", "tool_response": {"stdout": MAIL}},
     "after_builtin", {"decision": "deny", "reason": MAIL}),
    ({"hook_event_name": "Other", "tool_name": "mcp__x", "tool_response": {"stdout": MAIL}},
     "post_builtin", {"decision": "block", "reason": MAIL}),
]


def test_event_routes_and_responses(spark):
    df = spark.createDataFrame(
        [(i, json.dumps(p)) for i, (p, *_) in enumerate(EVENTS)], "id long, raw string"
    )
    rows = event_responses(df, changed_only=False).orderBy("id").collect()
    for (payload, handler, want), row in zip(EVENTS, rows, strict=True):
        assert row.handler == handler, payload
        if want is None:
            assert row.response is None, payload
        else:
            assert json.loads(row.response) == model.redact_tree(want, None, []), payload
    changed = {r.id for r in event_responses(df).collect()}
    assert changed == {i for i, e in enumerate(EVENTS) if e[2] is not None}


def test_event_quarantine(spark):
    df = spark.createDataFrame([("",), (" \n ",), ("not json",), ("{}",)], "raw string")
    assert [r.status for r in event_status(df).collect()] == ["blank", "blank", "invalid", "ok"]
    assert parse_events(df).count() == 1


def test_plugin_results_and_arguments(spark):
    df = spark.createDataFrame(
        [(MAIL, [("text", "at 10.0.0.1"), ("image", "at 10.0.0.1"), ("text", None)]),
         (None, None)],
        "output string, content array<struct<type: string, text: string>>",
    )
    first, second = plugin_after(df).collect()
    assert first.output == model.redact(MAIL)[0]
    assert [b.text for b in first.content] == [model.redact("at 10.0.0.1")[0], "at 10.0.0.1", None]
    assert second.output is None and second.content is None
    calls = spark.createDataFrame(
        [("read", {"filePath": "/p/.env", "extra": MAIL}), ("bash", {"command": "cat .env"}),
         ("write", {"filePath": ".env", "content": MAIL}), ("read", {})],
        "tool string, args map<string, string>",
    )
    rows = plugin_before(calls, prefix="[guard] ").collect()
    assert [r.blocked_reason for r in rows] == [
        "[guard] Blocked: sensitive file", "[guard] Blocked: command reads sensitive file",
        None, None,
    ]
    assert rows[0].args["extra"] == MAIL and not rows[0].has_redacted
    assert rows[2].args == {"filePath": ".env", "content": model.redact(MAIL)[0]}


SENSITIVE = """.env .env.local .env.production .env.development.local credentials.json
credentials.yaml db-credentials secret.txt secrets.yaml server.pem tls.key id_rsa id_rsa.pub
.netrc .pgpass keystore.p12 cert.pfx truststore.jks app.keystore private.asc
/home/user/project/.env.local /etc/ssl/private/server.key config/credentials.json""".split()
HARMLESS = """package.json src/index.ts README.md tsconfig.json .gitignore environment.ts
docker-compose.yml secrets/readme key""".split()
READS = [
    "cat .env", "cat /app/.env.local", "head -5 secrets.yaml", "tail -n 20 credentials.json",
    "less .env.production", "more secret.txt", "bat id_rsa", "cat .pgpass",
    "cat foo.txt && cat .env", "echo hello | cat .env", "cat $HOME/.env", "cat ${HOME}/.env",
    "cat ~/secrets/.env", "batcat .env", 'cat "$(echo .env)"', "cat `.env`", "cat <.env",
    "cat '.env'", "cat < .env", "x <\n.env; less y",
]
NO_READS = [
    "cat README.md", "ls -la", 'echo "hello"', "grep password src/config.ts",
    "head -5 package.json", "cat src/index.ts", "npm install", "node dist/cli.js", "ls .env",
    "cat -.env", ".env cat x", "", "concatenate .env",
]


@pytest.mark.parametrize(
    ("test", "yes", "no"),
    [(sensitive_path, [*SENSITIVE, "a/ .env "], [*HARMLESS, ".env\n.pem\nx", "a.pem\n/b", ""]),
     (sensitive_command, READS, NO_READS)],
)
def test_sensitive_names(spark, test, yes, no):
    df = spark.createDataFrame([(t,) for t in [*yes, *no]], "t string")
    for i, row in enumerate(df.select("t", test("t").alias("hit")).collect()):
        assert row.hit == (i < len(yes)), row.t
    assert spark.sql("SELECT CAST(NULL AS STRING) AS t").select(test("t")).first()[0] is False


def test_access_split_keeps_every_call(spark):
    df = spark.createDataFrame(
        [(1, "read", ".env", None), (2, "bash", None, "cat .env"), (3, "write", ".env", None),
         (4, "read", None, None)],
        "id long, tool string, file_path string, command string",
    )
    allowed, blocked = access_split(df)
    assert sorted(r.id for r in allowed.collect()) == [3, 4]
    assert sorted(r.id for r in blocked.collect()) == [1, 2]


def test_json_redaction_stays_in_the_jvm(spark):
    df = spark.createDataFrame([("{}",)], "raw string").select(F.col("raw"))
    plan = redact_json(df, "raw")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan
