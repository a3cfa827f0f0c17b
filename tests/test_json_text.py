"""JSON texts without schema, odd payloads, and aggregates over the last rows of a global order."""

from __future__ import annotations

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from veilframe.functions.json_text import masked, members
from veilframe.functions.ordered import over_last, with_positions
from veilframe.operators.events import event_responses, event_status, parse_events
from veilframe.operators.logs import MASK, MASKED_FIELDS, log_mask_json
from veilframe.operators.metrics import latency_rolling

NAMES = ["token", "secret", "a", "bé", 'to"k', "x]"]


def some(rng: random.Random, depth: int = 0):
    kind = rng.random()
    if depth > 4 or kind < 0.4:
        return rng.choice(["x", 'a"b\\', "{", "]:,", 5, 1.5, True, None, "", [], {}])
    if kind < 0.6:
        return [some(rng, depth + 1) for _ in range(rng.randint(0, 3))]
    return {rng.choice(NAMES): some(rng, depth + 1) for _ in range(rng.randint(0, 4))}


def plain_mask(record, deep: int = 2):
    if not isinstance(record, dict) or not deep:
        return record
    return {
        k: MASK if k in MASKED_FIELDS and v is not None else plain_mask(v, deep - 1) if isinstance(v, dict) else v
        for k, v in record.items()
    }


def test_masks_equal_a_walk_over_parsed_records():
    rng = random.Random(1)
    for _ in range(3000):
        record = some(rng)
        text = json.dumps(record, indent=rng.choice([None, 1]), ensure_ascii=rng.random() < 0.5)
        assert json.loads(masked(text, frozenset(MASKED_FIELDS), MASK)) == plain_mask(record), text


def test_members_equal_lookups_in_parsed_records():
    rng = random.Random(2)
    paths = (("a",), ("token",), ("a", "token"), ("a", "token", "secret"), ("secret",))
    for _ in range(3000):
        record = some(rng)
        want = {}
        for p in paths:
            at = record
            for k in p:
                at = at[k] if isinstance(at, dict) and k in at else ...
            if at is not ...:
                want[p] = at
        got = members(json.dumps(record, indent=rng.choice([None, 1])), paths)
        assert {p: json.loads(v) for p, v in got.items()} == want
    twice = '{"a":{"token":1},"token":3,"a":{"secret":2},"token":"x"}'
    assert members(twice, (("a", "token"), ("token",), ("a", "secret"))) == {("token",): '"x"', ("a", "secret"): "2"}


def test_log_records_of_any_shape(spark):
    deep = '{"a":' + "[" * 3000 + "]" * 3000 + ',"token":1}'
    rows = {
        '{"\\u0074oken" : 1.50 , "n":1.50}': f'{{"\\u0074oken" : "{MASK}" , "n":1.50}}',
        '{"token":{"a":1},"x":{"token":"y': f'{{"token":"{MASK}","x":{{"token":"{MASK}"',
        '{"x":{"y":{"token":1}},"Token":2}': '{"x":{"y":{"token":1}},"Token":2}',
        "not json token": "not json token", '["token"]': '["token"]', "": "", deep: deep.replace(":1}", f':"{MASK}"}}'),
    }
    df = spark.createDataFrame([*enumerate(rows), (99, None)], "id long, record string")
    got = {r.id: r.record for r in log_mask_json(df, "record").collect()}
    assert got == {**dict(enumerate(rows.values())), 99: None}


def test_payloads_with_repeated_keys_and_depth(spark):
    mail = "a@b.io"
    nest = "[" * 1500 + f'"{mail}"' + "]" * 1500
    raws = {
        1: f'{{"hook_event_name":"PreToolUse","hook_event_name":"BeforeTool","tool_input":1,"tool_input":{{"x":"{mail}"}}}}',
        2: f'{{"hook_event_name":"PreToolUse","tool_input":{nest}}}',
        3: f'{{"tool_response":{{"stdout":"{mail}"}},"tool_response":{{"stderr":"clean \\u00e9"}}}}',
        4: '{"tool_name":5,"tool_name":"x","tool_response":{"file":{"content":"a","content":"b"},"output":7}}',
        5: '{"a":1,"a":', 6: " ", 7: None,
        8: '{"hook_event_name":"PostToolUse","tool_name":"a","tool_name":"mcp__x","tool_response":{"content":[{"text":"%s","text":"%s"}]}}' % ("first", mail),
    }
    df = spark.createDataFrame(list(raws.items()), "id long, raw string")
    status = {r.id: r.status for r in event_status(df).collect()}
    assert status == {1: "ok", 2: "ok", 3: "ok", 4: "ok", 5: "invalid", 6: "blank", 7: "blank", 8: "ok"}
    parsed = {r.id: r for r in parse_events(df).collect()}
    assert {i: r.handler for i, r in parsed.items()} == {
        1: "pre_gemini", 2: "pre_claude", 3: "post_builtin", 4: "post_builtin", 8: "post_mcp"}
    assert (parsed[3].event_text, parsed[4].event_text) == ("clean é", "b")
    out = {r.id: r.response for r in event_responses(df).collect()}
    assert set(out) == {1, 2, 8} and all(mail not in r and "[USER_EMAIL_" in r for r in out.values())
    assert '"tool_input":{"x":"[USER_EMAIL_' in out[1] and out[2].count("[") >= 1501


@pytest.mark.parametrize("width", [7, 1000])
def test_means_over_the_last_rows(spark, width):
    rng = random.Random(4)
    t0 = dt.datetime(2024, 1, 1)
    rows = [(t0 + dt.timedelta(seconds=rng.randint(0, 300)), i, rng.uniform(-5, 90)) for i in range(900)]
    df = spark.createDataFrame(rows, "ts timestamp, id long, value double").repartition(6)
    got = [(r.id, r.duration_ms, r.mean_ms) for r in latency_rolling(df, ["ts", "id"], "value", 5, width).orderBy("ts", "id").collect()]
    kept = [(i, int(v + 0.5)) for _, i, v in sorted(rows) if v + 0.5 >= 1]
    assert [g[:2] for g in got] == kept
    for n, (_, _, mean) in enumerate(got):
        last = [ms for _, ms in kept[max(0, n - 4) : n + 1]]
        assert mean == sum(last) / len(last)
    plan = latency_rolling(df, ["ts", "id"], "value", 5, width)._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan


def test_positions_are_ordinals(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("k")).repartition(5)
    assert [r.k for r in with_positions(df, ["k"]).filter("_pos <> k").collect()] == []
    empty = with_positions(df.limit(0), ["k"])
    assert over_last(empty, "_pos", 3, {"n": F.count("*")}).collect() == []
    with pytest.raises(ValueError):
        over_last(empty, "_pos", 9, {}, width=8)
