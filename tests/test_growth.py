"""Work that grows no faster than the input: event lines (F5) and keys of any form (F6)."""

from __future__ import annotations

import json

from veilframe.operators import chunks, patterns, rehydrate
from veilframe.sources import tables


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_event_lines_are_classified_by_the_shape_of_their_delta(spark):
    """fields are taken from one struct; only objects are deltas and only strings are text."""
    delta = {
        '{"content":"a","text":"1","partial_json":"{}"}': ("delta", "a", "1", None, "{}"),
        '{"content":1,"text":true,"reasoning_content":{"a":"b"},"partial_json":["x"]}': ("delta", None, None, None, None),
        '{"content":null,"reasoning_content":""}': ("delta", None, None, "", None),
        '{"Content":"a","x":{"content":"b"}}': ("delta", None, None, None, None),
        "{}": ("delta", None, None, None, None),
        '"content"': ("event", None, None, None, None),
        "null": ("event", None, None, None, None),
        '[{"content":"a"}]': ("event", None, None, None, None),
        '{"content":"a","content":"b"}': ("text", None, None, None, None),
    }
    none = (None,) * 4
    want = {f'data: {{"delta":{k}}}': v for k, v in delta.items()}
    want |= {f'data: {{"choices":[{{"delta":{k}}}]}}': v for k, v in delta.items()}
    want |= {
        'data: {"choices":[{"delta":{"text":"first"}}],"delta":{"text":"second"}}': ("delta", None, "first", None, None),
        'data: {"choices":[{"delta":7}],"delta":{"text":"second"}}': ("delta", None, "second", None, None),
        'data: {"choices":{"delta":{"text":"x"}}}': ("event", *none), "data: 1": ("event", *none),
        "data: [DONE]": ("plain", *none), "data: [DONE] \t": ("plain", *none), "data: [DONE] x": ("text", *none),
        "data: [DONE]\nx": ("text", *none), 'data: ["DONE"]': ("event", *none), "data: ": ("text", *none),
        "data:{}": ("plain", *none), "": ("plain", *none), None: ("text", *none),
    }
    df = spark.createDataFrame([(1, i, line) for i, line in enumerate(want)], "stream_id long, seq long, line string")
    got = {r.line: tuple(r)[3:] for r in chunks.sse_parse(df).collect()}
    assert got == want


def test_lines_are_read_as_json_once(spark):
    """also below a filter, which repeated the parser before."""
    df = spark.createDataFrame([(1, 1, "data: {}")], "stream_id long, seq long, line string")
    for out in (chunks.sse_parse(df), chunks.sse_parse(df).filter("kind = 'delta'")):
        assert plan_of(out).count("parseJson(") == 1


def test_event_lines_come_from_one_redaction(spark, tmp_path):
    """head and deltas come out of one pass over the texts; a null text has a head alone."""
    at = str(tmp_path / "texts")
    spark.createDataFrame([(0, 'a "b"\n' * 10), (1, ""), (2, None)], "request_id long, redacted string").write.parquet(at)
    df = tables.sse_lines(spark.read.parquet(at))
    assert plan_of(df).count("FileScan") == 1
    got = {(r.stream_id, r.seq): r.line for r in df.collect()}
    head = [(s, 0, "event: start") for s in range(3)] + [(s, 2, "data: {broken") for s in range(3)] + [(s, 3, "data: [DONE]") for s in range(3)]
    note = json.dumps('a "b"\n' * 10)
    pieces = [('a "b"\n' * 10)[i : i + tables.DELTA_SIZE] for i in (0, tables.DELTA_SIZE)]
    want = {(s, n): line for s, n, line in head} | {
        (0, 1): f'data: {{"type":"message_start","note":{note}}}', (1, 1): 'data: {"type":"message_start","note":""}', (2, 1): None}
    want |= {(0, 4 + n): f'data: {{"id":"c","choices":[{{"index":0,"delta":{{"content":{json.dumps(p)}}}}}]}}' for n, p in enumerate(pieces)}
    assert got == want


def test_literal_keys_are_replaced_without_staging_texts(spark, monkeypatch):
    """every stage of every text was written; now only keys and the rows they stand in are."""
    written = []

    def stage(df, name):
        rows = [tuple(r) for r in df.collect()]
        written.extend(rows)
        return spark.createDataFrame(rows, df.schema)

    monkeypatch.setattr(rehydrate, "stage", stage)
    monkeypatch.setattr(patterns, "stage", stage)
    # b comes out of a, c out of b; "joined" comes about where the value of c meets its neighbour
    entries = [("KEY_aaaaaaa", "<KEY_bbbbbbb>"), ("KEY_bbbbbbb", "KEY_ccccccc"), ("KEY_ccccccc", "join"), ("join> ed", "late"), ("never", "x")]
    vault = spark.createDataFrame([(n, k, v) for n, (k, v) in enumerate(entries)], "at long, token string, value string")
    texts = ["marker KEY_aaaaaaa ed", "marker KEY_bbbbbbb", "marker alone", "KEY_ccccccc marker", None]
    df = spark.createDataFrame([(i, t, "o") for i, t in enumerate(texts)], "id long, text string, other string")
    got = {r.id: (r.text, r.other) for r in rehydrate.rehydrate_literal(df, ["id"], "text", vault, "at").collect()}
    assert got == {0: ("marker <late", "o"), 1: ("marker join", "o"), 2: ("marker alone", "o"), 3: ("join marker", "o"), 4: (None, "o")}
    assert written and not [r for r in written if "marker" in repr(r)]
