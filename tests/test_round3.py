"""Work that grows no faster than the input: what is read often is made once."""

from __future__ import annotations

from pyspark.sql import functions as F

from model import token as mint_of
from veilframe.functions.ordered import preceding_tail
from veilframe.operators.requests import exchange_join
from veilframe.streaming.jobs import emit_frames
from veilframe.streaming.sse import FRAME_SCHEMA, advance

TOKEN = "[USER_EMAIL_aaaaaa]"


def _vault(spark, entries):
    return spark.createDataFrame(list(entries.items()), "token string, value string")


def _counted(spark, rows, schema):
    """A frame whose rows are counted whenever they are made."""
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    return spark.createDataFrame(rows, schema).mapInArrow(count, schema), made


def test_framed_events_are_made_once(spark):
    """The state function stands below the frames: reading them thrice ran it thrice (F1)."""
    lines = ['data: {"delta":{"text":"plain"}}\n', f'data: {{"delta":{{"text":"to {TOKEN}"}}}}\n', f"x {TOKEN} y"]
    rows = [(1, n, *advance("", "", {}, line, 30)[2]) for n, line in enumerate(lines)]
    frames, made = _counted(spark, rows, FRAME_SCHEMA)
    out = emit_frames(frames, _vault(spark, {TOKEN: 'a"b'})).orderBy("seq").collect()
    assert [r.emitted for r in out] == [
        'data: {"delta":{"text":"plain"}}\n', 'data: {"delta":{"text":"to a\\"b"}}\n', 'x a"b y']
    assert made.value == len(rows)


def test_events_without_a_bracket_are_one_piece():
    lines = 'data: {"choices":[{"delta":{"content":"a"}}]}\n\ndata: {"delta":{"text":"b","partial_json":"c"}}\n'
    (was, raw, hold, pieces) = advance("", "", {}, lines, 30)[2]
    assert (was, raw, hold) == ("", "", "") and pieces == [{"fixed": lines, "live": "", "json": False}]


def test_tails_take_one_sort(spark):
    """Of keys within their first block the rows alone are shuffled and sorted, once (F2, F3, F4)."""
    rows = [(k, i, "ab"[: i % 3]) for k in (1, 2) for i in range(20)]
    df = spark.createDataFrame(rows, "k long, seq long, t string")
    out = preceding_tail(df, ["k"], "seq", F.col("t"), 3, "tail")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Sort [") == 1 and plan.count("Exchange ") == 1 and "Window" not in plan
    for r in out.collect():
        assert r.tail == "".join(t for k, i, t in rows if k == r.k and i < r.seq)[-3:]


def test_exchanges_meet_before_they_are_staged(spark):
    """The staged exchange holds the reply, so whole rows join no more (F8); a request without a
    response still fills the vault, and its exchange is not listed."""
    mail, token = "a@b.io", mint_of("USER_EMAIL", "a@b.io")
    sent = spark.createDataFrame(
        [(1, "POST", f'{{"m": "{mail}"}}'), (2, "POST", "{}")], "request_id long, method string, body string"
    ).withColumn("ts", F.timestamp_seconds(F.lit(0)))
    replies = spark.createDataFrame([(2, 200, f'{{"t":"{token}"}}')], "request_id long, status long, body string")
    out = exchange_join(sent, replies)
    assert [(r.request_id, r.has_redacted, r.client_body) for r in out.collect()] == [(2, False, f'{{"t":"{mail}"}}')]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join Inner") == 1
