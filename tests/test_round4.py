"""Event streams: lines of a known shape, streams that share a bucket (rehydrate_sse, F2)."""

from __future__ import annotations

import json
import random

import pandas as pd

import model
from veilframe.streaming import jobs, sse
from veilframe.streaming.sinks import read_stream

TOKEN = "[USER_EMAIL_aaaaaa]"
TEXTS = (
    "plain", "", "é ü 😀", 'a "quoted" \\ back', "line\nend\ttab\x01", f"to {TOKEN}!", f"{TOKEN[:7]}", TOKEN[7:], "[", "[A\"b",
    " ", "x[1] y", "[NETWORK", "\\u0041", "/", "assistant", "}}", '"', "null",
)


def event(shape: int, text: str, rng: random.Random) -> str:
    ascii_ = rng.random() < 0.3
    body = [
        {"id": "c", "choices": [{"index": 0, "delta": {"content": text}}]},
        {"type": "d", "delta": {"type": "text_delta", "text": text}},
        {"choices": [{"delta": {"role": "assistant", "reasoning_content": text}, "n": 1.5}], "m": "[x]"},
        {"delta": {"content": text, "partial_json": text}},
        {"delta": {"content": None, "text": text, "note": text}},
        {"delta": {"content": text, "text": "[keep]"}},
        {"delta": {}},
        {"note": text},
    ][shape]
    return "data: " + json.dumps(body, ensure_ascii=ascii_, separators=rng.choice([(",", ":"), (", ", ": ")]))


def lines_of(rng: random.Random, count: int) -> list[str]:
    odd = [
        'data: {"delta":{"text":"a","text":"b"}}', 'data: {"delta":{"text":"}}', 'data: {"delta":{"text":"a"},"x":1e400}',
        'data: {"delta":{"text":"bad\\x"}}', 'data: {"delta":{"text":"bad\\u12"}}', 'data: {"delta":{"text":"\t"}}',
        'data: {"delta":{"text":"a"}} x', "data: [DONE]", "data: [DONE] \r", ": ping", "", f"data: {TOKEN}", "data: {}",
        'data: {"delta":{"text":"\\ud83d"}}', 'data: {"delta":{"text":"\\ude00","role":"text"}}', 'data: {"n":1,"delta":{"text":"\\/"}}',
    ]
    return [rng.choice(odd) if rng.random() < 0.2 else event(rng.randrange(8), rng.choice(TEXTS), rng) for _ in range(count)]


def framed(lines: list[str], known: bool) -> tuple:
    """What lines show, with or without shapes that are known, and what is held after them."""
    held: dict[str, str] = {}
    reader = sse._Reader()
    if not known:
        reader.learn = lambda *_: None
    sse._READERS[:] = [reader]
    shown = [sse.advance("", "", held, line + "\n", 30)[2] for line in lines]
    text = ["".join(p["fixed"] + "\0" * bool(p["live"]) + p["live"] for p in s[3]) for s in shown]
    sse._READERS.clear()
    return text, {k: v for k, v in held.items() if v}, reader.used


def test_lines_of_a_known_shape_show_the_same():
    rng = random.Random(4)
    used = 0
    for _ in range(60):
        lines = lines_of(rng, 120)
        text, held, hits = framed(lines, True)
        assert (text, held) == framed(lines, False)[:2]
        used += hits
    assert used > 2000


def test_known_shapes_are_not_read_as_json():
    lines = [f'data: {{"id":{n // 50},"choices":[{{"delta":{{"content":"word {n}"}}}}]}}' for n in range(200)]
    reader, read = sse._Reader(), []
    decode = reader.read
    reader.read = lambda text: read.append(text) or decode(text)
    sse._READERS[:] = [reader]
    shown = sse.advance("", "", {}, "\n".join(lines) + "\n", 30)[2]
    sse._READERS.clear()
    assert shown[3] == [{"fixed": "\n".join(lines) + "\n", "live": "", "json": False}]
    assert len(read) < 60  # one reading a line before


def test_shapes_that_do_not_come_again_are_not_looked_for():
    reader = sse._Reader()
    sse._READERS[:] = [reader]
    for n in range(400):
        sse.advance("", "", {}, f'data: {{"id":{n},"delta":{{"text":"a"}}}}\n', 30)
    sse._READERS.clear()
    assert reader.tried <= 65 and len(reader.shapes) == sse.SHAPES


class State:
    """A group's state as Spark hands it over."""

    value, hasTimedOut, timeout = None, False, None
    exists = property(lambda self: self.value is not None)
    get = property(lambda self: self.value)

    def update(self, value):
        self.value = value

    def remove(self):
        self.value = None

    def setTimeoutDuration(self, ms):  # noqa: N802 - Spark's name
        self.timeout = ms


def shown_by(run, state, rows) -> dict:
    batch = pd.DataFrame(rows, columns=["stream_id", "seq", "chunk"])
    out = pd.concat(run((0,), iter([batch[:2], batch[2:]]), state))
    return {(r.stream_id, r.seq): r.raw + "".join(p["fixed"] + p["live"] for p in r.pieces or []) + r.rest for r in out.itertuples()}


def test_streams_share_a_bucket():
    """Chunks of several streams in any order; what a stream holds is its own, also later."""
    state, run = State(), sse.frame_events(40)
    line = 'data: {"delta":{"text":"%s"}}\n'
    first = [(2, 1, line % "b [USER"), (1, 1, "x\n"), (2, 0, line % "a"), (1, 0, "data: "), (3, 0, "data: [DONE]\n\n")]
    assert shown_by(run, state, first) == {
        (1, 0): "", (1, 1): "data: x\n", (2, 0): line % "a", (2, 1): line % "b ", (3, 0): "data: [DONE]\n\n"}
    assert [s for s, *_ in json.loads(state.value[0])] == [2]  # streams that hold nothing leave nothing
    assert shown_by(run, state, [(1, 2, "data: {"), (2, 2, line % "_EMAIL_aaaaaa]"), (9, 0, None)]) == {
        (1, 2): "", (2, 2): line % TOKEN, (9, 0): ""}
    assert [s for s, *_ in json.loads(state.value[0])] == [1]
    assert shown_by(run, state, [(1, 3, '"delta":1}\n'), (4, 0, "end\n"), (4, 1, "")])[(1, 3)] == 'data: {"delta":1}\n'
    assert not state.exists


def test_idle_streams_end_though_their_bucket_goes_on():
    state, run = State(), sse.frame_events(40, idle_seconds=5)
    shown_by(run, state, [(1, 0, "data: {"), (2, 0, "data: {"), (2, 1, "")])
    kept = json.loads(state.value[0])
    state.update((json.dumps([[s, at - 10, *rest] for s, at, *rest in kept]),))
    shown_by(run, state, [(2, 2, "}"), (3, 0, "data: x"), (3, 1, "")])
    assert sorted(s for s, *_ in json.loads(state.value[0])) == [2, 3] and state.timeout == 5000


def test_many_streams_and_the_null_one(spark, tmp_path):
    """Streams of few buckets, cut by micro-batches, against the model; ids beyond what a float holds."""
    rng, schema = random.Random(5), "stream_id long, seq long, chunk string"
    big = (1 << 53) + 1
    texts = {s: "".join(f'data: {{"delta":{{"text":{json.dumps(t)}}}}}\n\n' for t in ("a", TOKEN[:9], TOKEN[9:], f" {s}"))
             for s in [None, *range(20), big]}
    rows = []
    for s, text in texts.items():
        cuts = sorted(rng.sample(range(1, len(text)), 9))
        rows += [(s, n, text[a:b]) for n, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(text)], strict=True))]
    for part in range(2):
        some = [r for r in rows if (r[1] < 5) == (part == 0)]
        rng.shuffle(some)
        spark.createDataFrame(some, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    vault = spark.createDataFrame([(TOKEN, "Ann")], "token string, value string")
    at = str(tmp_path / "out")
    jobs.stream_sse(read_stream(spark, str(tmp_path / "in"), schema, 1), lambda: vault, at, at + "-ck").awaitTermination()
    got: dict = {}
    for r in spark.read.parquet(at).orderBy("seq").collect():
        got.setdefault(r.stream_id, []).append(r.emitted)
    chunks = {s: [c for i, _, c in sorted((r for r in rows if r[0] == s), key=lambda r: r[1])] for s in texts}
    # the vault is joined on the stream, so tokens of the null one stay
    assert got == {s: model.sse_stream(c, {TOKEN: TOKEN if s is None else "Ann"}) for s, c in chunks.items()}
