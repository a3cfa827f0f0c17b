"""Framing of server-sent events: the stateful step of event-stream rehydration.

Per stream and chunk it yields what may be shown by now, as pieces: fixed text, and live
text in which tokens are still to be replaced.  It knows nothing of the vault but the
length of its longest token, so a stream's state is an incomplete line, the end of plain text
and, per field, the end of a text that may yet become a token.  Streams are dealt to buckets, as
a group costs Spark about as much as some hundred chunks; a bucket's state lists the streams
that hold something.

Text outside of events is ``raw``.  Its end ``hold`` may be the beginning of a token; whether
it waits is decided where the vault is read, there and for the next chunk, to which it is
``was``.  (Where an event line follows such an end without a line end, it counts as an event.)
"""

from __future__ import annotations

import json
import re
import time
import uuid
from collections.abc import Callable, Iterator
from typing import Any, NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState

from veilframe.operators.chunks import HELD_DELTA, PARTIAL
from veilframe.operators.nested import JSON_STRING

FRAME_SCHEMA = (
    "stream_id long, seq long, was string, raw string, hold string,"
    " pieces array<struct<fixed: string, live: string, json: boolean>>"
)
FRAME_STATE = "streams string"  # JSON: stream_id, time of its last chunk, buffer, was, held
# What the state function returns: the pieces that hold live text, null where none does, and the
# fixed text after them.
SHOWN_SCHEMA = FRAME_SCHEMA + ", rest string"
BUCKETS = 1024  # a checkpoint is bound to this number

# The field marker, the end marker, and the fields that carry text.
DATA = "data: "
DONE = "data: [DONE]"
FIELDS = (("content", "text"), ("reasoning_content",), ("partial_json",))

_HELD = re.compile(HELD_DELTA.replace(r"\z", r"\Z"))
_STRING = re.compile(JSON_STRING)
_PARTIAL = re.compile(PARTIAL.replace(r"\z", r"\Z"))
_SPECIAL = re.compile(r'["\\\x00-\x1f]')
_INSIDE = re.compile(r'(?:[^"\\\x00-\x1f]++|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*+')


def _piece(fixed: str = "", live: str = "", is_json: bool = False) -> dict[str, Any]:
    return {"fixed": fixed, "live": live, "json": is_json}


def _no_constant(name: str) -> None:
    raise ValueError(f"not JSON: {name}")


def _value_pieces(text: str) -> list[dict[str, Any]]:
    """A JSON text in which the string values with a bracket are live; keys never are."""
    pieces, start = [], 0
    for m in _STRING.finditer(text):
        if "[" in m.group() and not text.startswith(":", m.end()):
            pieces.append(_piece(text[start : m.start()], m.group(), True))
            start = m.end()
    return [*pieces, _piece(fixed=text[start:])]


def _delta(event: Any) -> dict | None:
    """The delta object of an event, in either of its two places."""
    if not isinstance(event, dict):
        return None
    choices = event.get("choices")
    first = choices[0] if isinstance(choices, list) and choices else None
    for delta in (first.get("delta") if isinstance(first, dict) else None, event.get("delta")):
        if isinstance(delta, dict):
            return delta
    return None


class _Shape(NamedTuple):
    """What stands around the only text field of an event, as it is read and as it is printed."""

    head: str
    tail: str
    name: str
    before: str
    after: str


SHAPES = 16  # the last shapes used, kept


class _Reader:
    """Reads and prints events.  What is compiled for its mark serves many events."""

    def __init__(self) -> None:
        # Numbers travel as marked strings, so that they are printed as they were spelled.
        self.mark = mark = uuid.uuid4().hex
        self.numbers = re.compile(f'"{mark}([^"]*)"')
        self.fields = re.compile(f"<{mark}(\\d+){mark}>")
        self.read = json.JSONDecoder(
            parse_constant=_no_constant, parse_float=mark.__add__, parse_int=mark.__add__
        ).decode
        self.dump = json.JSONEncoder(ensure_ascii=False, separators=(",", ":")).encode
        self.probe = uuid.uuid4().hex
        self.shapes: list[_Shape] = []
        self.tried = self.used = 0

    def __reduce__(self) -> tuple:
        return _Reader, ()  # a new mark on each machine

    def printed(self, value: Any) -> str:
        return self.numbers.sub(r"\1", self.dump(value))

    def named(self, delta: dict) -> list[str]:
        """The fields of a delta that carry text."""
        return [
            n for names in FIELDS
            if (n := next((n for n in names if isinstance(delta.get(n), str) and self.mark not in delta[n]), None))
        ]

    def shaped(self, line: str) -> tuple[_Shape, str] | None:
        """The shape of a line that was met before, and the line's text.

        A string literal may hold anything that ends it neither early nor in an error, whatever
        stands around it, so such a line need not be read as JSON.
        """
        for n, shape in enumerate(self.shapes):
            size = len(line) - len(shape.head) - len(shape.tail)
            if size >= 0 and line.startswith(shape.head) and line.endswith(shape.tail):
                text = line[len(shape.head) : len(shape.head) + size]
                if _SPECIAL.search(text):
                    if not _INSIDE.fullmatch(text):
                        continue
                    text = self.read(f'"{text}"')
                if self.mark in text:
                    return None
                if n:
                    self.shapes.insert(0, self.shapes.pop(n))
                self.used += 1
                return shape, text
        return None

    def learn(self, line: str, name: str, text: str) -> None:
        """Keep the shape of a line with ``text`` in its only field ``name``: put something else in
        its place and see that just this field changes.  Where shapes do not come again, this ends."""
        if self.tried > 64 + self.used:
            return
        self.tried += 1
        for m in _STRING.finditer(line):
            head, tail = line[: m.start() + 1], line[m.end() - 1 :]
            try:
                if self.read(m.group()) != text:
                    continue
                event = self.read(f"{head[len(DATA) :]}{self.probe}{tail}")
            except ValueError:
                continue
            delta = _delta(event)
            if delta is not None and delta.get(name) == self.probe and self.named(delta) == [name]:
                delta[name] = f"<{self.mark}0{self.mark}>"
                before, _, after = self.fields.split(DATA + self.printed(event) + "\n")
                self.shapes = [_Shape(head, tail, name, before, after), *self.shapes[: SHAPES - 1]]
                return


_READERS: list[_Reader] = []


def _reader() -> _Reader:
    """The reader of this process."""
    if not _READERS:
        _READERS.append(_Reader())
    return _READERS[0]


def _shown(held: dict[str, str], name: str, text: str, longest: int) -> str:
    """What of a field's text is shown now, with what was held of it; its end may be held."""
    if was := held.get(name):
        text = was + text
    found = _HELD.search(text) if "[" in text else None
    rest = found.group() if found and len(found.group()) < longest else ""
    if was or rest:
        held[name] = rest
    return text[: len(text) - len(rest)]


def _line_pieces(line: str, held: dict[str, str], longest: int) -> list[dict[str, Any]]:
    """The pieces of a data line."""
    reader = _reader()
    printed = reader.printed
    try:
        event = reader.read(line[len(DATA) :])
    except ValueError:
        return [_piece(live=line + "\n")]
    delta = _delta(event)
    if delta is None:
        return [_piece(DATA), *_value_pieces(printed(event)), _piece(fixed="\n")]
    # Each text field gives way to a mark, which then splits the event into pieces.
    names, shown = reader.named(delta), []
    if len(names) == 1:
        reader.learn(line, names[0], delta[names[0]])
    for name in names:
        shown.append(_shown(held, name, delta[name], longest))
        delta[name] = f"<{reader.mark}{len(shown) - 1}{reader.mark}>"
    parts = reader.fields.split(DATA + printed(event) + "\n")
    pieces = [
        _piece(parts[i], reader.dump(shown[int(parts[i + 1])])[1:-1], True)
        for i in range(0, len(parts) - 1, 2)
    ]
    return [*pieces, _piece(fixed=parts[-1])]


def _framed(lines: list[str], held: dict[str, str], longest: int) -> tuple[list[dict[str, Any]] | None, str]:
    """The pieces of whole lines that can hold a token, each with the fixed text before it, and
    the fixed text after them."""
    reader, pieces, fixed = _reader(), None, ""
    shaped = reader.shaped
    for line in lines:
        if not line:
            fixed += "\n"
            continue
        if not line.startswith(DATA) or line.startswith(DONE) and line.strip() == DONE:
            fixed += line + "\n"
            continue
        found = shaped(line)
        if found:
            shape, text = found
            shown = _shown(held, shape.name, text, longest)
            if _SPECIAL.search(shown):
                shown = reader.dump(shown)[1:-1]
            new = [_piece(shape.before, shown, True), _piece(shape.after)] if "[" in shown else None
            if new is None:
                fixed += shape.before + shown + shape.after
                continue
        else:
            new = _line_pieces(line, held, longest)
        for p in new:
            if "[" in p["live"]:
                pieces = pieces or []
                pieces.append(_piece(fixed + p["fixed"], p["live"], p["json"]))
                fixed = ""
            else:
                fixed += p["fixed"] + p["live"]
    return pieces, fixed


Shown = tuple[str, str, str, list[dict[str, Any]]]


def _advance(
    buffer: str, was: str, held: dict[str, str], chunk: str, longest: int
) -> tuple[str, str, tuple[str, str, str, list[dict[str, Any]] | None, str]]:
    """Take in one chunk, see ``advance``; the pieces are as in ``SHOWN_SCHEMA``."""
    buffer += chunk
    if DATA not in buffer:
        # Not an event stream (yet): only a possible token start waits.
        partial = _PARTIAL.search(was + buffer)
        hold = partial.group() if partial and len(partial.group()) < longest else ""
        return "", hold, (was, buffer, hold, None, "")
    lines, newline, rest = buffer.rpartition("\n")
    if not newline:
        return buffer, was, ("", "", "", None, "")
    pieces, fixed = _framed(lines.split("\n"), held, longest)
    return rest, "", (was, "", "", pieces, fixed)


def advance(
    buffer: str, was: str, held: dict[str, str], chunk: str, longest: int
) -> tuple[str, str, Shown]:
    """Take in one chunk.

    Returns the new buffer, the end of plain text that may wait, and what can be shown: the
    end that may have waited so far, plain text, its end that may wait now, and pieces.
    """
    buffer, was, (waited, raw, hold, pieces, fixed) = _advance(buffer, was, held, chunk, longest)
    return buffer, was, (waited, raw, hold, [*(pieces or []), *([_piece(fixed)] if fixed else [])])


def bucket_of(stream: str) -> Column:
    """The bucket of a stream; the null stream has its own, so ids are whole numbers in all others."""
    return F.when(F.col(stream).isNotNull(), F.pmod(F.xxhash64(stream), F.lit(BUCKETS)))


def frame_events(
    longest: int, idle_seconds: float | None = None
) -> Callable[[tuple, Iterator[pd.DataFrame], GroupState], Iterator[pd.DataFrame]]:
    """The state function for ``applyInPandasWithState`` by ``bucket_of`` (or by a finer key).

    An idle stream's state is removed: with that of its bucket, or when others of it go on."""

    def run(
        key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState
    ) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        streams = {s: kept for s, *kept in json.loads(state.get[0])} if state.exists else {}
        batch, now = pd.concat(list(pdfs)), time.time()
        ids, seq = batch["stream_id"], batch["seq"].to_numpy()
        null = ids.isna().any()
        order = np.argsort(seq, kind="stable") if null else np.lexsort((seq, ids.to_numpy()))
        batch = batch.iloc[order]
        waited, raw, hold, rest = (np.full(len(batch), "", dtype=object) for _ in range(4))
        pieces = np.full(len(batch), None, dtype=object)
        names = [None] * len(batch) if null else batch["stream_id"].tolist()
        last = len(batch) - 1
        for n, chunk in enumerate(batch["chunk"].tolist()):
            if n == 0 or names[n] != names[n - 1]:
                _, buffer, was, held = streams.pop(names[n], (now, "", "", {}))
            if chunk and "\n" not in chunk and DATA in buffer:  # as ``_advance`` does, the most frequent case
                buffer += chunk
            else:
                buffer, was, (waited[n], raw[n], hold[n], pieces[n], rest[n]) = _advance(
                    buffer, was, held, chunk or "", longest
                )
            if (n == last or names[n + 1] != names[n]) and (buffer or was or any(held.values())):
                streams[names[n]] = (now, buffer, was, held)
        if idle_seconds is not None:
            streams = {s: kept for s, kept in streams.items() if kept[0] > now - idle_seconds}
        if streams:
            state.update((json.dumps([(s, *kept) for s, kept in streams.items()]),))
            if idle_seconds is not None:
                state.setTimeoutDuration(int(idle_seconds * 1000))
        elif state.exists:
            state.remove()
        columns = {"was": waited, "raw": raw, "hold": hold, "pieces": pieces, "rest": rest}
        yield pd.DataFrame({"stream_id": batch["stream_id"].array, "seq": batch["seq"].array, **columns})

    return run
