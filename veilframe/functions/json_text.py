"""Cutting JSON texts of any shape at their own spelling, for what has no schema.

A walk over the text's tokens knows the depth and the names around each value, needs no
recursion and so has no limit of depth, and never changes a number or an escape.  Rows that
need it come in Arrow batches; the others are settled by expressions before.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

TOKEN = re.compile(r'"(?:[^"\\]|\\.)*(?:"|\Z)|[{}\[\],:]|[^"{}\[\],:\s]+|\s+', re.S)
KINDS = {'"': "string", "{": "object", "[": "array", "t": "boolean", "f": "boolean", "n": "null"}


class Value(NamedTuple):
    """A value and where it stands: the names of the objects around it, None for an array."""

    path: tuple[str | None, ...]
    start: int
    end: int


def name_of(literal: str) -> str:
    """The name that a key's literal spells."""
    if "\\" not in literal:
        return literal[1:-1]
    try:
        return json.loads(literal, strict=False)
    except ValueError:
        return literal[1:-1]


def values(text: str, deepest: int, inside: Callable[[tuple], bool] = lambda path: True) -> Iterator[Value]:
    """The values in objects that stand at most ``deepest`` names deep, inner ones first.

    ``inside`` says of a path whether the values below it are wanted.  A value that the text
    breaks off in ends with the text.
    """
    path: list[str | None] = []  # of the value that is being read
    opened: list[tuple[str, int, bool]] = []  # bracket, where it stands, whether its values are wanted
    start = name = None
    for m in TOKEN.finditer(text):
        kind, at = m.group()[0], m.start()
        if kind.isspace() or kind == ":":
            continue
        object_is_open = bool(opened) and opened[-1][0] == "{"
        if kind == '"' and object_is_open and name is None:
            name = m.group()
            wanted = opened[-1][2]
            path.append(name_of(name) if wanted else None)
        elif kind in "{[":
            wanted = kind == "{" and len(path) < deepest and (not opened or opened[-1][2]) and inside(tuple(path))
            opened.append((kind, at, wanted))
            if kind == "[":
                path.append(None)
            start, name = at, None
        elif kind in "}],":
            if kind != "," and opened:
                bracket, at, _ = opened.pop()
                if bracket == "[":
                    path.pop()
                start = at
                object_is_open = bool(opened) and opened[-1][0] == "{"
                # the closed value ends here; its own member ends with the next comma or bracket
                if object_is_open and path and opened[-1][2]:
                    yield Value(tuple(path), start, m.end())
                if object_is_open and path:
                    path.pop()
                name = None
            elif kind == ",":
                name = None
        else:  # a string or a word as a value
            if object_is_open and path:
                if opened[-1][2]:
                    yield Value(tuple(path), at, m.end())
                path.pop()
            start = at
    while opened:
        bracket, at, _ = opened.pop()
        if bracket == "[" and path:
            path.pop()
        if opened and opened[-1][0] == "{" and path:
            if opened[-1][2]:
                yield Value(tuple(path), at, len(text))
            path.pop()


def kind_of(value: str) -> str:
    return KINDS.get(value[:1], "number")


def masked(text: str, names: frozenset[str], mask: str) -> str:
    """The text with the values of the named fields, at the top and one object down, replaced;
    nulls stay.  A text that is no object stays as it is."""
    if not text.lstrip().startswith("{"):
        return text
    spans = [(v.start, v.end) for v in values(text, 2) if v.path[-1] in names and text[v.start : v.end] != "null"]
    out, at = [], 0
    for start, end in sorted(spans, key=lambda s: (s[0], -s[1])):
        if start >= at:  # else inside a value that is masked as a whole
            out += [text[at:start], json.dumps(mask)]
            at = end
    return "".join([*out, text[at:]])


def members(text: str, paths: tuple[tuple[str, ...], ...]) -> dict[tuple[str, ...], str]:
    """The texts of the values at ``paths``.  Of repeated names the last one holds, with all
    that is in it and nothing of the earlier ones."""
    ways = {p[:n] for p in paths for n in range(len(p))}
    found: dict[tuple, Value] = {}
    for v in values(text, max(map(len, paths)), lambda path: path in ways):
        if v.path in paths or v.path in ways:
            found[v.path] = v
    out = {}
    for p in paths:
        v = found.get(p)
        around = [found.get(p[:n]) for n in range(1, len(p))]
        if v and all(a and a.start <= v.start and v.end <= a.end for a in around):
            out[p] = text[v.start : v.end]
    return out
