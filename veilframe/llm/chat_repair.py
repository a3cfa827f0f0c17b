"""Conversation structure repair by a square-root checkpointed dynamic programme.

A conversation is well formed if the initials of its roles read ``(s?(ua)+)?``: nothing, or an
optional system row and then user and assistant in turn.  Rows may be kept (``K``), given the
role user or assistant (``R``), deleted (``D``), and empty ones inserted (``I``); the cheapest
edits are found, and of equally cheap ones those whose letters come first in ASCII.

Four states say what may follow: at the start, after a system row, after a user row, after an
assistant row.  The cost of the best way to the end from each state, before a row, is a vector
of four numbers.  A conversation of n rows is cut into blocks of about the square root of the
longest one's length, and such vectors are only kept at the ends of blocks:

1. each block gives the cost from any state before it to any state after it (blocks in parallel);
2. one row per conversation folds these from its end: the vector at every checkpoint;
3. each block, again on its own, computes its vectors anew from its checkpoint and walks
   forward from each state, taking the least letter among the edits that keep the cost;
4. one row per conversation follows the states through its blocks, which picks each block's walk.

A task holds one block, or one row per block of a conversation: the square root of its length
in both cases.  Rows are put in order by a range sort, so that no conversation is one task's.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.llm.common import text_batches
from veilframe.sources.stage import stage

WHITE = r"\x20\x09-\x0D"
NEVER = 1 << 60
RETAG, DELETE, INSERT, CUT = 2, 3, 2, 1
START, SYSTEM, USER, ASSISTANT = range(4)
#: the state after one more user or assistant row; which of the two follows from the state
NEXT = (USER, USER, ASSISTANT, USER)
NAMES = {USER: "user", ASSISTANT: "assistant"}
#: cost to end a conversation in each state
END = (0, 2 * INSERT, INSERT, 0)
Vector = tuple[int, int, int, int]


def after_keeping(state: int, code: str) -> int | None:
    """The state after a kept row, None if its role does not fit."""
    role = code.lower()
    if role == "s":
        return SYSTEM if state == START else None
    return NEXT[state] if role == ("a" if state == USER else "u") else None


def backward(codes: str, end: Vector) -> list[Vector]:
    """Least cost from each state before each row and after the last one, where ``end`` is the
    cost after it.  A code is the role's initial, in upper case for a truncated text, ``x`` for
    another role, and ``-`` for a row that must go."""
    out = [end]
    for code in reversed(codes):
        then, cut = out[-1], CUT if code.isupper() else 0
        found = []
        for state in range(4):
            cost = DELETE + then[state]
            if code != "-":
                cost = min(cost, RETAG + cut + then[NEXT[state]])
                kept = after_keeping(state, code)
                if kept is not None:
                    cost = min(cost, cut + then[kept])
            found.append(cost)
        user, assistant = found[USER], found[ASSISTANT]
        found[USER], found[ASSISTANT] = min(user, INSERT + assistant), min(assistant, INSERT + user)
        for state in (START, SYSTEM):
            found[state] = min(found[state], INSERT + found[USER])
        out.append(tuple(min(c, NEVER) for c in found))
    return out[::-1]


def walk(codes: str, costs: list[Vector], state: int, last: bool) -> tuple[str, int]:
    """The ASCII-least edits that keep the cost, and the state after them; with ``last``, also
    those after the last row."""
    letters = []
    for i, code in enumerate(codes):
        cut = CUT if code.isupper() else 0
        while True:
            now, then = costs[i], costs[i + 1]
            if DELETE + then[state] == now[state]:
                letters.append("D")
            elif INSERT + now[NEXT[state]] == now[state]:
                letters.append("I")
                state = NEXT[state]
                continue
            elif (kept := after_keeping(state, code)) is not None and cut + then[kept] == now[state]:
                letters.append("K")
                state = kept
            else:
                letters.append("R")
                state = NEXT[state]
            break
    while last and costs[-1][state]:
        letters.append("I")
        state = NEXT[state]
    return "".join(letters), state


@functools.lru_cache(1 << 14)
def passage(codes: str) -> tuple[int, ...]:
    """Cost from each state before the rows to each state after them, row by row."""
    ends = [tuple(0 if s == q else NEVER for s in range(4)) for q in range(4)]
    by_end = [backward(codes, e)[0] for e in ends]
    return tuple(by_end[q][p] for p in range(4) for q in range(4))


@functools.lru_cache(1 << 14)
def walks(codes: str, end: Vector, last: bool) -> tuple[tuple[str, ...], tuple[int, ...]]:
    costs = backward(codes, end)
    found = [walk(codes, costs, s, last) if costs[0][s] < NEVER else ("", s) for s in range(4)]
    return tuple(f[0] for f in found), tuple(f[1] for f in found)


class Repair(NamedTuple):
    """``rows``: every edit in order, with its row; ``blocks``: the edits' letters by block;
    ``report``: one row per conversation."""

    rows: DataFrame
    blocks: DataFrame
    report: DataFrame


def in_order(rows: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """``conv, turn, role, text, at``: the rows, and a number that rises with conversation,
    turn (nulls first), role and text and leaves no gap within a conversation but between tasks."""
    kept = rows.select(
        F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(F.col(role_col), F.lit(" ")).alias("role"), F.coalesce(F.col(text_col), F.lit(" ")).alias("text"))
    # equal rows differ in the last column, so that any number of them can be cut into ranges
    placed = kept.withColumn("salt", F.monotonically_increasing_id()).orderBy("conv", "turn", "role", "text", "salt")
    return stage(placed.drop("salt").withColumn("at", F.monotonically_increasing_id()), "ordered")


def coded(ordered: DataFrame) -> DataFrame:
    """``conv, at, initial, code, fault``: what the repair needs to know of each row."""
    first = ordered.groupBy("conv", "role", F.sha2("text", 256)).agg(F.min("at").alias("first")).select("first")
    blank = ~F.col("text").rlike(f"[^{WHITE}]")
    initial = F.substring("role", 1, 1)
    row = ordered.select(
        "conv", "at", F.when(initial.isin("s", "u", "a"), initial).otherwise("x").alias("initial"), blank.alias("blank"),
        F.col("text").rlike(f"[.!?][{WHITE}]*\\z").alias("ended"))
    fault = F.when(F.col("blank"), "blank").when(F.col("first").isNull(), "duplicate").when(~F.col("ended"), "truncated")
    code = F.when(F.col("fault").isin("blank", "duplicate"), "-").when(F.col("fault").isNotNull(), F.upper("initial"))
    return row.join(first, row["at"] == first["first"], "left").withColumn("fault", fault).select(
        "conv", "at", "initial", F.coalesce(code, "initial").alias("code"), "fault")


def blocks_of(codes: DataFrame, length: int) -> DataFrame:
    """``conv, start, codes, initials`` and fault counts of each block."""
    one = F.array_sort(F.collect_list(F.struct("at", "code", "initial")))
    counts = [F.sum((F.col("fault") == f).cast("long")).alias(f) for f in ("blank", "duplicate", "truncated")]
    return codes.groupBy("conv", F.floor(F.col("at") / length).alias("block")).agg(
        one.alias("held"), *(F.coalesce(c, F.lit(0)).alias(n) for c, n in zip(counts, ("blank", "duplicate", "truncated")))
    ).select(
        "conv", F.col("held")[0]["at"].alias("start"), F.array_join("held.code", "").alias("codes"),
        F.array_join("held.initial", "").alias("initials"), "blank", "duplicate", "truncated")


def with_passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [list(passage(c.as_py())) for c in batch.column("codes")]
        yield batch.append_column("passage", pa.array(found, pa.list_(pa.int64())))


def checkpoints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From ``starts, passages`` in order: the cost after each block, and of the whole."""
    for batch in text_batches(batches, 256):
        rows = []
        for starts, passages in zip(batch.column("starts").to_pylist(), batch.column("passages").to_pylist()):
            end, last = END, True
            for start, flat in zip(reversed(starts), reversed(passages)):
                before = tuple(min(min(c + e for c, e in zip(flat[4 * p : 4 * p + 4], end)), NEVER) for p in range(4))
                rows.append((start, list(end), last, before[START]))
                end, last = before, False
        kinds = pa.int64(), pa.list_(pa.int64()), pa.bool_(), pa.int64()
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[j] for r in rows], k) for j, k in enumerate(kinds)], ["at_start", "end", "last", "cost"])


def with_walks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [walks(c, tuple(e), l) for c, e, l in zip(*(batch.column(n).to_pylist() for n in ("codes", "end", "last")))]
        batch = batch.append_column("letters", pa.array([list(f[0]) for f in found], pa.list_(pa.string())))
        yield batch.append_column("exits", pa.array([list(f[1]) for f in found], pa.list_(pa.int32())))


def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From ``starts, exits`` in order: the state before each block."""
    for batch in text_batches(batches, 256):
        rows = []
        for starts, exits in zip(batch.column("starts").to_pylist(), batch.column("exits").to_pylist()):
            state = START
            for start, to in zip(starts, exits):
                rows.append((start, state))
                state = to[state]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32())], ["at_start", "state"])


def edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per letter: its block, place and row, and the role of a new or retagged row."""
    for batch in text_batches(batches, 64):
        rows = []
        for start, codes, letters, state in zip(*(batch.column(n).to_pylist() for n in ("start", "codes", "letters", "state"))):
            at = start
            for place, letter in enumerate(letters):
                role = None
                if letter == "K":
                    state = after_keeping(state, codes[at - start])
                elif letter != "D":
                    state = NEXT[state]
                    role = NAMES[state]
                rows.append((start, place, letter, None if letter == "I" else at, role))
                at += letter != "I"
        kinds = pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.string()
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[j] for r in rows], k) for j, k in enumerate(kinds)], ["start", "place", "edit", "row", "new_role"])


def schema_of(df: DataFrame, more: str) -> str:
    return ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema] + [more])


def repair(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
           text_col: str = "text") -> Repair:
    """Repair every conversation.

    Rows are taken by turn, nulls first; rows of one turn by role and text.  A row's first
    fault counts: blank (only white space), duplicate (role and text were there before), or
    truncated (the last character that is not white space is none of ``.!?``).  Blank and
    duplicate rows are deleted (3); other rows are kept (0), retagged (2) or deleted (3), and a
    truncated row that stays costs 1 more; an inserted row costs 2.

    ``rows`` of the result has ``conv, start, place`` (the order within a conversation), ``edit,
    turn, role, text``: the role and text after the edit, and for deleted rows those they had.
    ``blocks`` has ``conv, start, letters``.  ``report`` has ``conv, gaps, blank, duplicate,
    truncated, illegal, cost``: the number of turns missing between the least and the greatest,
    the rows by first fault, neighbours whose initials are not ``su``, ``ua`` or ``au``, and the
    cost of the edits.

    A null role or text is one space, so a row with a null text is blank; a role with another
    initial, or an empty one, cannot be kept.  A null conversation is one of its own.  An empty
    table gives empty results.  Further columns are not looked at.
    """
    ordered = in_order(rows, conv_col, turn_col, role_col, text_col)
    longest = ordered.groupBy("conv").count().agg(F.max("count")).first()[0] or 1
    blocks = blocks_of(coded(ordered), int(np.ceil(np.sqrt(longest))))
    blocks = stage(blocks.mapInArrow(with_passages, schema_of(blocks, "passage array<long>")), "blocks")

    def folded(of: DataFrame, column: str, alias: str) -> DataFrame:
        """One row per conversation: what its blocks have in ``column``, in order."""
        held = F.array_sort(F.collect_list(F.struct("start", column)))
        return of.groupBy("conv").agg(held.alias("held")).select(
            F.col("held.start").alias("starts"), F.col(f"held.{column}").alias(alias))

    ends = folded(blocks, "passage", "passages").mapInArrow(
        checkpoints, "at_start long, end array<long>, last boolean, cost long")
    walked = blocks.drop("passage", "blank", "duplicate", "truncated").join(ends, F.col("start") == F.col("at_start")).drop("at_start")
    walked = stage(walked.mapInArrow(with_walks, schema_of(walked, "letters array<string>, exits array<int>")), "walked")
    states = folded(walked, "exits", "exits").mapInArrow(entries, "at_start long, state int")
    chosen = walked.join(states, F.col("start") == F.col("at_start")).select(
        "conv", "start", "codes", "initials", "cost", "state", F.expr("letters[state]").alias("letters"))
    chosen = stage(chosen, "chosen")

    made = chosen.select("start", "codes", "letters", "state").mapInArrow(
        edits, "start long, place int, edit string, row long, new_role string")
    texts = ordered.select("at", "turn", "role", "text", F.col("conv").alias("of"))
    convs = chosen.select(F.col("start").alias("_start"), "conv")
    out = made.join(texts, F.col("row") == F.col("at"), "left").join(convs, F.col("start") == F.col("_start")).select(
        "conv", "start", "place", "edit", "turn", F.coalesce("new_role", "role").alias("role"),
        F.coalesce("text", F.lit("")).alias("text"))
    return Repair(out, chosen.select("conv", "start", "letters"), report_of(ordered, blocks, chosen))


def report_of(ordered: DataFrame, blocks: DataFrame, chosen: DataFrame) -> DataFrame:
    turns = ordered.groupBy("conv", "turn").count().groupBy("conv").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).alias("gaps"))
    faults = blocks.groupBy("conv").agg(*(F.sum(n).alias(n) for n in ("blank", "duplicate", "truncated")))

    def illegal(initials: Column) -> Column:
        pairs = F.zip_with(F.split(initials, ""), F.split(F.substring(initials, 2, 1 << 30), ""), lambda a, b: F.concat(a, b))
        return F.size(F.filter(pairs, lambda p: p.isNotNull() & (F.length(p) == 2) & ~p.isin("su", "ua", "au")))

    # a block's initials, and the last one of the block before it
    ends = chosen.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct(
        "start", F.left("initials", F.lit(1)).alias("first"), F.right("initials", F.lit(1)).alias("last"),
        illegal(F.col("initials")).alias("inner"), "cost"))).alias("held"))
    seams = F.zip_with("held", F.slice("held", 2, F.greatest(F.size("held"), F.lit(1))), lambda a, b: F.concat(a["last"], b["first"]))
    inner = F.aggregate("held", F.lit(0).cast("long"), lambda acc, h: acc + h["inner"])
    across = F.size(F.filter(seams, lambda p: p.isNotNull() & ~p.isin("su", "ua", "au")))
    illegal_and_cost = ends.select("conv", (inner + across).alias("illegal"), F.col("held")[0]["cost"].alias("cost"))
    return merged([turns, faults, illegal_and_cost])


def merged(tables: list[DataFrame]) -> DataFrame:
    """The columns of tables with one row per ``conv`` side by side; a null is a value as any."""
    both = functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)
    return both.groupBy("conv").agg(*(F.max(c).alias(c) for c in both.columns if c != "conv"))


def digests(rows: DataFrame, key: str, order: list[str], piece: Column, between: str, out: str) -> DataFrame:
    """``key, out``: SHA-256 of the pieces of each key in order.  A digest reads its text from
    end to end, so a key's pieces stream through one task; they are sorted on disk and never
    held together."""
    placed = rows.select(key, *order, piece.alias("piece")).repartition(key).sortWithinPartitions(key, *order)
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha, now, started = None, None, False
        arrow = None
        for batch in text_batches(batches, 256):
            arrow, ready = batch.schema.field(0).type, []
            for k, p in zip(batch.column(0).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()):
                if started and k == now:
                    sha.update(between.encode())
                else:
                    if started:
                        ready.append((now, sha.hexdigest()))
                    sha, now, started = hashlib.sha256(), k, True
                sha.update(p.encode())
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in ready], arrow), pa.array([r[1] for r in ready], pa.string())], [key, out])
        if started:
            yield pa.RecordBatch.from_arrays([pa.array([now], arrow), pa.array([sha.hexdigest()], pa.string())], [key, out])

    return placed.mapInArrow(run, f"`{key}` {kind}, `{out}` string")
