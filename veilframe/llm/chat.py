"""Chat formatting by schema fingerprints.

Records are JSON texts of different layouts: message lists, prompt and response, instruction,
input and output, nested dialogues.  The nested field paths of a record are hashed; the hash
selects a declarative mapping, which says where turns, roles and texts are.  Canonical turns
are written with a template whose control strings are escaped inside texts, reversibly, and
the loss mask is a list of spans of the formatted text.  All of it is Catalyst expressions.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The template's fixed strings: a turn is OPEN role newline text CLOSE newline.
OPEN, CLOSE = "<s>", "</s>"
CONTROL = r"/?(?:s>|INST\]|SYS\])"
TURN = "struct<role:string,text:string>"


@dataclass(frozen=True)
class Mapping:
    """Where a layout keeps its turns.

    ``paths`` are the layout's leaf fields, ``[]`` marking an array.  ``turns`` is the path of
    the list of turns, each of which gives one turn per ``(role, field)`` of ``parts``; a role
    that begins with ``$`` names the field that holds it, and ``names`` renames such roles.
    Without ``turns`` the record itself gives the parts; empty ``optional`` parts are left out.
    """

    paths: tuple[str, ...]
    parts: tuple[tuple[str, str], ...]
    turns: str | None = None
    names: dict[str, str] = field(default_factory=dict, hash=False)
    optional: tuple[str, ...] = ()

    def fingerprint(self) -> int:
        value = xxhash.xxh64_intdigest("\n".join(sorted(self.paths)).encode(), 42)
        return value - (1 << 64) if value >= 1 << 63 else value


MAPPINGS = (
    Mapping(("messages[].content", "messages[].role"), (("$role", "content"),), "messages"),
    Mapping(("conversations[].from", "conversations[].value"), (("$from", "value"),), "conversations",
            {"human": "user", "gpt": "assistant"}),
    Mapping(("data.dialog[].speaker", "data.dialog[].utterance"), (("$speaker", "utterance"),), "data.dialog",
            {"customer": "user", "agent": "assistant"}),
    Mapping(("prompt", "response"), (("user", "prompt"), ("assistant", "response"))),
    Mapping(("input", "instruction", "output"),
            (("user", "instruction"), ("user", "input"), ("assistant", "output")), optional=("input",)),
    Mapping(("pairs[].answer", "pairs[].question"), (("user", "question"), ("assistant", "answer")), "pairs"),
)


def leaf_paths(schema: Column) -> Column:
    """The leaf field paths of a variant's schema text, joined by newlines in sorted order.

    The text is cut at its brackets and commas; a fold keeps the stack of names.  Scalar
    types do not matter: a null is a leaf like a string.
    """
    tokens = F.regexp_extract_all(schema, F.lit(r"`(?:[^`]|``)*`: |[^<>,:` ]+: |ARRAY<|OBJECT<|>|[A-Z]+(?:\([0-9,]+\))?"), F.lit(0))
    start = F.struct(
        F.array().cast("array<string>").alias("stack"), F.lit("").alias("name"),
        F.array().cast("array<string>").alias("out"))

    def step(acc: Column, token: Column) -> Column:
        here = F.concat(F.coalesce(F.try_element_at(acc.stack, F.lit(-1)), F.lit("")), acc["name"])
        named = F.regexp_replace(F.regexp_replace(token, ": $", ""), "`", "")
        inner = F.when(token == "ARRAY<", F.concat(here, F.lit("[]"))).otherwise(
            F.when(here == "", F.lit("")).otherwise(F.concat(here, F.lit("."))))
        return (
            F.when(token.endswith(": "), F.struct(acc.stack.alias("stack"), named.alias("name"), acc.out.alias("out")))
            .when(token.endswith("<"), F.struct(
                F.concat(acc.stack, F.array(inner)).alias("stack"), F.lit("").alias("name"), acc.out.alias("out")))
            .when(token == ">", F.struct(
                F.slice(acc.stack, 1, F.greatest(F.size(acc.stack) - 1, F.lit(0))).alias("stack"),
                F.lit("").alias("name"), acc.out.alias("out")))
            .otherwise(F.struct(acc.stack.alias("stack"), F.lit("").alias("name"),
                                F.concat(acc.out, F.array(here)).alias("out")))
        )

    return F.array_join(F.array_sort(F.array_distinct(F.aggregate(tokens, start, step).out)), "\n")


def turns_of(record: Column, mapping: Mapping) -> Column:
    """Canonical turns of a parsed record under one mapping."""
    fields = sorted({f for _, f in mapping.parts} | {r[1:] for r, _ in mapping.parts if r[0] == "$"})
    shape = "struct<" + ",".join(f"`{f}`:string" for f in fields) + ">"

    def parts(one: Column) -> Column:
        out = []
        for role, text in mapping.parts:
            who = one[role[1:]] if role[0] == "$" else F.lit(role)
            for old, new in mapping.names.items():
                who = F.when(who == old, F.lit(new)).otherwise(who)
            out.append(F.struct(F.coalesce(who, F.lit("")).alias("role"),
                                F.coalesce(one[text], F.lit("")).alias("text"),
                                F.lit(text in mapping.optional).alias("optional")))
        return F.array(*out)

    if mapping.turns:
        many = F.try_variant_get(record, f"$.{mapping.turns}", f"array<{shape}>")
        found = F.flatten(F.transform(many, parts))
    else:
        found = parts(F.try_variant_get(record, "$", shape))
    kept = F.filter(found, lambda t: ~t.optional | (t.text != ""))
    return F.transform(kept, lambda t: F.struct(t.role.alias("role"), t.text.alias("text")))


def escape(text: Column) -> Column:
    """One more backslash after the bracket of every control string, escaped ones too."""
    return F.regexp_replace(text, rf"([<\[])(\\*)({CONTROL})", r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])\\(\\*)({CONTROL})", "$1$2$3")


def format_records(records: DataFrame, json_col: str, learn: str = "assistant") -> DataFrame:
    """Adds ``layout`` (the fingerprint), ``turns``, ``formatted`` and ``loss_spans``, start
    and length in code points of the escaped texts of the role ``learn``.

    A record that is null, no JSON, or of a layout without mapping keeps its row with null
    turns, formatted text and spans (and a null layout if it could not be parsed).  A record
    without turns has an empty text.  Missing texts are empty, missing roles too.  Repeated
    records stay.  Added columns replace columns of the same name.
    """
    record = F.try_parse_json(F.col(json_col))
    out = records.withColumn("_record", record).withColumn(
        "layout", F.xxhash64(leaf_paths(F.schema_of_variant("_record"))))
    out = out.withColumn("layout", F.when(F.col("_record").isNotNull(), F.col("layout")))
    turns = F.lit(None).cast(f"array<{TURN}>")
    for m in reversed(MAPPINGS):
        turns = F.when(F.col("layout") == F.lit(m.fingerprint()), turns_of(F.col("_record"), m)).otherwise(turns)
    out = out.withColumn("turns", turns).drop("_record")
    pieces = F.transform("turns", lambda t: F.struct(
        F.concat(F.lit(OPEN), F.url_encode(t.role), F.lit("\n")).alias("head"),
        escape(t.text).alias("body"), (t.role == learn).alias("learn")))
    out = out.withColumn("_pieces", pieces)
    out = out.withColumn("formatted", F.array_join(F.transform(
        "_pieces", lambda p: F.concat(p.head, p.body, F.lit(CLOSE + "\n"))), ""))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))

    def place(acc: Column, p: Column) -> Column:
        begin, size = acc.at + F.length(p.head), F.length(p.body)
        span = F.array(F.struct(begin.alias("start"), size.alias("length")))
        return F.struct(
            (begin + size + len(CLOSE) + 1).alias("at"),
            F.when(p.learn, F.concat(acc.spans, span)).otherwise(acc.spans).alias("spans"))

    out = out.withColumn("loss_spans", F.aggregate("_pieces", start, place, lambda acc: acc.spans))
    return out.drop("_pieces")


def read_back(formatted: Column) -> Column:
    """The turns of a formatted text."""
    cut = F.split(formatted, CLOSE + "\n", -1)
    rows = F.slice(cut, 1, F.greatest(F.size(cut) - 1, F.lit(0)))
    return F.transform(rows, lambda r: F.struct(
        F.url_decode(F.substring_index(F.substr(r, F.lit(len(OPEN) + 1)), "\n", 1)).alias("role"),
        unescape(F.substr(r, F.locate("\n", r) + 1)).alias("text")))


def learned(formatted: Column, spans: Column) -> Column:
    """The unescaped text under the loss mask."""
    return F.array_join(F.transform(
        spans, lambda s: unescape(F.substr(formatted, s.start + 1, s.length))), "")


def as_records(conversations: DataFrame) -> DataFrame:
    """``conv_id, record``: the turns of each conversation as JSON, in the layouts that can hold
    them, dealt by ``conv_id``."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    grouped = conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("t"))
    t = F.col("t")

    def listed(role: str, text: str, names: dict[str, str]) -> Column:
        def one(x: Column) -> Column:
            who = x.role
            for old, new in names.items():
                who = F.when(x.role == old, F.lit(new)).otherwise(who)
            return F.struct(who.alias(role), x.text.alias(text))
        return F.transform(t, one)

    flipped = F.forall(t, lambda x: ~x.role.isin("human", "gpt", "customer", "agent"))
    roles = F.transform(t, lambda x: x.role)
    n = F.size(t)
    pair = roles == F.array(F.lit("user"), F.lit("assistant"))
    pairs = (n % 2 == 0) & F.forall(
        F.transform(t, lambda x, i: F.struct(x.role.alias("r"), (i % 2).alias("i"))),
        lambda x: x.r == F.when(x.i == 0, F.lit("user")).otherwise(F.lit("assistant")))
    deal = F.pmod(F.coalesce("conv_id", F.lit(0)), F.lit(6))
    first, second = F.get(t, 0).text, F.get(t, 1).text
    by_pair = F.transform(F.sequence(F.lit(0), F.greatest(F.floor(n / 2) - 1, F.lit(0)).cast("int")), lambda i: F.struct(
        F.get(t, 2 * i).text.alias("question"), F.get(t, 2 * i + 1).text.alias("answer")))
    record = (
        F.when((deal == 1) & flipped, F.to_json(F.struct(
            listed("from", "value", {"user": "human", "assistant": "gpt"}).alias("conversations"))))
        .when((deal == 2) & flipped, F.to_json(F.struct(F.struct(listed(
            "speaker", "utterance", {"user": "customer", "assistant": "agent"}).alias("dialog")).alias("data"))))
        .when((deal == 3) & pair, F.to_json(F.struct(first.alias("prompt"), second.alias("response"))))
        .when((deal == 4) & pair, F.to_json(F.struct(
            first.alias("instruction"), F.lit("").alias("input"), second.alias("output"))))
        .when((deal == 5) & pairs, F.to_json(F.struct(by_pair.alias("pairs"))))
        .otherwise(F.to_json(F.struct(listed("role", "content", {}).alias("messages"))))
    )
    return grouped.select("conv_id", record.alias("record"))


def formatted_conversations(conversations: DataFrame) -> DataFrame:
    """Digests of every formatted conversation, read back from its text and spans."""
    out = format_records(as_records(conversations), "record")
    turns = out.withColumn("_turns", read_back(F.col("formatted"))).withColumn(
        "_loss", learned(F.col("formatted"), F.col("loss_spans")))
    told = F.array_join(F.transform("_turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    return turns.select(
        "conv_id", F.size("_turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"),
        F.length("_loss").cast("long").alias("loss_chars"), F.sha2("_loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
