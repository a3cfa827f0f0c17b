"""Tool events: hook payloads as JSON text in, decisions as JSON text out.

Each payload is parsed once, routed by event and tool, and redacted by the one branch that
applies.  The whole job is a narrow projection; rows without a finding give no output.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.functions.json_text import kind_of, members
from veilframe.functions.redaction import redaction_sql
from veilframe.functions.rules import RULES, SPACE_MEMBERS
from veilframe.functions.tokens import HASH_WIDTH, once_sql, quote, sql_text
from veilframe.operators.access import blocked_reason_sql
from veilframe.operators.nested import is_json_sql, json_quote_sql, json_redaction_sql, redact_nested

# Event names, the tool prefix, and the fields whose text is collected.
PRE_CLAUDE, POST_CLAUDE, PRE_GEMINI, POST_GEMINI = (
    "PreToolUse", "PostToolUse", "BeforeTool", "AfterTool",
)
MCP_PREFIX = "mcp__"
TEXT_FIELDS = ("stdout", "stderr", "file.content", "content", "output")

PAYLOAD_SCHEMA = (
    "hook_event_name string, tool_name string, tool_input string, tool_response string"
)
RESPONSE_SCHEMA = "stdout string, stderr string, file string, content string, output string"

BLANK = f"^[{SPACE_MEMBERS}]*\\z"


# What is read of a payload, by place.
PATHS = (
    ("hook_event_name",), ("tool_name",), ("tool_input",), ("tool_response", "content"),
    *[("tool_response", *f.split(".")) for f in TEXT_FIELDS],
)


def event_status(df: DataFrame, raw: str = "raw") -> DataFrame:
    """Add ``status``: ``blank`` (ignored), ``invalid`` (an error) or ``ok``."""
    col = F.col(quote(raw))
    return df.withColumn(
        "status",
        F.when(col.isNull() | col.rlike(BLANK), "blank")
        .when(F.try_parse_json(col).isNotNull() | F.expr(is_json_sql(quote(raw))), "ok")
        .otherwise("invalid"),
    )


def odd_members(raw: Column) -> Column:
    """``array<struct<kind, text>>`` of a payload's values at ``PATHS``: strings as their text,
    others as they are spelled.  The last of repeated keys holds; any depth is read."""

    @F.arrow_udf("array<struct<kind: string, text: string>>")
    def read(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("text", pa.string())]))
        for texts in batches:
            out = []
            for t in texts.to_pylist():
                found = members(t, PATHS) if t is not None else {}
                values = [(kind_of(found[p]), found[p]) if p in found else (None, None) for p in PATHS]
                out.append(None if t is None else [
                    {"kind": k, "text": json.loads(v, strict=False) if k == "string" else v} for k, v in values])
            yield pa.array(out, kind)

    return read(raw)


def parse_events(df: DataFrame, raw: str = "raw") -> DataFrame:
    """Parse the valid payloads and route each to its handler.

    Adds ``handler``, ``tool_input``, ``content`` (JSON text, where they are of the right
    type) and ``event_text`` (the text of a built-in tool's response).

    Payloads that the JVM's parser refuses though they are JSON, for repeated keys or their
    depth, are cut by ``odd_members``; only those leave the JVM.
    """
    def kind(path: str) -> str:
        return f"schema_of_variant(try_variant_get(_v, '$.{path}', 'variant'))"

    def odd(*path: str) -> str:
        return f"_m[{PATHS.index(path)}]"

    parsed = (
        event_status(df, raw)
        .filter("status = 'ok'")
        .drop("status")
        .withColumn("_v", F.try_parse_json(F.col(quote(raw))))
        .withColumn("_p", F.from_json(F.col(quote(raw)), PAYLOAD_SCHEMA))
        .withColumn("_t", F.from_json("_p.tool_response", RESPONSE_SCHEMA))
        .withColumn("_m", odd_members(F.when(F.col("_v").isNull(), F.col(quote(raw)))))
    )

    def string_at(value: str, *path: str) -> str:
        return (
            f"CASE WHEN _m IS NOT NULL THEN if({odd(*path)}.kind = 'string', {odd(*path)}.text, NULL)"
            f" WHEN {kind('.'.join(path))} = 'STRING' THEN {value} END"
        )

    name = F.expr(string_at("_p.hook_event_name", "hook_event_name"))
    mcp = F.coalesce(F.expr(string_at("_p.tool_name", "tool_name")).startswith(MCP_PREFIX), F.lit(False))
    handler = (
        F.when(name == PRE_CLAUDE, "pre_claude")
        .when(name == PRE_GEMINI, "pre_gemini")
        .when((name == POST_CLAUDE) & mcp, "post_mcp")
        .when((name == POST_GEMINI) & mcp, "after_mcp")
        .when(name == POST_GEMINI, "after_builtin")
        .otherwise("post_builtin")
    )
    texts = []
    for field in TEXT_FIELDS:
        value = "get_json_object(_t.file, '$.content')" if field == "file.content" else f"_t.{field}"
        texts.append(f"nullif({string_at(value, 'tool_response', *field.split('.'))}, '')")
    given, content = odd("tool_input"), odd("tool_response", "content")
    return parsed.select(
        *[F.col(quote(c)) for c in df.columns],
        handler.alias("handler"),
        F.expr(
            f"CASE WHEN _m IS NOT NULL THEN if({given}.kind IN ('object', 'array'), {given}.text, NULL)"
            f" WHEN {kind('tool_input')} RLIKE '^(OBJECT|ARRAY)' THEN _p.tool_input END"
        ).alias("tool_input"),
        F.expr(
            f"CASE WHEN _m IS NOT NULL THEN if({content}.kind = 'array', {content}.text, NULL)"
            f" WHEN {kind('tool_response.content')} LIKE 'ARRAY%' THEN _t.content END"
        ).alias("content"),
        F.expr(f"nullif(concat_ws('\\n', {', '.join(texts)}), '')").alias("event_text"),
    )


def event_responses(
    df: DataFrame,
    raw: str = "raw",
    width: int = HASH_WIDTH,
    changed_only: bool = True,
    handlers: tuple[str, ...] | None = None,
) -> DataFrame:
    """The decision for each event: its handler and the JSON response.

    A row in which nothing was redacted has no response; ``changed_only`` drops it.
    ``handlers`` limits the work to the events routed to these.
    """
    keep = [F.col(quote(c)) for c in df.columns]
    events = parse_events(df, raw)
    if handlers is not None:
        events = events.filter(F.col("handler").isin(*handlers))
    json_in = (
        "CASE WHEN handler LIKE 'pre_%' THEN tool_input"
        " WHEN handler LIKE '%_mcp' THEN content END"
    )
    text_in = "CASE WHEN handler LIKE '%_builtin' THEN event_text END"
    staged = events.select(
        *keep,
        "handler",
        F.expr(
            once_sql(
                f"named_struct('j', {json_redaction_sql(json_in, width)},"
                f" 'x', {redaction_sql(text_in, RULES, width)})"
            )
        ).alias("_r"),
    ).select(*keep, "handler", F.col("_r.j").alias("_j"), F.col("_r.x").alias("_x"))
    # blocks with repeated keys are no variant; of those a struct takes the last
    joined_text = """
        array_join(coalesce(transform(
            filter(try_variant_get(try_parse_json(_j.text), '$', 'array<variant>'),
                b -> schema_of_variant(try_variant_get(b, '$.text', 'variant')) = 'STRING'),
            b -> try_variant_get(b, '$.text', 'string')),
            filter(from_json(_j.text, 'array<struct<text: string>>').text, t -> t IS NOT NULL)), '\\n')"""
    pre_claude = (
        '{"hookSpecificOutput":{"hookEventName":"PreToolUse",'
        '"permissionDecision":"allow","updatedInput":'
    )
    response = f"""
        CASE WHEN size(_j.findings) > 0 THEN
            CASE handler
            WHEN 'pre_claude' THEN concat({sql_text(pre_claude)}, _j.text, '}}}}')
            WHEN 'pre_gemini' THEN
                concat('{{"hookSpecificOutput":{{"tool_input":', _j.text, '}}}}')
            WHEN 'post_mcp' THEN
                concat('{{"updatedMCPToolOutput":{{"content":', _j.text, '}}}}')
            WHEN 'after_mcp' THEN
                concat('{{"decision":"deny","reason":', {json_quote_sql(joined_text)}, '}}')
            END
        WHEN size(_x.findings) > 0 THEN
            concat('{{"decision":"', if(handler = 'after_builtin', 'deny', 'block'),
                '","reason":', {json_quote_sql('_x.text')}, '}}')
        END"""
    out = staged.select(*keep, "handler", F.expr(once_sql(response)).alias("response"))
    return out.filter("response IS NOT NULL") if changed_only else out


def plugin_after(df: DataFrame, output: str = "output", content: str = "content") -> DataFrame:
    """Redact a tool result in place: the output string, and blocks of type ``text``.

    Blocks may have more fields, in any order; only the text of text blocks changes.
    """
    fields = ", ".join(
        f"{sql_text(f.name)}, "
        + (f"({redaction_sql('b.text')}).text" if f.name == "text" else f"b.{quote(f.name)}")
        for f in df.schema[content].dataType.elementType.fields
    )
    block = f"""
        transform({quote(content)}, b -> CASE WHEN b.type = 'text' AND b.text IS NOT NULL
            THEN named_struct({fields}) ELSE b END)"""
    return df.withColumns(
        {output: F.expr(f"({redaction_sql(quote(output))}).text"), content: F.expr(block)}
    )


def plugin_before(
    df: DataFrame, tool: str = "tool", args: str = "args", prefix: str = ""
) -> DataFrame:
    """Check a tool call, then redact its arguments (a string map).

    Adds ``blocked_reason``; the arguments of a blocked call are left alone, as it never
    runs.
    """
    checked = df.withColumn(
        "blocked_reason",
        F.expr(
            blocked_reason_sql(
                quote(tool), f"{quote(args)}['filePath']", f"{quote(args)}['command']", prefix
            )
        ),
    ).withColumn("_args", F.expr(f"CASE WHEN blocked_reason IS NULL THEN {quote(args)} END"))
    return (
        redact_nested(checked, ["_args"])
        .withColumn(args, F.coalesce("_args", quote(args)))
        .withColumn("has_redacted", F.size("findings") > 0)
        .drop("_args", "findings")
    )
