"""Redaction and rewriting of nested records.

Typed columns are walked once, at plan time: the walk turns a schema into one expression,
so a record of any depth is still a single narrow projection.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilframe.functions.redaction import (
    NO_FINDINGS,
    is_sensitive_key,
    key_redaction_sql,
    redaction_sql,
    sensitive_key_sql,
)
from veilframe.functions.rules import RULES
from veilframe.functions.tokens import HASH_WIDTH, once_sql, quote, sql_text

Leaf = Callable[[str, str | None], str]


def has_strings(dtype: T.DataType) -> bool:
    """Whether a value of this type can hold text."""
    if isinstance(dtype, T.StringType):
        return True
    if isinstance(dtype, T.ArrayType):
        return has_strings(dtype.elementType)
    if isinstance(dtype, T.MapType):
        return has_strings(dtype.valueType)
    if isinstance(dtype, T.StructType):
        return any(has_strings(f.dataType) for f in dtype.fields)
    return False


def rewrite_sql(
    expr: str,
    dtype: T.DataType,
    leaf: Leaf,
    key: str | None = None,
    map_leaf: Callable[[str, str], str] | None = None,
    depth: int = 0,
) -> str:
    """Apply ``leaf(expr, key)`` to every string of a value and leave the rest alone.

    ``key`` is the field name a string sits under; an array drops it, as its items are not
    named.  ``map_leaf(key expr, value expr)`` handles strings under map keys.
    """
    if isinstance(dtype, T.StringType):
        return leaf(expr, key)
    if not has_strings(dtype):
        return expr
    var = f"n{depth}"
    if isinstance(dtype, T.ArrayType):
        body = rewrite_sql(var, dtype.elementType, leaf, None, map_leaf, depth + 1)
        return f"transform({expr}, {var} -> {body})"
    if isinstance(dtype, T.MapType):
        name = f"k{depth}"
        if isinstance(dtype.valueType, T.StringType) and map_leaf is not None:
            body = map_leaf(name, var)
        else:
            body = rewrite_sql(var, dtype.valueType, leaf, None, map_leaf, depth + 1)
        return f"transform_values({expr}, ({name}, {var}) -> {body})"
    parts = ", ".join(
        f"{sql_text(f.name)}, "
        + rewrite_sql(f"{expr}.{quote(f.name)}", f.dataType, leaf, f.name, map_leaf, depth)
        for f in dtype.fields
    )
    return f"CASE WHEN {expr} IS NOT NULL THEN named_struct({parts}) END"


def _findings_sql(expr: str, dtype: T.DataType, depth: int = 0) -> str | None:
    """All findings of a walked value, depth first."""
    if not has_strings(dtype):
        return None
    if isinstance(dtype, T.StringType):
        return f"{expr}.findings"
    var = f"n{depth}"
    if isinstance(dtype, T.ArrayType):
        inner = _findings_sql(var, dtype.elementType, depth + 1)
        return f"flatten(transform(coalesce({expr}, array()), {var} -> {inner}))"
    if isinstance(dtype, T.MapType):
        inner = _findings_sql(var, dtype.valueType, depth + 1)
        return f"flatten(transform(coalesce(map_values({expr}), array()), {var} -> {inner}))"
    parts = [_findings_sql(f"{expr}.{quote(f.name)}", f.dataType, depth) for f in dtype.fields]
    return f"coalesce(concat({', '.join(p for p in parts if p)}), {NO_FINDINGS})"


def _text_sql(expr: str, dtype: T.DataType) -> str:
    return rewrite_sql(expr, dtype, lambda e, _k: f"{e}.text", map_leaf=lambda _k, v: f"{v}.text")


def redact_nested(
    df: DataFrame, columns: list[str] | None = None, width: int = HASH_WIDTH
) -> DataFrame:
    """Redact every string of the given columns and add all findings of the row.

    A string under a sensitive field name or map key is masked whole and not scanned.
    """
    fields = {f.name: f.dataType for f in df.schema.fields}
    chosen = [c for c in (columns or df.columns) if has_strings(fields[c])]

    def leaf(expr: str, key: str | None) -> str:
        if key is not None and is_sensitive_key(key):
            return key_redaction_sql(expr, width)
        return redaction_sql(expr, RULES, width)

    def map_leaf(key: str, value: str) -> str:
        return (
            f"CASE WHEN {sensitive_key_sql(key)} THEN {key_redaction_sql(value, width)}"
            f" ELSE {redaction_sql(value, RULES, width)} END"
        )

    if not chosen:
        return df.withColumn("findings", F.expr(NO_FINDINGS))
    at = {c: f"_r.c{i}" for i, c in enumerate(chosen)}
    parts = ", ".join(
        f"{sql_text(at[c][3:])}, {rewrite_sql(quote(c), fields[c], leaf, c, map_leaf)}"
        for c in chosen
    )
    walked = df.select(
        *[F.col(quote(c)) for c in df.columns if c not in chosen],
        F.expr(once_sql(f"named_struct({parts})")).alias("_r"),
    )
    found = [_findings_sql(at[c], fields[c]) or NO_FINDINGS for c in chosen]
    return walked.select(
        *[
            F.expr(_text_sql(at[c], fields[c])).alias(c) if c in chosen else F.col(quote(c))
            for c in df.columns
        ],
        F.expr(f"concat({', '.join(found)})").alias("findings"),
    )


# A JSON string literal.  Possessive, so that the regex engine loops instead of recursing.
JSON_STRING = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'
# The characters a JSON string literal has to escape.
JSON_ESCAPED = r'["\\\x00-\x1f]'


def json_quote_sql(text: str) -> str:
    """A string expression as a JSON string literal."""
    return (
        f"CASE WHEN {text} RLIKE {sql_text(JSON_ESCAPED)}"
        f" THEN transform(array(to_json(array({text}))), q -> substr(q, 2, length(q) - 2))[0]"
        f" ELSE concat('\"', {text}, '\"') END"
    )


def _json_unquote_sql(literal: str) -> str:
    return (
        f"CASE WHEN contains({literal}, {sql_text(chr(92))})"
        f" THEN from_json(concat('[', {literal}, ']'), 'array<string>')[0]"
        f" ELSE substr({literal}, 2, length({literal}) - 2) END"
    )


def is_json_sql(json: str) -> str:
    """Whether a text is one JSON value; keys may repeat.

    Inside an array and as the value of an object it must be the only item, and no text that
    is not a single value passes both.  The parser stops at a thousand levels; a text that is
    deeper passes if its brackets outside of string literals balance.
    """
    brackets = (
        f"split(regexp_replace(regexp_replace({json}, {sql_text(JSON_STRING)}, ''),"
        " '[^\\\\[\\\\]{}]+', ''), '')"
    )
    step = (
        "(s, c) -> named_struct('d', s.d + if(c IN ('[', '{'), 1, if(c IN (']', '}'), -1, 0)),"
        " 'top', greatest(s.top, s.d), 'low', least(s.low, s.d))"
    )
    deep = (
        f"aggregate({brackets}, named_struct('d', 0, 'top', 0, 'low', 0), {step},"
        " s -> s.d = 0 AND s.low >= 0 AND s.top >= 900)"
    )
    return (
        f"coalesce(json_array_length(concat('[', {json}, ']')) = 1"
        f" AND size(json_object_keys(concat('{{\"\":', {json}, '}}'))) = 1, false)"
        f" OR coalesce({deep}, false)"
    )


def json_redaction_sql(json: str, width: int = HASH_WIDTH) -> str:
    """``STRUCT<text, findings>`` for a JSON text of any shape; null where it is not JSON.

    The text is cut at its string literals.  A literal followed by a colon is a key and is
    kept; any other is a value, and the key right before it decides how it is redacted.
    Order of keys, numbers and nesting stay as they are, white space between them goes.
    """
    lit = sql_text(JSON_STRING)
    is_key = "gaps[i + 1] RLIKE '^[ \\\\t\\\\r\\\\n]*:'"
    under_key = "i > 0 AND gaps[i] RLIKE '^[ \\\\t\\\\r\\\\n]*:[ \\\\t\\\\r\\\\n]*$'"
    sensitive = sensitive_key_sql(_json_unquote_sql("lits[i - 1]"))
    value = f"""
        transform(array({_json_unquote_sql('l')}), u ->
            CASE WHEN {under_key} AND {sensitive} THEN {key_redaction_sql('u', width)}
            ELSE {redaction_sql('u', RULES, width)} END)[0]"""
    piece = f"""
        CASE WHEN {is_key} THEN named_struct('text', l, 'findings', {NO_FINDINGS})
        ELSE transform(array({value}), z ->
            named_struct('text', {json_quote_sql('z.text')}, 'findings', z.findings))[0] END"""
    return f"""
        transform(array({json}), j -> CASE WHEN {is_json_sql('j')} THEN
          transform(array(regexp_extract_all(j, {lit}, 0)), lits ->
            transform(array(split(j, {lit}, -1)), gaps ->
              transform(array(transform(lits, (l, i) -> {piece})), ps -> named_struct(
                'text', array_join(zip_with(
                    transform(gaps, g -> regexp_replace(g, '[ \\\\t\\\\r\\\\n]+', '')), ps,
                    (g, p) -> concat(g, coalesce(p.text, ''))), ''),
                'findings', flatten(ps.findings)))[0])[0])[0] END)[0]"""


def redact_json(
    df: DataFrame,
    column: str,
    width: int = HASH_WIDTH,
    redacted: str = "redacted",
    findings: str = "findings",
    status: str | None = None,
) -> DataFrame:
    """Add the redacted form and the findings of a JSON text column.

    Rows may differ in shape, keys may repeat and nesting may be deep; no schema is needed.
    Invalid JSON gives null, which column ``status`` (if named) tells apart from a missing
    text: ``ok``, ``missing`` or ``invalid``.
    """
    named = (redacted, findings, status)
    keep = [F.col(quote(c)) for c in df.columns if c not in named]
    state = F.when(F.col(quote(column)).isNull(), "missing").when(F.col("_r").isNull(), "invalid")
    more = [] if status is None else [state.otherwise("ok").alias(status)]
    return df.select(
        *keep, F.expr(once_sql(json_redaction_sql(quote(column), width))).alias("_r")
    ).select(
        *keep,
        F.col("_r.text").alias(redacted),
        F.coalesce(F.col("_r.findings"), F.expr(NO_FINDINGS)).alias(findings),
        *more,
    )
