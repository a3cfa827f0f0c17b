"""Putting originals back: token -> value by join, for text and nested records.

Only rows that hold a token take part in the join, and they take part with their distinct
tokens rather than with their text; the text meets a small map of its own values once, on
its key.  Rows without a token pass by untouched.  No side is broadcast by hand: the vault
can outgrow any executor, and Spark picks a broadcast itself where its size allows one.
A token on every row is split by adaptive skew-join handling.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilframe.functions.tokens import TOKEN_PATTERN, quote, sql_text, tokens_in_sql
from veilframe.operators.nested import JSON_STRING, has_strings, json_quote_sql, rewrite_sql
from veilframe.operators.patterns import file_strings, possible
from veilframe.session import spread
from veilframe.sources.stage import stage


def replace_tokens_sql(
    text: str, values: str, pattern: str = TOKEN_PATTERN, json: bool = False
) -> str:
    """``text`` with each token replaced by its entry in the map, if it has one.

    With ``json`` the text is a JSON string literal or its inside, and so are the values.
    """
    value = f"element_at({values}, tok)"
    if json:
        quoted = json_quote_sql("val")
        value = (
            f"transform(array({value}), val -> substr({quoted}, 2, length({quoted}) - 2))[0]"
        )
    return f"""
        array_join(zip_with(
            split({text}, {sql_text(pattern)}, -1),
            transform({tokens_in_sql(text, pattern)}, tok -> coalesce({value}, tok)),
            (gap, p) -> concat(gap, coalesce(p, ''))), '')"""


def replace_json_tokens_sql(json: str, values: str, pattern: str = TOKEN_PATTERN) -> str:
    """A JSON text with the tokens in its string values replaced.

    Keys, numbers and white space keep their spelling: the text is cut at its string literals,
    and those followed by a colon are keys.
    """
    literal = sql_text(JSON_STRING)
    inside = replace_tokens_sql("lit", values, pattern, json=True)
    return f"""
        transform(array(split({json}, {literal}, -1)), gaps -> array_join(zip_with(
            gaps,
            transform(regexp_extract_all({json}, {literal}, 0), (lit, i) -> CASE
                WHEN contains(lit, '[') AND NOT gaps[i + 1] RLIKE '^[ \\\\t\\\\r\\\\n]*:'
                THEN {inside} ELSE lit END),
            (gap, p) -> concat(gap, coalesce(p, ''))), ''))[0]"""


def _tokens_sql(column: str, dtype: T.DataType, pattern: str) -> str:
    text = quote(column) if isinstance(dtype, T.StringType) else f"to_json({quote(column)})"
    return f"coalesce({tokens_in_sql(text, pattern)}, array())"


def attach_values(
    df: DataFrame, keys: list[str], tokens: str, vault: DataFrame, out: str = "_values"
) -> DataFrame:
    """Add a map of the vault values of the tokens in each row.

    ``tokens`` is SQL for an array of tokens; ``keys`` identify a row.  Rows that share their
    keys share a map.  If the vault lists a token more than once, its smallest value holds.
    """
    entries = F.array_sort(F.collect_set(F.struct("token", "value")))
    pairs = df.select(*keys, F.expr(f"explode(array_distinct({tokens}))").alias("token"))
    found = (
        pairs.join(vault.select("token", "value"), "token")
        .groupBy(*keys)
        .agg(entries.alias("_entries"))
        .select(
            *keys,
            F.expr(
                "map_from_entries(filter(_entries,"
                " (e, i) -> i = 0 OR e.token <> _entries[greatest(i - 1, 0)].token))"
            ).alias(out),
        )
    )
    return df.join(found, keys, "left")


def vault_closure(vault: DataFrame, pattern: str = TOKEN_PATTERN) -> DataFrame:
    """``token, value``: the vault with the tokens inside its values resolved, however deep.

    Only values that hold a token of the vault take part.  Round by round those whose inner
    tokens are all resolved are resolved themselves, one round per level of nesting.  What is
    left is on a cycle or holds a token of one: there the tokens of the cycle stay as they are.
    """
    plain = vault.select("token", "value")
    inner = tokens_in_sql("value", pattern)
    edges = plain.filter(f"size({inner}) > 0").select("token", F.expr(f"explode(array_distinct({inner}))").alias("inner"))
    known = plain.select(F.col("token").alias("inner")).distinct()
    edges = stage(edges.join(known, "inner", "left_semi"), "edges")
    left = stage(plain.join(edges.select("token").distinct(), "token", "left_semi"), "nested")
    done = plain.join(left.select("token"), "token", "left_anti")

    def resolve(rows: DataFrame, entries: DataFrame) -> DataFrame:
        text = replace_tokens_sql("value", "_values", pattern)
        named = rows.withColumnRenamed("token", "outer")
        return attach_values(named, ["outer"], inner, entries).select(
            F.col("outer").alias("token"), F.expr(f"CASE WHEN _values IS NULL THEN value ELSE {text} END").alias("value"))

    while not left.isEmpty():
        waiting = edges.join(left.select(F.col("token").alias("inner")), "inner", "left_semi").select("token").distinct()
        ready = left.join(waiting, "token", "left_anti")
        rest = stage(left.join(waiting, "token", "left_semi"), "nested")
        resolved = stage(resolve(ready, done), "resolved")
        if resolved.isEmpty():
            return done.unionByName(resolve(left, done))
        done, left = done.unionByName(resolved), rest
    return done


def rehydrate(
    df: DataFrame,
    keys: list[str],
    columns: list[str],
    vault: DataFrame,
    pattern: str = TOKEN_PATTERN,
    when: str | None = None,
    json: bool = False,
    fixpoint: bool = False,
) -> DataFrame:
    """Replace the vault tokens in the given columns; unknown tokens stay as they are.

    ``when`` limits this to the rows where a SQL condition holds.  One pass leaves standing the
    tokens inside the values it puts in (a key block can hold some); with ``fixpoint`` those
    are resolved in the vault first, so that the texts are still read once.  With ``json`` the columns are JSON texts, of which
    only string values change.
    """
    if fixpoint:
        vault = vault_closure(vault, pattern)
    fields = {f.name: f.dataType for f in df.schema.fields}
    columns = [c for c in columns if has_strings(fields[c])]
    tokens = f"concat({', '.join(_tokens_sql(c, fields[c], pattern) for c in columns)})"
    test = f"size({tokens}) > 0" + (f" AND coalesce({when}, false)" if when else "")
    dirty = attach_values(df.filter(test), keys, tokens, vault)

    def leaf(expr: str, _key: str | None) -> str:
        if json:
            return replace_json_tokens_sql(expr, "_values", pattern)
        return replace_tokens_sql(expr, "_values", pattern)

    restored = dirty.select(
        *[
            F.expr(
                f"CASE WHEN _values IS NULL THEN {quote(c)}"
                f" ELSE {rewrite_sql(quote(c), fields[c], leaf)} END"
            ).alias(c)
            if c in columns
            else F.col(quote(c))
            for c in df.columns
        ]
    )
    return restored.unionByName(df.filter(f"NOT ({test})"))


# Keys of any form


def _in_order_sql(entries: str, first: str, last: bool = False) -> str:
    """All stages of a text as the entries replace their keys, one after the other, in order, or
    the last of them."""
    if last:
        return f"aggregate({entries}, {first}, (acc, e) -> replace(acc, e.token, e.value))"
    now = "element_at(acc, -1)"
    return (
        f"aggregate({entries}, array({first}), (acc, e) ->"
        f" if(contains({now}, e.token), concat(acc, array(replace({now}, e.token, e.value))), acc))"
    )


def rehydrate_literal(df: DataFrame, keys: list[str], column: str, vault: DataFrame, order: str) -> DataFrame:
    """Replace vault keys of any form, with or without brackets, in a text column.

    As in the batch replacement of a vault in insertion order: the keys are replaced one after
    the other, by ascending ``order`` (unique), everywhere in the text and in what earlier keys
    have put in; so an earlier key wins over a longer one that holds it.

    Only keys that may stand in a text are tried on it.  They are found by the scan of the texts
    (``possible``), with the keys that their values bring in.  Then what the replacements have
    made is asked again, for keys that came about where a value meets its neighbours, until it
    holds no key that was not tried.  Each time the texts move once, to meet their keys, and
    nothing of them is staged: only keys and their rows are.  The scan spreads small inputs.

    ``keys`` identify a row.  Null texts stay, empty keys are left out.
    """
    entries = vault.filter("token <> ''").select(F.col(order).alias("at"), "token", F.coalesce("value", F.lit("")).alias("value"))
    entries = stage(entries, "entries")
    filed = stage(file_strings(entries.select(F.col("token").alias("value"))), "filed")
    inner = stage(_keys_in_values(entries, filed), "inner")
    name = quote(column)
    texts = df.select(*keys, F.col(name).alias("_text")).filter("_text IS NOT NULL")

    def asked(rows: DataFrame) -> DataFrame:
        met = possible(rows, keys, "_text", filed).select(*keys, F.col("value").alias("token"))
        return met.filter(" AND ".join(f"{quote(k)} IS NOT NULL" for k in keys)).distinct()

    def held(found: DataFrame) -> DataFrame:
        return found.join(entries, "token").groupBy(*keys).agg(
            F.array_sort(F.collect_list(F.struct("at", "token", "value"))).alias("_held"))

    found, more = None, stage(asked(spread(texts)), "found")
    while not more.isEmpty():
        more = _with_inner(more, keys, inner)
        found = more if found is None else stage(found.unionByName(more).distinct(), "found")
        turned = found if found is more else found.join(more.select(*keys).distinct(), keys, "left_semi")
        made = texts.join(held(turned), keys).select(
            *keys, F.expr(f"explode(slice({_in_order_sql('_held', '_text')}, 2, size(_held)))").alias("_text"))
        more = stage(asked(made).join(found, [*keys, "token"], "left_anti"), "found")
    if found is None:
        return df
    done = texts.join(held(found), keys).select(*keys, F.expr(_in_order_sql("_held", "_text", last=True)).alias("_done"))
    return df.join(done, keys, "left").select(
        *[F.coalesce("_done", F.col(name)).alias(c) if c == column else F.col(quote(c)) for c in df.columns])


def _keys_in_values(entries: DataFrame, filed: DataFrame) -> DataFrame:
    """``token, inner``: the later keys that a key's value may bring in."""
    met = possible(entries, ["at"], "value", filed).select(F.col("at").alias("outer"), F.col("value").alias("inner")).distinct()
    outer = entries.select(F.col("at").alias("outer"), "token", "value")
    later = entries.select(F.col("token").alias("inner"), "at")
    return met.join(later, "inner").filter("at > outer").join(outer, "outer").filter("contains(value, inner)").select("token", "inner")


def _with_inner(found: DataFrame, keys: list[str], inner: DataFrame) -> DataFrame:
    """The keys found in each row and all that their values bring in, level by level."""
    new = found
    while not inner.isEmpty():
        met = new.join(inner, "token").select(*keys, F.col("inner").alias("token")).distinct()
        new = stage(met.join(found, [*keys, "token"], "left_anti"), "found")
        if new.isEmpty():
            break
        found = stage(found.unionByName(new), "found")
    return found
