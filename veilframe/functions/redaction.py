"""Redaction of one string as a Catalyst expression.

The expression yields ``STRUCT<text, findings>``.  First the screen decides in one scan
whether any rule can match; where it finds something, the single gates leave a short array
of candidate rules.  A fold over that array then applies the rules in order: split at the
matches, mint a token for each, join again.  A clean row costs one scan and no fold; no
separator character is put into the text, so any input is safe; nothing leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilframe.functions.rules import KEY_LABEL, RULES, SENSITIVE_KEYS, Rule, rule_table, screen
from veilframe.functions.tokens import HASH_WIDTH, mint_sql, once_sql, quote, sql_text

FINDINGS_TYPE = "array<struct<label:string,value:string,token:string>>"
NO_FINDINGS = f"CAST(array() AS {FINDINGS_TYPE})"


def redaction_sql(text: str, rules: tuple[Rule, ...] = RULES, width: int = HASH_WIDTH) -> str:
    """SQL for the redaction of the string expression ``text``."""
    candidates = f"""
        CASE WHEN t RLIKE {sql_text(screen(rules))}
        THEN filter({rule_table(rules)}, r ->
            exists(r.literals, x -> contains(t, x)) OR coalesce(t RLIKE r.probe, false))
        END"""
    # The whole match is the value unless the rule names a group; then scan once more.
    hits = f"""
        transform(array(regexp_extract_all(s.text, r.pattern, 0)), ms -> zip_with(
            ms,
            CASE WHEN r.grp = 0 THEN ms ELSE regexp_extract_all(s.text, r.pattern, r.grp) END,
            (m, v) -> named_struct(
                'match', m, 'value', v, 'token', {mint_sql('r.label', 'v', width)})))[0]"""
    # Only the first occurrence of the value inside the match gives way to the token.
    piece = """
        concat(
            substr(h.match, 1, instr(h.match, h.value) - 1),
            h.token,
            substr(h.match, instr(h.match, h.value) + length(h.value)))"""
    step = f"""
        transform(array({hits}), hits -> CASE WHEN size(hits) = 0 THEN s ELSE named_struct(
            'text', array_join(zip_with(
                split(s.text, r.pattern, -1),
                transform(hits, h -> {piece}),
                (gap, p) -> concat(gap, coalesce(p, ''))), ''),
            'findings', concat(s.findings, transform(hits, h ->
                named_struct('label', r.label, 'value', h.value, 'token', h.token)))) END)[0]"""
    start = f"named_struct('text', t, 'findings', {NO_FINDINGS})"
    return f"""
        transform(array({text}), t -> transform(array({candidates}), c ->
            CASE WHEN c IS NULL THEN {start}
            ELSE aggregate(c, {start}, (s, r) -> {step}) END)[0])[0]"""


def redaction(column: str, rules: tuple[Rule, ...] = RULES, width: int = HASH_WIDTH) -> Column:
    """``STRUCT<text, findings>`` for a string column, computed once per row."""
    return F.expr(once_sql(redaction_sql(quote(column), rules, width)))


def key_redaction_sql(value: str, width: int = HASH_WIDTH) -> str:
    """``STRUCT<text, findings>`` for a string under a sensitive key: it is masked whole."""
    token = mint_sql(sql_text(KEY_LABEL), "v", width)
    return f"""
        transform(array({value}), v -> named_struct(
            'text', {token},
            'findings', CASE WHEN v IS NULL THEN {NO_FINDINGS} ELSE
                array(named_struct('label', {sql_text(KEY_LABEL)}, 'value', v, 'token', {token}))
            END))[0]"""


def is_sensitive_key(name: str) -> bool:
    """Plan-time form of the key test, for struct field names."""
    flat = name.lower().replace("-", "").replace("_", "")
    return any(k in flat for k in SENSITIVE_KEYS)


def sensitive_key_sql(name: str) -> str:
    """Run-time form of the key test, for map keys and JSON keys."""
    return f"translate(lower({name}), '-_', '') RLIKE {sql_text('|'.join(SENSITIVE_KEYS))}"


def token_count(findings: str) -> Column:
    """How many different tokens a row holds."""
    return F.expr(f"CAST(size(array_distinct({quote(findings)}.token)) AS BIGINT)")
