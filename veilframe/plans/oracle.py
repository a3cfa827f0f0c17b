"""DuckDB SQL twins of the registered queries.

They follow a different route where one exists: one CTE per rule without gates, RE2
patterns, and whole-table windows, so agreement says something.
"""

from __future__ import annotations

from veilframe.functions.rules import RULES, Rule, select_rules
from veilframe.functions.tokens import CUSTOM_TOKEN_PATTERN, TOKEN_PATTERN
from veilframe.operators import access, logs
from veilframe.operators import requests as reqs
from veilframe.plans.queries import (
    ASOF_DELAY_HOURS,
    HANDLERS,
    PRUNE_TTL_SECONDS,
    SUBSET_LABELS,
    WAVE,
    WAVES,
)
from veilframe.sources import tables as src

SPACES = (
    r"\t\n\x0b\f\r \x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}"
)


def lit(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def to_re2(pattern: str, ignore_case: bool = False) -> str:
    """RE2 has ASCII \\b, \\w and \\d already; only the white space differs."""
    out = pattern.replace(r"[\s\S]", "(?s:.)")
    out = out.replace(r"[\s:;]", f"[{SPACES}:;]").replace(r"\s", f"[{SPACES}]")
    return ("(?i)" if ignore_case else "") + out


def token(label: str, value: str, width: int = 6) -> str:
    return f"('[{label}_' || substr(sha256({value}), 1, {width}) || ']')"


def chain(
    name: str,
    source: str,
    text: str = "text",
    rules: tuple[Rule, ...] = RULES,
    width: int = 6,
) -> str:
    """CTEs that redact one column of ``source``; the last, ``name``, has ``t`` and ``f``."""
    ctes = [
        f"{name}_0 AS (SELECT *, {text} AS t,"
        " CAST([] AS STRUCT(label VARCHAR, value VARCHAR, token VARCHAR)[]) AS f"
        f" FROM ({source}))"
    ]
    for n, rule in enumerate(rules):
        p = lit(to_re2(rule.pattern, rule.ignore_case))
        values = f"regexp_extract_all(t, {p}, {rule.group})"
        if rule.label == "SENSITIVE_SECRET":
            pieces = (
                f"list_transform(list_zip(regexp_extract_all(t, {p}), {values}), lambda z:"
                f" left(z[1], strpos(z[1], z[2]) - 1) || {token(rule.label, 'z[2]', width)}"
                " || substr(z[1], strpos(z[1], z[2]) + length(z[2])))"
            )
        else:
            pieces = f"list_transform({values}, lambda v: {token(rule.label, 'v', width)})"
        found = (
            f"list_transform({values}, lambda v: {{'label': '{rule.label}', 'value': v,"
            f" 'token': {token(rule.label, 'v', width)}}})"
        )
        out = name if n == len(rules) - 1 else f"{name}_{n + 1}"
        ctes.append(
            f"{out} AS (SELECT * EXCLUDE (t, f, hit),"
            f" CASE WHEN hit THEN array_to_string(list_transform(list_zip("
            f"regexp_split_to_array(t, {p}), {pieces}),"
            f" lambda z: coalesce(z[1], '') || coalesce(z[2], '')), '') ELSE t END AS t,"
            f" CASE WHEN hit THEN list_concat(f, {found}) ELSE f END AS f"
            f" FROM (SELECT *, regexp_matches(t, {p}) AS hit FROM {name}_{n}))"
        )
    return ",\n".join(ctes)


N_TOKENS = "len(list_distinct(list_transform(f, lambda x: x.token)))"

TIMED = (
    "SELECT doc_id AS request_id, ts, text, source, lang, event_type"
    " FROM documents JOIN events ON doc_id = event_id"
)


def unnested(source: str) -> str:
    """One row per finding of a chain."""
    return (
        "SELECT * EXCLUDE (t, f, i), i - 1 AS ord, f[i].label AS label, f[i].value AS value,"
        f" f[i].token AS token FROM (SELECT *, unnest(range(1, len(f) + 1)) AS i FROM {source})"
    )


FOUND = f"WITH {chain('r', TIMED)}, found AS ({unnested('r')})"
VAULT = (
    f"{FOUND}, vault AS (SELECT token, label, value, ts FROM found QUALIFY row_number()"
    " OVER (PARTITION BY token ORDER BY ts DESC, request_id DESC, ord DESC) = 1)"
)
DOCS = chain("r", "SELECT * FROM documents")


def restore(text: str, pattern: str = TOKEN_PATTERN) -> str:
    """Replace tokens by their entries in the map column ``m``."""
    p = lit(pattern)
    return (
        f"CASE WHEN regexp_matches({text}, {p}) THEN array_to_string(list_transform(list_zip("
        f"regexp_split_to_array({text}, {p}), list_transform(regexp_extract_all({text}, {p}),"
        f" lambda k: coalesce(m[k], k))), lambda z: coalesce(z[1], '') || coalesce(z[2], '')),"
        f" '') ELSE {text} END"
    )


def with_map(source: str, vault: str) -> str:
    """``source`` with the whole vault as one map ``m``."""
    entries = "map_from_entries(list({'k': token, 'v': value}))"
    return f"(SELECT * FROM {source}, (SELECT {entries} AS m FROM {vault}))"


def js(text: str) -> str:
    return f"CAST(to_json({text}) AS VARCHAR)"


def pick(values: tuple[str, ...], index: str) -> str:
    return f"([{', '.join(lit(v) for v in values)}])[CAST({index} % {len(values)} AS BIGINT) + 1]"


STREAM = (
    "CASE request_id % 3 WHEN 0 THEN 'true' WHEN 1 THEN '\"true\"' ELSE 'false' END"
)


def body(text: str) -> str:
    return (
        f"'{{\"stream\":' || {STREAM} || ',\"messages\":[{{\"role\":\"user\",\"content\":'"
        f" || {js(text)} || '}}]}}'"
    )


METHOD = pick(src.METHODS, "request_id")
PATH = pick(src.PATHS, "request_id")
STATUS = "CAST(CASE WHEN request_id % 10 = 9 THEN 429 ELSE 200 END AS BIGINT)"


def reply(text: str) -> str:
    return (
        "'{\"id\":\"r\",\"choices\":[{\"message\":{\"content\":' || " + js(text) + " || '}}]}'"
    )


BLOCK_TEXT = (
    "'-----BEGIN PRIVATE KEY-----' || chr(10) || CASE WHEN length(text) >= 64"
    " THEN left(text, 64) ELSE rpad(text, 64, ' ') END || text"
    " || chr(10) || '-----END PRIVATE KEY-----'"
)

SQL: dict[str, str] = {
    "redact_text": f"WITH {DOCS} SELECT doc_id, t AS redacted, {N_TOKENS} AS token_count FROM r",
    "token_mint": f"""SELECT doc_id, {token('SENSITIVE_SECRET', 'text')} AS token,
        {token('SENSITIVE_SECRET', 'text', 16)} AS wide_token FROM documents""",
    "findings": f"WITH {DOCS} SELECT doc_id, ord, label, value, token FROM ({unnested('r')})",
    "redaction_flags": f"""WITH {DOCS} SELECT doc_id, len(f) > 0 AS has_redacted,
        {N_TOKENS} AS token_count FROM r""",
    "redact_by_key": f"""WITH {DOCS} SELECT doc_id,
        {token('SENSITIVE_SECRET', 'source')} AS author,
        {token('SENSITIVE_SECRET', 'lang')} AS session_token, t AS message,
        n_chars AS secret_size, {token('SENSITIVE_SECRET', 'source')} AS api_key,
        t AS note, lang FROM r""",
    "redact_nested": f"""WITH {DOCS} SELECT doc_id, source AS first, t AS second,
        {token('SENSITIVE_SECRET', 'source')} AS apiKey, t AS note, t AS content, n_chars,
        {N_TOKENS} + 1 AS token_count FROM r""",
    "redact_json": f"""WITH {chain('r', TIMED)} SELECT request_id, {body('t')} AS redacted,
        {N_TOKENS} AS token_count FROM r""",
    "redact_json_status": f"""WITH {DOCS} SELECT doc_id,
        CASE WHEN doc_id % 5 IN (2, 3) THEN 'invalid' ELSE 'ok' END AS status,
        CASE doc_id % 5 WHEN 0 THEN '{{"a":' || {js('t')} || ',"a":' || {js('t')} || '}}'
            WHEN 1 THEN repeat('[', 1200) || {js('t')} || repeat(']', 1200)
            WHEN 4 THEN {js('t')} END AS redacted,
        CASE WHEN doc_id % 5 IN (2, 3) THEN 0 ELSE {N_TOKENS} END AS token_count FROM r""",
    "redact_chat": f"""WITH {chain('c', 'SELECT conv_id, turn, role, text FROM conversations')},
        {DOCS} SELECT c.conv_id, c.turn, c.role, c.t AS content, r.t AS attached,
        len(list_distinct(list_concat(list_transform(c.f, lambda x: x.token),
            coalesce(list_transform(r.f, lambda x: x.token), [])))) AS token_count
        FROM c LEFT JOIN r ON c.conv_id = r.doc_id""",
    "redact_corpus": f"""WITH {chain('u', 'SELECT page_id, url AS text FROM pages')},
        {chain('h', 'SELECT page_id, html AS text FROM pages')}
        SELECT page_id, u.t AS url, h.t AS html,
        len(list_distinct(list_concat(list_transform(u.f, lambda x: x.token),
            list_transform(h.f, lambda x: x.token)))) AS token_count
        FROM u JOIN h USING (page_id)""",
    "clean_rows": f"WITH {DOCS} SELECT doc_id, text FROM r WHERE len(f) = 0",
    "vault_build": f"""{FOUND} SELECT token, label, value, request_id, ord,
        epoch_us(ts) AS saved_at_us FROM found""",
    "vault_upsert": f"""{VAULT} SELECT token, label, value, epoch_us(ts) AS saved_at_us
        FROM vault""",
    "vault_prune": f"""{VAULT} SELECT token, value, epoch_us(ts) AS saved_at_us FROM vault
        WHERE ts >= (SELECT max(ts) FROM vault) - INTERVAL {PRUNE_TTL_SECONDS} SECOND""",
    "vault_size": f"""{VAULT} SELECT count(*) AS vault_size FROM vault
        WHERE ts >= (SELECT max(ts) FROM vault) - INTERVAL {PRUNE_TTL_SECONDS} SECOND""",
    "vault_get": f"""{VAULT}, {chain('h', 'SELECT page_id, html AS text FROM pages')},
        keys AS (SELECT DISTINCT token FROM ({unnested('h')}))
        SELECT token, value FROM keys LEFT JOIN vault USING (token)""",
    "vault_clear": f"""{FOUND} SELECT request_id, ord, token, source || '-' || lang AS session
        FROM found WHERE source || '-' || lang NOT IN
        (SELECT source || '-' || lang FROM ({TIMED}) WHERE event_type = 'signup')""",
    "vault_asof": f"""{FOUND}, look AS (SELECT request_id, ord, token,
            ts + INTERVAL {ASOF_DELAY_HOURS} HOUR AS due FROM found),
        last_any AS (SELECT l.due, max(x.ts) AS last FROM (SELECT DISTINCT due FROM look) l
            JOIN found x ON x.ts <= l.due GROUP BY l.due),
        own AS (SELECT l.request_id, l.ord, l.token, l.due, s.ts, s.value FROM look l
            JOIN found s ON s.token = l.token AND s.ts <= l.due
            QUALIFY row_number() OVER (PARTITION BY l.request_id, l.ord, l.token
                ORDER BY s.ts DESC, s.request_id DESC, s.ord DESC) = 1)
        SELECT request_id, ord, token, epoch_us(due) AS at_us,
            CASE WHEN ts >= last - INTERVAL 3600 SECOND THEN value END AS value
        FROM own JOIN last_any USING (due)""",
    "vault_collisions": f"""{FOUND} SELECT token, count(DISTINCT value) AS n_values FROM found
        GROUP BY token HAVING count(DISTINCT value) > 1""",
    "vault_collisions_narrow": f"""WITH {chain('r', TIMED, width=2)}
        SELECT token, count(DISTINCT value) AS n_values FROM ({unnested('r')})
        GROUP BY token HAVING count(DISTINCT value) > 1""",
    "rehydrate_text": f"""{VAULT} SELECT request_id, {restore('t')} AS restored
        FROM {with_map('r', 'vault')}""",
    "rehydrate_unknown": f"""{VAULT}, known AS (SELECT * FROM vault WHERE label <> 'USER_EMAIL')
        SELECT request_id, {restore('t')} AS restored
        FROM {with_map('r', 'known')}""",
    "rehydrate_custom": f"""WITH names AS (SELECT DISTINCT '[' || source || ']' AS token,
            'Source $1 ' || source AS value FROM documents)
        SELECT doc_id, {restore("('from [' || source || '] and [x] ' || text)",
                                CUSTOM_TOKEN_PATTERN)} AS restored
        FROM {with_map('documents', 'names')}""",
    "rehydrate_literal": """WITH s AS (SELECT DISTINCT source, ascii(right(source, 1)) AS n FROM documents WHERE source IS NOT NULL),
        e AS (SELECT 'TOKEN_' || source AS token, source || 'a' AS pos, CASE n % 3 WHEN 0 THEN '<$1 TOKEN_' || source || '0>'
                WHEN 1 THEN 'TOKEN_src' || n % 7 ELSE 'TOKEN' END AS value FROM s
            UNION ALL SELECT 'TOKEN_' || source || '0', source || 'b', 'zero' FROM s),
        names AS (SELECT token, arg_max(value, pos) AS value, max(pos) AS pos FROM e GROUP BY 1),
        every AS (SELECT list({'k': token, 'v': value} ORDER BY pos) AS l FROM names)
        SELECT doc_id, list_reduce(l, lambda acc, x: {'k': replace(acc.k, x.k, x.v), 'v': ''},
            {'k': 'TOKEN_' || source || '0 and TOKEN_' || source || '_' || source || ' ' || text, 'v': ''}).k AS restored
        FROM documents, every""",
    "rehydrate_nested": f"""{VAULT}, z AS (SELECT request_id, source,
            {restore('t')} AS log FROM {with_map('r', 'vault')})
        SELECT request_id, log, log AS text, source FROM z""",
    "round_trip": f"""{VAULT} SELECT count(*) AS n_rows,
        count(*) FILTER ({restore('t')} <> text) AS n_lost FROM {with_map('r', 'vault')}""",
    "rehydrate_nested_tokens": f"""WITH
        {chain('r', f'SELECT doc_id, {BLOCK_TEXT} AS text FROM documents')},
        vault AS (SELECT DISTINCT token, value FROM ({unnested('r')})),
        o AS (SELECT doc_id, m, {restore('t')} AS one_pass FROM {with_map('r', 'vault')})
        SELECT doc_id, one_pass, {restore('one_pass')} AS two_passes FROM o""",
    "rehydrate_responses": f"""{VAULT} SELECT request_id, {STATUS} AS status,
        CASE WHEN request_id % 10 = 9 THEN {reply('t')}
        ELSE {reply(f"({restore('t')})")} END AS body FROM {with_map('r', 'vault')}""",
    "pii_by_type": f"""{FOUND} SELECT split_part(token, '_', 2) AS type, count(*) AS n
        FROM (SELECT DISTINCT request_id, token FROM found) GROUP BY 1""",
    "pii_by_label": f"""{FOUND} SELECT label, count(*) AS n
        FROM (SELECT DISTINCT request_id, label, token FROM found) GROUP BY 1""",
    "request_token_count": f"""{FOUND} SELECT request_id, count(DISTINCT token) AS token_count
        FROM found GROUP BY 1""",
    "latency_last50": """SELECT event_id, CAST(floor(value + 0.5) AS BIGINT) AS duration_ms
        FROM events WHERE floor(value + 0.5) > 0 ORDER BY ts DESC, event_id DESC LIMIT 50""",
    "vault_gauge": f"""{FOUND} SELECT CAST(least(100, floor(
        (SELECT count(*) FROM (SELECT DISTINCT request_id, token FROM found)) / 1000 * 100 + 0.5))
        AS BIGINT) AS vault_percent""",
    "pii_by_source": f"""{FOUND} SELECT source, label, count(*) AS n FROM found
        GROUP BY ROLLUP (source, label)""",
}

for _label in SUBSET_LABELS:
    SQL[f"rule_subset_{_label.lower()}"] = (
        f"WITH {chain('r', 'SELECT * FROM documents', rules=select_rules([_label]))}"
        f" SELECT doc_id, t AS redacted, {N_TOKENS} AS token_count FROM r"
    )

_HASHED = "SELECT *, sha256(CAST(doc_id AS VARCHAR)) AS h FROM documents"
for _label, _key in src.KEYS.items():
    _free = "planted" if _label in SUBSET_LABELS else "subset"
    _with_key = (
        f"SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN text || ' ' || {_key} || ' .' ELSE text END"
        f" AS text FROM ({_HASHED})"
    )
    SQL[f"rule_{_free}_{_label.lower()}"] = (
        f"WITH {chain('r', _with_key, rules=select_rules([_label]))}"
        f" SELECT doc_id, t AS redacted, {N_TOKENS} AS token_count FROM r"
    )
_ANY_KEY = " ".join(f"WHEN {n} THEN {key}" for n, key in enumerate(src.KEYS.values()))
_WITH_ANY = (
    f"SELECT doc_id, text || ' ' || CASE doc_id % {len(src.KEYS)} {_ANY_KEY} END || ' .' AS text"
    f" FROM ({_HASHED})"
)
SQL["rules_planted"] = (
    f"WITH {chain('r', _WITH_ANY)} SELECT doc_id, t AS redacted, {N_TOKENS} AS token_count FROM r"
)

_RESCAN = chain("b", "SELECT doc_id, t AS text, f AS own FROM a")
_BARE_SECRET = "substr(sha256(source), 1, 20)"
_TWICE = (
    "SELECT doc_id, text || CASE WHEN doc_id % 5 = 0 THEN chr(10) || 'api_key=' ||"
    f" {_BARE_SECRET} || ' or ' || {_BARE_SECRET} ELSE '' END || CASE WHEN doc_id % 7 = 1"
    f" THEN chr(10) || 'x' || {_BARE_SECRET} || 'y' ELSE '' END AS text FROM documents"
)
SQL["leak_audit"] = f"""WITH {chain('a', _TWICE)}, {_RESCAN}
    SELECT doc_id, len(f) AS n_rescan, len(list_filter(list_distinct(
        list_transform(own, lambda x: x.value)), lambda v: contains(text, v))) AS n_known
    FROM b WHERE n_rescan > 0 OR n_known > 0"""
SQL["leak_audit_vault"] = f"""WITH {chain('a', _TWICE)},
    vals AS (SELECT DISTINCT value FROM ({unnested('a')}) WHERE value <> '')
    SELECT doc_id, count(*) AS n_known FROM a, vals
    WHERE contains(a.t, vals.value) GROUP BY doc_id"""
_RESCAN_R = chain("b", "SELECT request_id, t AS text, f AS own FROM r")
SQL["latency_rolling"] = """SELECT event_id, duration_ms, avg(duration_ms) OVER (ORDER BY ts, event_id
    ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS mean_ms
    FROM (SELECT *, CAST(floor(value + 0.5) AS BIGINT) AS duration_ms FROM events) WHERE duration_ms > 0"""
SQL["pii_totals"] = f"""{FOUND}, {_RESCAN_R},
    tok AS (SELECT DISTINCT request_id, token FROM found),
    ty AS (SELECT split_part(token, '_', 2) AS type, count(*) AS n FROM tok GROUP BY 1),
    recent AS ({SQL['latency_last50']})
    SELECT (SELECT count(*) FROM events) AS request_count,
        (SELECT count(*) FROM tok) AS redacted_count,
        (SELECT count(*) FROM b WHERE len(f) > 0 OR len(list_filter(own,
            lambda x: contains(text, x.value))) > 0) AS leaks,
        (SELECT string_agg(type || ':' || n, ',' ORDER BY type || ':' || n) FROM ty) AS types,
        (SELECT string_agg(duration_ms, ',' ORDER BY ts, event_id)
         FROM recent JOIN events USING (event_id)) AS latency"""

# Tool events: what each payload shape must lead to, from the text it was built of.

_EVENT_TEXT = (
    "CASE doc_id % 10 WHEN 4 THEN text || chr(10) || lang WHEN 5 THEN text WHEN 6 THEN text"
    " WHEN 7 THEN text || chr(10) || lang END"
)
_HANDLER = (
    "(['pre_claude', 'pre_gemini', 'post_mcp', 'after_mcp', 'post_builtin', 'after_builtin',"
    " 'post_builtin', 'post_builtin'])[doc_id % 10 + 1]"
)
_SCANNED = chain(
    "r",
    f"SELECT doc_id, source, {_HANDLER} AS handler, coalesce({_EVENT_TEXT}, text) AS text"
    " FROM documents WHERE doc_id % 10 < 8",
)
_RESPONSE = f"""CASE
    WHEN doc_id % 10 = 1 THEN
        '{{"hookSpecificOutput":{{"tool_input":{{"title":"Report","properties":{{"note":'
        || {js('t')} || ',"apiKey":' || {js(token('SENSITIVE_SECRET', 'source'))} || '}}}}}}}}'
    WHEN len(f) = 0 THEN NULL
    WHEN doc_id % 10 = 0 THEN
        '{{"hookSpecificOutput":{{"hookEventName":"PreToolUse","permissionDecision":"allow",'
        || '"updatedInput":{{"channel":"#general","text":' || {js('t')} || '}}}}}}'
    WHEN doc_id % 10 = 2 THEN
        '{{"updatedMCPToolOutput":{{"content":[{{"type":"text","text":"Result:"}},'
        || '{{"type":"text","text":' || {js('t')} || '}}]}}}}'
    WHEN doc_id % 10 = 3 THEN
        '{{"decision":"deny","reason":' || {js("('Result:' || chr(10) || t)")} || '}}'
    ELSE '{{"decision":"' || CASE WHEN doc_id % 10 = 5 THEN 'deny' ELSE 'block' END
        || '","reason":' || {js('t')} || '}}' END"""
SQL["event_route"] = (
    f"SELECT doc_id AS event_id, {_HANDLER} AS handler FROM documents WHERE doc_id % 10 < 8"
)
SQL["event_text"] = f"""SELECT doc_id AS event_id, nullif({_EVENT_TEXT}, '') AS event_text
    FROM documents WHERE doc_id % 10 < 8"""
SQL["event_changed_only"] = f"""WITH {_SCANNED} SELECT * FROM (
    SELECT doc_id AS event_id, handler, {_RESPONSE} AS response FROM r)
    WHERE response IS NOT NULL"""
for _name in HANDLERS:
    SQL[f"event_{_name}"] = f"""WITH {_SCANNED} SELECT doc_id AS event_id,
        {_RESPONSE} AS response FROM r WHERE handler = '{_name}'"""
SQL["payload_lines"] = f"""SELECT status, handler, sum(k) AS n FROM (
        SELECT CASE doc_id % 10 WHEN 8 THEN 'blank' WHEN 9 THEN 'invalid' ELSE 'ok' END AS status,
            CASE WHEN doc_id % 10 < 8 THEN {_HANDLER} END AS handler,
            CASE doc_id % 10 WHEN 8 THEN 2 ELSE 1 END AS k FROM documents)
    GROUP BY ALL"""
_DEEP = ("repeat('[', 1200)", "repeat(']', 1200)")
SQL["event_odd_payloads"] = f"""WITH {chain('r', "SELECT doc_id, text FROM documents")}
    SELECT doc_id AS event_id,
        (['pre_gemini', 'pre_claude', 'post_builtin', 'after_mcp', 'pre_claude'])[doc_id % 5 + 1] AS handler,
        CASE WHEN len(f) = 0 THEN NULL ELSE CASE doc_id % 5
        WHEN 0 THEN '{{"hookSpecificOutput":{{"tool_input":{{"note":' || {js('t')} || '}}}}}}'
        WHEN 2 THEN '{{"decision":"block","reason":' || {js('t')} || '}}'
        WHEN 3 THEN '{{"decision":"deny","reason":' || {js("('Result:' || chr(10) || t)")} || '}}'
        ELSE '{{"hookSpecificOutput":{{"hookEventName":"PreToolUse","permissionDecision":"allow","updatedInput":'
            || CASE doc_id % 5 WHEN 1 THEN {_DEEP[0]} || {js('t')} || {_DEEP[1]}
                ELSE '{{"k":' || {js('t')} || ',"k":' || {js('t')} || '}}' END || '}}}}' END END AS response
    FROM r"""
SQL["event_quarantine"] = """SELECT doc_id AS event_id, CASE doc_id % 10 WHEN 8 THEN 'blank'
    WHEN 9 THEN 'invalid' ELSE 'ok' END AS status FROM documents"""
SQL["event_plugin_after"] = f"""WITH {DOCS}
    SELECT doc_id, t AS output, t AS first, text AS second FROM r"""

# Access audit


def re2_path(path: str) -> str:
    base = (
        f"regexp_replace(list_extract(string_split({path}, '/'), -1),"
        f" {lit(f'^[{SPACES}]+|[{SPACES}]+' + chr(92) + 'z')}, '', 'g')"
    )
    return f"regexp_matches({base}, {lit('|'.join(access.SENSITIVE_NAMES))})"


_READER = rf"\b({'|'.join(access.READERS)})\b"
_BARE = f"translate(w, {lit(access.SHELL_META)}, '')"
_TARGETS = f"regexp_extract_all(command, {lit(rf'<[{SPACES}]*([^{SPACES}|;&<>]+)')}, 1)"
_TRIMMED = f"regexp_replace(p, {lit(f'^[{SPACES}]+|[{SPACES}]+' + chr(92) + 'z')}, '', 'g')"
_WORDS = f"regexp_split_to_array({_TRIMMED}, {lit(f'[{SPACES}]+')})"
_FIRST = (
    f"list_position(list_transform({_WORDS}, lambda w: regexp_matches(w, {lit(_READER)})), true)"
)
_AFTER = f"list_slice({_WORDS}, coalesce(nullif({_FIRST}, 0), 1000000) + 1, 1000000)"
COMMAND_HIT = f"""(regexp_matches(command, {lit(_READER)}) AND (
    len(list_filter({_TARGETS}, lambda w: {re2_path(_BARE)})) > 0
    OR len(list_filter(regexp_split_to_array(command, '[|;&<>]+'), lambda p:
        len(list_filter({_AFTER}, lambda w: w NOT LIKE '-%' AND {re2_path(_BARE)})) > 0)) > 0))"""
_CALLS = f"""SELECT event_id, {pick(('read', 'bash', 'write'), 'event_id')} AS tool,
    '/srv/' || event_type || '/' || {pick(src.FILE_NAMES, 'event_id')} AS file_path,
    {pick(src.COMMANDS, 'event_id')} AS command FROM events"""
_REASON = f"""CASE WHEN tool = 'read' AND {re2_path('file_path')}
        THEN '{access.BLOCKED_FILE}'
    WHEN tool = 'bash' AND {COMMAND_HIT} THEN '{access.BLOCKED_COMMAND}' END"""
SQL["sensitive_path"] = f"""SELECT id, path, {re2_path('path')} AS sensitive FROM (
    SELECT 'e' || event_id AS id, file_path AS path FROM ({_CALLS})
    UNION ALL SELECT 'p' || page_id, url FROM pages)"""
SQL["sensitive_command"] = f"""SELECT event_id, command, {COMMAND_HIT} AS sensitive FROM (
    SELECT event_id, command || ' ' || file_path AS command FROM ({_CALLS}))"""
SQL["access_decision"] = f"SELECT event_id, tool, {_REASON} AS blocked_reason FROM ({_CALLS})"
SQL["access_split"] = f"""SELECT event_id, CASE WHEN {_REASON} IS NULL THEN 'allowed'
    ELSE 'blocked' END AS side FROM ({_CALLS})"""
SQL["event_plugin_before"] = f"""WITH {DOCS}, calls AS ({_CALLS}),
    z AS (SELECT event_id, tool, {_REASON} AS blocked_reason, text, t, f
        FROM calls LEFT JOIN r ON event_id = doc_id)
    SELECT event_id, tool, blocked_reason,
        CASE WHEN blocked_reason IS NULL THEN t ELSE text END AS text,
        blocked_reason IS NULL AND coalesce(len(f), 0) > 0 AS has_redacted FROM z"""

# Logs and requests

SQL["log_mask"] = """SELECT event_id, '[REDACTED]' AS token,
    CASE WHEN event_type <> 'view' THEN '[REDACTED]' END AS apiKey, event_type AS Password,
    '[REDACTED]' AS ctx_password, event_type AS ctx_user, event_type AS deep_secret,
    '[REDACTED]' AS extra_id_token, event_type AS extra_path FROM events"""
SQL["log_files"] = SQL["log_mask"]
_LEVEL = pick(src.LEVELS, "event_id")
_CASES = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in logs.SEVERITIES.items())
_P, _T, _M = js("props"), js("event_type"), '"[REDACTED]"'
SQL["log_mask_json"] = f"""SELECT event_id, CASE event_id % 6
    WHEN 0 THEN '{{"level":"info","token":{_M},"ctx":{{"password":{_M},"user":' || {_T} || ',"deep":{{"secret":' || {_T} || '}}}}}}'
    WHEN 1 THEN '{{"msg":' || {_T} || ',"apiKey":null,"list":[{{"token":' || {_T} || '}}],"extra":{{"idToken":{_M},"path":'
        || {_T} || '}}}}'
    WHEN 2 THEN '{{ "token" : {_M},' || chr(9) || '"n":1.50 , "m":' || {_T} || '}}'
    WHEN 3 THEN '[{{"token":' || {_T} || '}}]'
    WHEN 4 THEN '{{"\\u0073ecret":{_M},"a":{{"clientSecret":{_M},"b":{{"clientSecret":' || {_T} || '}}}},"big":1e400}}'
    ELSE event_type END AS record FROM events"""
SQL["log_severity"] = f"""SELECT event_id, {_LEVEL} AS level,
    CASE {_LEVEL} {_CASES} ELSE 'DEFAULT' END AS severity FROM events"""
_HAS = {
    "x-api-key": "event_type = 'error'",
    "authorization": "event_type IN ('click', 'purchase')",
    "x-goog-api-key": "event_type = 'signup'",
    "?key": "path LIKE '%key=%'",
}
_ROUTED: dict[str, tuple[str, str | None, tuple[str, ...]]] = {
    path: (provider, target, names)
    for path, (_m, _p, provider, target, names) in zip(
        ("/v1/messages", "/v1/chat/completions", "/api/paas/v4/chat/completions",
         "/api/coding/paas/v4/chat/completions"), reqs.ROUTES, strict=False)
}
_LOG = f"SELECT *, {METHOD} AS method, {PATH} AS path FROM ({TIMED})"


def _by_route(values: dict[str, str], model: str, health: str, other: str) -> str:
    fixed = " ".join(
        f"WHEN method = 'POST' AND path = '{p}' THEN {v}" for p, v in values.items()
    )
    return (
        f"CASE {fixed} WHEN method = 'POST' AND path LIKE '/v1beta/models/%' THEN {model}"
        f" WHEN method = 'GET' AND path = '/health' THEN {health} ELSE {other} END"
    )


SQL["route_classify"] = f"""SELECT request_id, method, path,
    {_by_route({p: lit(v[0]) for p, v in _ROUTED.items()}, "'google'", "'health'",
               "'google'")} AS provider,
    {_by_route({p: lit(v[1] or '') for p, v in _ROUTED.items()},
               f"'{reqs.GOOGLE_BASE}' || path", "NULL", f"'{reqs.GOOGLE_BASE}' || path")}
    AS target FROM ({_LOG})"""
SQL["missing_auth"] = f"""SELECT request_id, {_by_route(
    {p: 'NOT (' + ' OR '.join(_HAS[n] for n in v[2]) + ')' for p, v in _ROUTED.items()},
    f"NOT ({_HAS['x-goog-api-key']} OR {_HAS['?key']})", 'false', 'false')} AS missing
    FROM ({_LOG})"""
SQL["stream_mode"] = f"SELECT request_id, request_id % 3 <> 2 AS streamed FROM ({TIMED})"
SQL["body_methods"] = f"""WITH {chain('r', TIMED)} SELECT request_id,
    CASE WHEN {METHOD} <> 'GET' THEN {body('t')} END AS forwarded,
    CASE WHEN {METHOD} <> 'GET' THEN {N_TOKENS} ELSE 0 END AS token_count FROM r"""
_SENT = chain("r", f"SELECT * FROM ({TIMED})")
SQL["exchange_join"] = f"""WITH {_SENT}, found AS (
        SELECT * FROM ({unnested('r')}) WHERE {METHOD} <> 'GET'),
    vault AS (SELECT token, value FROM found QUALIFY row_number()
        OVER (PARTITION BY token ORDER BY ts DESC, request_id DESC, ord DESC) = 1)
    SELECT request_id, CASE WHEN {METHOD} <> 'GET' THEN {body('t')} END AS forwarded,
        {METHOD} <> 'GET' AND len(f) > 0 AS has_redacted, {STATUS} AS status,
        CASE WHEN request_id % 10 = 9 THEN {reply('t')}
        ELSE {reply(f"({restore('t')})")} END AS client_body
    FROM {with_map('r', 'vault')}"""

# Streams: whole texts and window functions in place of chunk state

_SIZE = src.DELTA_SIZE
_CUT = f"regexp_extract_all(t, '(?s:.{{1,{_SIZE}}})')"
_CHUNKS = f"""ck AS (SELECT request_id, t, unnest({_CUT}) AS chunk,
    unnest(range(0, len({_CUT}))) AS seq FROM r)"""


def emitted(hold: str) -> str:
    """Chunk ends less what ``hold`` says of the text before them, then restored."""
    return f"""{_CHUNKS}, ends AS (SELECT request_id, t, seq,
        least((seq + 1) * {_SIZE}, length(t)) AS e FROM ck),
    tails AS (SELECT *, substr(t, greatest(0, e - n) + 1, e - greatest(0, e - n)) AS tail
        FROM ends, (SELECT max(length(token)) - 1 AS n FROM vault)),
    cuts AS (SELECT request_id, seq, t, e - ({hold}) AS e FROM tails),
    spans AS (SELECT request_id AS stream_id, seq, substr(t, b + 1, e - b) AS span
        FROM (SELECT *, lag(e, 1, 0) OVER (PARTITION BY request_id ORDER BY seq) AS b
            FROM cuts))"""


_PREFIXES = (
    "SELECT DISTINCT left(token, n) AS p FROM (SELECT token, unnest(range(1, length(token))) AS n"
    " FROM vault)"
)
_RAW = "regexp_extract(tail, '\\[[^\\[\\]]*$')"
SQL["rehydrate_chunks_raw"] = f"""{VAULT}, pref AS ({_PREFIXES}),
    {emitted(f"CASE WHEN {_RAW} IN (SELECT p FROM pref) THEN length({_RAW}) ELSE 0 END")}
    SELECT stream_id, seq, {restore('span')} AS emitted FROM {with_map('spans', 'vault')}"""
SQL["rehydrate_chunks_stream"] = SQL["rehydrate_chunks_raw"]
# A vault that grows: a token is known from its wave on, and a bracket is held as long as every
# chunk since it opened could know of it.
_WAVE_OF = f"least(seq // {WAVE}, {WAVES - 1})"
SQL["rehydrate_chunks_growing"] = f"""{VAULT}, {_CHUNKS}, born AS (
        SELECT token, value, (strpos('0123456789abcdef', substr(token, length(token) - 6, 1)) - 1) % {WAVES} AS birth
        FROM vault),
    pref AS (SELECT left(token, n) AS p, min(birth) AS birth
        FROM (SELECT *, unnest(range(1, length(token))) AS n FROM born) GROUP BY 1),
    ends AS (SELECT request_id, t, seq, {_WAVE_OF} AS wave, least((seq + 1) * {_SIZE}, length(t)) AS e FROM ck),
    tails AS (SELECT *, regexp_extract(substr(t, greatest(0, e - n) + 1, e - greatest(0, e - n)), '\\[[^\\[\\]]*$') AS part
        FROM ends, (SELECT max(length(token)) - 1 AS n FROM vault)),
    known AS (SELECT tails.*, e - length(part) AS opened, part <> '' AND coalesce(birth <= wave, false) AS ok
        FROM tails LEFT JOIN pref ON part = p),
    cuts AS (SELECT *, e - CASE WHEN bool_and(ok) OVER (PARTITION BY request_id, opened ORDER BY seq)
        THEN length(part) ELSE 0 END AS shown FROM known),
    spans AS (SELECT request_id AS stream_id, seq, wave, substr(t, b + 1, shown - b) AS span
        FROM (SELECT *, lag(shown, 1, 0) OVER (PARTITION BY request_id ORDER BY seq) AS b FROM cuts)),
    maps AS (SELECT w, map_from_entries(list({{'k': token, 'v': value}})) AS m
        FROM born, range({WAVES}) AS g(w) WHERE birth <= w GROUP BY w)
    SELECT stream_id, seq, {restore('span')} AS emitted FROM spans LEFT JOIN maps ON wave = w"""
_DELTA = "regexp_extract(tail, '\\[(?:[A-Z_][^\\[\\]]*)?$')"
_LONGEST = "(SELECT max(length(token)) FROM vault)"
_FIELD = "(['content', 'text', 'reasoning_content'])[stream_id % 3 + 1]"
SQL["sse_delta_text"] = f"""{VAULT},
    {emitted(f"CASE WHEN length({_DELTA}) < {_LONGEST} THEN length({_DELTA}) ELSE 0 END")}
    SELECT stream_id, {_FIELD} AS field, seq + 4 AS seq, {restore('span')} AS emitted
    FROM {with_map('spans', 'vault')}"""
SQL["sse_parse"] = f"""WITH {chain('r', TIMED)}, {_CHUNKS}
    SELECT request_id AS stream_id, seq + 4 AS seq, 'delta' AS kind,
        CASE WHEN request_id % 3 = 0 THEN chunk END AS content,
        CASE WHEN request_id % 3 = 1 THEN chunk END AS text,
        CASE WHEN request_id % 3 = 2 THEN chunk END AS reasoning_content FROM ck
    UNION ALL SELECT request_id, i, (['plain', 'event', 'text', 'plain'])[i + 1],
        NULL, NULL, NULL FROM r, range(0, 4) AS g(i)"""
# Event streams: every line and its end are placed in the whole wire text, and what a line
# shows belongs to the wire chunk that brings its line end.
_WIRE = src.WIRE_SIZE


def _frame(text: str) -> str:
    cases = " ".join(
        f"WHEN {n} THEN 'data: ' || {lit(head)} || {js(text)} || {lit(tail)}"
        for n, (head, tail) in enumerate(src.DELTA_FRAMES)
    )
    return f"CASE stream_id % {len(src.DELTA_FRAMES)} {cases} END || chr(10)"


SQL["rehydrate_sse"] = f"""{VAULT},
    {emitted(f"CASE WHEN length({_DELTA}) < {_LONGEST} THEN length({_DELTA}) ELSE 0 END")},
    shown AS (SELECT stream_id, seq, {restore('span')} AS span FROM {with_map('spans', 'vault')}),
    lines AS (
        SELECT ck.request_id AS stream_id, ck.seq, 0 AS part, ck.chunk, shown.span
        FROM ck JOIN shown ON shown.stream_id = ck.request_id AND shown.seq = ck.seq),
    parts AS (
        SELECT stream_id, seq, part, {_frame('chunk')} AS wire, {_frame('span')} AS client FROM lines
        UNION ALL SELECT stream_id, seq, 1, chr(10), chr(10) FROM lines
        UNION ALL SELECT request_id, 1000000000, part,
            CASE part WHEN 0 THEN 'data: [DONE]' ELSE '' END || chr(10),
            CASE part WHEN 0 THEN 'data: [DONE]' ELSE '' END || chr(10)
        FROM r, range(0, 2) AS g(part)),
    placed AS (SELECT *, CAST(sum(length(wire)) OVER (PARTITION BY stream_id ORDER BY seq, part)
        AS BIGINT) AS upto FROM parts),
    told AS (SELECT stream_id, (upto - 1) // {_WIRE} AS seq,
            string_agg(client, '' ORDER BY upto) AS emitted
        FROM placed GROUP BY 1, 2),
    slots AS (SELECT stream_id, unnest(range(0, (max(upto) - 1) // {_WIRE} + 1)) AS seq
        FROM placed GROUP BY stream_id)
    SELECT stream_id, seq, coalesce(emitted, '') AS emitted FROM slots LEFT JOIN told
    USING (stream_id, seq)"""
SQL["stream_redact"] = SQL["redact_text"]
SQL["stream_vault"] = f"""{VAULT} SELECT token, label, value, epoch_us(ts) AS saved_at_us
    FROM vault WHERE ts >= (SELECT max(ts) FROM vault) - INTERVAL {PRUNE_TTL_SECONDS} SECOND"""
SQL["vault_store"] = f"{VAULT} SELECT token, label, value, epoch_us(ts) AS saved_at_us FROM vault"
SQL["vault_store_lookup"] = SQL["vault_get"]
SQL["stream_counters"] = f"""{FOUND} SELECT epoch_us(date_trunc('hour', ts)) AS window_start_us,
    split_part(token, '_', 2) AS type, count(*) AS n
    FROM (SELECT DISTINCT request_id, ts, token FROM found) GROUP BY 1, 2"""
