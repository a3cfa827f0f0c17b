"""Request-log operators: routing, authorisation, and whole exchanges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.functions.tokens import quote, sql_text
from veilframe.operators.nested import redact_json
from veilframe.operators.redact import explode_findings
from veilframe.operators.rehydrate import rehydrate
from veilframe.operators.vault import vault_build, vault_upsert
from veilframe.sources.stage import stage

# Method, path pattern, provider, target and accepted credentials per route.
ROUTES = (
    ("POST", r"(?i)^/v1/messages/?\z", "anthropic",
     "https://api.anthropic.com/v1/messages", ("x-api-key", "authorization")),
    ("POST", r"(?i)^/v1/chat/completions/?\z", "openai",
     "https://api.openai.com/v1/chat/completions", ("authorization",)),
    ("POST", r"(?i)^/api/paas/v4/chat/completions/?\z", "zhipuai",
     "https://api.z.ai/api/paas/v4/chat/completions", ("authorization",)),
    ("POST", r"(?i)^/api/coding/paas/v4/chat/completions/?\z", "zhipuai",
     "https://api.z.ai/api/coding/paas/v4/chat/completions", ("authorization",)),
    ("POST", r"(?i)^/v1beta/models/[^/]+/?\z", "google", None, ("x-goog-api-key", "?key")),
    ("GET", r"(?i)^/health/?\z", "health", None, ()),
)
GOOGLE_BASE = "https://generativelanguage.googleapis.com"
BODY_METHODS = ("POST", "PUT", "PATCH")


def _path_sql(url: str) -> str:
    return f"split_part({url}, '?', 1)"


def _route_case(method: str, url: str, values: list[str], default: str) -> str:
    path = _path_sql(url)
    cases = " ".join(
        f"WHEN {method} = {sql_text(m)} AND {path} RLIKE {sql_text(pattern)} THEN {value}"
        for (m, pattern, *_), value in zip(ROUTES, values, strict=True)
    )
    return f"CASE {cases} ELSE {default} END"


def route_classify(df: DataFrame, method: str = "method", url: str = "path") -> DataFrame:
    """Add ``provider`` and ``target`` (null for the health check)."""
    m, u = quote(method), quote(url)
    google = f"concat({sql_text(GOOGLE_BASE)}, {u})"
    # The model route keeps the query up to a second question mark, the fallback all of it.
    query = f"if(contains({u}, '?'), concat('?', split_part({u}, '?', 2)), '')"
    model = (
        f"concat({sql_text(GOOGLE_BASE + '/v1beta/models/')},"
        f" split_part({_path_sql(u)}, '/', 4), {query})"
    )
    targets = [
        model if provider == "google" else sql_text(target)
        for _, _, provider, target, _ in ROUTES
    ]
    return df.withColumns(
        {
            "provider": F.expr(
                _route_case(m, u, [sql_text(r[2]) for r in ROUTES], sql_text("google"))
            ),
            "target": F.expr(_route_case(m, u, targets, google)),
        }
    )


def missing_auth(
    method: str = "method", url: str = "path", headers: str = "headers"
) -> Column:
    """Whether a request lacks the credential its route asks for (header names in any case)."""
    m, u, h = quote(method), quote(url), quote(headers)

    def given(name: str) -> str:
        if name == "?key":
            return f"{u} RLIKE '[?&]key=[^&]'"
        return (
            f"exists(map_entries({h}), e -> lower(e.key) = {sql_text(name)} AND e.value <> '')"
        )

    tests = [
        f"NOT ({' OR '.join(f'coalesce({given(n)}, false)' for n in names)})" if names else "false"
        for *_, names in ROUTES
    ]
    return F.expr(_route_case(m, u, tests, "false"))


def stream_mode(body: str = "body") -> Column:
    """Whether the request asks for a streamed response: ``stream`` is true or "true"."""
    return F.coalesce(F.get_json_object(quote(body), "$.stream") == "true", F.lit(False))


def body_methods(df: DataFrame, method: str = "method", body: str = "body") -> DataFrame:
    """Redact the bodies of methods that carry one; others have no forwarded body."""
    keep = df.columns
    narrowed = df.withColumn(
        "_body", F.when(F.col(quote(method)).isin(*BODY_METHODS), F.col(quote(body)))
    )
    return redact_json(narrowed, "_body", redacted="forwarded").select(
        *keep, "forwarded", "findings"
    )


def rehydrate_responses(
    responses: DataFrame, vault: DataFrame, key: str = "request_id",
    status: str = "status", body: str = "body",
) -> DataFrame:
    """Restore the bodies of successful responses; error bodies pass as they are."""
    ok = f"{quote(status)} BETWEEN 200 AND 299"
    return rehydrate(responses, [key], [body], vault, when=ok, json=True)


def exchange_join(
    requests: DataFrame, responses: DataFrame, saved_at: str = "ts", key: str = "request_id"
) -> DataFrame:
    """A log of whole exchanges: what was forwarded, and what the client got back.

    Requests and responses meet on their key before anything is redacted or staged, so each
    text is shuffled once; the vault, the forwarded bodies and the replies all read from the stage.
    Requests without a response are staged as well, for what they add to the vault.
    """
    replies = responses.select(key, "status", F.col("body").alias("_reply"), F.lit(True).alias("_met"))
    sent = body_methods(requests.select(key, saved_at, "method", "body").join(replies, key, "left"))
    staged = stage(sent.select(key, saved_at, "forwarded", "findings", "status", "_reply", "_met"), "exchange")
    saves = vault_build(explode_findings(staged, [key, saved_at]), saved_at, key)
    met = staged.filter("_met").select(
        key, "forwarded", (F.size("findings") > 0).alias("has_redacted"), "status", F.col("_reply").alias("body"))
    return rehydrate_responses(met, vault_upsert(saves), key).withColumnRenamed("body", "client_body")
