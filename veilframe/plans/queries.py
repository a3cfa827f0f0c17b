"""The registered queries: each operator over the whole of the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.functions.redaction import token_count
from veilframe.functions.tokens import CUSTOM_TOKEN_PATTERN, mint
from veilframe.operators import access, chunks, events, logs, metrics, redact, rehydrate, vault
from veilframe.operators import requests as reqs
from veilframe.operators.nested import redact_json, redact_nested
from veilframe.sources import tables as src
from veilframe.sources.io import read_logs, read_payloads
from veilframe.sources.stage import stage, stage_path
from veilframe.sources.vault_store import VaultStore
from veilframe.streaming import jobs
from veilframe.streaming.sinks import append_to_table, batches_to_table, drain, read_stream

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}

ASOF_DELAY_HOURS = 3
PRUNE_TTL_SECONDS = 12 * 3600
ROWS_PER_BUCKET = 16  # of the stores in queries: small, so that there are several buckets
LINE_TASKS = 4  # tasks per core where every text becomes many lines
WAVE, WAVES, WAVE_FILES = 20, 4, 8  # chunks of a stream per micro-batch, micro-batches, files of each


def query(name: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name or fn.__name__] = fn
        return fn

    return register


def micros(column: str) -> Column:
    return F.unix_micros(column).alias(f"{column}_us")


# Redaction


@query()
def redact_text(spark: SparkSession, sf: str) -> DataFrame:
    out = redact.with_flags(redact.redact_text(src.documents(spark, sf)))
    return out.select("doc_id", "redacted", "token_count")


@query()
def token_mint(spark: SparkSession, sf: str) -> DataFrame:
    return src.documents(spark, sf).select(
        "doc_id",
        mint("SENSITIVE_SECRET", "text").alias("token"),
        mint("SENSITIVE_SECRET", "text", 16).alias("wide_token"),
    )


@query()
def findings(spark: SparkSession, sf: str) -> DataFrame:
    return redact.explode_findings(redact.redact_text(src.documents(spark, sf)), ["doc_id"])


@query()
def redaction_flags(spark: SparkSession, sf: str) -> DataFrame:
    out = redact.with_flags(redact.redact_text(src.documents(spark, sf)))
    return out.select("doc_id", "has_redacted", "token_count")


@query()
def redact_by_key(spark: SparkSession, sf: str) -> DataFrame:
    record = F.struct(
        F.col("source").alias("author"),
        F.col("lang").alias("Session-Token"),
        F.col("text").alias("message"),
        F.col("n_chars").alias("secret_size"),
    )
    fields = F.create_map(
        F.lit("api-key"), "source", F.lit("note"), "text", F.lit("lang"), "lang"
    )
    df = src.documents(spark, sf).select("doc_id", record.alias("rec"), fields.alias("m"))
    return redact_nested(df, ["rec", "m"]).select(
        "doc_id", "rec.author", F.col("rec.Session-Token").alias("session_token"),
        "rec.message", "rec.secret_size", F.col("m")["api-key"].alias("api_key"),
        F.col("m")["note"].alias("note"), F.col("m")["lang"].alias("lang"),
    )


@query("redact_nested")
def nested(spark: SparkSession, sf: str) -> DataFrame:
    args = F.struct(
        F.array("source", "text").alias("tokens"),
        F.struct(F.col("source").alias("apiKey"), F.col("text").alias("note")).alias("config"),
        F.array(F.struct(F.col("text").alias("content"), "n_chars")).alias("parts"),
    )
    df = src.documents(spark, sf).select("doc_id", args.alias("args"))
    out = redact_nested(df, ["args"])
    return out.select(
        "doc_id",
        F.col("args.tokens")[0].alias("first"), F.col("args.tokens")[1].alias("second"),
        "args.config.apiKey", "args.config.note",
        F.col("args.parts")[0]["content"].alias("content"),
        F.col("args.parts")[0]["n_chars"].alias("n_chars"),
        token_count("findings").alias("token_count"),
    )


@query("redact_json")
def json_bodies(spark: SparkSession, sf: str) -> DataFrame:
    out = redact.with_flags(redact_json(src.requests(spark, sf), "body"))
    return out.select("request_id", "redacted", "token_count")


@query()
def redact_json_status(spark: SparkSession, sf: str) -> DataFrame:
    """Documents in bodies with repeated keys, deep nesting, cut ends and trailing text."""
    out = redact_json(src.odd_bodies(spark, sf), "body", status="status")
    return redact.with_flags(out).select("doc_id", "status", "redacted", "token_count")


@query()
def redact_chat(spark: SparkSession, sf: str) -> DataFrame:
    out = redact_nested(src.chat_turns(spark, sf), ["messages"])
    return out.select(
        "conv_id", "turn",
        F.col("messages")[0]["role"].alias("role"),
        F.col("messages")[0]["content"].alias("content"),
        F.col("messages")[1]["content"].alias("attached"),
        token_count("findings").alias("token_count"),
    )


@query()
def redact_corpus(spark: SparkSession, sf: str) -> DataFrame:
    pages = src.spread(src.table(spark, sf, "pages"))
    out = redact.redact_corpus(pages, ["url", "html"])
    return out.select("page_id", "url", "html", token_count("findings").alias("token_count"))


@query()
def clean_rows(spark: SparkSession, sf: str) -> DataFrame:
    return redact.clean_rows(src.documents(spark, sf)).select("doc_id", "text")


def _subset(label: str) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        out = redact.redact_text(src.documents(spark, sf), labels=[label])
        return redact.with_flags(out).select("doc_id", "redacted", "token_count")

    return run


def _planted(label: str) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        out = redact.redact_text(src.with_keys(src.documents(spark, sf), label), labels=[label])
        return redact.with_flags(out).select("doc_id", "redacted", "token_count")

    return run


SUBSET_LABELS = (
    "USER_EMAIL", "NETWORK_IP", "NETWORK_IP_V6", "SENSITIVE_SECRET", "PAYMENT_CARD",
    "PHONE_NUMBER",
)
for _label in SUBSET_LABELS:
    QUERIES[f"rule_subset_{_label.lower()}"] = _subset(_label)
for _label in src.KEYS:
    _free = "planted" if _label in SUBSET_LABELS else "subset"
    QUERIES[f"rule_{_free}_{_label.lower()}"] = _planted(_label)


@query()
def rules_planted(spark: SparkSession, sf: str) -> DataFrame:
    """All rules over documents of which each holds a key of one kind, by its number."""
    out = redact.redact_text(src.with_any_key(src.documents(spark, sf)))
    return redact.with_flags(out).select("doc_id", "redacted", "token_count")


# Vault


def _request_findings(spark: SparkSession, sf: str) -> DataFrame:
    return redact.explode_findings(
        src.request_findings(spark, sf), ["request_id", "ts", "source", "lang", "event_type"]
    )


def _saves(spark: SparkSession, sf: str) -> DataFrame:
    return vault.vault_build(_request_findings(spark, sf), "ts", "request_id")


def _vault(spark: SparkSession, sf: str) -> DataFrame:
    return vault.vault_upsert(_saves(spark, sf))


@query()
def vault_build(spark: SparkSession, sf: str) -> DataFrame:
    return _saves(spark, sf).select(
        "token", "label", "value", "request_id", "ord", micros("saved_at")
    )


@query()
def vault_upsert(spark: SparkSession, sf: str) -> DataFrame:
    return _vault(spark, sf).select("token", "label", "value", micros("saved_at"))


@query()
def vault_prune(spark: SparkSession, sf: str) -> DataFrame:
    kept = vault.vault_prune(stage(_vault(spark, sf), "vault"), PRUNE_TTL_SECONDS)
    return kept.select("token", "value", micros("saved_at"))


@query()
def vault_get(spark: SparkSession, sf: str) -> DataFrame:
    pages = redact.redact_text(src.spread(src.table(spark, sf, "pages")), "html")
    keys = redact.explode_findings(pages, ["page_id"]).select("token").distinct()
    return vault.vault_get(keys, _vault(spark, sf)).select("token", "value")


@query()
def vault_size(spark: SparkSession, sf: str) -> DataFrame:
    saved = stage(_vault(spark, sf), "vault")
    return vault.vault_size(vault.vault_prune(saved, PRUNE_TTL_SECONDS))


@query()
def vault_clear(spark: SparkSession, sf: str) -> DataFrame:
    """Sessions are source and language; one with a sign-up event has ended."""
    session = F.concat_ws("-", "source", "lang").alias("session")
    saves = _request_findings(spark, sf).select("request_id", "ord", "token", session)
    ended = src.timed_documents(spark, sf).filter("event_type = 'signup'").select(session)
    return vault.vault_clear(saves, ended, "session").select(
        "request_id", "ord", "token", "session"
    )


@query()
def vault_asof(spark: SparkSession, sf: str) -> DataFrame:
    found = stage(_saves(spark, sf), "saves")
    at = F.col("saved_at") + F.make_dt_interval(hours=F.lit(ASOF_DELAY_HOURS))
    lookups = found.select("request_id", "ord", "token", at.alias("at"))
    return vault.vault_asof(found, lookups, "at").select(
        "request_id", "ord", "token", micros("at"), "value"
    )


@query()
def vault_collisions(spark: SparkSession, sf: str) -> DataFrame:
    return vault.vault_collisions(_saves(spark, sf)).select("token", "n_values")


@query()
def vault_collisions_narrow(spark: SparkSession, sf: str) -> DataFrame:
    """The same audit at two hex digits, where collisions do occur."""
    out = redact.redact_text(src.timed_documents(spark, sf), width=2)
    found = redact.explode_findings(out, ["request_id", "ts"])
    return vault.vault_collisions(vault.vault_build(found, "ts", "request_id")).select(
        "token", "n_values"
    )


# Rehydration


def _staged(spark: SparkSession, sf: str, *more: str) -> tuple[DataFrame, DataFrame]:
    """The redacted requests, staged, and the vault read from the same stage."""
    columns = ["request_id", "ts", "redacted", "findings", *more]
    staged = stage(src.request_findings(spark, sf).select(*columns), "redacted")
    found = redact.explode_findings(staged, ["request_id", "ts"])
    return staged, vault.vault_upsert(vault.vault_build(found, "ts", "request_id"))


@query()
def rehydrate_text(spark: SparkSession, sf: str) -> DataFrame:
    staged, saved = _staged(spark, sf)
    texts = staged.select("request_id", F.col("redacted").alias("restored"))
    return rehydrate.rehydrate(texts, ["request_id"], ["restored"], saved)


@query()
def rehydrate_unknown(spark: SparkSession, sf: str) -> DataFrame:
    staged, saved = _staged(spark, sf)
    texts = staged.select("request_id", F.col("redacted").alias("restored"))
    known = saved.filter("label <> 'USER_EMAIL'")
    return rehydrate.rehydrate(texts, ["request_id"], ["restored"], known)


@query()
def rehydrate_custom(spark: SparkSession, sf: str) -> DataFrame:
    docs = src.documents(spark, sf)
    names = docs.select("source").distinct().select(
        F.concat(F.lit("["), "source", F.lit("]")).alias("token"),
        F.concat(F.lit("Source $1 "), "source").alias("value"),
    )
    texts = docs.select(
        "doc_id",
        F.concat(F.lit("from ["), "source", F.lit("] and [x] "), "text").alias("restored"),
    )
    return rehydrate.rehydrate(texts, ["doc_id"], ["restored"], names, CUSTOM_TOKEN_PATTERN)


@query()
def rehydrate_literal(spark: SparkSession, sf: str) -> DataFrame:
    """Keys without brackets: ``TOKEN_<source>``, of which some hold others, and whose values
    hold later and earlier keys or make one with what follows."""
    docs = src.table(spark, sf, "documents")  # the operator spreads what it scans
    sources = docs.filter("source IS NOT NULL").select("source").distinct()
    key, n = F.concat(F.lit("TOKEN_"), "source"), F.ascii(F.right("source", F.lit(1)))
    value = (
        F.when(n % 3 == 0, F.concat(F.lit("<$1 "), key, F.lit("0>")))
        .when(n % 3 == 1, F.concat(F.lit("TOKEN_src"), (n % 7).cast("string")))
        .otherwise(F.lit("TOKEN"))
    )
    names = sources.select(key.alias("token"), value.alias("value"), F.concat("source", F.lit("a")).alias("at")).unionByName(
        sources.select(F.concat(key, F.lit("0")).alias("token"), F.lit("zero").alias("value"), F.concat("source", F.lit("b")).alias("at")))
    names = names.groupBy("token").agg(F.max_by("value", "at").alias("value"), F.max("at").alias("at"))
    text = F.concat(key, F.lit("0 and "), key, F.lit("_"), "source", F.lit(" "), "text")
    return rehydrate.rehydrate_literal(docs.select("doc_id", text.alias("restored")), ["doc_id"], "restored", names, "at")


@query()
def rehydrate_nested(spark: SparkSession, sf: str) -> DataFrame:
    staged, saved = _staged(spark, sf, "source")
    record = F.struct(
        F.col("redacted").alias("log"),
        F.array(F.struct(F.col("redacted").alias("text"), "source")).alias("parts"),
    )
    out = rehydrate.rehydrate(
        staged.select("request_id", record.alias("rec")), ["request_id"], ["rec"], saved
    )
    return out.select(
        "request_id", "rec.log",
        F.col("rec.parts")[0]["text"].alias("text"),
        F.col("rec.parts")[0]["source"].alias("source"),
    )


@query()
def round_trip(spark: SparkSession, sf: str) -> DataFrame:
    staged, saved = _staged(spark, sf, "text")
    texts = staged.select("request_id", "text", F.col("redacted").alias("restored"))
    restored = rehydrate.rehydrate(texts, ["request_id"], ["restored"], saved)
    return restored.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col("restored") != F.col("text")).alias("n_lost"),
    )


@query()
def rehydrate_nested_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """Every document inside a key block: one pass leaves inner tokens, two restore all."""
    block = F.concat(
        F.lit("-----BEGIN PRIVATE KEY-----\n"), F.rpad(F.col("text"), 64, " "), "text",
        F.lit("\n-----END PRIVATE KEY-----"),
    )
    df = src.documents(spark, sf).select("doc_id", block.alias("text"))
    staged = stage(redact.redact_text(df).drop("text"), "blocks")
    found = redact.explode_findings(staged, ["doc_id"])
    saved = stage(vault.vault_upsert(
        vault.vault_build(found, F.timestamp_seconds(F.lit(0)), "doc_id")
    ), "vault")
    texts = staged.select(
        "doc_id", F.col("redacted").alias("one_pass"), F.col("redacted").alias("two_passes")
    )
    once = rehydrate.rehydrate(texts.drop("two_passes"), ["doc_id"], ["one_pass"], saved)
    full = rehydrate.rehydrate(
        texts.drop("one_pass"), ["doc_id"], ["two_passes"], saved, fixpoint=True
    )
    return once.join(full, "doc_id")


@query()
def rehydrate_responses(spark: SparkSession, sf: str) -> DataFrame:
    staged, saved = _staged(spark, sf)
    return reqs.rehydrate_responses(src.echo_responses(staged), saved)


# Tool events


@query()
def event_route(spark: SparkSession, sf: str) -> DataFrame:
    return events.parse_events(src.tool_events(spark, sf)).select("event_id", "handler")


@query()
def payload_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Payloads from a text file, one per line (a blank one of two lines is two), by what becomes
    of them."""
    folder = stage_path(spark, "payloads")
    src.tool_events(spark, sf).select("raw").write.text(folder)
    lines = events.event_status(read_payloads(spark, folder))
    routed = events.parse_events(lines.select("raw")).select("handler", F.lit("ok").alias("status"))
    others = lines.filter("status <> 'ok'").select(F.lit(None).cast("string").alias("handler"), "status")
    return routed.unionByName(others).groupBy("status", "handler").agg(F.count("*").alias("n"))


@query()
def event_text(spark: SparkSession, sf: str) -> DataFrame:
    return events.parse_events(src.tool_events(spark, sf)).select("event_id", "event_text")


@query()
def event_changed_only(spark: SparkSession, sf: str) -> DataFrame:
    return events.event_responses(src.tool_events(spark, sf)).select(
        "event_id", "handler", "response"
    )


def _handler(name: str) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        out = events.event_responses(
            src.tool_events(spark, sf), changed_only=False, handlers=(name,)
        )
        return out.select("event_id", "response")

    return run


HANDLERS = (
    "pre_claude", "pre_gemini", "post_mcp", "post_builtin", "after_mcp", "after_builtin",
)
for _name in HANDLERS:
    QUERIES[f"event_{_name}"] = _handler(_name)


@query()
def event_quarantine(spark: SparkSession, sf: str) -> DataFrame:
    return events.event_status(src.tool_events(spark, sf)).select("event_id", "status")


@query()
def event_odd_payloads(spark: SparkSession, sf: str) -> DataFrame:
    """Payloads with repeated keys and deep nesting, routed and answered."""
    out = events.event_responses(src.odd_events(spark, sf), changed_only=False)
    return out.select("event_id", "handler", "response")


@query()
def event_plugin_after(spark: SparkSession, sf: str) -> DataFrame:
    def block(kind: str, text: str) -> Column:
        return F.struct(F.lit(kind).alias("type"), F.col(text).alias("text"))

    df = src.documents(spark, sf).select(
        "doc_id", F.col("text").alias("output"),
        F.array(block("text", "text"), block("image", "text")).alias("content"),
    )
    return events.plugin_after(df).select(
        "doc_id", "output",
        F.col("content")[0]["text"].alias("first"), F.col("content")[1]["text"].alias("second"),
    )


@query()
def event_plugin_before(spark: SparkSession, sf: str) -> DataFrame:
    """Tool calls whose arguments carry the document of the same id."""
    calls = src.tool_calls(spark, sf)
    docs = src.documents(spark, sf).select("doc_id", "text")
    args = F.create_map(
        F.lit("filePath"), "file_path", F.lit("command"), "command", F.lit("text"), "text"
    )
    df = calls.join(docs, calls.event_id == docs.doc_id, "left").select(
        "event_id", "tool", args.alias("args")
    )
    return events.plugin_before(df).select(
        "event_id", "tool", "blocked_reason", F.col("args")["text"].alias("text"), "has_redacted"
    )


# Access audit


@query()
def sensitive_path(spark: SparkSession, sf: str) -> DataFrame:
    pages = src.table(spark, sf, "pages").select(
        F.concat(F.lit("p"), "page_id").alias("id"), F.col("url").alias("path")
    )
    files = src.tool_calls(spark, sf).select(
        F.concat(F.lit("e"), "event_id").alias("id"), F.col("file_path").alias("path")
    )
    return files.unionByName(pages).select(
        "id", "path", access.sensitive_path("path").alias("sensitive")
    )


@query()
def sensitive_command(spark: SparkSession, sf: str) -> DataFrame:
    calls = src.tool_calls(spark, sf).withColumn(
        "command", F.concat_ws(" ", "command", "file_path")
    )
    return calls.select(
        "event_id", "command", access.sensitive_command("command").alias("sensitive")
    )


@query()
def access_decision(spark: SparkSession, sf: str) -> DataFrame:
    return access.access_decision(src.tool_calls(spark, sf)).select(
        "event_id", "tool", "blocked_reason"
    )


@query()
def access_split(spark: SparkSession, sf: str) -> DataFrame:
    allowed, blocked = access.access_split(src.tool_calls(spark, sf))
    return allowed.select("event_id", F.lit("allowed").alias("side")).unionByName(
        blocked.select("event_id", F.lit("blocked").alias("side"))
    )


# Metrics


@query()
def pii_by_type(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.pii_by_type(src.request_findings(spark, sf))


@query()
def pii_by_label(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.pii_by_label(src.request_findings(spark, sf))


@query()
def request_token_count(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.request_token_count(src.request_findings(spark, sf))


@query()
def pii_totals(spark: SparkSession, sf: str) -> DataFrame:
    redacted = src.request_findings(spark, sf).select("request_id", "redacted", "findings")
    staged = stage(redacted, "totals")
    leaks = metrics.leak_audit(staged, ["request_id"])
    return metrics.pii_totals(
        src.events(spark, sf), staged, leaks, ["ts", "event_id"], "value"
    )


@query()
def latency_last50(spark: SparkSession, sf: str) -> DataFrame:
    out = metrics.latency_last(src.events(spark, sf), ["ts", "event_id"], "value")
    return out.select("event_id", "duration_ms")


@query()
def latency_rolling(spark: SparkSession, sf: str) -> DataFrame:
    out = metrics.latency_rolling(src.events(spark, sf), ["ts", "event_id"], "value", width=4096)
    return out.select("event_id", "duration_ms", "mean_ms")


@query()
def vault_gauge(spark: SparkSession, sf: str) -> DataFrame:
    by_type = metrics.pii_by_type(src.request_findings(spark, sf))
    totals = by_type.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("redacted_count"))
    return metrics.vault_gauge(totals)


@query()
def pii_by_source(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.pii_by_source(_request_findings(spark, sf))


def _repeated(spark: SparkSession, sf: str) -> DataFrame:
    """Redacted text with leaks: every fifth document names a secret of its source and repeats
    it bare, every seventh one holds the same secret inside a longer word."""
    secret = F.substr(F.sha2("source", 256), F.lit(1), F.lit(20))
    text = F.concat(
        "text",
        F.when(F.expr("doc_id % 5 = 0"), F.concat(F.lit("\napi_key="), secret, F.lit(" or "), secret))
        .otherwise(""),
        F.when(F.expr("doc_id % 7 = 1"), F.concat(F.lit("\nx"), secret, F.lit("y"))).otherwise(""),
    )
    return redact.redact_text(src.documents(spark, sf).select("doc_id", text.alias("text")))


@query()
def leak_audit(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.leak_audit(_repeated(spark, sf), ["doc_id"])


@query()
def leak_audit_vault(spark: SparkSession, sf: str) -> DataFrame:
    staged = stage(_repeated(spark, sf).select("doc_id", "redacted", "findings"), "repeated")
    found = redact.explode_findings(staged, ["doc_id"])
    return metrics.vault_leak_audit(staged, ["doc_id"], "redacted", found)


# Logs and requests


@query()
def log_mask(spark: SparkSession, sf: str) -> DataFrame:
    return _masked_logs(src.log_records(spark, sf))


def _masked_logs(records: DataFrame) -> DataFrame:
    return logs.log_mask(records).select(
        "event_id", "token", "apiKey", "Password", F.col("ctx.password").alias("ctx_password"),
        F.col("ctx.user").alias("ctx_user"), F.col("ctx.deep.secret").alias("deep_secret"),
        F.col("extra")["idToken"].alias("extra_id_token"),
        F.col("extra")["path"].alias("extra_path"),
    )


@query()
def log_files(spark: SparkSession, sf: str) -> DataFrame:
    """Log records from a file of JSON lines, masked."""
    records, folder = src.log_records(spark, sf), stage_path(spark, "logs")
    records.write.json(folder)
    return _masked_logs(read_logs(spark, folder, records.schema))


@query()
def log_mask_json(spark: SparkSession, sf: str) -> DataFrame:
    return logs.log_mask_json(src.json_logs(spark, sf), "record")


@query()
def log_severity(spark: SparkSession, sf: str) -> DataFrame:
    return src.log_records(spark, sf).select(
        "event_id", "level", logs.log_severity("level").alias("severity")
    )


@query()
def route_classify(spark: SparkSession, sf: str) -> DataFrame:
    return reqs.route_classify(src.requests(spark, sf)).select(
        "request_id", "method", "path", "provider", "target"
    )


@query()
def body_methods(spark: SparkSession, sf: str) -> DataFrame:
    out = reqs.body_methods(src.requests(spark, sf))
    return out.select("request_id", "forwarded", token_count("findings").alias("token_count"))


@query()
def missing_auth(spark: SparkSession, sf: str) -> DataFrame:
    return src.requests(spark, sf).select("request_id", reqs.missing_auth().alias("missing"))


@query()
def stream_mode(spark: SparkSession, sf: str) -> DataFrame:
    return src.requests(spark, sf).select("request_id", reqs.stream_mode().alias("streamed"))


@query()
def exchange_join(spark: SparkSession, sf: str) -> DataFrame:
    replies = src.echo_responses(src.request_findings(spark, sf))
    return reqs.exchange_join(src.requests(spark, sf), replies)


# Streams


def _in_order(texts: DataFrame, cut: Callable[[DataFrame], DataFrame], name: str) -> DataFrame:
    """Stage the chunks that ``cut`` makes of texts with each stream in one file, in order, as a
    source would: the texts are dealt, not their chunks.  There are two files per core, so the
    number of micro-batches does not grow with the input."""
    files = 2 * texts.sparkSession.sparkContext.defaultParallelism
    return stage(cut(texts.repartition(files, "request_id").sortWithinPartitions("request_id")), name)


def _stream_of(staged: DataFrame, files_per_trigger: int | None = None) -> DataFrame:
    folder = staged.inputFiles()[0].rsplit("/", 1)[0]
    return read_stream(staged.sparkSession, folder, staged.schema, files_per_trigger)


@query()
def rehydrate_chunks_raw(spark: SparkSession, sf: str) -> DataFrame:
    staged, saved = _staged(spark, sf)
    return chunks.rehydrate_chunks(src.delta_chunks(staged), stage(saved, "vault"))


def _in_waves(df: DataFrame) -> DataFrame:
    """A folder of chunks as they would arrive: ``WAVE`` chunks of every stream, then the next
    ones, and the rest in the last of ``WAVES`` micro-batches of ``WAVE_FILES`` files."""
    spark, folder = df.sparkSession, stage_path(df.sparkSession, "waves")
    wave = F.least(F.floor(F.col("seq") / WAVE), F.lit(WAVES - 1))
    chunked = stage(df, "chunks")
    for n in range(WAVES):
        chunked.filter(wave == n).repartition(WAVE_FILES).write.mode("append").parquet(folder)
    return read_stream(spark, folder, df.schema, WAVE_FILES)


@query()
def rehydrate_chunks_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The same through Structured Streaming; every stream crosses several micro-batches."""
    staged, saved = _staged(spark, sf)
    known = stage(saved, "vault")
    stream = _in_waves(src.delta_chunks(staged))
    out = drain(
        lambda path, ckpt: jobs.stream_chunks(stream, lambda: known, path, ckpt), spark, "raw"
    )
    return spark.read.parquet(out).select("stream_id", "seq", "emitted")


def _birth(token: str) -> Column:
    """The wave with which a token is saved, from the first digit of its hash."""
    return (F.instr(F.lit("0123456789abcdef"), F.substr(token, F.lit(-7), F.lit(1))) - 1) % WAVES


class _ByBatch(VaultStore):
    """Micro-batch ``n`` sees version ``n``."""

    def pin(self, batch: int) -> int:
        return min(batch, WAVES - 1)


@query()
def rehydrate_chunks_growing(spark: SparkSession, sf: str) -> DataFrame:
    """Chunk streams while the vault grows: a quarter of the tokens is saved with each wave, so
    many are saved after their beginning was shown, or between their halves."""
    staged = stage(src.request_findings(spark, sf).select("request_id", "ts", "redacted", "findings"), "redacted")
    found = redact.explode_findings(staged, ["request_id", "ts"])
    saves = stage(vault.vault_build(found, "ts", "request_id"), "saves")
    store = _ByBatch(spark, stage_path(spark, "store"), rows_per_bucket=ROWS_PER_BUCKET)
    for n in range(WAVES):
        store.append(saves.filter(_birth("token") == n))
    stream = _in_waves(src.delta_chunks(staged))
    out = drain(lambda path, ckpt: jobs.stream_chunks(stream, store, path, ckpt), spark, "growing")
    return spark.read.parquet(out).select("stream_id", "seq", "emitted")


@query()
def vault_store(spark: SparkSession, sf: str) -> DataFrame:
    """The vault through the store: saves arrive by the hour of their request, an append for
    each of four parts of the day."""
    saves = stage(_saves(spark, sf), "saves")
    store = VaultStore(spark, stage_path(spark, "store"), ROWS_PER_BUCKET)
    for part in range(4):
        store.append(saves.filter(F.floor(F.hour("saved_at") / 6) == part), tag=f"part {part}")
    return store.read().select("token", "label", "value", micros("saved_at"))


@query()
def vault_store_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """The tokens of the pages, looked up in the buckets that can hold them."""
    store = VaultStore(spark, stage_path(spark, "store"), ROWS_PER_BUCKET)
    store.append(_saves(spark, sf))
    pages = redact.redact_text(src.spread(src.table(spark, sf, "pages")), "html")
    keys = stage(redact.explode_findings(pages, ["page_id"]).select("token").distinct(), "keys")
    return vault.vault_get(keys, store.read(tokens=keys)).select("token", "value")


@query()
def rehydrate_sse(spark: SparkSession, sf: str) -> DataFrame:
    staged, saved = _staged(spark, sf)
    known = stage(saved, "vault")
    stream = _stream_of(_in_order(staged.select("request_id", "redacted"), src.sse_wire, "wire"), 4)
    out = drain(
        lambda path, ckpt: jobs.stream_sse(stream, lambda: known, path, ckpt), spark, "sse"
    )
    return spark.read.parquet(out).select("stream_id", "seq", "emitted")


@query()
def sse_parse(spark: SparkSession, sf: str) -> DataFrame:
    lines = src.sse_lines(src.request_findings(spark, sf, LINE_TASKS))
    return chunks.sse_parse(lines).select(
        "stream_id", "seq", "kind", "content", "text", "reasoning_content"
    )


@query()
def sse_delta_text(spark: SparkSession, sf: str) -> DataFrame:
    staged, saved = _staged(spark, sf)
    return chunks.sse_delta_text(src.sse_lines(staged), stage(saved, "vault"))


@query()
def stream_redact(spark: SparkSession, sf: str) -> DataFrame:
    path = f"{sf}/documents*.parquet"  # a stream source wants a folder or a pattern
    # One file in one row group: spread it, as ``spread`` does for a batch.
    stream = read_stream(spark, path, spark.read.parquet(path).schema).repartition(
        spark.sparkContext.defaultParallelism
    )
    out = drain(
        lambda table, ckpt: append_to_table(jobs.stream_redact(stream), table, ckpt),
        spark, "redacted",
    )
    return redact.with_flags(spark.read.parquet(out)).select("doc_id", "redacted", "token_count")


@query()
def stream_vault(spark: SparkSession, sf: str) -> DataFrame:
    arriving = stage(src.timed_documents(spark, sf), "arriving")
    stream = _stream_of(arriving, 4)
    out = drain(
        lambda table, ckpt: jobs.stream_vault(stream, table, ckpt), spark, "vault-log"
    )
    saved = jobs.read_vault(spark, out, PRUNE_TTL_SECONDS)
    return saved.select("token", "label", "value", micros("saved_at"))


@query()
def stream_counters(spark: SparkSession, sf: str) -> DataFrame:
    arriving = stage(src.timed_documents(spark, sf), "arriving")
    counted = jobs.stream_counters(_stream_of(arriving))
    out = drain(
        lambda table, ckpt: batches_to_table(counted, table, ckpt, output_mode="update"),
        spark, "counters",
    )
    return jobs.read_counters(spark, out).select(micros("window_start"), "type", "n")
