"""Streaming forms of redaction, the vault, the counters and chunk rehydration.

Redaction is stateless and shares its expression with the batch form.  Whatever needs the
vault happens inside a micro-batch as a join with the vault table, so no state and no task
holds a copy of the vault; state is limited to the short tail of each open stream, in a
table of its own for chunk streams (``held``) and in Spark's state store for event streams.
"""

from __future__ import annotations

import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupStateTimeout

from veilframe.functions.tokens import CUSTOM_TOKEN_PATTERN, tokens_in_sql, type_of
from veilframe.operators.chunks import known_to, longest_token
from veilframe.operators.redact import explode_findings, redact_text
from veilframe.operators.rehydrate import attach_values, replace_tokens_sql
from veilframe.operators.vault import SAVE_COLUMNS, vault_build, vault_prune, vault_upsert
from veilframe.sources.stage import stage
from veilframe.sources.vault_store import VaultStore
from veilframe.streaming import held
from veilframe.streaming.sinks import batches_to_table
from veilframe.streaming.sse import FRAME_STATE, SHOWN_SCHEMA, bucket_of, frame_events

VaultReader = Callable[[], DataFrame]


# Redaction and the vault


def stream_redact(stream: DataFrame, column: str = "text") -> DataFrame:
    """Redact each arriving row; the same projection as in batch."""
    return redact_text(stream, column)


def stream_vault(
    stream: DataFrame,
    path: str,
    checkpoint: str,
    column: str = "text",
    saved_at: str = "ts",
    request_id: str = "request_id",
) -> StreamingQuery:
    """Keep a vault log up to date: one partition of saves per micro-batch.

    Each batch is combined to one save per token before it is written.  Readers use
    ``read_vault``; nothing is kept in state, whatever the number of tokens.
    """

    def saves(batch: DataFrame) -> DataFrame:
        found = explode_findings(redact_text(batch, column), [request_id, saved_at])
        last = vault_build(found, saved_at, request_id)
        order = F.struct("saved_at", "request_id", "ord")
        return (
            last.groupBy("token")
            .agg(F.max_by(F.struct(*SAVE_COLUMNS), order).alias("_last"))
            .select("_last.*")
        )

    return batches_to_table(stream, path, checkpoint, saves)


def read_vault(spark: SparkSession, path: str, ttl_seconds: int | None = None) -> DataFrame:
    """The vault a ``stream_vault`` log stands for.

    With ``ttl_seconds`` the tokens that had expired at the last save of the log are gone.
    Saves that are too old are left out before they are combined: the last save of a token
    that lives is never among them.
    """
    log = spark.read.parquet(path).select(*SAVE_COLUMNS)
    return vault_upsert(log if ttl_seconds is None else vault_prune(log, ttl_seconds))


def compact_vault(
    spark: SparkSession, path: str, out: str, ttl_seconds: int | None = None
) -> None:
    """Write the log at ``path`` to a new folder with one live save per token.

    Run it between streams, then start the next one on the new folder; the rows are the batch -1.
    """
    log = spark.read.parquet(path).select(*SAVE_COLUMNS)
    live = log if ttl_seconds is None else vault_prune(log, ttl_seconds)
    order = F.struct("saved_at", "request_id", "ord")
    last = live.groupBy("token").agg(F.max_by(F.struct(*SAVE_COLUMNS), order).alias("_last"))
    last.select("_last.*").withColumn("batch", F.lit(-1)).write.partitionBy("batch").parquet(out)


# Live counters


def stream_counters(
    stream: DataFrame,
    column: str = "text",
    ts: str = "ts",
    width: str = "1 hour",
    slide: str | None = None,
    session_gap: str | None = None,
    lateness: str = "1 hour",
) -> DataFrame:
    """Redactions per type and time window, as they arrive.

    Windows are over the request time: tumbling, sliding with ``slide``, or sessions that
    end after ``session_gap``.  Rows later than ``lateness`` are left out and their state is
    dropped.  A token counts once per request.
    (Session windows need the append output mode.)
    """
    tokens = redact_text(stream.withWatermark(ts, lateness), column).select(
        ts, F.explode(F.array_distinct(F.col("findings.token"))).alias("token")
    )
    if session_gap:
        span = F.session_window(ts, session_gap)
    else:
        span = F.window(ts, width, slide) if slide else F.window(ts, width)
    return tokens.groupBy(span.alias("window"), type_of(F.col("token")).alias("type")).agg(
        F.count(F.lit(1)).alias("n")
    )


def read_counters(spark: SparkSession, path: str) -> DataFrame:
    """The latest count of each window from a table of updates."""
    return (
        spark.read.parquet(path)
        .groupBy("window", "type")
        .agg(F.max_by("n", "batch").alias("n"))
        .select(F.col("window.start").alias("window_start"), "type", "n")
    )


# Chunk streams


def stream_chunks(
    stream: DataFrame,
    vault: VaultReader | VaultStore,
    path: str,
    checkpoint: str,
    idle_seconds: float | None = None,
    flush: bool = False,
) -> StreamingQuery:
    """Rehydrate chunks as they arrive (``stream_id, seq, emitted``).

    Chunks of a stream must arrive in order across micro-batches; within one they are
    sorted.  See ``held``: what was held back is kept as it was, so the vault may grow at any
    time.  With a ``VaultStore``, a micro-batch that is run again reads the version it read
    first and gives the same rows.  Streams without a chunk for ``idle_seconds`` end with the
    next micro-batch; their held text is dropped, or with ``flush`` shown as one more chunk.
    """
    step = held.micro_batch(vault, f"{checkpoint.rstrip('/')}/veilframe", idle_seconds, flush)
    return batches_to_table(stream, path, checkpoint, step)


def stream_sse(
    stream: DataFrame,
    vault: VaultReader,
    path: str,
    checkpoint: str,
    longest: int | None = None,
    idle_seconds: float | None = None,
) -> StreamingQuery:
    """Rehydrate event streams as they arrive (``stream_id, seq, emitted``).

    The vault is read for each micro-batch.  What is held is shorter than ``longest``: by
    default the longest token at the start, and without bound if the vault is empty then.
    Give it where a vault that holds tokens may still get longer ones.  The state of a stream
    without a chunk for ``idle_seconds`` is dropped, with what it held.
    """
    if longest is None:
        longest = longest_token(vault()) or sys.maxsize
    chunks = stream.select("stream_id", "seq", "chunk", bucket_of("stream_id").alias("bucket"))
    framed = chunks.groupBy("bucket").applyInPandasWithState(
        frame_events(longest, idle_seconds), SHOWN_SCHEMA, FRAME_STATE, "append",
        GroupStateTimeout.NoTimeout if idle_seconds is None else GroupStateTimeout.ProcessingTimeTimeout,
    )
    return batches_to_table(framed, path, checkpoint, lambda b: emit_frames(b, vault()))


def emit_frames(frames: DataFrame, vault: DataFrame) -> DataFrame:
    """Fill the live parts of framed events from the vault and join the parts.

    ``was`` and ``hold`` are possible token starts before and at the end of plain text; they
    wait only if a token of the vault begins so.  ``rest`` is fixed text after the pieces, if the
    frames have it.  The frames are staged, as several branches read them and the state function
    is to run once; those that ask for nothing join nothing.
    """
    if "rest" not in frames.columns:
        frames = frames.withColumn("rest", F.lit(""))
    pattern = CUSTOM_TOKEN_PATTERN
    in_events = tokens_in_sql("p.live", pattern)
    in_raw = tokens_in_sql("concat(was, raw)", pattern)
    tokens = (
        f"concat(coalesce(flatten(transform(pieces, p -> {in_events})), array()), {in_raw},"
        " filter(array(was, hold), x -> x <> ''))"
    )
    asks = f"CASE WHEN pieces IS NULL AND concat(was, raw, hold) = '' THEN array() ELSE coalesce({tokens}, array()) END"
    frames = stage(frames.withColumn("_asked", F.expr(asks)), "frames")
    plain = replace_tokens_sql("p.live", "_values", pattern)
    quoted = replace_tokens_sql("p.live", "_values", pattern, json=True)
    known = "if(_values IS NOT NULL AND map_contains_key(_values, {0}), {0}, '')"
    text = f"concat({known.format('was')}, raw)"
    shown = f"substr({text}, 1, length({text}) - length({known.format('hold')}))"
    filled = f"""
        concat(
            CASE WHEN _values IS NULL THEN raw
                ELSE {replace_tokens_sql(shown, "_values", pattern)} END,
            coalesce(array_join(transform(pieces, p -> concat(p.fixed, CASE
                WHEN _values IS NULL THEN p.live WHEN p.json THEN {quoted} ELSE {plain} END)), ''), ''), rest)"""
    as_it_is = "concat(raw, coalesce(array_join(transform(pieces, p -> concat(p.fixed, p.live)), ''), ''), rest)"
    asked = frames.select(F.expr("explode(array(nullif(was, ''), nullif(hold, '')))").alias("prefix"))
    dirty = attach_values(frames.filter("size(_asked) > 0"), ["stream_id", "seq"], "_asked", known_to(vault, asked))
    return dirty.select("stream_id", "seq", F.expr(filled).alias("emitted")).unionByName(
        frames.filter("size(_asked) = 0").select("stream_id", "seq", F.expr(as_it_is).alias("emitted"))
    )
