"""Rehydration of ordered chunks, where a token may be cut between two of them.

The rule: after each chunk, hold back the longest end of the text that is the beginning of
a vault token, and emit the rest.  What is held back never reaches past the last ``[``, and
whether it is held depends only on the characters since that bracket.  So each chunk needs
no more than the short tail of text before it, every chunk can be decided on its own, and
one long stream spreads over as many tasks as it has blocks.

Input is ``stream_id, seq, chunk`` with ``seq`` the ordinal of a chunk in its stream.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.functions.ordered import preceding_tail
from veilframe.functions.tokens import CUSTOM_TOKEN_PATTERN, once_sql, sql_text, tokens_in_sql
from veilframe.operators.rehydrate import attach_values, rehydrate, replace_tokens_sql
from veilframe.sources.stage import stage

# An end that may be the beginning of a token; whether it is one, the vault decides.
PARTIAL = r"\[[^\[\]]*\z"
# Fixed value: what a held-back tail of a delta field looks like.
HELD_DELTA = r"\[(?:[A-Z_][^\[\]]*)?\z"

# The end of an event stream, and the text fields of a delta.
DONE_LINE = r"^data: \[DONE\]\s*\z"
DELTA_FIELDS = ("content", "text", "reasoning_content", "partial_json")

KEYS = ["stream_id", "seq"]


def longest_token(vault: DataFrame) -> int:
    """The length of the longest token of the vault, one number for the driver."""
    return vault.agg(F.coalesce(F.max(F.length("token")), F.lit(0))).first()[0]


def with_tails(chunks: DataFrame, longest: int, keys: list[str] | None = None) -> DataFrame:
    """Add ``tail``: as much of the stream before each chunk as a token can begin in."""
    placed = preceding_tail(chunks, keys or ["stream_id"], "seq", F.col("chunk"), max(longest - 1, 1), "tail")
    return placed.withColumn("tail", F.when(F.length("chunk") > 0, F.col("tail")).otherwise(""))


def token_prefixes(vault: DataFrame, asked: DataFrame) -> DataFrame:
    """The strings of ``asked`` (one column, ``prefix``) that a vault token begins with.

    Vault tokens give only prefixes of the lengths asked for, and these are made distinct on
    the map side, so the many tokens behind a short prefix never meet.
    """
    asked = asked.filter("prefix IS NOT NULL").distinct()
    lengths = asked.agg(F.collect_set(F.length("prefix"))).scalar()  # at most the longest token
    begins = (
        vault.withColumn("_lengths", lengths)
        .select(
            F.expr(
                "explode(transform(filter(_lengths, n -> n < length(token)),"
                " n -> substr(token, 1, n)))"
            ).alias("prefix")
        )
        .distinct()
    )
    return asked.join(begins, "prefix", "left_semi")


def known_to(vault: DataFrame, asked: DataFrame) -> DataFrame:
    """``token, value``: the vault, and with a null value the beginnings asked for."""
    return vault.select("token", "value").unionByName(
        token_prefixes(vault, asked).select(
            F.col("prefix").alias("token"), F.lit(None).cast("string").alias("value")
        )
    )


def _partial(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, PARTIAL, 0), F.lit(""))


def questions(chunks: DataFrame) -> DataFrame:
    """What each chunk with its ``tail`` has to ask the vault.

    ``_was`` and ``_now`` are the possible token starts at the end of the text before and
    with the chunk; ``_asked`` adds the tokens that the chunk may complete or hold.
    """
    work = chunks.select(
        *KEYS, "chunk",
        _partial(F.col("tail")).alias("_was"),
        _partial(F.concat("tail", "chunk")).alias("_now"),
    )
    tokens = tokens_in_sql("concat_ws('', _was, chunk)", CUSTOM_TOKEN_PATTERN)
    asked = f"concat(array_compact(array(_was, _now)), coalesce({tokens}, array()))"
    return work.withColumn("_asked", F.expr(once_sql(asked)))


def decide(work: DataFrame, vault: DataFrame) -> DataFrame:
    """``stream_id, seq, emitted, rest`` for chunks with their ``questions``: the text shown with
    each chunk, and what is held back after it."""
    # One lookup answers both: is this end a token's beginning, and what does a token mean.
    known = known_to(vault, work.select(F.expr("explode(array(_was, _now))").alias("prefix")))
    dirty = attach_values(work.filter("size(_asked) > 0"), KEYS, "_asked", known)
    was = "if(map_contains_key(_values, _was), _was, '')"
    now = "if(map_contains_key(_values, _now), _now, '')"
    text = f"concat(coalesce({was}, ''), chunk)"
    shown = f"substr({text}, 1, length({text}) - length(coalesce({now}, '')))"
    return dirty.select(
        *KEYS,
        F.expr(replace_tokens_sql(shown, "_values", CUSTOM_TOKEN_PATTERN)).alias("emitted"),
        F.expr(f"coalesce({now}, '')").alias("rest"),
    ).unionByName(
        work.filter("size(_asked) = 0").select(
            *KEYS, F.coalesce("chunk", F.lit("")).alias("emitted"), F.lit("").alias("rest")
        )
    )


def last_spoken(chunks: DataFrame) -> DataFrame:
    """``stream_id, _last``: the last chunk of each stream that holds text."""
    return chunks.filter(F.length("chunk") > 0).groupBy("stream_id").agg(F.max("seq").alias("_last"))


def emit_raw(work: DataFrame, vault: DataFrame, flush_at_end: bool = False) -> DataFrame:
    """``stream_id, seq, emitted`` for chunks with their ``questions``.

    The held-back end of a stream is never emitted, as in a stream that just stops;
    ``flush_at_end`` appends it to the last chunk (which then must be known, so only for
    complete streams).
    """
    decided = decide(work, vault)
    if not flush_at_end:
        return decided.drop("rest")
    return decided.join(last_spoken(work), "stream_id", "left").select(
        *KEYS,
        F.when(F.col("seq") == F.col("_last"), F.concat("emitted", "rest"))
        .otherwise(F.col("emitted"))
        .alias("emitted"),
    )


def rehydrate_chunks(
    chunks: DataFrame, vault: DataFrame, flush_at_end: bool = False
) -> DataFrame:
    """The text emitted for each chunk of complete streams.

    The questions are staged: several branches of what follows read them.  The tokens are
    those of the vault, whatever stands in their brackets and however long they are.
    """
    tailed = with_tails(chunks, longest_token(vault))
    return emit_raw(stage(questions(tailed), "questions"), vault, flush_at_end)


def cut_into_chunks(df: DataFrame, stream: str, text: str, size: int) -> DataFrame:
    """Text as a stream of chunks of ``size`` characters."""
    pattern = sql_text("(?s:.{1,%d})" % size)
    return df.select(
        F.col(stream).alias("stream_id"),
        F.expr(f"posexplode(regexp_extract_all({text}, {pattern}, 0))").alias("seq", "chunk"),
    ).withColumn("seq", F.col("seq").cast("bigint"))


# Server-sent events


def sse_parse(lines: DataFrame) -> DataFrame:
    """Classify event lines (``stream_id, seq, line``) and take the deltas apart.

    ``kind`` is ``plain`` (passes as it is), ``text`` (a data line that is not JSON),
    ``event`` (JSON without a delta) or ``delta``; ``content``, ``text``,
    ``reasoning_content`` and ``partial_json`` are the string fields of a delta.  A line is
    read as JSON once, also where a filter on ``kind`` follows.
    """
    done = f"startswith(line, 'data: [DONE]') AND line RLIKE {sql_text(DONE_LINE)}"
    data = f"startswith(line, 'data: ') AND NOT ({done})"
    json = once_sql(f"CASE WHEN {data} THEN try_parse_json(substr(line, 7)) END")
    # As a struct, a delta is null unless it is an object, and its fields are found in one look.
    shape = sql_text(f"struct<{', '.join(f'{n}: variant' for n in DELTA_FIELDS)}>")
    delta = f"coalesce(try_variant_get(_v, '$.choices[0].delta', {shape}), try_variant_get(_v, '$.delta', {shape}))"
    events = lines.select("stream_id", "seq", "line", F.expr(json).alias("_v"))
    events = events.select("stream_id", "seq", "line", F.isnull("_v").alias("_no_json"), F.expr(once_sql(delta)).alias("_d"))
    kind = (
        F.when(F.col("_d").isNotNull(), "delta")
        .when(~F.col("_no_json"), "event")
        .when(~F.expr(data), "plain")
        .otherwise("text")
    )

    def field(name: str) -> Column:
        return F.expr(
            f"CASE WHEN schema_of_variant(_d.{name}) = 'STRING' THEN try_variant_get(_d.{name}, '$', 'string') END"
        ).alias(name)

    return events.select("stream_id", "seq", "line", kind.alias("kind"), *[field(n) for n in DELTA_FIELDS])


def sse_delta_text(lines: DataFrame, vault: DataFrame) -> DataFrame:
    """What each delta shows to the client: ``stream_id, field, seq, emitted``.

    Tokens cut between events are put together per stream and field before they are
    replaced.  In order, the pieces of a field are its whole text, less a tail that could
    still become a token when the stream stops.
    """
    parsed = sse_parse(lines).filter("kind = 'delta'")
    fields = parsed.select(
        "stream_id", "seq",
        F.explode(
            F.filter(
                F.array(
                    F.struct(
                        F.when(F.col("content").isNotNull(), "content").otherwise("text")
                        .alias("field"),
                        F.coalesce("content", "text").alias("chunk"),
                    ),
                    *[
                        F.struct(F.lit(n).alias("field"), F.col(n).alias("chunk"))
                        for n in ("reasoning_content", "partial_json")
                    ],
                ),
                lambda x: x["chunk"].isNotNull(),
            )
        ).alias("_f"),
    ).select("stream_id", "seq", "_f.field", "_f.chunk")
    fields = stage(fields, "fields")
    longest = longest_token(vault)
    tailed = with_tails(fields, longest, ["stream_id", "field"])
    shown = stage(cut_deltas(tailed, longest), "deltas")
    return rehydrate(
        shown, ["stream_id", "field", "seq"], ["emitted"], vault, CUSTOM_TOKEN_PATTERN
    )


def held_delta(text: Column, longest: int) -> Column:
    """The end of a delta field that is held back: it may still become a token."""
    tail = F.regexp_extract(text, HELD_DELTA, 0)
    return F.when(F.length(tail) < longest, tail).otherwise("")


def cut_deltas(fields: DataFrame, longest: int) -> DataFrame:
    """What of each delta piece, given its ``tail``, is shown now: ``emitted``, not yet
    rehydrated.  What is held is shorter than the longest token, so it needs no cap.
    """
    was = held_delta(F.col("tail"), longest)
    now = held_delta(F.concat("tail", "chunk"), longest)
    text = F.concat(was, "chunk")
    return fields.select(
        "stream_id", "field", "seq",
        F.when(F.length("chunk") == 0, "")
        .otherwise(F.substr(text, F.lit(1), F.length(text) - F.length(now)))
        .alias("emitted"),
    )
