"""Chunk rehydration by micro-batch, with a state that is a table.

What a stream holds back after a micro-batch is a row of the table ``held``: the text itself,
as it was held and not yet shown.  The next micro-batch puts it before the stream's first
chunk and decides on its own chunks as the batch form does, block by block, so a stream with
most chunks of a micro-batch spreads over tasks.  Nothing that was shown is ever asked for
again: a token that the vault learns between its two halves stays as it was shown, and one
that it forgets is shown as it was held.

    held/batch=<n>   stream_id, seq, text, at     after micro-batch n, streams that hold text
    pins/batch=<n>   version, at                  the vault and the time that micro-batch n saw

Both are written per micro-batch and overwritten if it is run again; the pin is written first
and read by the second run, which therefore sees the same vault and the same clock.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.operators.chunks import decide, last_spoken, longest_token, questions, with_tails
from veilframe.sources.stage import stage
from veilframe.sources.vault_store import VaultStore

HELD_SCHEMA = "stream_id long, seq long, text string, at long"
PIN_SCHEMA = "version int, at long"


def read_if_there(spark: SparkSession, schema: str, path: str) -> DataFrame:
    """A table, or an empty one where nothing has been written."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def pinned(spark: SparkSession, folder: str, epoch: int, version: int | None) -> tuple[int | None, int]:
    """The vault version and the time in microseconds of a micro-batch, fixed by its first run."""
    path = f"{folder}/pins/batch={epoch}"
    found = read_if_there(spark, PIN_SCHEMA, path).collect()
    if not found:
        found = [(version, time.time_ns() // 1000)]
        spark.createDataFrame(found, PIN_SCHEMA).coalesce(1).write.mode("overwrite").parquet(path)
    return found[0][0], found[0][1]


def with_held(batch: DataFrame, before: DataFrame) -> DataFrame:
    """The chunks, the first one of each stream with the held text in front."""
    first = batch.groupBy("stream_id").agg(F.min("seq").alias("seq"))
    put = before.select("stream_id", "text").join(first, "stream_id")
    return batch.join(put, ["stream_id", "seq"], "left").select(
        "stream_id", "seq",
        F.when(F.col("text").isNull(), F.col("chunk"))
        .otherwise(F.concat("text", F.coalesce("chunk", F.lit("")))).alias("chunk"),
    )


def micro_batch(
    vault: Callable[[], DataFrame] | VaultStore, folder: str, idle_seconds: float | None, flush: bool
) -> Callable[[DataFrame, int], DataFrame]:
    """The step from chunks (``stream_id, seq, chunk``) to what they show."""

    def step(batch: DataFrame, epoch: int) -> DataFrame:
        spark = batch.sparkSession
        store = vault if isinstance(vault, VaultStore) else None
        version, now = pinned(spark, folder, epoch, store.pin(epoch) if store else None)
        known = store.read(version) if store else vault()
        longest = store.longest(version) if store else longest_token(known)
        before = read_if_there(spark, HELD_SCHEMA, f"{folder}/held/batch={epoch - 1}")

        chunks = stage(with_held(batch.select("stream_id", "seq", "chunk"), before), "arrived")
        tailed = with_tails(chunks, longest)
        shown = stage(decide(stage(questions(tailed), "questions"), known), "shown")

        ends = shown.join(last_spoken(chunks), "stream_id").filter("seq = _last AND rest <> ''")
        holding = ends.select("stream_id", "seq", F.col("rest").alias("text"), F.lit(now).alias("at"))
        quiet = before.join(batch.select("stream_id").distinct(), "stream_id", "left_anti")
        over = F.lit(False) if idle_seconds is None else F.col("at") < now - int(idle_seconds * 1_000_000)
        holding.unionByName(quiet.filter(~over)).write.mode("overwrite").parquet(f"{folder}/held/batch={epoch}")

        out = shown.drop("rest")
        if not flush:
            return out
        ended = quiet.filter(over).select("stream_id", (F.col("seq") + 1).alias("seq"), F.col("text").alias("emitted"))
        return out.unionByName(ended)

    return step
