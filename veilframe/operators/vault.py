"""The token vault as a table: ``token, label, value, saved_at``.

A *save* is one finding with the time and place it was made: ``token, label, value,
saved_at, request_id, ord``.  The vault is the last save of every token.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.functions.ordered import latest_before, with_positions

DEFAULT_TTL_SECONDS = 3600

SAVE_COLUMNS = ["token", "label", "value", "saved_at", "request_id", "ord"]


def vault_build(findings: DataFrame, saved_at: Column | str, request_id: str) -> DataFrame:
    """Findings as saves."""
    at = F.col(saved_at) if isinstance(saved_at, str) else saved_at
    return findings.select(
        "token", "label", "value", at.alias("saved_at"),
        F.col(request_id).alias("request_id"), "ord",
    )


def vault_upsert(saves: DataFrame, on_collision: str = "last") -> DataFrame:
    """The vault after all saves: last write wins and refreshes the time.

    Two different values can share a token.  ``last`` keeps the newer one; ``error`` fails
    the job instead of losing a value.  The aggregate combines on the map side, so a token
    that occurs everywhere costs one row per input partition.
    """
    order = F.struct("saved_at", "request_id", "ord")
    vault = saves.groupBy("token").agg(
        F.max_by(F.struct("label", "value"), order).alias("_last"),
        F.max("saved_at").alias("saved_at"),
        (F.min("value") != F.max("value")).alias("_collides"),
    )
    value = F.col("_last.value")
    if on_collision == "error":
        value = F.when(
            F.col("_collides"),
            F.raise_error(F.concat(F.lit("token collision: "), F.col("token"))),
        ).otherwise(value)
    elif on_collision != "last":
        raise ValueError("on_collision must be 'last' or 'error'")
    return vault.select(
        "token", F.col("_last.label").alias("label"), value.alias("value"), "saved_at"
    )


def vault_merge(vault: DataFrame, saves: DataFrame) -> DataFrame:
    """An existing vault with new saves on top; on equal times the save wins."""
    old = vault.select(
        "token", "label", "value", "saved_at",
        F.lit(None).cast("bigint").alias("request_id"), F.lit(None).cast("bigint").alias("ord"),
    )
    return vault_upsert(old.unionByName(saves.select(*SAVE_COLUMNS)))


def vault_prune(vault: DataFrame, ttl_seconds: int = DEFAULT_TTL_SECONDS) -> DataFrame:
    """Drop what had expired at the last save; an age equal to the TTL survives.

    The vault is read twice, for the last save and for the rows: give a stored table.
    """
    last_save = vault.agg(F.max("saved_at")).scalar()
    return vault.filter(
        F.col("saved_at") >= last_save - F.make_dt_interval(secs=F.lit(ttl_seconds))
    )


def vault_get(keys: DataFrame, vault: DataFrame) -> DataFrame:
    """Look up tokens; an unknown token gets null.  Reading never checks the age."""
    return keys.join(vault.select("token", "value"), "token", "left")


def vault_size(vault: DataFrame) -> DataFrame:
    return vault.agg(F.count(F.lit(1)).alias("vault_size"))


def vault_clear(saves: DataFrame, ended_sessions: DataFrame, session: str) -> DataFrame:
    """The saves without those of ended sessions."""
    return saves.join(ended_sessions.select(session).distinct(), session, "left_anti")


def vault_collisions(saves: DataFrame) -> DataFrame:
    """Tokens that stand for more than one value, and for how many.

    Values are made distinct before they are counted, so a frequent value is one row.
    """
    return (
        saves.select("token", "value")
        .distinct()
        .groupBy("token")
        .agg(F.count(F.lit(1)).alias("n_values"))
        .filter(F.col("n_values") > 1)
    )


def vault_asof(
    saves: DataFrame,
    lookups: DataFrame,
    at: str,
    ttl_seconds: int = DEFAULT_TTL_SECONDS,
    block: int = 65536,
) -> DataFrame:
    """The value each looked-up token had at the time of its lookup.

    ``lookups`` holds ``token`` and the time column ``at``.  A token counts if it was saved
    at or before that time and had not expired at the last save of *any* token by then.
    Adds ``value`` (null where not live).

    Saves are reduced to the last one per token and time.  Saves and lookups are then put in
    one order, by token and time, in which every row has its ordinal, and look back along
    blocks of equal row counts with the ends of blocks carried on.  So neither a hot token nor
    a single time stamp ends up in one task; nor does the one timeline of all saves, whose
    distinct times look back along slices.
    """
    micros = F.unix_micros("saved_at").alias("_at")
    last = saves.groupBy("token", micros).agg(F.max_by("value", F.struct("request_id", "ord")).alias("value"))
    probe = lookups.withColumn("_id", F.struct(*lookups.columns)).withColumn("_salt", F.monotonically_increasing_id())

    timeline = saves.select(micros, F.lit(0).alias("_kind")).distinct().unionByName(
        lookups.select(F.unix_micros(at).alias("_at"), F.lit(1).alias("_kind")).distinct()
    )
    # times are distinct, so a second holds no more than two rows a microsecond
    last_any = latest_before(
        timeline, [], "_at", F.when(F.col("_kind") == 0, F.col("_at")), "_any", tie=["_kind"], width=1_000_000
    ).filter("_kind = 1").select("_at", "_any")
    per_token = last.withColumn("_kind", F.lit(0)).unionByName(
        probe.select("token", F.unix_micros(at).alias("_at"), F.lit(1).alias("_kind"), "_id", "_salt"),
        allowMissingColumns=True,
    )
    save = F.when(F.col("_kind") == 0, F.struct("token", "_at", "value"))
    placed = with_positions(per_token, ["token", "_at", "_kind", "_salt"])
    own = latest_before(placed, [], "_pos", save, "_own", width=block, fanout=block).filter("_kind = 1")
    live = (F.col("_own.token") == F.col("token")) & (F.col("_any") - F.col("_own._at") <= ttl_seconds * 1_000_000)
    return own.join(last_any, "_at", "left").select(
        "_id.*", F.when(live, F.col("_own.value")).alias("value")
    )
