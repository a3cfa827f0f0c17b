"""Reading payloads, chunks and log records, and the vault store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilframe.operators.redact import explode_findings, redact_corpus
from veilframe.operators.vault import vault_build, vault_merge, vault_upsert
from veilframe.sources.stage import stage

VAULT_SCHEMA = "token string, value string, saved_at timestamp, label string"
CHUNK_SCHEMA = "stream_id long, seq long, chunk string"


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """One JSON payload per line, kept as text so that bad lines can be set aside."""
    return spark.read.text(path).withColumnRenamed("value", "raw")


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CHUNK_SCHEMA).parquet(path)


def read_logs(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """Log records, one JSON object per line."""
    return spark.read.schema(schema).json(path)


def write_vault(vault: DataFrame, path: str) -> None:
    """Store a vault by label.  It holds the originals: keep the folder from the readers
    of the redacted tables."""
    (
        vault.select("token", "value", "saved_at", "label")
        .repartition("label", F.substring("token", -3, 2))
        .write.partitionBy("label")
        .parquet(path)
    )


def read_vault_store(
    spark: SparkSession, path: str, labels: list[str] | None = None
) -> DataFrame:
    """A stored vault; with ``labels`` only their folders are read."""
    vault = spark.read.schema(VAULT_SCHEMA).parquet(path)
    if labels is not None:
        vault = vault.filter(F.col("label").isin(labels))
    return vault.select("token", "label", "value", "saved_at")


def append_vault(saves: DataFrame, path: str, new_path: str) -> None:
    """Merge new saves into a stored vault; the result is a new folder."""
    write_vault(vault_merge(read_vault_store(saves.sparkSession, path), saves), new_path)


def write_corpus(
    df: DataFrame,
    columns: list[str],
    key: str,
    saved_at: Column | str,
    table_path: str,
    vault_path: str,
    labels: list[str] | None = None,
) -> None:
    """Redact text columns and write two tables: the redacted rows, and the vault.

    The rules run once; both sinks read the staged result, the vault only its findings.
    The stage holds originals as well, so its folder needs the protection of the vault.
    """
    staged = stage(redact_corpus(df, columns, labels), "corpus")
    staged.drop("findings").write.parquet(table_path)
    at = [saved_at] if isinstance(saved_at, str) else []
    found = explode_findings(staged, [key, *at])
    write_vault(vault_upsert(vault_build(found, saved_at, key)), vault_path)
