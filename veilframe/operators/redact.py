"""Redaction of text columns: the text, its findings, and what is derived from them.

Every operator here is a narrow projection or filter over the scan; none of them shuffles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.functions.redaction import redaction, redaction_sql, token_count
from veilframe.functions.rules import select_rules
from veilframe.functions.tokens import HASH_WIDTH, once_sql, quote, sql_text


def redact_text(
    df: DataFrame,
    column: str = "text",
    labels: list[str] | None = None,
    width: int = HASH_WIDTH,
    redacted: str = "redacted",
    findings: str = "findings",
) -> DataFrame:
    """Add the redacted text and the array of findings of one text column."""
    keep = [F.col(quote(c)) for c in df.columns if c not in (redacted, findings)]
    return df.select(*keep, redaction(column, select_rules(labels), width).alias("_r")).select(
        *keep, F.col("_r.text").alias(redacted), F.col("_r.findings").alias(findings)
    )


def redact_corpus(
    df: DataFrame,
    columns: list[str],
    labels: list[str] | None = None,
    width: int = HASH_WIDTH,
) -> DataFrame:
    """Replace several text columns by their redacted form and add all findings at once."""
    rules = select_rules(labels)
    others = [F.col(quote(c)) for c in df.columns if c not in columns]
    parts = ", ".join(
        f"{sql_text(f'c{i}')}, {redaction_sql(quote(c), rules, width)}" for i, c in enumerate(columns)
    )
    staged = df.select(*others, F.expr(once_sql(f"named_struct({parts})")).alias("_r"))
    return staged.select(
        *[
            F.col(f"_r.c{columns.index(c)}.text").alias(c) if c in columns else F.col(quote(c))
            for c in df.columns
        ],
        F.concat(*[F.col(f"_r.c{i}.findings") for i in range(len(columns))]).alias("findings"),
    )


def with_flags(df: DataFrame, findings: str = "findings") -> DataFrame:
    """Add ``has_redacted`` and the number of different tokens of each row."""
    return df.withColumns(
        {
            "has_redacted": F.size(quote(findings)) > 0,
            "token_count": token_count(findings),
        }
    )


def explode_findings(df: DataFrame, keep: list[str], findings: str = "findings") -> DataFrame:
    """One row per finding: the kept columns, its position, label, value and token."""
    return df.select(*keep, F.posexplode(findings).alias("ord", "_f")).select(
        *keep, F.col("ord").cast("bigint").alias("ord"), "_f.label", "_f.value", "_f.token"
    )


def clean_rows(df: DataFrame, column: str = "text") -> DataFrame:
    """The rows in which no rule finds anything, unchanged."""
    clean = once_sql(f"size(({redaction_sql(quote(column))}).findings) = 0")
    return df.withColumn("_clean", F.expr(clean)).filter("_clean").drop("_clean")


def changed_rows(df: DataFrame, findings: str = "findings") -> DataFrame:
    """The rows in which something was redacted."""
    return df.filter(F.size(quote(findings)) > 0)
