"""Log scrubbing: masking of named fields, and level names."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilframe.functions.json_text import masked
from veilframe.functions.tokens import quote, sql_text

# Masked field names (case-sensitive), the mask, and the level mapping.
MASKED_FIELDS = (
    "token", "accessToken", "refreshToken", "apiKey", "password", "idToken",
    "authorization", "secret", "clientSecret",
)
MASK = "[REDACTED]"
SEVERITIES = {
    "trace": "DEBUG",
    "debug": "DEBUG",
    "info": "INFO",
    "warn": "WARNING",
    "error": "ERROR",
    "fatal": "CRITICAL",
}
DEFAULT_SEVERITY = "DEFAULT"


def _masked(expr: str) -> str:
    """The mask, where there is a value at all."""
    return f"CASE WHEN {expr} IS NOT NULL THEN {sql_text(MASK)} END"


def _mask_inside(expr: str, dtype: T.DataType) -> str:
    """One level down: fields of a struct, entries of a map.

    The mask is a string; in a map of other values a masked entry is left out instead.
    """
    if isinstance(dtype, T.StructType):
        parts = ", ".join(
            f"{sql_text(f.name)}, "
            + (
                _masked(f"{expr}.{quote(f.name)}")
                if f.name in MASKED_FIELDS
                else f"{expr}.{quote(f.name)}"
            )
            for f in dtype.fields
        )
        return f"CASE WHEN {expr} IS NOT NULL THEN named_struct({parts}) END"
    if isinstance(dtype, T.MapType) and isinstance(dtype.keyType, T.StringType):
        names = ", ".join(sql_text(n) for n in MASKED_FIELDS)
        if not isinstance(dtype.valueType, T.StringType):
            return f"map_filter({expr}, (k, v) -> k NOT IN ({names}) OR v IS NULL)"
        return (
            f"transform_values({expr}, (k, v) -> CASE WHEN k IN ({names}) AND v IS NOT NULL"
            f" THEN {sql_text(MASK)} ELSE v END)"
        )
    return expr


def log_mask(df: DataFrame) -> DataFrame:
    """Mask the named fields of log records, at the top and one level down, no deeper.

    The names are known when the query is planned, so this is a projection, and a masked
    column is not even read beyond its null flags.
    """
    return df.select(
        *[
            F.expr(
                _masked(quote(f.name))
                if f.name in MASKED_FIELDS
                else _mask_inside(quote(f.name), f.dataType)
            ).alias(f.name)
            for f in df.schema.fields
        ]
    )


def log_mask_json(df: DataFrame, column: str) -> DataFrame:
    """Mask the named fields of records that are JSON texts, whatever their shape.

    As ``log_mask``: at the top and one object down, nulls stay, and the value may be of any
    kind and depth.  All else keeps its spelling, white space too.  A text that is no object
    stays as it is, and one that breaks off is masked as far as it goes.  Only texts that hold
    one of the names, or an escape that could spell one, leave the JVM.
    """
    names = "|".join(MASKED_FIELDS)
    gate = F.col(quote(column)).rlike(f'"(?:{names})"|\\\\u')

    @F.arrow_udf("string")
    def cut(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            found = (None if t is None else masked(t, frozenset(MASKED_FIELDS), MASK) for t in texts.to_pylist())
            yield pa.array(found, pa.string(), size=len(texts))

    return df.withColumn(column, F.coalesce(cut(F.when(gate, F.col(quote(column)))), F.col(quote(column))))


def log_severity(level: str = "level") -> Column:
    """The severity of a level name; anything unknown is ``DEFAULT``."""
    out = F
    for name, severity in SEVERITIES.items():
        out = out.when(F.col(quote(level)) == name, severity)
    return out.otherwise(DEFAULT_SEVERITY)
