"""Token minting and the token grammar, as Spark SQL expressions.

Expressions in this package are SQL text: they nest inside the lambdas of higher-order
functions and cost one parse, where the same tree built call by call would cost hundreds
of round trips to the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The token format is '[' label '_' first hex digits of SHA-256 ']'.
HASH_WIDTH = 6
TOKEN_PATTERN = r"\[[A-Z][A-Z0-9_]*_[0-9a-f]{1,64}\]"  # every width that can be minted
# Anything in brackets, for vaults whose tokens were not minted here.
CUSTOM_TOKEN_PATTERN = r"\[[^\[\]]+\]"


def sql_text(value: str | int | bool | None) -> str:
    """A Python value as a Spark SQL literal."""
    if value is None:
        return "CAST(NULL AS STRING)"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, int):
        return str(value)
    text = value.replace("\\", "\\\\").replace("'", "\\'")
    return "'" + text.replace("${", "$\\{") + "'"  # no variable substitution


def quote(name: str) -> str:
    """A column name as a quoted identifier."""
    return "`" + name.replace("`", "``") + "`"


def once_sql(expr: str) -> str:
    """A generator of one row per row, which computes an expression once.

    The optimizer moves a filter below a plain projection by repeating what it reads, and a
    redaction would then run several times per row.  It does not merge generators with what
    stands above them, while filters on other columns still pass below to the scan.  A
    projection can hold one such expression; put several values into one struct.
    """
    return f"explode_outer(array({expr}))"


def mint_sql(label: str, value: str, width: int = HASH_WIDTH) -> str:
    """``[LABEL_hhhhhh]`` for two SQL expressions; a null value stays null."""
    if not 1 <= width <= 64:
        raise ValueError("hash width must be between 1 and 64 hex digits")
    return f"concat('[', {label}, '_', substring(sha2({value}, 256), 1, {width}), ']')"


def mint(label: str, value: str, width: int = HASH_WIDTH) -> Column:
    """The token of column ``value`` under a fixed label."""
    return F.expr(mint_sql(sql_text(label), quote(value), width))


def type_of(token: Column) -> Column:
    """The short type shown in breakdowns: the second ``_`` part of the token."""
    return F.coalesce(F.get(F.split(token, "_"), 1), F.lit("UNK"))


def tokens_in_sql(text: str, pattern: str = TOKEN_PATTERN) -> str:
    """All token-shaped pieces of a text, in order, with repeats."""
    return f"regexp_extract_all({text}, {sql_text(pattern)}, 0)"
