"""Access audit: which paths and shell commands touch sensitive files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.functions.rules import ASCII_BOUNDARY, SPACE_MEMBERS
from veilframe.functions.tokens import quote, sql_text

# The file names never to be read, the commands that read files, and the
# characters that can wrap a name in a shell word.
SENSITIVE_NAMES = (
    r"^\.env(\z|\..*)",
    r"(?i:credentials)",
    r"(?i:secret)",
    r"\.pem\z",
    r"\.key\z",
    r"\.p12\z",
    r"\.pfx\z",
    r"\.jks\z",
    r"\.keystore\z",
    r"\.asc\z",
    r"^id_rsa",
    r"^\.netrc\z",
    r"^\.pgpass\z",
)
READERS = ("cat", "head", "tail", "less", "more", "bat", "batcat")
SHELL_META = "`\"'$(){}"
BLOCKED_FILE = "Blocked: sensitive file"
BLOCKED_COMMAND = "Blocked: command reads sensitive file"

SPACE = f"[{SPACE_MEMBERS}]"
READER = f"{ASCII_BOUNDARY}({'|'.join(READERS)}){ASCII_BOUNDARY}"


def _trim_sql(text: str) -> str:
    return f"regexp_replace({text}, {sql_text(f'^{SPACE}+|{SPACE}+' + chr(92) + 'z')}, '')"


def sensitive_path_sql(path: str) -> str:
    """Whether the last part of a path is a sensitive name; null counts as empty."""
    base = _trim_sql(f"element_at(split(coalesce({path}, ''), '/', -1), -1)")
    return f"({base} RLIKE {sql_text('|'.join(SENSITIVE_NAMES))})"


def sensitive_command_sql(command: str) -> str:
    """Whether a shell command reads a sensitive file.

    Sensitive are the targets of ``<`` and, in each part of the command, any word after
    the first reader that is not a flag.
    """
    redirect = sql_text(rf"<{SPACE}*([^{SPACE_MEMBERS}|;&<>]+)")
    bare = f"translate(w, {sql_text(SHELL_META)}, '')"
    words = f"split({_trim_sql('p')}, {sql_text(SPACE + '+')}, -1)"
    reader = sql_text(READER)
    after = f"""
        transform(array({words}), ws -> transform(
            array(array_position(transform(ws, w -> w RLIKE {reader}), true)), at ->
                CASE WHEN at = 0 OR at = size(ws) THEN CAST(array() AS ARRAY<STRING>)
                ELSE slice(ws, CAST(at AS INT) + 1, size(ws)) END)[0])[0]"""
    return f"""
        transform(array(coalesce({command}, '')), cmd -> cmd RLIKE {reader} AND (
            exists(regexp_extract_all(cmd, {redirect}, 1), w -> {sensitive_path_sql(bare)})
            OR exists(split(cmd, '[|;&<>]+', -1), p -> exists({after}, w ->
                NOT startswith(w, '-') AND {sensitive_path_sql(bare)}))))[0]"""


def sensitive_path(column: str) -> Column:
    return F.expr(sensitive_path_sql(quote(column)))


def sensitive_command(column: str) -> Column:
    return F.expr(sensitive_command_sql(quote(column)))


def blocked_reason_sql(tool: str, path: str, command: str, prefix: str = "") -> str:
    """Why a tool call must not run; null where it may."""
    return f"""
        CASE WHEN {tool} = 'read' AND {sensitive_path_sql(path)}
            THEN {sql_text(prefix + BLOCKED_FILE)}
        WHEN {tool} = 'bash' AND {sensitive_command_sql(command)}
            THEN {sql_text(prefix + BLOCKED_COMMAND)} END"""


def access_decision(
    df: DataFrame,
    tool: str = "tool",
    path: str = "file_path",
    command: str = "command",
    prefix: str = "",
) -> DataFrame:
    """Add ``blocked_reason`` to tool calls."""
    return df.withColumn(
        "blocked_reason",
        F.expr(blocked_reason_sql(quote(tool), quote(path), quote(command), prefix)),
    )


def access_split(df: DataFrame, **columns: str) -> tuple[DataFrame, DataFrame]:
    """The allowed and the blocked tool calls."""
    decided = access_decision(df, **columns)
    return (
        decided.filter("blocked_reason IS NULL").drop("blocked_reason"),
        decided.filter("blocked_reason IS NOT NULL"),
    )
