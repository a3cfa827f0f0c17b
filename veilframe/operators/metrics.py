"""Volume reports and the leak audit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.functions.ordered import over_last, with_positions
from veilframe.functions.redaction import redaction_sql
from veilframe.functions.tokens import once_sql, quote, type_of
from veilframe.operators.patterns import occurrences

# How many latencies are kept, and the redactions that fill the gauge.
LATENCIES_KEPT = 50
GAUGE_FULL = 1000


def request_tokens(findings: DataFrame, request: str = "request_id") -> DataFrame:
    """The different tokens of each request; repeats inside a request count once.

    Rows that still hold their array ``findings`` are whole requests: repeats go within the row
    and nothing is shuffled.  Exploded findings of a request may come from several rows.
    """
    if "findings" in findings.columns:
        tokens = F.array_distinct(F.transform("findings", lambda f: F.struct(f["label"].alias("label"), f["token"].alias("token"))))
        return findings.select(request, F.explode(tokens).alias("_t")).select(request, "_t.label", "_t.token")
    return findings.select(request, "label", "token").distinct()


def pii_by_type(findings: DataFrame, request: str = "request_id") -> DataFrame:
    """Redactions per short type."""
    return (
        request_tokens(findings, request)
        .groupBy(type_of(F.col("token")).alias("type"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def pii_by_label(findings: DataFrame, request: str = "request_id") -> DataFrame:
    return (
        request_tokens(findings, request).groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    )


def request_token_count(findings: DataFrame, request: str = "request_id") -> DataFrame:
    if "findings" in findings.columns:
        counted = findings.select(request, F.size(F.array_distinct(F.col("findings.token"))).cast("bigint").alias("token_count"))
        return counted.filter("token_count > 0")
    return (
        request_tokens(findings, request)
        .groupBy(request)
        .agg(F.count(F.lit(1)).alias("token_count"))
    )


def latency_last(
    metrics: DataFrame, order: list[str], duration: str, keep: int = LATENCIES_KEPT
) -> DataFrame:
    """The most recent positive durations, rounded; a top-k, so no total sort."""
    ms = F.floor(F.col(duration) + F.lit(0.5)).cast("bigint")
    return (
        metrics.select(*order, ms.alias("duration_ms"))
        .filter("duration_ms > 0")
        .orderBy(*[F.col(c).desc() for c in order])
        .limit(keep)
    )


def latency_rolling(
    metrics: DataFrame, order: list[str], duration: str, keep: int = LATENCIES_KEPT, width: int = 65536
) -> DataFrame:
    """Each positive duration, rounded, with the mean of the last ``keep`` ones up to it.

    ``order`` must tell rows apart.  The order is global, but no task sees more than a block of
    ``width`` rows of it.
    """
    ms = F.floor(F.col(duration) + F.lit(0.5)).cast("bigint")
    placed = with_positions(metrics.select(*order, ms.alias("duration_ms")).filter("duration_ms > 0"), order)
    mean = {"mean_ms": F.avg("duration_ms")}
    return over_last(placed, "_pos", keep, mean, width).select(*order, "duration_ms", "mean_ms")


def vault_gauge(totals: DataFrame, redacted: str = "redacted_count") -> DataFrame:
    """How full the gauge is, in percent."""
    percent = F.floor(F.col(redacted) / F.lit(GAUGE_FULL) * 100 + F.lit(0.5)).cast("bigint")
    return totals.select(F.least(F.lit(100).cast("bigint"), percent).alias("vault_percent"))


def pii_totals(
    requests: DataFrame,
    findings: DataFrame,
    leaks: DataFrame,
    order: list[str],
    duration: str,
    request: str = "request_id",
) -> DataFrame:
    """One row: requests, redactions, leaks, the breakdown and the recent latencies.

    The parts are global aggregates; the two lists are bounded by the number of rules and
    by ``LATENCIES_KEPT``.
    """
    by_type = pii_by_type(findings, request)
    types = by_type.agg(
        F.array_join(
            F.array_sort(F.collect_list(F.concat_ws(":", "type", F.col("n").cast("string")))), ","
        ).alias("types"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("redacted_count"),
    )
    recent = latency_last(requests, order, duration).agg(
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct(*order, "duration_ms"))),
                lambda r: r["duration_ms"].cast("string"),
            ),
            ",",
        ).alias("latency")
    )
    return types.select(
        requests.agg(F.count(F.lit(1))).scalar().alias("request_count"),
        "redacted_count",
        leaks.agg(F.count(F.lit(1))).scalar().alias("leaks"),
        "types",
        recent.scalar().alias("latency"),
    )


def pii_by_source(findings: DataFrame, source: str = "source") -> DataFrame:
    """Findings per source and label, with subtotals and a total."""
    return (
        findings.rollup(source, "label")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(source, "label", "n")
    )


def leak_audit(
    df: DataFrame, keys: list[str], redacted: str = "redacted", findings: str = "findings"
) -> DataFrame:
    """Redacted rows that still give something away.

    ``n_rescan`` counts what the rules find in the output, ``n_known`` the row's own values
    that still stand in it.  Both are local to the row, so a clean corpus costs one scan.
    """
    text, found = quote(redacted), quote(findings)
    counted = df.select(
        *keys,
        F.expr(once_sql(f"CAST(size(({redaction_sql(text)}).findings) AS BIGINT)")).alias(
            "n_rescan"
        ),
        F.expr(
            f"CAST(size(filter(array_distinct({found}.value), v -> contains({text}, v)))"
            " AS BIGINT)"
        ).alias("n_known"),
    )
    return counted.filter("n_rescan > 0 OR n_known > 0")


def vault_leak_audit(df: DataFrame, keys: list[str], text: str, vault: DataFrame) -> DataFrame:
    """Texts in which a value of the whole vault stands, not only their own: ``n_known``.

    A value counts wherever it stands, also inside a longer word, and once per text.
    ``occurrences`` finds them by their rarest pieces; the text itself moves only for rows that
    have a candidate.
    """
    return occurrences(df, keys, text, vault.select("value")).groupBy(*keys).agg(F.count(F.lit(1)).alias("n_known"))
