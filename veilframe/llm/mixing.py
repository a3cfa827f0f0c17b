"""Mixing sources to target weights by temperature.

Source weights are token shares raised to an exponent and normalised.  The exponent, 1 for
natural shares, 0 for equal ones and above 1 for sharper ones, is bisected to reach a target
entropy, as far as no source then repeats more often than allowed.  The weights
are then realised as blocks: every source is a sequence of passes, each a permutation of all
its documents, cut off when the source's budget of tokens is spent, and every block takes
from every source the share of tokens that its weight says.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veilframe.sources.stage import stage

ENTROPY = 0.95  # of the entropy of equal shares
REPEATS = 1.5  # passes over any source
BLOCK_TOKENS = 1 << 20
STEPS = 4
SHARPEST = 64.0  # the greatest exponent
PARTS = 16
RUN = 4096  # documents, about, that one task puts in order


def token_count(text_col: str) -> Column:
    """Words of a text; a text without any, or null, counts one token so that it has a place."""
    return F.greatest(F.coalesce(F.regexp_count(text_col, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)), F.lit(1)).cast("long")


def shares(weighed: DataFrame) -> DataFrame:
    """``source, docs, tokens, share, top`` by source; ``top`` is the greatest share."""
    totals = weighed.groupBy("source").agg(F.count("*").alias("docs"), F.sum("tokens").alias("tokens"))
    whole = totals.agg(F.sum("tokens").cast("double").alias("all"), F.max("tokens").alias("most"))
    return totals.join(F.broadcast(whole)).select(
        "source", "docs", "tokens", (F.col("tokens") / F.col("all")).alias("share"), (F.col("most") / F.col("all")).alias("top"))


def powered(exponent: float) -> Column:
    """The weight of a source before it is normalised; shares over the greatest one keep it from
    vanishing under large exponents."""
    return F.pow(F.col("share") / F.col("top"), F.lit(exponent))


def exponent(by_source: DataFrame, entropy: float | None, repeats: float | None, budget: float | None) -> float:
    """The exponent by bisection on aggregates over the source table.

    Entropy falls steadily with the exponent.  Natural shares (1) that are not even enough are
    flattened by an exponent below 1, those that are more even than the target are sharpened by
    one above.  The number of passes rises with the distance from 1 on either side, so the limit
    on repeats brings the exponent back towards 1 where it must.  Without an entropy the shares
    are flattened as far as the limit lets them.  Where no exponent meets the target (equal
    shares), the shares stay as they are.

    ``PARTS`` points of the interval are measured at once, ``STEPS`` times.  ``budget`` is a
    multiple of all tokens, or None for the least budget at which no source is cut short.
    """
    n = by_source.count()
    if n < 2:
        return 1.0
    target = None if entropy is None else entropy * math.log(n) - 1e-12

    def measured(points: list[float]) -> list[tuple[float, float]]:
        """Entropy and passes at each exponent."""
        aggregates = []
        for i, a in enumerate(points):
            w, s = powered(a), F.col("share")
            aggregates += [F.sum(w).alias(f"z{i}"), F.sum(w * F.log(s / F.col("top"))).alias(f"l{i}"),
                           F.max(w / s).alias(f"m{i}"), F.min(w / s).alias(f"s{i}")]
        row = by_source.agg(*aggregates).first()
        out = []
        for i, a in enumerate(points):
            z, m = row[f"z{i}"], row[f"m{i}"]
            spread = row[f"s{i}"] if budget is None else z / budget
            out.append((math.log(z) - a * row[f"l{i}"] / z, m / spread if spread else math.inf))
        return out

    sharpen = target is not None and measured([1.0])[0][0] >= target
    low, high = (1.0, SHARPEST) if sharpen else (0.0, 1.0)
    for _ in range(STEPS):
        points = [low + (high - low) * i / PARTS for i in range(PARTS + 1)]
        found = [(target is not None and h >= target, repeats is not None and p > repeats + 1e-12) for h, p in measured(points)]
        if sharpen:  # the last point that is even enough and within the limit
            at = max(i for i, (flat, often) in enumerate(found) if i == 0 or (flat and not often))
        else:  # the last point that is still too flat, or just flat enough
            at = max(i for i, (flat, often) in enumerate(found) if i == 0 or flat or often)
        low, high = points[at], points[min(at + 1, PARTS)]
    if sharpen:
        return low if low < SHARPEST else 1.0
    return high if repeats is not None else low


def mixture(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    entropy: float | None = ENTROPY,
    repeats: float | None = REPEATS,
    budget: float | None = None,
    block_tokens: int = BLOCK_TOKENS,
    seed: int = 17,
    keep: bool = False,
) -> DataFrame:
    """The mixed corpus in order: one row for each use of a document, with
    ``block, position, doc_id, source, pass, tokens`` (all columns of ``docs`` if ``keep``).

    Weights follow the entropy target unless a source would then be repeated more than
    ``repeats`` times.  With ``budget`` None the corpus is as large as it must be for every
    document to be used once at least; otherwise it has about ``budget`` times all tokens.
    Documents of a null source are a source of their own.  Texts without a word count one
    token.  Repeated rows are documents of their own; equal ones may take each other's place.
    No source or pass is put in order by one task: order is by a hash, the hash's leading
    bits cut each pass into runs, and a run's start is the sum of the runs before it.
    """
    columns = docs.columns if keep else [id_col, source_col]
    weighed = docs.select(
        F.struct(*[docs[c] for c in columns]).alias("row"),
        docs[id_col].cast("string").alias("key"),
        docs[source_col].alias("source"),
        token_count(text_col).alias("tokens"),
        F.xxhash64(docs[text_col]).alias("tie"),
    )
    by_source = stage(shares(weighed.select("source", "tokens")), "sources")
    a = exponent(by_source, entropy, repeats, budget)
    weights = by_source.withColumn("w", powered(a))
    z, least, total, count = weights.agg(
        F.sum("w"), F.min(F.col("w") / F.col("share")), F.sum("tokens"), F.sum("docs")
    ).first()
    size = (1.0 / least if budget is None else budget / z) * (total or 0) if count else 0.0
    plan = weights.select(
        F.col("source").alias("s"), F.col("tokens").alias("in_source"),
        F.greatest(F.round(F.col("w") * F.lit(size)).cast("long"), F.lit(1)).alias("quota"),
    )
    blocks = max(1, math.ceil(size * (z or 0) / block_tokens))
    bits = max(0, math.ceil(math.log2(max(1, (count or 0) / RUN))))

    spread = weighed.join(plan, weighed.source.eqNullSafe(plan.s)).drop("s")
    used = spread.withColumn("pass", F.explode(F.sequence(
        F.lit(0), F.floor((F.col("quota") - 1) / F.col("in_source")).cast("int"))))
    hashed = used.withColumn("h", F.xxhash64(F.lit(seed), "pass", "key")).withColumn(
        "run", F.shiftright("h", 64 - bits) if bits else F.lit(0).cast("long"))
    runs = stage(hashed.groupBy("source", "pass", "run").agg(F.sum("tokens").alias("n")), "runs")
    over = W.partitionBy("source", "pass").orderBy("run")
    starts = runs.withColumn("start", F.sum("n").over(over) - F.col("n")).drop("n")
    starts = starts.select(F.col("source").alias("s"), F.col("pass").alias("p"), F.col("run").alias("r"), "start")
    within = W.partitionBy("source", "pass", "run").orderBy("h", "key", "tie").rowsBetween(W.unboundedPreceding, -1)
    ordered = hashed.withColumn("inside", F.coalesce(F.sum("tokens").over(within), F.lit(0)))
    placed = ordered.join(
        starts, ordered.source.eqNullSafe(starts.s) & (F.col("pass") == F.col("p")) & (F.col("run") == F.col("r"))
    ).withColumn("at", F.col("pass") * F.col("in_source") + F.col("start") + F.col("inside"))
    taken = placed.filter("at < quota").withColumn(
        "block", F.least(F.floor(F.col("at") / F.col("quota") * F.lit(blocks)), F.lit(blocks - 1)).cast("long"))
    if keep:
        return taken.select(*(F.col("row").getField(c).alias(c) for c in columns))
    in_block = W.partitionBy("block").orderBy(F.xxhash64(F.lit(seed + 1), "pass", "key"), "key", "tie", "pass")
    return taken.select(
        "block", F.row_number().over(in_block).alias("position"), F.col("row").getField(id_col).alias(id_col),
        F.col("row").getField(source_col).alias(source_col), F.col("pass").cast("int").alias("pass"), "tokens",
    )
