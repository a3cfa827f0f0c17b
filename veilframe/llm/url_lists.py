"""URL filters by temporal list joins.

A filter list is a log of dated entries: from a day on a key (a host, a domain, or a host
with its first path segment) is blocked, allowed, or no longer listed.  Entries become
validity intervals, cut into periods so that one key's captures and intervals meet in small
pieces.  Every capture is joined as of its fetch day with the entries of all its keys, and
the most specific active one decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

PERIOD = 32  # days in a period


def host_of(url: Column) -> Column:
    """The lower-case host of an http or https URL, without user, port and last dot; empty if
    there is none."""
    host = F.regexp_extract(url, r"^(?i:https?)://(?:[^/?#@]*@)?([^/?#:@]+)", 1)
    return F.regexp_replace(F.lower(host), r"\.$", "")


def keys_of(url: Column) -> Column:
    """``specificity, key`` of every listing that may cover a URL: its host and the domains
    above it with a dot, the more labels the more specific, and its host with the first path
    segment, the most specific of all."""
    host = host_of(url)
    labels = F.split(host, r"\.")
    n = F.size(labels)
    domains = F.transform(
        F.sequence(F.lit(2), F.greatest(n, F.lit(2))),
        lambda k: F.struct(k.alias("specificity"), F.array_join(F.slice(labels, n - k + 1, k), ".").alias("key")))
    segment = F.regexp_extract(url, r"^(?i:https?)://[^/?#]*/([^/?#]+)", 1)
    first = F.array(F.struct((n + 1).alias("specificity"), F.concat(host, F.lit("/"), segment).alias("key")))
    own = F.when(n >= 2, domains).otherwise(F.array(F.struct(n.alias("specificity"), host.alias("key"))))
    return F.when(host == "", F.array().cast("array<struct<specificity:int,key:string>>")).otherwise(
        F.when(segment != "", F.concat(own, first)).otherwise(own))


def intervals(entries: DataFrame) -> DataFrame:
    """``key, action, since, until`` from ``key, day, action``: an entry holds until the day of
    the key's next one, the last one without end (``until`` null).

    Of several entries of a day the greatest action text holds.  Entries without key, day or
    action are no entries.  Only one row per key and day reaches the window.
    """
    daily = entries.filter("key IS NOT NULL AND day IS NOT NULL AND action IS NOT NULL").groupBy("key", "day").agg(
        F.max("action").alias("action"))
    return daily.select(
        "key", "action", F.col("day").alias("since"),
        F.lead("day").over(W.partitionBy("key").orderBy("day")).alias("until"))


def evaluate(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """``id, url, day, verdict, rule, since, until`` for ``id, url, day``: ``block``, ``allow`` or
    ``none``, the rule that decided, and its validity.

    Every capture gives one row; a null or malformed URL or a null day gives ``none``.  The
    distinct (key, day) pairs of all captures are joined, not the captures: a host that a
    third of all captures share has one row a day.  Repeated captures stay.
    """
    spans = intervals(entries).filter("action <> 'remove'")
    days = captures.agg(F.min("day"), F.max("day")).first()
    origin = F.lit("1970-01-01").cast("date")

    def period(day: Column) -> Column:
        return F.floor(F.datediff(day, origin) / PERIOD).cast("int")

    numbered = captures.select("id", "url", "day", F.monotonically_increasing_id().alias("row"))
    wide = numbered.select("id", "url", "day", "row", F.explode_outer(keys_of(F.col("url"))).alias("k")).select(
        "id", "url", "day", "row", "k.specificity", "k.key")
    asked = wide.filter("key IS NOT NULL AND day IS NOT NULL").select("key", "day").distinct().withColumn(
        "period", period(F.col("day")))
    first, last = F.lit(days[0]).cast("date"), F.lit(days[1]).cast("date")
    pieces = spans.filter((F.col("since") <= last) & (F.col("until").isNull() | (F.col("until") > first))).withColumn(
        "period", F.explode(F.sequence(
            period(F.greatest("since", first)), period(F.least(F.coalesce("until", last), last)))))
    active = asked.join(pieces.withColumnRenamed("key", "listed"), (F.col("key") == F.col("listed")) & (
        asked.period == pieces.period) & (F.col("day") >= F.col("since")) & (
        F.col("until").isNull() | (F.col("day") < F.col("until")))).select(
        "key", "day", F.struct("action", "since", "until").alias("hit"))
    found = wide.filter("key IS NOT NULL").join(
        active.withColumnRenamed("day", "d").withColumnRenamed("key", "k"),
        (F.col("key") == F.col("k")) & (F.col("day") == F.col("d")), "left")
    # captures without a host ask for nothing and stay out of the join, where they would meet
    met = found.unionByName(wide.filter("key IS NULL"), allowMissingColumns=True)
    best = F.max(F.when(F.col("hit").isNotNull(), F.struct(
        "specificity", F.col("key").alias("rule"), "hit.action", "hit.since", "hit.until")))
    return met.groupBy("id", "url", "day", "row").agg(best.alias("best")).select(
        "id", "url", "day", F.coalesce("best.action", F.lit("none")).alias("verdict"),
        "best.rule", "best.since", "best.until")


def dated_pages(pages: DataFrame) -> DataFrame:
    """Captures derived from pages: the fetch day follows from the page's id."""
    day = F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(F.col("page_id") * 37, F.lit(366)).cast("int"))
    return pages.select(F.col("page_id").alias("id"), "url", day.alias("day"))


def listed_hosts(pages: DataFrame) -> DataFrame:
    """A filter list derived from the hosts of pages: of every host, domain and first path
    segment, those that a digest picks have three entries on dates of the year."""
    key = F.explode(keys_of(F.col("url"))).alias("k")
    keys = pages.select(key).select("k.key").distinct()

    def digit(n: int) -> Column:
        return F.conv(F.substring(F.md5("key"), 1 + 4 * n, 4), 16, 10).cast("int")

    picked = keys.filter(digit(0) % 3 == 0).select("key", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("i"))
    number = F.when(F.col("i") == 1, digit(1)).when(F.col("i") == 2, digit(2)).otherwise(digit(3))
    return picked.select(
        "key", F.date_add(F.lit("2023-12-01").cast("date"), number % 400).alias("day"),
        F.when(number % 3 == 0, F.lit("remove")).when(number % 3 == 1, F.lit("allow")).otherwise(F.lit("block")).alias("action"))
