"""Document fingerprints: 128-bit SimHash, and search by permuted block tables.

Terms are pairs of neighbouring words; every occurrence votes with a weight that grows with
the length of its words, set bits for and unset bits against.  All of it is Catalyst
expressions: terms are hashed inside arrays, and the votes of a text are 64 sums, each of
which counts two bits in the halves of a 64-bit number.
"""

from __future__ import annotations

import json
import math
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veilframe.sources.stage import stage

BITS = 128
RADIUS = 6
BLOCKS = 8
BUCKET = 2048  # documents, about, that one task puts in order, in tables of up to two million
LANES = (1 << 32) | 1


def terms(text: Column) -> Column:
    """``hash, weight`` of the pairs of neighbouring words (and the last word alone), words
    being runs other than the six ASCII white spaces, A-Z in lower case."""
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.filter(F.split(lower, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return F.zip_with(words, F.slice(words, 2, F.greatest(F.size(words), F.lit(1))), lambda a, b: F.struct(
        F.xxhash64(a, b).alias("h"),
        F.least(F.length(a) + F.coalesce(F.length(b), F.lit(0)), F.lit(24)).cast("long").alias("w")))


def votes(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    """``keys, hi, lo``: the fingerprint of each row's whole ``text``, as two 64-bit words.

    ``keys`` tell rows apart.  A text without words has fingerprint zero.
    """
    one = rows.select(*keys, F.explode_outer(terms(F.col(text))).alias("t")).select(
        *keys, F.col("t.h").alias("h"), F.col("t.w").alias("w"))
    two = one.withColumn("g", F.xxhash64("h", F.lit(1)))
    sums = [F.sum("w").alias("total")]
    for word in "hg":
        for i in range(32):
            lanes = F.shiftrightunsigned(word, i).bitwiseAND(F.lit(LANES))
            sums.append(F.sum(lanes * F.col("w")).alias(f"{word}{i}"))
    counted = two.groupBy(*keys).agg(*sums)

    def packed(word: str) -> Column:
        bits = []
        for i in range(32):
            low = F.col(f"{word}{i}").bitwiseAND(F.lit((1 << 32) - 1))
            high = F.shiftrightunsigned(f"{word}{i}", 32)
            for at, count in ((i, low), (i + 32, high)):
                value = (1 << at) - (1 << 64) if at == 63 else 1 << at
                bits.append(F.when(count * 2 > F.col("total"), F.lit(value).cast("long")).otherwise(F.lit(0).cast("long")))
        while len(bits) > 1:
            bits = [a.bitwiseOR(b) for a, b in zip(bits[::2], bits[1::2])]
        return bits[0]

    return counted.select(*keys, packed("h").alias("hi"), packed("g").alias("lo"))


def distance(a: str, b: str) -> Column:
    """Differing bits of two fingerprints given by the prefixes of their columns."""
    return F.bit_count(F.col(f"{a}hi").bitwiseXOR(F.col(f"{b}hi"))) + F.bit_count(
        F.col(f"{a}lo").bitwiseXOR(F.col(f"{b}lo")))


def likeness(bits: Column) -> Column:
    """The cosine that a number of differing bits stands for, 0 if it is negative."""
    return F.greatest(F.lit(0.0), F.when(bits == 0, F.lit(1.0)).otherwise(
        F.cos(bits * F.lit(3.141592653589793 / BITS))))


def hex_of(prefix: str = "") -> Column:
    return F.lower(F.concat(F.lpad(F.hex(f"{prefix}hi"), 16, "0"), F.lpad(F.hex(f"{prefix}lo"), 16, "0")))


def block(prefix: str, i: int) -> Column:
    """The ``i``-th of the eight 16-bit blocks."""
    word = F.col(f"{prefix}hi") if i < 4 else F.col(f"{prefix}lo")
    return F.shiftrightunsigned(word, 16 * (i % 4)).bitwiseAND(F.lit(0xFFFF))


def table_keys(prefix: str, radius: int) -> Column:
    """One key for each permuted table: with ``radius`` of the blocks possibly changed, the
    others are equal in one of the tables."""
    return F.array(*(
        F.xxhash64(F.lit(t), *(block(prefix, i) for i in same))
        for t, same in enumerate(combinations(range(BLOCKS), BLOCKS - radius))
    ))


def within_radius(fingerprints: DataFrame, queries: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``qhi, qlo, hi, lo, distance``: for every distinct query fingerprint, itself included, all
    distinct fingerprints within ``radius`` bits (at most 7).

    Both frames have ``hi, lo``.  ``radius`` bits touch at most ``radius`` of the eight blocks,
    so a pair meets in a table; it comes from the first in which it meets.  The tables are joined
    by sorting: Spark sizes them as if each fingerprint had one key and would broadcast them.
    """
    groups = list(combinations(range(BLOCKS), BLOCKS - radius))
    base = fingerprints.select("hi", "lo").distinct()
    asked = queries.select(F.col("hi").alias("qhi"), F.col("lo").alias("qlo")).distinct()
    left = asked.select("qhi", "qlo", F.explode(table_keys("q", radius)).alias("slot"))
    right = base.select("hi", "lo", F.explode(table_keys("", radius)).alias("key"))
    equal = [F.when(block("", i) == block("q", i), F.lit(1 << i)).otherwise(F.lit(0)) for i in range(BLOCKS)]
    agreed = equal[0]
    for e in equal[1:]:
        agreed = agreed.bitwiseOR(e)
    first = F.lit(None).cast("long")
    for t in reversed(range(len(groups))):
        need = sum(1 << i for i in groups[t])
        meets = F.xxhash64(F.lit(t), *(block("q", i) for i in groups[t]))
        first = F.when(agreed.bitwiseAND(F.lit(need)) == need, meets).otherwise(first)
    met = left.hint("merge").join(right, (F.col("slot") == F.col("key")) & (distance("", "q") <= radius) & (F.col("slot") == first))
    return met.select("qhi", "qlo", "hi", "lo", distance("", "q").alias("distance"))


def ranges(n: int) -> int:
    """How many ranges ``n`` rows are cut into: ranges of ``BUCKET`` rows, and in large tables as
    many ranges as a range has rows, so that neither the cuts nor a range outgrow a task."""
    return max(1, min(-(-n // BUCKET), max(1024, math.isqrt(n))))


def number_below(table: Column, size: int, at: str) -> Column:
    """How many of the ``size`` sorted values of a constant array lie below a column, by halving."""

    def halve(s: Column, _: Column) -> Column:
        mid = F.shiftright(s["lo"] + s["hi"], 1)
        done, below = s["lo"] >= s["hi"], F.get(table, mid) < F.col(at)
        return F.struct(F.when(~done & below, mid + 1).otherwise(s["lo"]).alias("lo"),
                        F.when(~done & ~below, mid).otherwise(s["hi"]).alias("hi"))

    steps = F.sequence(F.lit(0), F.lit(size.bit_length()))
    return F.aggregate(steps, F.struct(F.lit(0).alias("lo"), F.lit(size).alias("hi")), halve, lambda s: s["lo"])


def with_next(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``bucket, row, id, text, next_row, next_text``: every row beside the next by descending id.

    Ids are cut into ranges at quantiles that are ids of the table; the row with such an id is
    also dealt to the range above it, where it precedes the first row, and the rows with the
    greatest id to the lowest range.  So each range is ordered by one task and texts are
    shuffled once.  Rows of one id are ordered by a hash of their text; a null id comes last.
    """
    base = docs.select(
        F.monotonically_increasing_id().alias("row"), docs[id_col].alias("id"),
        F.coalesce(docs[id_col].cast("long"), F.lit(-(1 << 63))).alias("at"),
        F.coalesce(docs[text_col], F.lit("")).alias("text"))
    n = base.count()
    buckets = ranges(n)
    marks = [i / buckets for i in range(1, buckets + 1)]
    cuts = base.agg(F.percentile_approx("at", F.array(*map(F.lit, marks)), F.lit(20 * max(1024, buckets))), F.max("at")).first()
    cuts = sorted({*(cuts[0] or []), *([cuts[1]] if cuts[1] is not None else [])})
    table = F.from_json(F.lit(json.dumps({"v": cuts})), "struct<v:array<bigint>>")["v"]
    number = F.col("number")
    above = F.when(F.get(table, number) == F.col("at"), F.pmod(number + 1, F.lit(max(1, len(cuts)))))
    dealt = base.withColumn("number", number_below(table, len(cuts), "at")).select("*", F.explode(F.filter(F.array(
        F.struct(number.alias("bucket"), F.lit(1).alias("own")),
        F.struct(above.alias("bucket"), F.lit(0).alias("own"))), lambda s: s.bucket.isNotNull())).alias("d")
    ).select("d.bucket", "d.own", "row", "id", "at", "text")
    order = W.partitionBy("bucket").orderBy("own", "at", F.xxhash64("text"), "row")
    placed = dealt.withColumn("next_row", F.lag("row").over(order)).withColumn("next_text", F.lag("text").over(order))
    return placed.filter("own = 1").select("bucket", "row", "id", "text", "next_row", "next_text")


def edited(text: Column, following: Column) -> Column:
    """The last half of the code points replaced by the first as many of ``following``."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.left(text, F.length(text) - half), F.left(following, half))


def document_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For every row its fingerprint, that of its edited text, and the likeness of its own to
    both that and the next row's.

    Null texts count as empty, empty texts have fingerprint zero, and a lone row is its own
    next.  Repeated rows and ids give one row each.  ``near_rows`` says, for ids divisible by
    50, how many other rows have a fingerprint within six bits; it is null for other ids.
    """
    # the rows stay where the ranges put them: grouping by range and row needs no shuffle
    told = ["bucket", "row", "id", "next_row", "n_chars", "edited_sha256"]
    pair = with_next(docs, id_col, text_col).withColumn("edited", edited(F.col("text"), F.col("next_text")))
    versions = pair.select(
        "bucket", "row", "id", "next_row", F.length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        F.explode(F.array(*(F.struct(F.lit(v).alias("v"), F.col(c).alias("body"))
                            for v, c in enumerate(("text", "edited"))))).alias("e"),
    ).select(*told, "e.v", "e.body")
    prints = stage(votes(versions, [*told, "v"], "body").groupBy(*told).agg(*(
        F.max(F.when(F.col("v") == v, F.col(c))).alias(p + c) for v, p in ((0, ""), (1, "e")) for c in ("hi", "lo"))),
        "prints")
    asked = prints.filter("id % 50 = 0")
    counts = prints.groupBy("hi", "lo").agg(F.count("*").alias("rows"))
    near = within_radius(counts, asked).join(counts, ["hi", "lo"]).groupBy("qhi", "qlo").agg(
        (F.sum("rows") - 1).alias("near_rows"))
    following = prints.select(F.col("row").alias("n"), F.col("hi").alias("nhi"), F.col("lo").alias("nlo"))
    both = prints.join(following, F.col("next_row") == F.col("n"))
    found = both.join(near, (F.col("hi") == F.col("qhi")) & (F.col("lo") == F.col("qlo")) & (F.col("id") % 50 == 0), "left")
    return found.select(
        F.col("id").alias(id_col), "n_chars", "edited_sha256", hex_of().alias("fingerprint"),
        hex_of("e").alias("edited_fingerprint"), likeness(distance("", "e")).alias("near_edited"),
        likeness(distance("", "n")).alias("near_next"), "near_rows",
    )
