"""What several operators share: reading tables, bounded samples, connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.sources.stage import stage


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: str, modulus: int, rest: int):
    """True where crc32 of the id as text leaves ``rest``; false for a null id."""
    crc = F.crc32(F.col(doc_id).cast("string"))
    return F.coalesce(crc % modulus == rest, F.lit(False))


def bounded_sample(df: DataFrame, by: str, most: int, key: str) -> list:
    """At most ``most`` rows of each value of ``by``, chosen by a hash of ``key``.

    One aggregate finds the share of each value to keep, one scan keeps it.  Of rows with one
    key, which come or stay away together, one is kept before anything is sent, so however often
    a row is repeated, the driver gets ``most`` rows (and a margin) for each value.
    """
    counts = {r[0]: r[1] for r in df.groupBy(by).count().collect() if r[0] is not None}
    if not counts:
        return []
    share = F.lit(0.0)
    for value, n in counts.items():
        share = F.when(F.col(by) == F.lit(value), F.lit(min(1.0, 1.3 * most / n))).otherwise(share)
    drawn = F.pmod(F.xxhash64(F.lit("sample"), F.col(key)), F.lit(1 << 20)) / F.lit(float(1 << 20))
    rows = df.filter(drawn < share).dropDuplicates([by, key]).collect()
    rows.sort(key=lambda r: (np.uint64(hash_of(r[key])), str(r[key])))
    taken: dict = {}
    out = []
    for r in rows:
        taken[r[by]] = taken.get(r[by], 0) + 1
        if taken[r[by]] <= most:
            out.append(r)
    return out


def hash_of(value: object) -> int:
    """A stable 64-bit hash of a value's text."""
    import hashlib

    return int.from_bytes(hashlib.blake2b(str(value).encode(), digest_size=8).digest(), "big")


def components(links: DataFrame) -> DataFrame:
    """Connected components of ``links (a bigint, b bigint)``: ``node, root``, the smallest
    node of each component as its root.

    Large-star and small-star rounds: each node hands its neighbours to its smallest one, so
    the edges shrink to stars in a logarithmic number of rounds.  A node's neighbours are
    never gathered; each round joins edges with one minimum per node.  Every round is a table
    in the shared folder.
    """
    edges = stage(
        links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct(),
        "edges",
    )
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = (
            both.filter("b > a").join(least, "a")
            .select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        )
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(
            F.explode(
                F.when(F.col("b") == F.col("m"), F.array(F.struct("a", F.col("m").alias("b"))))
                .otherwise(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b"))))
            ).alias("e")
        ).select("e.a", "e.b").distinct()
        edges = stage(small, "edges")
        state = edges.agg(
            F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")
        ).first()
        if before == state:
            break
        before = state
    roots = edges.select(F.col("b").alias("node")).distinct().withColumn("root", F.col("node"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until no column has it."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name = "_" + name
    return name


def text_batches(batches: Iterator, rows: int) -> Iterator:
    """Arrow batches cut to at most ``rows`` rows.  After the last one, a worker that goes on to
    other tasks gives the memory of the batches back."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    pa.default_memory_pool().release_unused()
