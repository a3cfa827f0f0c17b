"""A vault store that grows by appends and keeps its versions.

Tokens are spread over buckets by hash, a power of two of them, chosen by the number of rows.
An append writes the new saves next to what is there, a folder per bucket it touches, and a
new manifest that lists for each bucket the folders that make it up.  A bucket is merged into
one folder when its appended rows reach half of its first folder's, or when it has many
folders; no other bucket is read or written.  A token's rows are thus rewritten a logarithmic
number of times, however small the appends are.

    data/gen=<number>/bucket=<number>   saves, at most one per token
    manifest/version=<number>           bucket, gen, n, longest, bits, tag

The manifest is written last, so a failed append leaves the last version as it was, and an
append of the same ``tag`` that was completed is not repeated.  Each version stays readable:
a job that is run again reads the vault that it read before.  One writer at a time.

The store holds originals: keep its folder from the readers of the redacted tables.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.operators.vault import SAVE_COLUMNS
from veilframe.sources.stage import stage

SAVE_SCHEMA = "token string, label string, value string, saved_at timestamp, request_id long, ord long"
MANIFEST_SCHEMA = "bucket int, gen int, n long, longest int, bits int, tag string"
ROWS_PER_BUCKET = 4_000_000
MOST_FOLDERS = 8
VAULT_COLUMNS = ["token", "label", "value", "saved_at"]


class Part(NamedTuple):
    """One folder of a bucket, and the length of its longest token."""

    bucket: int
    gen: int
    n: int
    longest: int


def last_saves(saves: DataFrame) -> DataFrame:
    """The last save of each token."""
    order = F.struct("saved_at", "request_id", "ord")
    last = saves.groupBy("token").agg(F.max_by(F.struct(*SAVE_COLUMNS), order).alias("_last"))
    return last.select("_last.*")


def bucket_of(token: str, bits: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(token), 64 - bits).cast("int") if bits else F.lit(0)


class VaultStore:
    """The vault at ``path``."""

    def __init__(self, spark: SparkSession, path: str, rows_per_bucket: int = ROWS_PER_BUCKET) -> None:
        self.spark, self.path, self.rows_per_bucket = spark, path.rstrip("/"), rows_per_bucket

    # Versions

    def versions(self) -> list[int]:
        """All versions, in order; none if the store is new."""
        try:
            manifests = self.spark.read.schema(f"{MANIFEST_SCHEMA}, version int").parquet(f"{self.path}/manifest")
        except AnalysisException:
            return []
        return sorted(r[0] for r in manifests.select("version").distinct().collect())

    def latest(self) -> int:
        """The newest version, -1 if there is none."""
        return max(self.versions(), default=-1)

    def pin(self, batch: int) -> int:
        """The version that a micro-batch reads when it is run for the first time."""
        return self.latest()

    def manifest(self, version: int | None = None) -> list:
        """The rows of a manifest: one for each folder, which is no more than a few per bucket."""
        version = self.latest() if version is None else version
        if version < 0:
            return []
        return self.spark.read.schema(MANIFEST_SCHEMA).parquet(f"{self.path}/manifest/version={version}").collect()

    def longest(self, version: int | None = None) -> int:
        """The length of the longest token, from the manifest."""
        return max((r.longest for r in self.manifest(version)), default=0)

    def folder(self, gen: int, bucket: int) -> str:
        return f"{self.path}/data/gen={gen}/bucket={bucket}"

    # Writing

    def append(self, saves: DataFrame, tag: str | None = None) -> int:
        """Add saves (``token, label, value, saved_at, request_id, ord``); the new version.

        The last save of a token holds, by time, request and ordinal.
        """
        version, rows = self.latest() + 1, self.manifest()
        if tag is not None and any(r.tag == tag for r in rows):
            return version - 1
        new = last_saves(saves.select(*SAVE_COLUMNS))
        if not any(r.n for r in rows):
            return self._write_all(new, version, tag)
        bits, gen = rows[0].bits, 2 * version
        touched = self._write(new, gen, bits)
        held: dict[int, list[Part]] = {}
        for r in rows:
            held.setdefault(r.bucket, []).append(Part(r.bucket, r.gen, r.n, r.longest))
        for part in touched:
            held.setdefault(part.bucket, []).append(part)
        full = [
            parts for parts in (held[t.bucket] for t in touched)
            if len(parts) > 1 and (2 * sum(p.n for p in parts[1:]) >= parts[0].n or len(parts) > MOST_FOLDERS)
        ]
        if full:
            every = self._read((p.gen, p.bucket) for parts in full for p in parts)
            for part in self._write(last_saves(every), gen + 1, bits):
                held[part.bucket] = [part]
        self._commit([p for parts in held.values() for p in parts], bits, version, tag)
        return version

    def rebucket(self) -> int:
        """Rewrite the newest version with as many buckets as its rows ask for."""
        return self._write_all(self._saves(self.manifest()), self.latest() + 1, None)

    def _write_all(self, last: DataFrame, version: int, tag: str | None) -> int:
        last = stage(last, "vault")  # counted before it is spread over buckets
        bits = max(0, math.ceil(math.log2(max(1, last.count()) / self.rows_per_bucket)))
        self._commit(self._write(last, 2 * version + 1, bits), bits, version, tag)
        return version

    def _write(self, last: DataFrame, gen: int, bits: int) -> list[Part]:
        """Write one generation; the folders of the buckets it touches."""
        at = f"{self.path}/data/gen={gen}"
        spread = last.withColumn("bucket", bucket_of("token", bits)).repartition("bucket")
        spread.write.mode("overwrite").partitionBy("bucket").parquet(at)
        try:
            written = self.spark.read.schema(f"{SAVE_SCHEMA}, bucket int").parquet(at)
        except AnalysisException:
            return []
        counted = written.filter("bucket IS NOT NULL").groupBy("bucket").agg(
            F.count("*").alias("n"), F.max(F.length("token")).alias("longest"))
        return [Part(r.bucket, gen, r.n, r.longest) for r in counted.collect()]

    def _commit(self, parts: list[Part], bits: int, version: int, tag: str | None) -> None:
        rows = [(*p, bits, tag) for p in sorted(parts)] or [(0, -1, 0, 0, bits, tag)]
        listed = self.spark.createDataFrame(rows, MANIFEST_SCHEMA)
        listed.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/version={version}")

    # Reading

    def _read(self, parts: Iterable[tuple[int, int]]) -> DataFrame:
        paths = [self.folder(gen, bucket) for gen, bucket in parts]
        if not paths:
            return self.spark.createDataFrame([], SAVE_SCHEMA)
        return self.spark.read.schema(SAVE_SCHEMA).parquet(*paths)

    def _saves(self, rows: list) -> DataFrame:
        """The last saves of the buckets listed.  Those in one folder are read as they are."""
        held: dict[int, list[tuple[int, int]]] = {}
        for r in rows:
            if r.n:
                held.setdefault(r.bucket, []).append((r.gen, r.bucket))
        single = self._read(parts[0] for parts in held.values() if len(parts) == 1)
        several = [p for parts in held.values() if len(parts) > 1 for p in parts]
        return single.unionByName(last_saves(self._read(several))) if several else single

    def read(self, version: int | None = None, tokens: DataFrame | None = None, ttl_seconds: int | None = None) -> DataFrame:
        """``token, label, value, saved_at`` of a version, the newest by default.

        With ``tokens`` (one column) only the buckets that hold one of them are opened.  With
        ``ttl_seconds`` the tokens that had expired at the last save of the version are left
        out; the last save is looked for in all buckets.
        """
        rows = self.manifest(version)
        asked = rows
        if tokens is not None and rows:
            named = tokens.select(F.col(tokens.columns[0]).alias("token")).filter("token IS NOT NULL")
            buckets = {r[0] for r in named.select(bucket_of("token", rows[0].bits)).distinct().collect()}
            asked = [r for r in rows if r.bucket in buckets]
        vault = self._saves(asked)
        if ttl_seconds is not None:
            last = self._read((r.gen, r.bucket) for r in rows if r.n).agg(F.max("saved_at")).scalar()
            vault = vault.filter(F.col("saved_at") >= last - F.make_dt_interval(secs=F.lit(ttl_seconds)))
        return vault.select(*VAULT_COLUMNS)

    def unreferenced(self, keep: int) -> list[str]:
        """Folders that none of the last ``keep`` versions needs, for the caller to delete."""
        versions = self.versions()
        needed = {(r.gen, r.bucket) for v in versions[-keep:] for r in self.manifest(v)}
        older = {(r.gen, r.bucket) for v in versions[:-keep] for r in self.manifest(v) if r.n}
        return sorted(self.folder(*p) for p in older - needed)

