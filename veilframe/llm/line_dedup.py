"""Line deduplication with two Bloom filters.

1. Every document adds the hashes of its different long lines to a pair of Bloom filters: bits
   seen once, and bits seen twice.  Both bits of a hash lie in one segment of the filter; tasks
   send what they have seen by segment, packed, and each segment is merged on its own:
   ``twice |= their twice | (once & their once)``, ``once |= their once``.
2. A line that two documents share has its bits in the second filter.  A second scan takes the
   lines that look so, and only these are shuffled: grouped by the line itself, which confirms
   or clears the suspicion, with the smallest document id as the one that keeps it.
3. The lines to drop go back to their texts as line numbers.

The filter has 16 bits for every line of the corpus, so that about one line in a hundred is
suspected wrongly, up to ``MOST_BITS``; beyond that, more lines go through to the exact step,
which costs shuffle and never a result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.llm.common import text_batches
from veilframe.sources.stage import stage

LEAST_CHARS = 10
WHITE = b" \t\n\x0b\x0c\r"
SEGMENT_BITS = 16
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 30  # the largest filter is 128 MB in the driver and in each worker
PER_LINE = 16
HOT = 1000  # a line with more than this part of all suspects is joined by broadcast
FLUSH = 1 << 19  # hashes that a task holds before it sends them


def key_of(line: bytes) -> bytes | None:
    """What makes two lines the same: stripped, A-Z in lower case; None if it is short."""
    key = line.strip(WHITE).lower()  # on bytes, only ASCII letters change
    if len(key) >= 4 * LEAST_CHARS or (
            len(key) >= LEAST_CHARS and sum(b & 0xC0 != 0x80 for b in key) >= LEAST_CHARS):
        return key
    return None


def places(hashes: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The segment of each hash and its two bits in it."""
    low = np.uint64((1 << SEGMENT_BITS) - 1)
    return (hashes >> np.uint64(2 * SEGMENT_BITS)) % np.uint64(segments), hashes & low, (hashes >> np.uint64(SEGMENT_BITS)) & low


def seen(found: np.ndarray, segments: int) -> pa.RecordBatch:
    """A pair of filters in sparse form: per segment, the bits set once and those set twice."""
    segment, one, two = places(found, segments)
    two = np.where(one == two, two ^ np.uint64(1), two)  # two bits that differ, so that one hash sets none twice
    bits, counts = np.unique(np.concatenate([segment << np.uint64(SEGMENT_BITS) | b for b in (one, two)]), return_counts=True)
    at = (bits >> np.uint64(SEGMENT_BITS)).astype(np.int64)
    low = (bits & np.uint64((1 << SEGMENT_BITS) - 1)).astype("<u2")
    starts = np.flatnonzero(np.diff(at, prepend=-1))
    parts = zip(np.split(low, starts[1:]), np.split(counts > 1, starts[1:]))
    once, twice = zip(*((x[~t].tobytes(), x[t].tobytes()) for x, t in parts))
    return pa.RecordBatch.from_arrays(
        [pa.array(at[starts], pa.int64()), pa.array(once, pa.binary()), pa.array(twice, pa.binary())], ["segment", "once", "twice"])


def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One segment's second filter, from what all tasks have seen."""
    once, twice = (np.zeros(1 << SEGMENT_BITS, bool) for _ in range(2))
    segment = None
    for batch in batches:
        for s, a, b in zip(*batch.columns):
            segment = s.as_py()
            a, b = (np.frombuffer(x.as_py(), "<u2") for x in (a, b))
            twice[a] |= once[a]
            twice[b] = True
            once[a] = once[b] = True
    yield pa.RecordBatch.from_arrays(
        [pa.array([segment], pa.int64()), pa.array([np.packbits(twice, bitorder="little").tobytes()], pa.binary())],
        ["segment", "bits"])


def hashes_of(text: bytes | None) -> np.ndarray:
    """Hashes of the text's different long lines."""
    keys = {k for line in (text or b"").split(b"\n") if (k := key_of(line)) is not None}
    return np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys))


def seen_twice(body: DataFrame, segments: int) -> np.ndarray:
    """The second filter over the texts of ``body (id, text)``, as bytes by segment."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in text_batches(batches, 256):
            for text in batch.column("text"):
                held.append(hashes_of(text.as_py()))
                size += len(held[-1])
                if size >= FLUSH:
                    yield seen(np.concatenate(held), segments)
                    held, size = [], 0
        if size:
            yield seen(np.concatenate(held), segments)

    merged = body.mapInArrow(scan, "segment long, once binary, twice binary").groupBy("segment").applyInArrow(
        merge, "segment long, bits binary")
    out = np.zeros((segments, 1 << (SEGMENT_BITS - 3)), np.uint8)
    for r in merged.toLocalIterator():
        out[r["segment"]] = np.frombuffer(r["bits"], np.uint8)
    return out


def suspects(body: DataFrame, twice: np.ndarray) -> DataFrame:
    """``id, digest, key, lines``: the different lines of a text that are in the second filter,
    with their numbers in the text."""
    held = body.sparkSession.sparkContext.broadcast(twice)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = held.value
        flat, segments = bits.ravel(), len(bits)
        for batch in text_batches(batches, 256):
            rows: list[tuple] = []
            for i, digest, text in zip(*batch.columns):
                where: dict[bytes, list[int]] = {}
                for n, line in enumerate((text.as_py() or b"").split(b"\n")):
                    if (key := key_of(line)) is not None:
                        where.setdefault(key, []).append(n)
                segment, one, two = places(np.fromiter(map(xxhash.xxh3_64_intdigest, where), np.uint64, len(where)), segments)
                two = np.where(one == two, two ^ np.uint64(1), two)
                both = True
                for b in (one, two):
                    at = (segment << np.uint64(SEGMENT_BITS) | b).astype(np.int64)
                    both &= flat[at >> 3] >> (at & 7).astype(np.uint8) & 1 == 1
                rows += ((i.as_py(), digest.as_py(), k, n) for (k, n), met in zip(where.items(), both) if met)
            kinds = ("id", pa.int64()), ("digest", pa.int64()), ("key", pa.binary()), ("lines", pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[j] for r in rows], kind) for j, (_, kind) in enumerate(kinds)], [n for n, _ in kinds])

    return body.mapInArrow(scan, "id long, digest long, key binary, lines array<int>")


def lines_to_drop(body: DataFrame, segments: int) -> DataFrame:
    """``id, digest, lines``: the numbers of the lines that a text loses, for texts that lose any.

    A line that over a thousandth of all suspects have meets them by broadcast: there are less
    than a thousand such lines, known by their hashes.  All others are joined by shuffle, so no
    line sends more than that share to one task.
    """
    found = stage(suspects(body, seen_twice(body, segments)), "suspects")
    # null ids are one document that comes after all others
    order = F.struct(F.col("id").isNull().alias("none"), "id")
    shared = found.groupBy("key").agg(
        F.min("id").alias("keeper"), F.max("id").alias("last"), F.max(F.col("id").isNull()).alias("none"), F.count("*").alias("met")
    ).filter((F.col("keeper") < F.col("last")) | (F.col("keeper").isNotNull() & F.col("none")))
    shared = stage(shared.select("key", "keeper", "met"), "shared")
    often = F.col("met") * HOT > found.count()
    hot = F.broadcast(shared.filter(often).select(F.sha2("key", 256).alias("name"), "keeper"))
    named = found.withColumn("name", F.sha2("key", 256))
    met = named.join(hot, "name").select("id", "digest", "lines", "keeper").unionByName(
        named.join(hot, "name", "left_anti").join(shared.filter(~often), "key").select("id", "digest", "lines", "keeper"))
    lost = met.filter(order != F.struct(F.lit(False).alias("none"), F.col("keeper").alias("id")))
    return lost.groupBy("id", "digest").agg(F.flatten(F.collect_set("lines")).alias("lines"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_lines, n_dropped, kept``: every row's text without the lines that an earlier
    document has.

    Lines end at ``\\n``.  Two lines are the same if they are equal without white space at both
    ends and with A-Z in lower case; those under ten code points are left alone.  A line that
    two documents or more hold stays in the one with the smallest id, with all its occurrences
    there, and goes in all others.

    Null and empty texts are one empty line.  Rows of one id are one document, so a line that
    only they hold stays; null ids are one document after all others.  Rows, repeated ones
    too, stay; further columns are not looked at.  An empty table gives none.
    """
    body = docs.select(
        F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("digest"),
        F.col(text_col).cast("binary").alias("text"))
    lines = F.sum(F.octet_length(text_col) - F.octet_length(F.replace(F.col(text_col), F.lit("\n"), F.lit(""))) + 1)
    n = docs.agg(F.coalesce(lines, F.lit(0))).first()[0]
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (PER_LINE * n).bit_length()))
    drop = lines_to_drop(body, bits >> SEGMENT_BITS)
    drop = stage(drop, "drop").select(F.col("id").alias("_id"), F.col("digest").alias("_digest"), "lines")
    same = F.col("id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches, 256):
            kept, counts = [], []
            for text, out in zip(batch.column(1), batch.column(2)):
                held = (text.as_py() or b"").split(b"\n")
                out = set(out.as_py() or ())
                kept.append(b"\n".join(x for n, x in enumerate(held) if n not in out) if out else text.as_py() or b"")
                counts.append((len(held), len(out)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array([c[j] for c in counts], pa.int64()) for j in range(2)), pa.array(kept, pa.binary())],
                ["id", "n_lines", "n_dropped", "kept"])

    found = body.join(drop, same, "left").select("id", "text", "lines").mapInArrow(
        cut, "id long, n_lines long, n_dropped long, kept binary")
    return found.select(F.col("id").alias(id_col), "n_lines", "n_dropped", F.col("kept").cast("string").alias("kept"))
