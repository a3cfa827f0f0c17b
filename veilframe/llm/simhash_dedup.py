"""SimHash near-duplicates by covering locality-sensitive hashing.

Every bit position gets a non-zero vector of ``radius + 1`` bits; every non-zero vector v of
that length gives a mask of the positions whose vector has an odd product with v.  At most
``radius`` differing positions span at most ``radius`` dimensions, so some v is orthogonal
to all of them: under its mask the two fingerprints are equal.  Every pair within the radius
therefore meets in at least one of the ``2 ** (radius + 1) - 1`` tables.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.llm.common import components, text_batches
from veilframe.sources.stage import stage

BITS = 64
CHUNK = 1 << 16


def covering_masks(radius: int, bits: int = BITS) -> list[int]:
    """The masks as unsigned integers; any two words within ``radius`` agree under one."""
    size = (1 << (radius + 1)) - 1
    order = [i % size + 1 for i in range(bits)]
    masks = []
    for v in range(1, size + 1):
        masks.append(sum(1 << i for i, m in enumerate(order) if (m & v).bit_count() & 1))
    return masks


def signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def words(text: str | None) -> list[bytes]:
    """Runs of bytes other than the six ASCII white spaces, A-Z in lower case."""
    return text.encode("utf-8").lower().split() if text else []


def shingles(tokens: list[bytes], n: int) -> list[bytes]:
    """All runs of ``n`` words; the whole sequence if there are fewer; none for no word."""
    if len(tokens) <= n:
        return [b" ".join(tokens)] if tokens else []
    return [b" ".join(t) for t in zip(*(tokens[i:] for i in range(n)))]


def majority(hashes: np.ndarray) -> int:
    """The 64-bit word whose bits are set in over half of the hashes."""
    if not len(hashes):
        return 0
    votes = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), CHUNK):
        raw = hashes[at : at + CHUNK].astype(">u8").view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(raw, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > len(hashes)).tobytes(), "big")


def fingerprint(text: str | None, n: int) -> int:
    digest = xxhash.xxh64_intdigest
    found = [digest(s, 42) for s in shingles(words(text), n)]
    return majority(np.array(found, dtype=np.uint64))


def fingerprints(docs: DataFrame, id_col: str, text_col: str, n: int = 3) -> DataFrame:
    """``id_col, fp``: one row per row, whole texts; a null or empty text has fingerprint 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches, 256):
            fps = [signed(fingerprint(t.as_py(), n)) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], ["id", "fp"])

    kept = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return kept.mapInArrow(run, "id long, fp long")


def _distance(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def fingerprint_links(nodes: DataFrame) -> DataFrame:
    """``a, b``: links between distinct fingerprints (column ``fp``) that connect exactly
    those within two bits of each other, without comparing all pairs of a table entry.

    An entry of the seven covering tables with two fingerprints is one comparison.  The
    fingerprints of fuller entries are expanded to all words within one bit: two of them are
    within two bits exactly if they share such a word.  A word has at most 65 fingerprints
    around it, so these groups are bounded, and each links to its smallest member.
    """
    tables = F.array(
        *(
            F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("key"))
            for t, m in enumerate(covering_masks(2))
        )
    )
    keyed = nodes.select("fp", F.explode(tables).alias("e")).select("fp", "e.t", "e.key")
    entries = stage(
        keyed.groupBy("t", "key")
        .agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b"))
        .filter("n > 1"),
        "entries",
    )
    pairs = entries.filter("n = 2").filter(_distance("a", "b") <= 2).select("a", "b")
    full = entries.filter("n > 2").select("t", "key")
    crowded = keyed.join(full, ["t", "key"], "left_semi").select("fp").distinct()
    near = F.array(
        F.col("fp"), *(F.col("fp").bitwiseXOR(F.lit(signed(1 << i))) for i in range(BITS))
    )
    hubs = (
        crowded.select("fp", F.explode(near).alias("word"))
        .groupBy("word")
        .agg(F.collect_list("fp").alias("fps"))
        .filter(F.size("fps") > 1)
        .select(F.array_min("fps").alias("a"), F.explode("fps").alias("b"))
        .filter("a <> b")
    )
    return pairs.unionByName(hubs).distinct()


def simhash_components(docs: DataFrame, id_col: str, text_col: str, n: int = 3) -> DataFrame:
    """``id, fp, component_id``: fingerprints within two bits are linked, and every row gets
    the smallest id that it can reach, itself included.

    A null or empty text has fingerprint zero and is linked like any other.  Rows that repeat
    an id stay as they are; a row with a null id stays and takes part in links, and the
    component has the smallest id that is not null, or null.  Other columns are not read.
    """
    fps = stage(fingerprints(docs, id_col, text_col, n), "fingerprints")
    nodes = stage(fps.groupBy("fp").agg(F.min("id").alias("least")), "nodes")
    roots = components(fingerprint_links(nodes.select("fp")))
    placed = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn(
        "root", F.coalesce("root", "fp")
    )
    placed = stage(placed, "placed")
    ids = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = placed.join(ids, "root").select("fp", "component_id")
    return fps.join(by_fp, "fp").select("id", "fp", "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 3) -> DataFrame:
    """The rows of ``docs`` of one document of each component, the one with the smallest id.

    Rows of one id are one document, of which one row stays: it is a component's first document
    if any of its texts is.  Rows with a null id stay as they are.  Only ids are joined back to
    the rows, and where no id is repeated no text is moved but for that join.
    """
    found = simhash_components(docs, id_col, text_col, n).filter("id is not null")
    first = F.max(F.col("component_id") == F.col("id"))
    by_id = found.groupBy("id").agg(first.alias("first"), F.count("*").alias("rows")).filter("not first or rows > 1")
    odd = stage(by_id, "copies").withColumnRenamed("id", "_id")
    once = docs.join(odd, docs[id_col].cast("long") == odd["_id"], "left_anti")
    again = docs.join(odd.filter("first").select("_id"), docs[id_col].cast("long") == F.col("_id"), "left_semi")
    return once.unionByName(again.dropDuplicates([id_col]))


def hex_word(column: str) -> Column:
    """A 64-bit word as 16 lower-case hex digits."""
    return F.lower(F.lpad(F.hex(column), 16, "0"))
