"""Which of many strings stand in which texts, without comparing all with all.

Every string is filed under the hash of one of its pieces of ``PIECE`` characters (a shorter
one under itself), the piece that the fewest strings share, so that a common domain or key
header brings nothing together.  The hashes in use make a Bloom filter of bounded size.  The
scan of the texts tests every piece of a text against it, and only what passes leaves the
scan: rows in the exchange grow with the candidates and not with the text.  A candidate is
checked in full.

Pieces are hashed in numpy, all windows of a text at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.functions.tokens import quote
from veilframe.sources.stage import stage

PIECE = 8
BITS_PER_STRING = 16
LEAST_BITS, MOST_BITS = 1 << 16, 1 << 26  # the largest filter is 8 MB; beyond it, more passes to the join
SLICE = 256  # rows whose pieces a task holds at once


def piece_hashes(text: str, size: int) -> np.ndarray:
    """A 64-bit hash of every run of ``size`` characters."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    n = len(points) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    found = np.full(n, size, np.uint64)
    for i in range(size):
        found = found * np.uint64(0x9E3779B97F4A7C15) + points[i : i + n]
        found ^= found >> np.uint64(29)
    found *= np.uint64(0xBF58476D1CE4E5B9)
    return found ^ (found >> np.uint64(32))


def bit_places(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    mask = np.uint64(bits - 1)
    return hashes & mask, (hashes >> np.uint64(32)) & mask


def passes(hashes: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Whether both bits of each hash are set."""
    out = np.ones(len(hashes), bool)
    for at in bit_places(hashes, 64 * len(words)):
        out &= words[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1) == 1
    return out


def file_strings(strings: DataFrame) -> DataFrame:
    """``value, piece``: each string of ``strings (value)`` with the hash it is filed under."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                values = batch.column(0).slice(at, SLICE)
                found = [np.unique(piece_hashes(v, min(len(v), PIECE))) for v in values.to_pylist()]
                rows = np.repeat(np.arange(len(values)), [len(f) for f in found])
                yield pa.RecordBatch.from_arrays(
                    [values.take(pa.array(rows)), pa.array(np.concatenate(found).view(np.int64))], ["value", "piece"])

    kept = strings.filter("value <> ''").select("value").distinct()
    pieces = kept.mapInArrow(cut, "value string, piece long")
    shared = pieces.groupBy("piece").agg(F.count("*").alias("_n"))
    return pieces.join(shared, "piece").groupBy("value").agg(F.min(F.struct("_n", "piece"))["piece"].alias("piece"))


def filter_words(filed: DataFrame) -> np.ndarray:
    """The Bloom filter over the pieces of a staged table, as 64-bit words."""
    n = filed.count()
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (BITS_PER_STRING * n).bit_length()))
    places = F.array(F.col("piece").bitwiseAND(F.lit(bits - 1)),
                     F.shiftrightunsigned("piece", 32).bitwiseAND(F.lit(bits - 1)))
    set_bits = filed.select(F.explode(places).alias("at")).select(
        F.shiftright("at", 6).alias("word"), F.expr("shiftleft(1L, CAST(at & 63 AS INT))").alias("bit"))
    table = set_bits.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()  # no more rows than words
    words = np.zeros(bits >> 6, np.uint64)
    words[table.column("word").to_numpy()] = table.column("bits").to_numpy().view(np.uint64)
    return words


def asked_pieces(df: DataFrame, keys: list[str], text: Column, filed: DataFrame) -> DataFrame:
    """``keys, piece``: the different pieces of each text that pass the filter."""
    spark = df.sparkSession
    sizes = sorted(r[0] for r in filed.select(F.least(F.length("value"), F.lit(PIECE))).distinct().collect())
    words = spark.sparkContext.broadcast(filter_words(filed))
    rows = df.select(*[F.col(quote(k)) for k in keys], text.cast("string").alias("_text"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                found = []
                for t in part.column(part.num_columns - 1).to_pylist():
                    met = [h[passes(h, words.value)] for s in sizes if t for h in [piece_hashes(t, s)]]
                    found.append(np.unique(np.concatenate(met)) if met else np.zeros(0, np.uint64))
                index = pa.array(np.repeat(np.arange(part.num_rows), [len(f) for f in found]))
                pieces = pa.array(np.concatenate(found).view(np.int64), pa.int64())
                yield pa.RecordBatch.from_arrays([*(part.column(i).take(index) for i in range(len(keys))), pieces], [*keys, "piece"])

    kinds = [f"{quote(k)} {rows.schema[k].dataType.simpleString()}" for k in keys]
    return rows.mapInArrow(scan, ", ".join([*kinds, "piece long"]))


def possible(df: DataFrame, keys: list[str], text: str, filed: DataFrame) -> DataFrame:
    """``keys, value``: the strings whose piece stands in the text of each row, among them all that
    stand there themselves.  The texts do not leave their scan."""
    return asked_pieces(df, keys, F.col(quote(text)), filed).join(filed, "piece").select(*keys, "value")


def occurrences(df: DataFrame, keys: list[str], text: str, strings: DataFrame) -> DataFrame:
    """``keys, value``: the strings of ``strings (value)`` that stand in the text of each row.

    A string counts wherever it stands, also inside a longer word.  ``keys`` must tell rows
    apart; texts that share their keys are each asked for what any of them holds.  Null and
    empty texts and strings meet nothing.
    """
    candidates = possible(df, keys, text, stage(file_strings(strings), "filed"))
    return candidates.join(df.select(*keys, F.col(quote(text)).alias("_text")), keys).filter(
        F.contains("_text", F.col("value"))).select(*keys, "value")
