"""Looking backwards in an order, without ever putting one key into one task.

A plain window ``PARTITION BY key ORDER BY position`` sends a hot key (one stream, one
token, or the global timeline) to a single task.  Here positions are cut into blocks of a
fixed width; a window only ever spans a block.  What a block needs from the rows before it
is carried over from the last rows of earlier blocks, one row per block, by the same method
or, at the last level, by a plain window over so few rows that it may.

The rows are shuffled once, by key and block: the block ends are read from the same
exchange, and the carried values meet the rows on the same partitioning.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilframe.sources.stage import stage


class _Latest:
    """The last non-null value."""

    def add(self, df: DataFrame, by: list[str], order: list[str], column: str) -> DataFrame:
        """Add ``_before`` and ``_through``: the summary without and with each row."""
        window = (W.partitionBy(*by) if by else W).orderBy(*order)
        last = F.last(column, ignorenulls=True)
        first = W.unboundedPreceding
        return df.withColumns(
            {
                "_before": last.over(window.rowsBetween(first, -1)),
                "_through": last.over(window.rowsBetween(first, 0)),
            }
        )

    def join(self, carried: Column, local: Column) -> Column:
        return F.coalesce(local, carried)


def _look_back(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    column: str,
    out: str,
    summary: _Latest,
    inclusive: bool,
    width: int,
    fanout: int,
    levels: int,
) -> DataFrame:
    """Add ``out``, the summary of ``column`` over the earlier rows of the same key, with
    the row itself where ``inclusive``."""
    mine = "_through" if inclusive else "_before"
    other = "_before" if inclusive else "_through"
    if levels == 0:
        local = summary.add(df, keys, order, column)
        return local.drop(other).withColumnRenamed(mine, out)
    block, carry = f"_block{levels}", f"_carry{levels}"
    work = df.withColumn(block, F.floor(F.col(order[0]) / F.lit(width)).cast("bigint"))
    local = summary.add(work, [*keys, block], order, column)
    ends = (
        local.withColumn(
            "_more", F.lead(F.lit(1)).over(W.partitionBy(*keys, block).orderBy(*order))
        )
        .filter("_more IS NULL")
        .select(*keys, block, F.col("_through").alias("_e"))
    )
    carried = _look_back(
        ends, keys, [block], "_e", carry, summary, False, fanout, fanout, levels - 1
    ).select(*keys, block, carry)
    return (
        local.drop(other)
        .join(carried, [*keys, block], "left")
        .withColumn(mine, summary.join(F.col(carry), F.col(mine)))
        .drop(block, carry)
        .withColumnRenamed(mine, out)
    )


def latest_before(
    df: DataFrame,
    keys: list[str],
    position: str,
    value: Column,
    out: str,
    tie: list[str] | None = None,
    width: int = 4096,
    fanout: int = 4096,
    levels: int = 2,
) -> DataFrame:
    """Add ``out``: the last non-null ``value`` at or before each row of the same key.

    ``position`` is a bigint column; ``tie`` orders rows of equal position.  ``width`` is
    the block width in units of ``position``, ``fanout`` the number of blocks in a block of
    the next level.
    """
    order = [position, *(tie or [])]
    work = df.withColumn("_v", value)
    return _look_back(
        work, keys, order, "_v", out, _Latest(), True, width, fanout, levels
    ).drop("_v")


def _tails_sorted(df: DataFrame, by: list[str], position: str, size: int, ends: bool) -> DataFrame:
    """One pass over the rows sorted by ``by`` and ``position``: adds ``_before``, the last
    ``size`` characters of the column ``_t`` before each row of its group; with ``ends`` yields
    instead a row per group, ``by`` and ``_e``, those characters at its end."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, tail = None, ""
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in by), strict=True)
            found, closed = [], []
            for key, text in zip(rows, batch.column("_t").to_pylist(), strict=True):
                if key != group:
                    if group is not None:
                        closed.append((*group, tail))
                    group, tail = key, ""
                found.append(tail)
                if text:
                    tail = text if len(text) >= size else (tail + text)[-size:]
            if not ends:
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string())], [*batch.schema.names, "_before"])
            elif closed:
                yield listed(closed, batch.schema)
        if ends and group is not None:
            yield listed([(*group, tail)], batch.schema)

    def listed(closed: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
        types = [*(schema.field(c).type for c in by), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*closed), types, strict=True)], [*by, "_e"])

    kept = df.select(*by, position, "_t") if ends and position not in by else df
    kinds = T.StructType([kept.schema[c] for c in (by if ends else kept.columns)]).add("_e" if ends else "_before", "string")
    return kept.repartition(*by).sortWithinPartitions(*by, position).mapInArrow(scan, kinds)


def preceding_tail(
    df: DataFrame,
    keys: list[str],
    position: str,
    text: Column,
    size: int,
    out: str,
    width: int = 65536,
    levels: int = 1,
) -> DataFrame:
    """Add ``out``: the last ``size`` characters of all text before each row of its key.

    ``position`` is the row's ordinal in its key.  The rows are shuffled and sorted once and
    read in one pass.  Only where a key goes beyond its first block of ``width`` positions
    is anything carried on: the ends of the blocks of such keys, a row per block, look back by
    the same method.  The input is read twice, or more where there are such keys, so give a
    stored table or a cheap projection.
    """
    work = df.withColumn("_t", F.right(text, F.lit(size)))
    if not levels:
        return _tails_sorted(work, keys, position, size, False).drop("_t").withColumnRenamed("_before", out)
    block, carry = f"_block{levels}", f"_carry{levels}"
    work = work.withColumn(block, F.floor(F.col(position) / F.lit(width)).cast("bigint"))
    local = _tails_sorted(work, [*keys, block], position, size, False).drop("_t")
    beyond = df.filter((F.col(position) >= width) | (F.col(position) < 0))
    if beyond.isEmpty():
        return local.drop(block).withColumnRenamed("_before", out)
    long = work.join(beyond.select(*keys).distinct(), keys, "left_semi")
    ends = stage(_tails_sorted(long, [*keys, block], position, size, True), "ends")
    carried = preceding_tail(ends, keys, block, F.col("_e"), size, carry, width, levels - 1).select(*keys, block, carry)
    tail = F.right(F.concat(F.coalesce(carry, F.lit("")), "_before"), F.lit(size))
    return local.join(carried, [*keys, block], "left").withColumn(out, tail).drop("_before", block, carry)


def with_positions(df: DataFrame, order: list[str], out: str = "_pos") -> DataFrame:
    """The rows, staged, with their ordinal from 0 in a total order as column ``out``.

    A range sort puts the rows in order over many tasks, each numbers its own, and the rows
    before each task, one number per task, are added up on the driver.
    """
    placed = stage(df.orderBy(*order).withColumn(out, F.monotonically_increasing_id()), "ordered")
    task, row = F.shiftright(out, 33), F.col(out).bitwiseAND(F.lit((1 << 33) - 1))
    counts = sorted((r[0], r[1]) for r in placed.groupBy(task.cast("int")).count().collect())
    before, offsets = 0, []
    for number, n in counts:
        offsets.append((number, before))
        before += n
    tasks = F.broadcast(df.sparkSession.createDataFrame(offsets, "_task int, _before long"))
    return placed.withColumn("_task", task.cast("int")).join(tasks, "_task", "left").withColumn(
        out, row + F.col("_before")).drop("_task", "_before")


def over_last(
    df: DataFrame, pos: str, size: int, out: dict[str, Column], width: int = 65536
) -> DataFrame:
    """Add aggregates over each row and the ``size - 1`` rows before it, by position ``pos``
    (ordinals without a gap).

    Positions are cut into blocks, and each block gets the last ``size - 1`` rows of the one
    before as well, so no task holds more than a block.
    """
    if size > width:
        raise ValueError("a frame must fit into a block")
    block = F.floor(F.col(pos) / F.lit(width)).cast("bigint")
    carried = df.filter(F.col(pos) % width > width - size)
    both = df.withColumns({"_block": block, "_own": F.lit(True)}).unionByName(
        carried.withColumns({"_block": block + 1, "_own": F.lit(False)}))
    frame = W.partitionBy("_block").orderBy(pos).rowsBetween(1 - size, 0)
    return both.withColumns({name: agg.over(frame) for name, agg in out.items()}).filter("_own").drop("_block", "_own")
