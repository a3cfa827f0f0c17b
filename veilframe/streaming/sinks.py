"""Running a streaming query over what is available, and exactly-once table sinks."""

from __future__ import annotations

from collections.abc import Callable
from inspect import signature

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from veilframe.sources.stage import stage_path

BatchFn = Callable[[DataFrame], DataFrame] | Callable[[DataFrame, int], DataFrame]


def read_stream(
    spark: SparkSession, path: str, schema: str | object, files_per_trigger: int | None = None
) -> DataFrame:
    """A parquet folder (or file) as a stream."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def append_to_table(
    df: DataFrame, path: str, checkpoint: str, available_now: bool = True
) -> StreamingQuery:
    """Append a stateless or append-mode stream to a parquet table."""
    writer = df.writeStream.format("parquet").option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start(path)


def batches_to_table(
    df: DataFrame,
    path: str,
    checkpoint: str,
    batch_fn: BatchFn | None = None,
    output_mode: str = "append",
    available_now: bool = True,
) -> StreamingQuery:
    """Write each micro-batch, after ``batch_fn``, to its own partition ``batch=N``.

    A batch that is run again after a failure overwrites its partition, so every row
    arrives once; the batch number orders updates.  ``batch_fn`` may take it as well.
    """
    numbered = batch_fn is not None and len(signature(batch_fn).parameters) > 1

    def write(batch: DataFrame, epoch: int) -> None:
        out = batch if batch_fn is None else batch_fn(batch, epoch) if numbered else batch_fn(batch)
        out.write.mode("overwrite").parquet(f"{path}/batch={epoch}")

    writer = (
        df.writeStream.outputMode(output_mode)
        .option("checkpointLocation", checkpoint)
        .foreachBatch(write)
    )
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def drain(start: Callable[[str, str], StreamingQuery], spark: SparkSession, name: str) -> str:
    """Run a query over all available input; returns the folder of its table.

    A stream keeps the number of state partitions it starts with, and each costs a task per
    micro-batch, so it is set to the cores at hand and not to the session's default.
    """
    path = stage_path(spark, name)
    partitions = "spark.sql.shuffle.partitions"
    default = spark.conf.get(partitions)
    spark.conf.set(partitions, str(spark.sparkContext.defaultParallelism))
    try:
        start(f"{path}/table", f"{path}/checkpoint").awaitTermination()
    finally:
        spark.conf.set(partitions, default)
    return f"{path}/table"
