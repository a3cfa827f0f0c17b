"""Session defaults, and the one place that decides whether an input needs spreading."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

ROW_GROUP_BYTES = 128 * 1024 * 1024


def build_session(master: str | None = None, app: str = "veilframe", **conf: str) -> SparkSession:
    """A session with UTC timestamps and adaptive execution on.

    Cluster settings (executors, shuffle partitions) are left to the caller.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names.

    A local folder stands in only where none is named and Spark runs in one process, as in
    tests: on a cluster other machines could not read it.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder all executors can read")
    return os.path.join(tempfile.gettempdir(), "veilframe-checkpoint")


def spread(df: DataFrame, *by: str, tasks: int = 1) -> DataFrame:
    """Use all cores for a small input that sits in one or two row groups.

    Regex work is CPU bound, and a row group is the smallest unit a scan can split.  An
    input with at least one row group per core is left alone, so a large table is never
    shuffled for this.  ``by`` names the columns to deal by, ``tasks`` how many tasks a core
    gets: several even out rows that take long.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores * tasks, *by) if size < cores * ROW_GROUP_BYTES else df
