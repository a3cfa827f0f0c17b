"""Staged tables: an expensive frame that several jobs read is written once."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from veilframe.session import checkpoint_dir


def stage_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/veilframe/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write the frame to the shared folder and read it back.

    The result survives the loss of any executor and cuts the lineage; readers of a few
    columns scan just those.  The folder is the caller's to clean, as with a checkpoint.
    """
    path = stage_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
