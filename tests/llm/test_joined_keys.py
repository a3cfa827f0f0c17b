"""Training-data operators whose joins must not outgrow the driver."""

from __future__ import annotations

from pyspark.sql import functions as F

from veilframe.llm.fingerprints import within_radius


def test_table_keys_are_not_broadcast(spark):
    """A fingerprint has 28 keys, but Spark sizes what is exploded as if it had one (op10, F1)."""
    prints = spark.range(200).select(
        F.when(F.col("id") < 8, F.lit(1) + F.col("id")).otherwise(F.xxhash64("id")).alias("hi"),
        F.when(F.col("id") < 8, F.lit(0)).otherwise(F.xxhash64("id", "id")).alias("lo"))
    found = within_radius(prints, prints.filter("hi BETWEEN 1 AND 8"))
    near = {(r.qhi, r.hi, r.distance) for r in found.collect()}
    assert near == {(a, b, (a ^ b).bit_count()) for a in range(1, 9) for b in range(1, 9)}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
