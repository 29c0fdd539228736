"""Shared scratch space and lineage cuts that survive executor loss."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder under the one that all executors share, named by the session's ``spark.checkpoint.dir``. Without that key there is
    no place that every executor can read, so it is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4()}"


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the checkpoint folder and read it back, so that a lost executor costs a re-read and loops do not grow the plan."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(scratch(df.sparkSession, "checkpoints"))
    return df.checkpoint()
