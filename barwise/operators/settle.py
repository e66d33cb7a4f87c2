"""Cutting lineage between the stages of a job, so that plans stay small and lost tasks are read again."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that the session names in spark.checkpoint.dir, which all executors share.

    Only a local session without one gets a temporary folder; on a cluster that would be lost with its
    machine, so it is an error there.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="checkpoints-"))
    return sc.getCheckpointDir()


def settled(df: DataFrame) -> DataFrame:
    """Compute `df` once and cut its lineage through the shared checkpoint folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()
