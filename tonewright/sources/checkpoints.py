"""Cutting a lineage in the folder all executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's ``spark.checkpoint.dir``; only where a local session (a test) names none, a temporary folder."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None and not context.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    context.setCheckpointDir(named or tempfile.mkdtemp(prefix="tonewright-checkpoint-"))


def cut(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared checkpoint folder, so that later actions read it instead of computing it again."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
