"""Where a job cuts its lineage: a checkpoint in the folder the session names."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# how tables of pairs are written whose candidates ascend within a query: ids as differences, which take about a byte
SORTED_PARQUET = {"parquet.writer.version": "v2", "parquet.enable.dictionary#cand_id": "false"}


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; a local run without one gets its own.

    On a cluster the folder must be shared, so there it has to be configured.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="pairmatch-checkpoint-")
    context.setCheckpointDir(configured)
    return configured


def cut_lineage(df: DataFrame) -> DataFrame:
    """Compute ``df`` once into the checkpoint folder and go on from there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared checkpoint folder, for tables a job writes and reads back."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
