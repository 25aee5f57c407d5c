"""Cutting lineage in loops, through the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only where that is unset (local tests) a folder is made."""
    found = spark.sparkContext._jsc.sc().getCheckpointDir()
    folder = spark.conf.get("spark.checkpoint.dir", None) or (found.get() if found.isDefined() else None)
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    folder = folder or "file://" + tempfile.mkdtemp(prefix="quillspark-")
    if not found.isDefined():
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder there."""
    return f"{shared(spark)}/quillspark/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """``df`` checkpointed in the shared folder."""
    shared(df.sparkSession)
    return df.checkpoint()


def spread(df: DataFrame) -> DataFrame:
    """``df`` over as many partitions as there are cores, where a few large files would keep most of them idle; for
    functions that cost far more than moving their rows.  Tables of more partitions stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
