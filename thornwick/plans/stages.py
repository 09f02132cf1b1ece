"""Cuts in plans: what many branches read is computed once."""

from __future__ import annotations

import tempfile
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession


def kept(df: DataFrame) -> DataFrame:
    """df computed once: a checkpoint in the shared folder where one is set, else in the session's cache (spilling to disk)."""
    spark = df.sparkSession
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return df.checkpoint() if found else df.persist(StorageLevel.MEMORY_AND_DISK)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder's path below the cluster's shared one (spark.checkpoint.dir); a temporary one where that is unset, in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no shared folder")
        found = tempfile.mkdtemp(prefix="thornwick-")
    return f"{found.rstrip('/')}/{name}-{uuid.uuid4().hex}"
