"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees: spark.checkpoint.dir; where that is unset and Spark runs in this process alone (tests), a temporary one."""
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not configured:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that every executor can read and write")
        configured = tempfile.mkdtemp(prefix="metasift-")
        sc.setCheckpointDir(configured)
    elif sc.getCheckpointDir() is None:
        sc.setCheckpointDir(configured)
    return configured


def settle(df: DataFrame) -> DataFrame:
    """Compute ``df`` once and keep it in the shared folder, where a lost executor can't take it along."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def tidy() -> None:
    """Gives what Arrow holds for later back to the system: a Python worker goes on to other tasks and operators."""
    pa.default_memory_pool().release_unused()


def fresh_path(spark: SparkSession, kind: str) -> str:
    """A new path in the shared folder, under the application's own, so that all an application wrote can be removed at once."""
    return f"{shared_dir(spark).rstrip('/')}/{spark.sparkContext.applicationId}/{kind}-{uuid.uuid4().hex}"
