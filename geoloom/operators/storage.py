"""Intermediate tables that outlive executors."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or what the session's context was given. Where neither is
    set, a session that is one process (master local, as in tests) gets a temporary one; a cluster has to name one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="geoloom-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def durable(df: DataFrame, *by: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder, partitioned by its last columns where they are named."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/geoloom-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
