"""Folders for what a query writes and reads again."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def folder(spark: SparkSession, name: str) -> str:
    """A new folder below the one that the session names in spark.checkpoint.dir; a temporary one only in a local session without it."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root is None:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        import tempfile

        root = tempfile.mkdtemp(prefix="placefabric-")
    return f"{root}/{name}-{uuid.uuid4().hex}"
