"""The folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_root(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Where that is unset, a temporary one, on one machine only."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="terravane-"))
        named = context.getCheckpointDir()
    return named.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A path below the shared root that nothing else uses."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
