"""The folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def folder(spark: SparkSession, name: str) -> str:
    """A new path in ``spark.checkpoint.dir``. A local session without that setting gets a folder of its own; a cluster must name one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            base = held.get()
        elif spark.sparkContext.master.split("[")[0] == "local":
            base = tempfile.mkdtemp(prefix="quaystone-")
            spark.sparkContext.setCheckpointDir(base)
        else:
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    return f"{base.rstrip('/')}/quaystone/{name}-{uuid.uuid4().hex[:12]}"
