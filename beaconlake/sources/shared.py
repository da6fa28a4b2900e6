"""The folder that driver and executors share, for what a query writes between its steps."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

_KEY = "spark.checkpoint.dir"


def fresh_folder(spark: SparkSession, label: str) -> str:
    """A new folder under ``spark.checkpoint.dir``; a session in one process that names none gets a temporary one."""
    root = spark.conf.get(_KEY, None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError(f"{_KEY} must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="beaconlake-")
        spark.conf.set(_KEY, root)
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"
