"""Intermediate tables in the folder that all executors share.

Jobs cut their lineage here: a table written to the shared folder survives the loss of any
executor, and later steps read it instead of recomputing.  The folder is the one named by
``spark.checkpoint.dir``; a session that names none gets a temporary one if it runs in one process
(a test), and an error on a cluster, whose executors would not see that folder.
"""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_KEY = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The shared folder of the session, without a trailing slash."""
    named = spark.conf.get(_KEY, None)
    if not named:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError(f"{_KEY} must name a folder that driver and executors share")
        named = "file://" + tempfile.mkdtemp(prefix="beaconlake-")
        spark.conf.set(_KEY, named)
    return named.rstrip("/")


def unused(df: DataFrame, *names: str) -> list[str]:
    """``names``, each with as many underscores in front as it takes to be no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


class Scratch:
    """A fresh subfolder of the shared folder for the tables of one run of one operator."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"

    def folder(self, name: str) -> str:
        return f"{self.path}/{name}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` as Parquet and return a DataFrame that reads it."""
        where = self.folder(name)
        df.write.mode("overwrite").option("compression", "zstd").parquet(where)
        return self.spark.read.schema(df.schema).parquet(where)

    def drop(self, name: str) -> None:
        """Delete a table that no later step reads."""
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.folder(name))
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        self.free()

    def free(self) -> None:
        """Let go of the shuffle files of steps that are done: Spark deletes them when the driver collects its garbage, which a large heap may never need.

        Python goes first: a DataFrame in a cycle of its objects keeps its plan in the JVM, and so its files.
        """
        gc.collect()
        self.spark._jvm.System.gc()
