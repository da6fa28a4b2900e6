"""Small JSON files that name what is current, replaced as a whole: a reader sees the old one or the new one."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


def _context(spark: SparkSession, where: str):
    hadoop = spark._jvm.org.apache.hadoop.fs
    path = hadoop.Path(where)
    conf = spark._jsc.hadoopConfiguration()
    return hadoop, path, path.getFileSystem(conf), conf


def read_pointer(spark: SparkSession, where: str) -> dict | None:
    """What the pointer says; None if there is none."""
    _, path, files, _ = _context(spark, where)
    if not files.exists(path):
        return None
    stream = files.open(path)
    try:
        return json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()


def swap_pointer(spark: SparkSession, where: str, says: dict) -> None:
    """Replace the pointer in one step: a new file takes the old one's name."""
    hadoop, path, files, conf = _context(spark, where)
    new = hadoop.Path(f"{where}.{uuid.uuid4().hex}")
    files.mkdirs(path.getParent())
    stream = files.create(new, True)
    try:
        stream.write(json.dumps(says).encode())
    finally:
        stream.close()
    overwrite = spark._jvm.java.lang.reflect.Array.newInstance(spark._jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 1)
    overwrite[0] = getattr(spark._jvm, "org.apache.hadoop.fs.Options$Rename").OVERWRITE
    hadoop.FileContext.getFileContext(files.getUri(), conf).rename(new, path, overwrite)


def exists(spark: SparkSession, where: str) -> bool:
    _, path, files, _ = _context(spark, where)
    return files.exists(path)
