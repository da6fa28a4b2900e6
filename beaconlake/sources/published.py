"""Published sets of tables: folders named by their content, and one pointer that says which are current.

A writer first writes what is new, into folders of their own, and then swaps the pointer; killed at any
moment it leaves readers the old set or the new one.  A table that did not change is not written again.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from beaconlake.sources.pointer import exists, read_pointer, swap_pointer


def signature(df: DataFrame) -> str:
    """Of the rows, in whatever order, and the schema: count, exclusive or and sum of row hashes."""
    row = F.xxhash64(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])))
    seen = df.agg(F.count("*").alias("n"), F.coalesce(F.bit_xor(row), F.lit(0)).alias("x"), F.coalesce(F.sum(row.cast("decimal(38,0)")), F.lit(0)).alias("s")).first()
    text = f"{df.schema.json()}|{seen.n}|{seen.x}|{seen.s}"
    return df.sparkSession.range(1).select(F.sha2(F.lit(text), 256)).first()[0][:32]


def publish(tables: Mapping[str, DataFrame], path: str) -> dict[str, bool]:
    """Make ``tables`` the current set at ``path``; which of them were written.

    A folder counts once its writer has finished (_SUCCESS); a half-written one has a name of its
    own that no pointer ever says.
    """
    spark = next(iter(tables.values())).sparkSession
    current = (read_pointer(spark, f"{path}/current.json") or {}).get("tables", {})
    wrote, names = {}, {}
    for name, df in tables.items():
        sign = signature(df)
        held = current.get(name, "")
        if held.startswith(f"{sign}-") and exists(spark, f"{path}/{name}/{held}/_SUCCESS"):
            names[name], wrote[name] = held, False
            continue
        names[name], wrote[name] = f"{sign}-{uuid.uuid4().hex[:8]}", True
        df.write.parquet(f"{path}/{name}/{names[name]}")
    if any(wrote.values()) or names.keys() != current.keys():
        swap_pointer(spark, f"{path}/current.json", {"tables": names})
    return wrote


def current(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of one published set; none before the first."""
    held = read_pointer(spark, f"{path}/current.json") or {"tables": {}}
    return {name: spark.read.parquet(f"{path}/{name}/{folder}") for name, folder in held["tables"].items()}


def clean(spark: SparkSession, path: str, keep: int = 1) -> int:
    """Drop folders no pointer names, but the ``keep`` newest of each table, which readers may still have open; how many."""
    held = (read_pointer(spark, f"{path}/current.json") or {"tables": {}})["tables"]
    hadoop, gone = spark._jvm.org.apache.hadoop.fs, 0
    for name, folder in held.items():
        root = hadoop.Path(f"{path}/{name}")
        files = root.getFileSystem(spark._jsc.hadoopConfiguration())
        old = sorted((s for s in files.listStatus(root) if s.getPath().getName() != folder), key=lambda s: -s.getModificationTime())
        gone += sum(bool(files.delete(s.getPath(), True)) for s in old[keep:])
    return gone
