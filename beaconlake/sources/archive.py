"""The archive: messages in Parquet by local day and hour, as appended pieces and as compacted hours.

``pieces/`` grows by appends; ``hours/`` holds settled hours, each rewritten as a whole.  A reader
takes an hour from ``hours/`` where it is there and from ``pieces/`` otherwise, so it never sees a
message twice.  Both are partitioned by day and hour.  ``index/`` has the first and last time in every
file, so a window opens the files that can hold something of it; a file it doesn't know is opened.
"""

from __future__ import annotations

import re
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from beaconlake.functions.localtime import day_key, hour_key
from beaconlake.sources import published

SLACK = timedelta(hours=1)


def with_hours(df: DataFrame, at: str = "at") -> DataFrame:
    """``df`` with its local day and hour; rows without a time have no place and are left out."""
    return df.filter(F.col(at).isNotNull()).withColumn("day", day_key(F.col(at))).withColumn("hour", hour_key(F.col(at)))


def append(df: DataFrame, path: str, at: str = "at") -> None:
    """Add a batch; files follow the hours, and a large hour is split over several."""
    with_hours(df, at).hint("rebalance", "day", "hour").write.mode("append").partitionBy("day", "hour").parquet(f"{path}/pieces")
    index_files(df.sparkSession, path, at)


def _there(spark: SparkSession, where: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def normal(column: Column, kind: T.DataType) -> Column:
    """A value that is equal for equal values: maps, at any depth, become arrays of their entries by key."""
    if isinstance(kind, T.MapType):
        entry = lambda e: F.struct(normal(e["key"], kind.keyType).alias("key"), normal(e["value"], kind.valueType).alias("value"))
        return F.array_sort(F.transform(F.map_entries(column), entry))
    if isinstance(kind, T.ArrayType):
        return F.transform(column, lambda x: normal(x, kind.elementType)) if _has_map(kind) else column
    if isinstance(kind, T.StructType):
        return F.when(column.isNotNull(), F.struct(*[normal(column[f.name], f.dataType).alias(f.name) for f in kind.fields])) if _has_map(kind) else column
    return F.to_json(column) if isinstance(kind, T.VariantType) else column


def _has_map(kind: T.DataType) -> bool:
    inner = [kind.elementType] if isinstance(kind, T.ArrayType) else [f.dataType for f in kind.fields] if isinstance(kind, T.StructType) else []
    return isinstance(kind, (T.MapType, T.VariantType)) or any(map(_has_map, inner))


def canonical(df: DataFrame) -> DataFrame:
    """Distinct rows; maps and variants, which have no equality, are compared in their normal form, at any depth."""
    odd = [f for f in df.schema.fields if _has_map(f.dataType)]
    if not odd:
        return df.dropDuplicates()
    keyed = df.withColumns({f"_n_{f.name}": normal(F.col(f"`{f.name}`"), f.dataType) for f in odd})
    return keyed.dropDuplicates([c for c in keyed.columns if c not in {f.name for f in odd}]).select(*df.columns)


def _listed(spark: SparkSession, path: str, part: str, days: list[str] | None = None) -> dict[str, str]:
    """The files of a part, of some days or all, by what names them in the index: part, folders and file."""
    folders = [f"{path}/{part}"] if days is None else [f"{path}/{part}/day={d}" for d in days]
    there = [f for f in folders if _there(spark, f)]
    files = spark.read.option("basePath", f"{path}/{part}").parquet(*there).inputFiles() if there else []
    return {part + f[f.rindex("/day=") :]: f for f in files}


def index_files(spark: SparkSession, path: str, at: str = "at") -> int:
    """Index the files that are not: file, first, last, rows; how many.  Only their times are read."""
    where = f"{path}/index"
    known = {r.file for r in spark.read.parquet(where).select("file").distinct().collect()} if _there(spark, where) else set()
    listed = _listed(spark, path, "pieces") | _listed(spark, path, "hours")
    new = sorted(listed.keys() - known)
    if new:
        file = F.regexp_extract(F.col("_metadata.file_path"), r".*/((?:pieces|hours)/day=.*)$", 1)
        seen = spark.read.parquet(*(listed[n] for n in new)).groupBy(file.alias("file")).agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count("*").alias("rows"))
        seen.coalesce(1).write.mode("append").parquet(where)
    return len(new)


def _hour_of(name: str) -> tuple[str, int]:
    """Day and hour of a file, from its folders."""
    m = re.search(r"/day=([^/]+)/hour=(\d+)/", name)
    return m[1], int(m[2])


def _overlapping(spark: SparkSession, path: str, low: str, high: str) -> tuple[list[str], list[str]]:
    """The compacted files and the pieces that can hold a time of the window: those whose span meets it, and those without one.

    A piece of a compacted hour is none of them; which hours are is told by the names of their folders.
    """
    span = spark.range(1).select(F.explode(F.sequence(*[day_key(F.lit(t).cast("timestamp")).cast("date") for t in (low, high)]))).collect()
    days = [r[0].isoformat() for r in span]
    hours, pieces = _listed(spark, path, "hours", days), _listed(spark, path, "pieces", days)
    closed: set[str] = set()
    if _there(spark, f"{path}/index"):
        apart = (F.col("last") < F.lit(low).cast("timestamp")) | (F.col("first") >= F.lit(high).cast("timestamp"))
        closed = {r.file for r in spark.read.parquet(f"{path}/index").filter(apart).select("file").collect()}
    done = {_hour_of(name) for name in hours}
    return sorted(f for n, f in hours.items() if n not in closed), sorted(f for n, f in pieces.items() if n not in closed and _hour_of(n) not in done)


def compact(spark: SparkSession, path: str, settled_before: datetime, recheck: timedelta = timedelta(hours=24), at: str = "at") -> None:
    """Rewrite the hours that ended before ``settled_before`` and began within ``recheck`` of it, without repeats.

    An hour compacted earlier is made again from its pieces, so pieces that came late get in: those
    of the recheck always, older ones when they hold a file newer than the compacted hour.  Only
    those hours' partitions are replaced.
    """
    if not _there(spark, f"{path}/pieces"):
        return
    pieces = spark.read.parquet(f"{path}/pieces")
    low, high = (settled_before - recheck - SLACK).isoformat(sep=" "), settled_before.isoformat(sep=" ")
    ends = F.date_trunc("hour", F.col(at)) + F.expr("INTERVAL 1 HOUR")
    rows = pieces.filter(_days(low, high)).filter((F.col(at) >= F.lit(low).cast("timestamp")) & (ends <= F.lit(high).cast("timestamp")))
    hours = rows.select("day", "hour").distinct()
    if _there(spark, f"{path}/hours"):
        newest = lambda part: spark.read.parquet(f"{path}/{part}").groupBy("day", "hour").agg(F.max("_metadata.file_modification_time").alias(part))
        late = newest("pieces").join(newest("hours"), ["day", "hour"]).filter("pieces > hours").select("day", "hour")
        hours = hours.unionByName(late).distinct()
    whole = pieces.join(F.broadcast(hours), ["day", "hour"], "left_semi")  # a row per hour of the recheck and per hour with late pieces
    canonical(whole).hint("rebalance", "day", "hour").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "hour").parquet(f"{path}/hours")
    index_files(spark, path, at)


def _days(low: str, high: str) -> Column:
    """Partitions that can hold instants between two UTC times."""
    return F.col("day").between(day_key(F.lit(low).cast("timestamp")), day_key(F.lit(high).cast("timestamp")))


def read_window(spark: SparkSession, path: str, start: datetime, end: datetime, at: str = "at") -> DataFrame:
    """Distinct messages with start <= at < end, from compacted hours first and pieces for the rest.

    The frame has no order; an archive that is not there yet gives an error from Spark's reader.
    """
    low, high = start.isoformat(sep=" "), end.isoformat(sep=" ")
    inside = (F.col(at) >= F.lit(low).cast("timestamp")) & (F.col(at) < F.lit(high).cast("timestamp"))
    schema = spark.read.parquet(f"{path}/pieces").schema

    def opened(part: str, files: list[str]) -> DataFrame:
        rows = spark.read.schema(schema).option("basePath", f"{path}/{part}").parquet(*files) if files else spark.createDataFrame([], schema)
        return rows.filter(_days(low, high)).filter(inside)

    hours, pieces = _overlapping(spark, path, low, high)
    return canonical(opened("hours", hours).unionByName(opened("pieces", pieces)))


def coverage(rows: DataFrame, start: datetime, end: datetime, at: str = "at", bad: int | None = None) -> DataFrame:
    """One row on how whole a window is: rows, first and last time, unreadable rows, whether an absence may be claimed.

    It may if the unreadable rows were counted and are none; an empty window can be whole.  Who has
    not counted them (``bad`` None) gets no such claim.
    """
    return rows.agg(F.count("*").alias("rows"), F.min(at).alias("first"), F.max(at).alias("last")).select(
        "*", F.lit(bad).cast("bigint").alias("unreadable"), F.lit(bad == 0).alias("complete"), F.lit(start).alias("from"), F.lit(end).alias("to")
    )


def expire(spark: SparkSession, path: str, before_day: str) -> int:
    """Drop whole days before ``before_day``; the number of folders dropped."""
    gone = 0
    for part in ("pieces", "hours"):
        root = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{part}")
        files = root.getFileSystem(spark._jsc.hadoopConfiguration())
        for status in files.listStatus(root) if files.exists(root) else []:
            name = status.getPath().getName()
            if name.startswith("day=") and name.removeprefix("day=") < before_day:
                gone += bool(files.delete(status.getPath(), True))
    return gone


def publish(df: DataFrame, path: str) -> bool:
    """Replace a small published table only if its rows changed; whether it was written (:mod:`.published`)."""
    return published.publish({"rows": df}, path)["rows"]
