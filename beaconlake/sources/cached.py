"""Sources that are polled on a cadence and keep their last good rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from beaconlake.sources.pointer import read_pointer, swap_pointer

#: Last good rows older than this are served no more.
KEEP = timedelta(hours=1)


def cached(spark: SparkSession, path: str, refresh: Callable[[], DataFrame], cadence: timedelta, now: datetime, keep: timedelta = KEEP) -> DataFrame:
    """The rows of a source with as_of (when they were fetched), stale and error.

    Rows tried within ``cadence`` are served as they are.  Otherwise ``refresh`` is called and its rows
    are written; if that fails, whatever the error, the last good rows are served as stale, with
    the error, and the next try is a cadence away.  A source that never worked, or whose last good rows are
    older than ``keep``, raises.
    """
    stamp = lambda t: t.astimezone(timezone.utc).isoformat()
    held = read_pointer(spark, f"{path}/current.json")
    if held is None or now - datetime.fromisoformat(held["tried"]) >= cadence:
        folder, error = f"rows-{uuid.uuid4().hex}", None
        try:
            refresh().write.parquet(f"{path}/{folder}")
        except Exception as failed:  # a source may fail in any way; what it last gave stays
            if held is None:
                raise
            error = f"{type(failed).__name__}: {str(failed)[:300]}"
        held = {"tried": stamp(now), "good": stamp(now), "folder": folder, "error": None} if error is None else held | {"tried": stamp(now), "error": error}
        swap_pointer(spark, f"{path}/current.json", held)
    good = datetime.fromisoformat(held["good"])
    if now - good > keep:
        raise LookupError(f"{path}: no good rows since {held['good']} ({held['error']})")
    rows = spark.read.parquet(f"{path}/{held['folder']}")
    return rows.select("*", F.lit(held["good"]).cast("timestamp").alias("as_of"), F.lit(held["error"] is not None).alias("stale"), F.lit(held["error"]).cast("string").alias("error"))
