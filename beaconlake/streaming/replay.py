"""A whole table through a streaming step, as a batch query would run it."""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from beaconlake.sources.shared import fresh_folder

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def keyed_state(spark: SparkSession):
    """The state store that states with many keys and timers need, for the queries started inside."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(_PROVIDER) if before is None else spark.conf.set(_PROVIDER, before)


def replay(rows: DataFrame, step: Callable[[DataFrame], DataFrame], label: str) -> DataFrame:
    """What ``step``, a function of a stream, gives for all ``rows``, once its end has come.

    The rows should hold one that is late enough for the watermark to pass all others.
    """
    spark = rows.sparkSession
    where = fresh_folder(spark, label)
    rows.write.parquet(f"{where}/in")
    with keyed_state(spark):
        made = step(spark.readStream.schema(rows.schema).parquet(f"{where}/in"))
        run = made.writeStream.format("parquet").option("path", f"{where}/out").option("checkpointLocation", f"{where}/state").trigger(availableNow=True).start()
        run.awaitTermination()
    return spark.read.schema(made.schema).parquet(f"{where}/out")
