"""Readers of the Parquet tables and the message view over events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A Parquet table; zone-less timestamps become UTC instants."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    zoneless = [c for c, kind in df.dtypes if kind == "timestamp_ntz"]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in zoneless}) if zoneless else df


def grid_lat(key: Column) -> Column:
    return F.lit(42.2) + (key * 7919 % 1000) / F.lit(2500.0)


def grid_lon(key: Column) -> Column:
    return F.lit(-71.2) + (key * 104729 % 1000) / F.lit(2500.0)


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as messages: event_id, at, at_us, feed, unit, call_type, value, k, lat, lon."""
    e = table(spark, sf_dir, "events")
    return e.select(
        "event_id",
        F.col("ts").alias("at"),
        F.unix_micros("ts").alias("at_us"),
        F.concat(F.lit("feed-"), F.col("user_id") % 20).alias("feed"),
        F.concat(F.lit("u"), F.col("user_id")).alias("unit"),
        F.col("event_type").alias("call_type"),
        "value",
        F.get_json_object("props", "$.k").cast("int").alias("k"),
        grid_lat(F.col("event_id")).alias("lat"),
        grid_lon(F.col("event_id")).alias("lon"),
    )


#: The same view in DuckDB SQL, as the head of a WITH clause.
MESSAGES_SQL = """messages AS (
  SELECT event_id, ts AS at, epoch_us(ts) AS at_us, 'feed-' || (user_id % 20) AS feed, 'u' || user_id AS unit,
         event_type AS call_type, value, CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS INTEGER) AS k,
         CAST(42.2 AS DOUBLE) + CAST(event_id * 7919 % 1000 AS DOUBLE) / CAST(2500 AS DOUBLE) AS lat,
         CAST(-71.2 AS DOUBLE) + CAST(event_id * 104729 % 1000 AS DOUBLE) / CAST(2500 AS DOUBLE) AS lon
  FROM events)"""
