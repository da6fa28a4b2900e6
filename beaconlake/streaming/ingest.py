"""The live half's entry: landing files, normal form, one claim per message, sealed hours."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ITEM = "machine string, seq bigint, src string, city string, towns string, text string, at timestamp, clip string, unit string, lat double, lon double, call_type string, precision string"
TEXT_LIMIT = 4000
LATE = "10 minutes"


def read_landing(spark: SparkSession, path: str, files_per_batch: int = 64) -> DataFrame:
    """JSON files that relays drop into a folder, as a stream; lines that are no JSON have only nulls."""
    return spark.readStream.schema(ITEM).option("maxFilesPerTrigger", files_per_batch).option("mode", "PERMISSIVE").json(path)


def normalize(items: DataFrame) -> DataFrame:
    """Messages of at least 4 characters, cut to TEXT_LIMIT, with a source and a list of towns."""
    text = F.trim(F.coalesce("text", F.lit("")))
    towns = F.filter(F.transform(F.split(F.coalesce(F.nullif("towns", F.lit("")), "city", F.lit("")), ","), lambda t: F.trim(t)), lambda t: t != "")
    rows = items.filter((F.length(text) >= 4) & F.col("at").isNotNull())
    return rows.withColumns({"text": F.substring(text, 1, TEXT_LIMIT), "src": F.coalesce(F.nullif("src", F.lit("")), F.lit("unknown")), "towns": towns})


def claim_once(items: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each (machine, seq) once within ``late``; messages without a number all pass."""
    marked = items.withWatermark("at", late)
    claimed = marked.filter("seq IS NOT NULL").withColumn("_claim", F.coalesce("machine", F.lit(""))).dropDuplicatesWithinWatermark(["_claim", "seq"]).drop("_claim")
    return claimed.unionByName(marked.filter("seq IS NULL"))


def hourly_counts(items: DataFrame, late: str = LATE) -> DataFrame:
    """Messages by source and hour, emitted once when the watermark has passed the hour."""
    return items.withWatermark("at", late).groupBy(F.window("at", "1 hour").alias("w"), "src").agg(F.count("*").alias("n")).select(F.col("w.start").alias("hour"), "src", "n")


def bad_lines(spark: SparkSession, path: str, files_per_batch: int = 64) -> DataFrame:
    """The lines of landing files that are no JSON, as a stream (line, file): a side table whose count says how whole the archive is."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(path)
    broken = (F.trim("value") != "") & F.try_parse_json("value").isNull()
    return lines.filter(broken).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("file"))


def to_archive(items: DataFrame, path: str, checkpoint: str, enrich: Callable[[DataFrame], DataFrame] | None = None):
    """Append a stream to an archive (:mod:`beaconlake.sources.archive`); a batch that fails is retried whole.

    A batch goes through ``enrich``, which names itself in the column by; if that fails the rows are
    archived as they came, by raw-fallback.  A retried batch may append a second time, which readers
    undo: they return distinct rows.
    """
    from beaconlake.sources import archive

    def write(batch: DataFrame, _: int) -> None:
        if enrich is None:
            archive.append(batch, path)
            return
        try:
            archive.append(enrich(batch), path)
        except Exception as error:  # whatever the enrichment does, the messages must be kept
            logging.getLogger(__name__).warning("enrichment failed, archiving raw: %s", str(error)[:200])
            archive.append(batch.withColumn("by", F.lit("raw-fallback")), path)

    return items.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
