"""Session settings the engine relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "beaconlake", **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; ``conf`` adds settings (dots written as ``__``)."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()
