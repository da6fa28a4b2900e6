"""Calendar keys in the newsroom's zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ZONE = "America/New_York"


def local(at: Column) -> Column:
    return F.from_utc_timestamp(at, ZONE)


def day_key(at: Column) -> Column:
    return F.date_format(local(at), "yyyy-MM-dd")


def hour_key(at: Column) -> Column:
    """Hour of the local day; the doubled hour in autumn is one bucket of two hours."""
    return F.date_format(local(at), "HH")


def is_calendar_day(text: Column) -> Column:
    """Whether the text is a day that exists, written yyyy-MM-dd."""
    return F.coalesce(F.date_format(F.try_to_date(text, "yyyy-MM-dd"), "yyyy-MM-dd") == text, F.lit(False))
