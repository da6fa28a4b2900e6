"""Which lookups a cache answers, from the lookups alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from beaconlake.operators.spaced import spaced

DAY_MS = 86_400_000
#: How long an answer is good, and how long it is known that there is none.
HIT_MS, MISS_MS = 30 * DAY_MS, 6 * 3_600_000


def served(lookups: DataFrame, key: str = "name", at: str = "at_ms", found: str = "found") -> DataFrame:
    """``lookups`` with fetched: whether this one went out, or was answered from what an earlier one brought.

    What a name has (``found``) does not change.  A name goes out when first asked for, and again once its
    answer is HIT_MS old, or, if there was none, MISS_MS.  Lookups of a name at one time go out together.
    """
    out = None
    for has, good_for in ((True, HIT_MS), (False, MISS_MS)):
        some = lookups.filter(F.coalesce(found, F.lit(False)) == has)
        went = spaced(some, [key], at, good_for, HIT_MS).select(F.col(key).alias("_key"), F.col(at).alias("_at"), F.lit(True).alias("_out"))
        part = some.join(went, F.col(key).eqNullSafe(F.col("_key")) & (F.col(at) == F.col("_at")), "left").withColumn("fetched", F.coalesce("_out", F.lit(False))).drop("_key", "_at", "_out")
        out = part if out is None else out.unionByName(part)
    return out
