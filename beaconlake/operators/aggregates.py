"""Aggregates with exact tie and index rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def floor_quantiles(df: DataFrame, by: str, value: str, quantiles: dict[str, float]) -> DataFrame:
    """For each group the element of its sorted values at index ``floor(n * q)``, by name: a row (by, *names).

    ``percentile_disc`` and ``percentile`` index otherwise.  Values are counted first, so a group is
    as long as its distinct values, and only counts are ranked.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(by, value).agg(F.count("*").alias("_c"))
    upto = F.sum("_c").over(Window.partitionBy(by).orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    sizes = counts.groupBy(F.col(by).alias("_by")).agg(F.sum("_c").alias("_n"))
    ranked = counts.withColumn("_upto", upto).join(sizes, F.col(by).eqNullSafe(F.col("_by")))
    return ranked.groupBy(by).agg(*[F.min(F.when(F.col("_upto") > F.floor(F.col("_n") * F.lit(q)), F.col(value))).alias(name) for name, q in quantiles.items()])


def mode_first(df: DataFrame, by: str, value: str, order: list[str]) -> DataFrame:
    """Most frequent value of each group; of equally frequent ones the first to appear."""
    counts = df.groupBy(by, value).agg(F.count("*").alias("n"), F.min(F.struct(*order)).alias("_first"))
    w = Window.partitionBy(by).orderBy(F.desc("n"), "_first")
    return counts.withColumn("_r", F.row_number().over(w)).filter("_r = 1").select(by, value, "n")


def fleet_level(levels: DataFrame, by: str, level: str) -> DataFrame:
    """high from three feeds at high on, watch from four at high or watch on."""
    c = levels.groupBy(by).agg(F.count_if(F.col(level) == "high").alias("high"), F.count_if(F.col(level) == "watch").alias("watch"))
    return c.withColumn("level", F.when(F.col("high") >= 3, "high").when(F.col("high") + F.col("watch") >= 4, "watch").otherwise("normal"))


def largest_gap(df: DataFrame, by: str, at: str, tie: str) -> DataFrame:
    w = Window.partitionBy(by).orderBy(at, tie)
    gaps = df.withColumn("_gap", F.col(at) - F.lag(at).over(w))
    return gaps.groupBy(by).agg(F.max("_gap").alias("longest_gap"), F.count("_gap").alias("gaps"))


def flow_totals(df: DataFrame, by: str, delta: str, ignore: int, suspect: int) -> DataFrame:
    """Sums of rises and falls; changes up to ``ignore`` count for nothing, from ``suspect`` on they are only counted."""
    d = F.col(delta)
    real = (F.abs(d) > ignore) & (F.abs(d) < suspect)
    return df.groupBy(by).agg(
        F.sum(F.when(real & (d > 0), d).otherwise(0)).alias("arrivals"),
        F.sum(F.when(real & (d < 0), -d).otherwise(0)).alias("departures"),
        F.count_if(F.abs(d) >= suspect).alias("suspect"),
        F.sum(F.when(real, d).otherwise(0)).alias("net"),
    )


def curve_correlation(counts: DataFrame, days: DataFrame, day: str, hour: str, n: str) -> DataFrame:
    """Pearson r of the hourly counts of the two days in ``days``; an hour missing on one day counts 0."""
    first = days.agg(F.min(day).alias("_first"))
    both = counts.join(days.select(F.col(day).alias("_d")), F.col(day) == F.col("_d")).crossJoin(F.broadcast(first))  # two rows, one row
    of = lambda same: F.sum(F.when((F.col(day) == F.col("_first")) == same, F.col(n)).otherwise(0))
    hours = both.groupBy(hour).agg(of(True).alias("x"), of(False).alias("y"))
    return hours.agg(F.round(F.corr("x", "y"), 6).alias("r"), F.count("*").alias("hours"))


def first_to_later(df: DataFrame, by: str, at: str, opens: Column, answers: Column, limit: int, family: Column) -> DataFrame:
    """Median, by family, of the time from a group's first opening row to its first later answer, up to ``limit``."""
    rows = df.withColumn("_first", F.min(F.when(opens, F.col(at))).over(Window.partitionBy(by)))
    gaps = rows.filter(answers & (F.col(at) > F.col("_first"))).groupBy(by).agg(F.first(family).alias("family"), (F.min(at) - F.min("_first")).alias("gap"))
    gaps = gaps.filter(F.col("gap") <= limit)
    sizes = gaps.groupBy(F.col("family").alias("_f")).agg(F.count("*").alias("n"))
    return floor_quantiles(gaps, "family", "gap", {"median_gap": 0.5}).join(sizes, F.col("family").eqNullSafe(F.col("_f"))).drop("_f")


def zone_topk(df: DataFrame, inside: Column, weight: Column, key: str, k: int, share: float) -> DataFrame:
    """The ``k`` heaviest rows, ``share`` of them from the zone and the rest from outside."""
    rows = df.select(key, inside.alias("inside"), weight.alias("weight"))
    w = Window.partitionBy("inside").orderBy(F.desc("weight"), key)
    quota = F.when(F.col("inside"), int(k * share)).otherwise(k - int(k * share))
    return rows.withColumn("_p", F.row_number().over(w)).filter(F.col("_p") <= quota).drop("_p")
